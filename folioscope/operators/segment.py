"""Segmentation of pages into lines, columns and regions, and places in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S


def words_to_lines(words: DataFrame, page: str, block: str, line: str, order: str) -> DataFrame:
    """Lines of words: text in order, the box around them, mean confidence without unknown (-1) ones."""
    conf = F.avg(F.when(F.col("conf") != -1, F.col("conf") / 100))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("texto")))), lambda s: s["texto"]), " ")
    return words.groupBy(page, block, line).agg(text.alias("texto"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(conf, 4).cast("decimal(9,4)").alias("confianza"))


def islands(rows: DataFrame, by: list[str], centre: str, low: str, high: str, gap, out: str, tie: str) -> DataFrame:
    """Numbers groups along one axis: a row starts a new one if it is `gap` beyond the row before it, by edge or by centre."""
    w = Window.partitionBy(*by).orderBy(centre, tie)
    fresh = ((F.col(low) - F.lag(high).over(w)) >= gap) | ((F.col(centre) - F.lag(centre).over(w)) >= gap)
    return rows.withColumn("__new", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def regions(lines: DataFrame, page: str = "page", tie: str = "line") -> DataFrame:
    """Lines with their column (gaps in x) and, inside it, their region (gaps in y)."""
    whole = Window.partitionBy(page)
    lines = lines.withColumns({"w": F.max("x1").over(whole) - F.min("x0").over(whole), "h": F.max("y1").over(whole) - F.min("y0").over(whole), "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    columns = islands(lines, [page], "cx", "x0", "x1", F.greatest(F.col("w") * 0.045, F.lit(14.0)), "col", tie)
    return islands(columns, [page, "col"], "cy", "y0", "y1", F.greatest(F.col("h") * 0.085, F.lit(22.0)), "reg", tie)


def scored_regions(lines: DataFrame, page: str = "page", tie: str = "line", least: int = 2) -> DataFrame:
    """Regions that look like vouchers, numbered in order per page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", F.col(tie), "texto"))), lambda s: s["texto"]), "\n")
    found = regions(lines, page, tie).groupBy(page, "col", "reg").agg(text.alias("texto"), F.count("*").alias("lineas"))
    kept = found.withColumn("score", S.let(S.normal_key(F.col("texto")), lambda norm: region_score(F.col("texto"), norm))).where(F.col("score") >= least)
    return kept.withColumn("region", F.row_number().over(Window.partitionBy(page).orderBy("col", "reg")) - 1).select(page, "region", "lineas", "score")


def region_score(text: Column, norm: Column) -> Column:
    """Signs of a voucher: a series 2, a total or an amount 1, a tax id 1, three amounts or more 1. norm: the text's normal key."""
    signs = ((S.matches(norm, P.VALID_SERIES), 2), (S.matches(norm, P.TOTAL_CONTEXT) | F.rlike(norm, F.lit(P.REGION_AMOUNT)), 1), (S.matches(text, P.RUC_MARK), 1), (F.regexp_count(norm, F.lit(P.REGION_AMOUNT)) >= 3, 1))
    return sum((F.when(cond, n).otherwise(0) for cond, n in signs), F.lit(0))


def read_order(lines: DataFrame, page: str = "page", tie: str = "line") -> DataFrame:
    """A page's lines from top to bottom and left to right, as one text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", F.col(tie), "texto"))), lambda s: s["texto"]), "\n")
    return lines.groupBy(page).agg(text.alias("texto"))


def roi(lines: DataFrame, width: int, height: int, page: str = "page", least: int = 3, confidence: float = 0.3, margin: float = 0.05) -> DataFrame:
    """The box around confident lines with a margin, inside the page; none for few lines or under 5 % of the page."""
    box = lines.where(F.col("conf") >= confidence).groupBy(page).agg(F.count("*").alias("n"), F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d")).where(F.col("n") >= least)
    mx, my = int(width * margin), int(height * margin)
    box = box.select(page, F.greatest(F.col("a") - mx, F.lit(0)).alias("x0"), F.greatest(F.col("b") - my, F.lit(0)).alias("y0"), F.least(F.col("c") + mx, F.lit(width)).alias("x1"), F.least(F.col("d") + my, F.lit(height)).alias("y1"))
    return box.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= int(0.05 * width * height))


def page_of_offset(pages: DataFrame, asked: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """The page on which an offset of a document lies: the first whose running length reaches it, else the last."""
    run = pages.select(doc, page, F.sum("length").over(Window.partitionBy(doc).orderBy(page)).alias("place"))
    # Offsets and the ends of pages in one order: the next page's end is that of the offset's page.
    both = asked.select(doc, F.col("offset").alias("place"), F.lit(None).cast(dict(pages.dtypes)[page]).alias(page)).unionByName(run)
    w = Window.partitionBy(doc).orderBy("place", F.col(page).isNotNull(), page)
    found = F.coalesce(F.first(page, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.max(page).over(Window.partitionBy(doc)))
    return both.withColumn("found", found).where(F.col(page).isNull() & F.col("found").isNotNull()).select(doc, F.col("place").alias("offset"), F.col("found").alias(page))
