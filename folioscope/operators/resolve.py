"""Resolution of conflicts, deduplication, comparison with truth, calibration, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from . import classify as C


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate of one struct, combined before its shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def resolve(ocr: DataFrame, vlm: DataFrame, keys: list[str], field: str = "campo") -> DataFrame:
    """Full join of two extractors' cells (valor, confianza): winner, reason, and whether a person should look."""
    o = ocr.select(*keys, F.col("valor").alias("ocr"), F.col("confianza").alias("c_ocr"), F.lit(True).alias("has_ocr"))
    v = vlm.select(*keys, F.col("valor").alias("vlm"), F.col("confianza").alias("c_vlm"), F.lit(True).alias("has_vlm"))
    name = F.lower(F.trim(F.col(field)))
    both = o.join(v, keys, "full_outer").withColumns({"a": F.coalesce("has_ocr", F.lit(False)) & F.col("ocr").isNotNull(), "b": F.coalesce("has_vlm", F.lit(False)) & F.col("vlm").isNotNull()})
    reason = S.first_of(
        (~F.col("a") & ~F.col("b"), "sin_valor"),
        (~F.col("b"), "solo_ocr"),
        (~F.col("a"), "solo_vlm"),
        (S.equivalent(F.col("ocr"), F.col("vlm")), "coinciden"),
        (name.isin(*P.PREFER_OCR), "campo_numerico_prefer_ocr"),
        (name.isin(*P.PREFER_VLM), "campo_texto_prefer_vlm"),
        (F.col("c_ocr") > F.col("c_vlm"), "confianza_mayor_ocr"),
        (F.col("c_vlm") > F.col("c_ocr"), "confianza_mayor_vlm"),
        default="empate_tiebreak_ocr",
    )
    out = both.withColumn("razon", reason)
    vlm_wins = F.col("razon").isin("solo_vlm", "campo_texto_prefer_vlm", "confianza_mayor_vlm") | ((F.col("razon") == "coinciden") & (F.col("c_vlm") > F.col("c_ocr")))
    conflict = ~F.col("razon").isin("sin_valor", "solo_ocr", "solo_vlm", "coinciden")
    out = out.withColumns({"ganador": S.first_of((F.col("razon") == "sin_valor", F.lit(None).cast("string")), (vlm_wins, "vlm"), default="ocr"), "conflicto": conflict})
    gap = F.when(F.col("ganador") == "vlm", F.col("c_ocr") - F.col("c_vlm")).otherwise(F.col("c_vlm") - F.col("c_ocr"))
    return out.select(*keys, F.when(F.col("ganador") == "vlm", F.col("vlm")).otherwise(F.col("ocr")).alias("valor"), "ganador", "razon", "conflicto", (F.col("conflicto") & (gap > F.lit(0.3).cast("decimal(4,2)"))).alias("revisar"))


def conflict_summary(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("razon").agg(F.count("*").alias("n"), F.count_if("conflicto").alias("conflictos"), F.count_if("revisar").alias("revisar"))


def keep_best(rows: DataFrame, key: Column, rank: Column, position: list[str], unknown: str = "SIN_IDENTIFICAR") -> DataFrame:
    """The best row of each key, the first of equals; rows without a key all stay."""
    r = rows.withColumns({"__key": key, "__rank": rank})
    known = r.where(F.col("__key") != unknown)
    best = known.groupBy("__key").agg(F.max_by(F.struct(*rows.columns), F.struct("__rank", *[-F.col(p) for p in position])).alias("r")).select("r.*")
    return best.unionByName(r.where(F.col("__key") == unknown).select(*rows.columns))


def keep_first(rows: DataFrame, keys: list[Column], position: list[str]) -> DataFrame:
    named = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    return named.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by(F.struct(*rows.columns), F.struct(*position)).alias("r")).select("r.*")


def compared(kind: Column, extracted: Column, expected: Column, tolerance: float = P.TOLERANCE) -> Column:
    """MATCH, MATCH_PARCIAL, ERROR, NO_EXTRAIDO or SKIP_GT_NULL."""
    e, t = S.nonempty(extracted), S.nonempty(expected)
    same_money = F.abs(S.money(e) - S.money(t)) < F.lit(tolerance).cast("decimal(18,2)")
    digits = lambda c: F.regexp_replace(c, r"[^0-9A-Za-z]", "")
    half = (kind == "serie_numero") & (F.contains(digits(e), digits(t)) | F.contains(digits(t), digits(e)))
    return S.first_of((t.isNull(), "SKIP_GT_NULL"), (e.isNull(), "NO_EXTRAIDO"), (kind.isin("total", "igv") & same_money, "MATCH"), (F.upper(digits(e)) == F.upper(digits(t)), "MATCH"), (half, "MATCH_PARCIAL"), default="ERROR")


def accuracy(outcomes: DataFrame, by: str = "campo") -> DataFrame:
    """Counts and rates per field; skipped and partial outcomes aren't evaluated, and partial ones are shown apart."""
    n = lambda *names: F.count_if(F.col("resultado").isin(*names))
    out = outcomes.groupBy(by).agg(n("MATCH", "ERROR", "NO_EXTRAIDO").alias("evaluados"), n("MATCH").alias("match"), n("ERROR").alias("error"), n("NO_EXTRAIDO").alias("no_extraido"), n("SKIP_GT_NULL").alias("skip"), n("MATCH_PARCIAL").alias("parcial"))
    rate = lambda c: F.when(F.col("evaluados") > 0, F.round(F.col(c).cast("decimal(18,0)") / F.col("evaluados").cast("decimal(18,0)"), 4).cast("decimal(9,4)"))
    return out.withColumns({"precision": rate("match"), "tasa_error": rate("error"), "tasa_no_extraido": rate("no_extraido")})


def global_accuracy(outcomes: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("resultado").isin(*names))
    share = lambda a: F.round(100 * a.cast("decimal(18,0)") / n("MATCH", "ERROR", "NO_EXTRAIDO").cast("decimal(18,0)"), 2).cast("decimal(9,2)")
    return outcomes.agg(share(n("MATCH")).alias("precision"), share(n("ERROR", "NO_EXTRAIDO")).alias("falla"), F.min("confianza").alias("minima"), F.max("confianza").alias("maxima"), F.round(F.avg("confianza"), 4).cast("decimal(9,4)").alias("media"))


def profiles(spark) -> DataFrame:
    """Threshold profiles, which are constants: of the router (grupo router) and of fields (grupo abstencion)."""
    fields = P.FIELD_THRESHOLDS | {"default": P.DEFAULT_THRESHOLD}
    rows = [(name, group, kind, float(v)) for name, router in P.ROUTER_PROFILES.items() for group, values in (("router", router), ("abstencion", fields)) for kind, v in values.items()]
    return spark.createDataFrame(rows, "perfil string, grupo string, clave string, umbral double").withColumn("umbral", F.col("umbral").cast("decimal(6,2)"))


def ordered_findings(findings: DataFrame, case: str = "sinad", longest: tuple[int, int] = (200, 150)) -> DataFrame:
    """Findings of each case by severity, then position, numbered from 1; descriptions and actions are cut to what a sheet shows."""
    order = S.first_of(*[(F.col("nivel") == k, i) for i, k in enumerate(P.SEVERITY)], default=len(P.SEVERITY))
    number = F.row_number().over(Window.partitionBy(case).orderBy("orden", "voucher", "regla"))
    out = findings.withColumn("orden", order).withColumn("nro", number)
    return out.select(case, "nro", "voucher", "regla", C.severity_label(F.col("nivel")).alias("severidad"), C.finding_type(F.col("regla")).alias("tipo"), F.substring("descripcion", 1, longest[0]).alias("descripcion"), F.coalesce(F.substring("accion", 1, longest[1]), F.lit("")).alias("accion"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy(C.severity_label(F.col("nivel")).alias("severidad")).agg(F.count("*").alias("n"))


def first_details(rows: DataFrame, key: str, detail: str, shown: int = 3) -> DataFrame:
    """The first few details of each key, and how many more there are. Only the shown ones and a count are kept per key."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(detail)))
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__n") <= shown, F.col(detail)))), ", ")
    return ranked.groupBy(key).agg(few.alias("__few"), F.count("*").alias("__all")).select(key, F.concat(F.col("__few"), F.when(F.col("__all") > shown, F.concat(F.lit(" ... +"), F.col("__all") - shown, F.lit(" más"))).otherwise("")).alias("detalle"))
