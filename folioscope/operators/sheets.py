"""Rows of the sheets that people read. Missing values are blanks, or NULL in the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Columns of the voucher sheet, with where they come from, and of the summary.
VOUCHER_SHEET = (("Tipo", "tipo"), ("Serie", "serie"), ("Número", "numero"), ("RUC emisor", "ruc"), ("Razón social", "razon_social"), ("Fecha emisión", "fecha_emision"), ("Importe total", "total"), ("IGV", "igv"), ("Motor", "motor"), ("Página", "pagina"))
SUMMARY_SHEET = ("expediente", "archivo_pdf", "pagina", "region_id", "ruc", "proveedor", "tipo_comprobante", "serie", "numero", "fecha", "total", "confianza", "observaciones")


def blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def header_rows(head: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """A row for each labelled value of a case: key, parte, fila, etiqueta, valor."""
    pairs = F.array(*[F.struct(F.lit(i).alias("fila"), F.lit(label).alias("etiqueta"), blank(v).alias("valor")) for i, (label, v) in enumerate(values.items(), 1)])
    return head.select(key, F.lit("cabecera").alias("parte"), F.explode(pairs).alias("p")).select(key, "parte", "p.*")


def voucher_sheet(vouchers: DataFrame) -> DataFrame:
    page = F.when(F.col("pagina") > 0, F.col("pagina"))
    return vouchers.select(*[blank(page if c == "pagina" else F.col(c)).alias(name) for name, c in VOUCHER_SHEET])


def summary_sheet(vouchers: DataFrame) -> DataFrame:
    return vouchers.select(*[S.cell_text(F.col(c)).alias(c) for c in SUMMARY_SHEET])


def first_of_many(details: Column, shown: int = 3) -> Column:
    """The first few of an array, and how many more there are."""
    more = F.when(F.size(details) > shown, F.concat(F.lit(" ... +"), (F.size(details) - shown).cast("string"), F.lit(" más"))).otherwise("")
    return F.concat(F.array_join(F.slice(details, 1, shown), ", "), more)


def diagnostic(routes: DataFrame, cells: DataFrame, stats: DataFrame, key: str = "sinad", longest: int = 60) -> DataFrame:
    """The diagnostic sheet of all cases: banner, sections, fields that were abstained from, and footer."""
    row = lambda part, number, field, value: [F.lit(part).alias("seccion"), number.cast("int").alias("fila"), field.alias("campo"), value.alias("valor")]
    alerts = F.when(F.col("alertas") == "", F.array().cast("array<string>")).otherwise(F.split("alertas", ","))
    banner = routes.select(key, *row("banner", F.lit(0), F.col("status"), F.concat_ws(" | ", "confianza", "accion")))
    sections = routes.select(key, *row("secciones", F.lit(0), F.lit("alertas"), S.let(alerts, lambda a: first_of_many(a))))
    value = F.when(F.col("valor").isNull(), "(abstención)").otherwise(F.concat(F.substring("valor", 1, longest), F.when(F.length("valor") > longest, "...").otherwise("")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("voucher", "campo"))
    shown = F.concat_ws(" | ", value, F.concat((F.col("confianza") * 100).cast("int").cast("string"), F.lit("%")), F.col("status"))
    fields = cells.where("razon is not null").select(key, *row("campos", number, F.col("campo"), shown))
    footer = stats.select(key, *row("pie", F.lit(0), F.lit("metricas"), F.concat(F.lit("celdas: "), F.col("total"), F.lit(", abstenidas: "), F.col("abstenidos"))))
    return banner.unionByName(sections).unionByName(fields).unionByName(footer)
