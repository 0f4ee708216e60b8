"""Validation rules. Verdicts are true, false, or null where they can't be evaluated; rules give findings.

Vouchers: sinad, voucher, ruc, serie, numero, tipo, fecha, n_items, items, subtotal,
igv, total, noches. Money is decimal(18,2), so sums and verdicts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S

MONEY = "decimal(18,2)"


def amount(x: object) -> Column:
    return F.lit(x).cast(MONEY)


def igv_ok(subtotal: Column, igv: Column, total: Column, rates: tuple[float, ...] = P.IGV_RATES, tolerance: float = P.TOLERANCE) -> Column:
    """The tax is none, or one of the rates of the subtotal (or of what total less tax leaves)."""
    base = F.coalesce(subtotal, total - igv)
    at_rate = S.any_of([F.abs(igv - F.round(base * F.lit(r).cast("decimal(4,2)"), 2)) <= amount(tolerance) for r in rates])
    return F.when(igv == 0, True).when(base.isNotNull() & igv.isNotNull(), at_rate)


def total_ok(subtotal: Column, igv: Column, total: Column, tolerance: float = P.TOLERANCE) -> Column:
    return F.abs(total - (subtotal + F.coalesce(igv, amount(0)))) <= amount(tolerance)


def items_ok(items: Column, subtotal: Column, tolerance: float = P.TOLERANCE) -> Column:
    return F.abs(items - subtotal) <= amount(tolerance)


def nights_ok(total: Column, nights: Column) -> Column:
    return F.when(nights > 0, total / nights > 0).when(nights.isNotNull(), False)


def all_ok(*verdicts: Column) -> Column:
    """No verdict that could be evaluated is false."""
    return F.forall(F.filter(F.array(*verdicts), lambda x: x.isNotNull()), lambda x: x)


def verdicts(vouchers: DataFrame) -> DataFrame:
    v = vouchers.withColumns(
        {
            "igv_ok": igv_ok(F.col("subtotal"), F.col("igv"), F.col("total")),
            "total_ok": total_ok(F.col("subtotal"), F.col("igv"), F.col("total")),
            "suma_items_ok": items_ok(F.col("items"), F.col("subtotal")),
            "noches_ok": nights_ok(F.col("total"), F.col("noches")),
        }
    )
    return v.withColumn("todo_ok", all_ok(F.col("igv_ok"), F.col("total_ok"), F.col("suma_items_ok"), F.col("noches_ok")))


#: Verdict, rule and level of its failure.
ARITHMETIC = (("igv_ok", "VAL_IGV_ARITMETICA", "MAYOR"), ("total_ok", "VAL_TOTAL_ARITMETICA", "MAYOR"), ("suma_items_ok", "VAL_SUMA_ITEMS", "MENOR"), ("noches_ok", "VAL_NOCHES_HOSPEDAJE", "MENOR"))


def arithmetic_findings(vouchers: DataFrame, *only: str) -> DataFrame:
    """A finding for each verdict that is false, in one pass over the vouchers."""
    rules = [r for r in ARITHMETIC if not only or r[1] in only]
    found = F.filter(F.array(*[F.when(~F.col(v), F.struct(F.lit(rule).alias("regla"), F.lit(level).alias("nivel"))) for v, rule, level in rules]), lambda x: x.isNotNull())
    return verdicts(vouchers).select("sinad", "voucher", F.explode(found).alias("f")).select("sinad", "voucher", "f.regla", "f.nivel")


def model_verdicts(vouchers: DataFrame) -> DataFrame:
    """The variant for model output: the declared rate (18 % if none) unrounded, other amounts in the total, nights against dates.

    Vouchers have besides: tasa (percent), otros, descuentos, exonerado, inafecto, entrada and salida.
    """
    sub, igv, total, none = F.col("subtotal"), F.col("igv"), F.col("total"), amount(0)
    due = sub * F.coalesce("tasa", F.lit(18).cast("decimal(6,2)")) / F.lit(100).cast("decimal(6,2)")
    added = sub + F.coalesce(igv, none) + F.coalesce("otros", none) - F.coalesce("descuentos", none) + F.coalesce("exonerado", none) + F.coalesce("inafecto", none)
    near = lambda x: F.abs(x) <= amount(P.TOLERANCE)
    return vouchers.select("voucher", near(F.col("items") - sub).alias("suma_ok"), near(due - igv).alias("igv_ok"), near(added - total).alias("total_ok"), (F.datediff("salida", "entrada") == F.col("noches")).alias("noches_ok"))


def header_and_detail(vouchers: DataFrame, items: DataFrame) -> DataFrame:
    """Each voucher with the sum and number of its items, and whether they make its subtotal."""
    detail = items.groupBy("voucher").agg(F.sum("importe").cast(MONEY).alias("detalle"), F.count("*").alias("n"))
    both = vouchers.select("voucher", "subtotal").join(detail, "voucher", "left")
    return both.withColumn("cuadra", F.abs(F.col("detalle") - F.col("subtotal")) <= amount(P.TOLERANCE))


def missing_documents(cases: DataFrame, declared: DataFrame, vouchers: DataFrame, key: str = "sinad") -> DataFrame:
    """Cases without a declaration of expenses, and cases without vouchers: a finding for each."""
    lacking = lambda there, rule: cases.select(key).join(there.select(key), key, "left_anti").select(key, F.lit(rule).alias("regla"), F.lit("MAYOR").alias("nivel"))
    return lacking(declared, "VIAT_DOC_ANEXO3").unionByName(lacking(vouchers, "VIAT_DOC_COMPROBANTES"))


def agent_result(findings: DataFrame, key: str = "sinad") -> DataFrame:
    """A bundle of rules as a result for each case: it succeeds if no finding is critical."""
    return findings.groupBy(key).agg((F.count_if(F.col("nivel") == "CRITICA") == 0).alias("exito"), F.count("*").alias("n"), F.count_if(F.col("nivel") == "CRITICA").alias("criticas"))


def empty_cases(cases: DataFrame, vouchers: DataFrame, key: str = "sinad") -> DataFrame:
    """Cases without any voucher."""
    return cases.select(key).join(vouchers.select(key), key, "left_anti").select(key, F.lit("VAL_EXPEDIENTE_VACIO").alias("regla"), F.lit("MAYOR").alias("nivel"))


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each later occurrence of a key, with its number and the first occurrence's position.

    Only the keys that repeat are numbered: one count, aggregated before its
    shuffle, tells them, so unique rows aren't sorted.
    """
    repeated = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("times")).where("times > 1")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(repeated, keys).withColumn("nth", number).where("nth > 1").select(*keys, *order, F.col(f"first.{order[0]}").alias("first_one"), "nth")


def declared_sum(vouchers: DataFrame, declared: DataFrame, tolerance: float = P.DECLARED_TOLERANCE) -> DataFrame:
    """Sum of a case's vouchers against the declared one: ok, a finding, or information if none is declared."""
    sums = vouchers.groupBy("sinad").agg(F.sum("total").cast(MONEY).alias("suma"))
    both = sums.join(declared, "sinad", "left")
    rule = S.first_of((F.col("declarado").isNull(), "VAL_SUMA_VS_ANEXO3_INFO"), (F.abs(F.col("suma") - F.col("declarado")) > amount(tolerance), "VAL_SUMA_VS_ANEXO3"), default="OK")
    return both.select("sinad", "suma", "declarado", rule.alias("regla"))


def missing_fields(vouchers: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """Required fields that a voucher's type asks for and the voucher hasn't; types match by containment, either way."""
    kind = F.upper(F.col("tipo"))
    wanted = S.first_of(*[(F.contains(kind, F.lit(k)) | F.contains(F.lit(k), kind), F.array(*map(F.lit, names))) for k, names in required.items()])
    names = sorted({n for ns in required.values() for n in ns})
    here = F.filter(F.array(*[F.when(S.nonempty(F.col(n).cast("string")).isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    lost = F.array_except(wanted, here)
    return vouchers.select("sinad", "voucher", F.array_join(lost, ",").alias("faltantes")).where("faltantes <> ''")


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("nivel").agg(F.count("*").alias("n"), F.count_distinct("voucher").alias("vouchers"))


# -- per-diem rules: a case is a trip with a period, an allowance and vouchers -----


def trips(vouchers: DataFrame) -> DataFrame:
    """Per case: first and last day, days, spent, allowance. The allowance is the cap's, less for some."""
    v = vouchers.groupBy("sinad").agg(F.min("fecha").alias("salida"), F.max("fecha").alias("regreso"), F.sum("total").cast(MONEY).alias("gastado"), F.count_distinct("fecha").alias("dias_con_gasto"), F.count("*").alias("n"))
    return v.withColumn("dias", F.greatest(F.datediff("regreso", "salida") + 1, F.lit(1)))


def daily_cap(trip: DataFrame, cap: int = P.DAILY_CAP) -> DataFrame:
    over = F.col("gastado") > (F.lit(cap) * F.col("dias")).cast(MONEY) + amount(P.DECLARED_TOLERANCE)
    return trip.select("sinad", "dias", "gastado", S.first_of((F.col("dias").isNull() | F.col("gastado").isNull(), "VIAT_TOPE_DIARIO_INFO"), (over, "VIAT_TOPE_DIARIO"), default="OK").alias("regla"))


def outside_period(vouchers: DataFrame, periods: DataFrame, slack: int = 1) -> DataFrame:
    """Vouchers more than a day outside the trip."""
    both = vouchers.select("sinad", "voucher", "fecha").join(periods, "sinad")
    return both.where(~F.col("fecha").between(F.date_sub("desde", slack), F.date_add("hasta", slack))).select("sinad", "voucher", "fecha", F.lit("VIAT_FECHA_FUERA_PERIODO").alias("regla"))


def allowance(trip: DataFrame, granted: Column, returned: Column) -> DataFrame:
    """Spent more than granted, or a refund that isn't the difference."""
    rest = granted - F.col("gastado")
    rule = S.first_of((F.col("gastado").isNull(), "VIAT_MONTO_INFO"), (F.col("gastado") > granted + amount(P.DECLARED_TOLERANCE), "VIAT_MONTO_EXCEDE_ASIGNADO"), (F.abs(rest - returned) > amount(P.DECLARED_TOLERANCE), "VIAT_DEVOLUCION_INCONSISTENTE"), default="OK")
    return trip.select("sinad", granted.cast(MONEY).alias("otorgado"), "gastado", rule.alias("regla"))


def day_coverage(trip: DataFrame) -> DataFrame:
    part = (F.col("dias_con_gasto") > 0) & (F.col("dias_con_gasto") < F.col("dias"))
    return trip.select("sinad", "dias", "dias_con_gasto", S.first_of((F.col("dias_con_gasto") == 0, "VIAT_COBERTURA_INFO"), (part, "VIAT_COBERTURA_DIAS"), default="OK").alias("regla"))


def buyer_is_claimant(buyer: Column, claimant: Column) -> Column:
    clean = lambda c: F.translate(c, " -", "")
    return F.coalesce(clean(buyer) == clean(claimant), F.lit(False))


def loose_igv_ok(base: Column, igv: Column) -> Column:
    """Within 0.06, or 3.5 %, of 18 % of the base; true if not evaluable."""
    due = base * F.lit(0.18).cast("decimal(4,2)")
    off = F.abs(igv - due)
    return F.coalesce(S.first_of((base <= 0, True), (off <= amount(0.06), True), default=off <= due * F.lit(0.035).cast("decimal(6,4)")), F.lit(True))


def breakdown_ok(total: Column, *components: Column) -> Column:
    """The components add up to the total, if two or more are there."""
    count = sum((c.isNotNull().cast("int") for c in components), F.lit(0))
    added = sum((F.coalesce(c, amount(0)) for c in components), amount(0))
    room = F.greatest(F.lit(0.12).cast("decimal(20,4)"), (F.abs(total) * F.lit(0.018).cast("decimal(6,4)")).cast("decimal(20,4)"))
    return S.first_of((total.isNull() | (total == 0) | (count < 2), True), default=F.abs(added - total) <= room)
