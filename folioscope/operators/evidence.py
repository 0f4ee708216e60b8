"""Evidence cells: status, abstention, completeness, and the routing of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S


def limit(kind: Column) -> Column:
    return S.threshold(kind, P.FIELD_THRESHOLDS)


def status(value: Column, confidence: Column, kind: Column) -> Column:
    return S.first_of((value.isNull() | (confidence == 0), "ILEGIBLE"), (confidence < limit(kind), "INCOMPLETO"), default="LEGIBLE")


def abstention(value: Column, confidence: Column, kind: Column, snippet: Column, page: Column) -> Column:
    """Why a cell isn't used, by priority; null if it is."""
    return S.first_of((value.isNull(), "valor_ausente"), (confidence < limit(kind), "confianza_baja"), (S.nonempty(snippet).isNull(), "snippet_vacio"), (page < 1, "pagina_invalida"))


def judged(cells: DataFrame) -> DataFrame:
    c = F.col
    return cells.withColumns({"status": status(c("valor"), c("confianza"), c("tipo_campo")), "razon": abstention(c("valor"), c("confianza"), c("tipo_campo"), c("snippet"), c("pagina"))})


def by_reason(cells: DataFrame) -> DataFrame:
    """Abstentions of each reason and their share of all cells."""
    counted = judged(cells).groupBy("razon").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.where("razon is not null").crossJoin(F.broadcast(total)).select("razon", "n", F.round(F.col("n").cast("decimal(18,0)") / F.col("total").cast("decimal(18,0)"), 4).cast("decimal(9,4)").alias("tasa"))


def summary(cells: DataFrame, key: str = "sinad") -> DataFrame:
    counted = judged(cells).groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "LEGIBLE").alias("legibles"), F.count_if(F.col("status") == "INCOMPLETO").alias("incompletos"), F.count_if(F.col("razon").isNotNull()).alias("abstenidos"))
    return counted.withColumn("tasa", F.round(F.col("abstenidos").cast("decimal(18,0)") / F.col("total").cast("decimal(18,0)"), 4).cast("decimal(9,4)"))


def placeholders(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected cell: the found one, or a formal abstention, so that nothing is lost."""
    both = expected.join(found, keys, "left")
    return both.select(*keys, "valor", F.coalesce("confianza", F.lit(0).cast("decimal(4,2)")).alias("confianza"), F.when(F.col("valor").isNull(), "ABSTENCION").otherwise("EXTRAIDO").alias("origen"))


def complete(evidence: Column) -> Column:
    """An evidence struct with all five required fields."""
    return S.nonempty(evidence["archivo"]).isNotNull() & (evidence["pagina"] >= 1) & S.nonempty(evidence["valor_detectado"]).isNotNull() & S.nonempty(evidence["snippet"]).isNotNull() & S.nonempty(evidence["metodo"]).isNotNull()


def enforced(findings: DataFrame) -> DataFrame:
    """Serious findings without complete evidence become INCIERTO, for a person to look at."""
    serious = F.col("nivel").isin("CRITICA", "MAYOR")
    shown = F.coalesce((F.size("evidencias") > 0) & F.forall("evidencias", complete), F.lit(False))
    return findings.withColumn("degradada", serious & ~shown).withColumn("nivel_final", F.when(F.col("degradada"), "INCIERTO").otherwise(F.col("nivel")))


def lacking(evidences: Column) -> Column:
    """Blank required fields of each evidence; numbered if there are several."""
    many = F.size(evidences) > 1

    def of(e: Column, i: Column) -> Column:
        names = F.filter(F.array(*[F.when(S.nonempty(e[n].cast("string")).isNull(), F.lit(n)) for n in ("archivo", "pagina", "valor_detectado", "snippet", "metodo")]), lambda x: x.isNotNull())
        return F.transform(names, lambda n: F.when(many, F.concat(F.lit("["), i, F.lit("]."), n)).otherwise(n))

    return F.flatten(F.transform(evidences, of))


def routed(stats: DataFrame) -> DataFrame:
    """Cases with total, abstenidos, con_datos, degradadas, problemas, duplicados, errores -> status, confidence, action, reason."""
    c = F.col
    rate = F.when(c("total") > 0, c("abstenidos").cast("decimal(18,0)") / c("total").cast("decimal(18,0)")).otherwise(F.lit(0).cast("decimal(18,6)"))
    checks = [
        S.first_of((rate >= P.ABSTENTION_CRITICAL, 2), (rate >= P.ABSTENTION_WARNING, 1), default=0),
        S.first_of((c("con_datos") < 1, 2), default=0),
        S.first_of((c("degradadas") > P.TOO_MANY_ERRORS, 2), (c("degradadas") > P.MANY_ERRORS, 1), default=0),
        S.first_of((c("problemas") >= P.TOO_MANY_PROBLEMS, 2), default=0),
        S.first_of((c("duplicados") > 0, 1), default=0),
        S.first_of((c("errores") > P.TOO_MANY_ERRORS, 2), (c("errores") > P.MANY_ERRORS, 1), default=0),
    ]
    names = ("abstencion", "datos_minimos", "degradadas", "completitud", "duplicados", "aritmetica")
    worst = F.greatest(*checks)
    known = F.when(c("total") > 0, rate).otherwise(F.lit(1).cast("decimal(18,6)"))
    state = S.first_of((worst == 2, "CRITICAL"), (worst == 1, "WARNING"), default="OK")
    trust = S.first_of((worst == 2, "BAJA"), ((worst == 0) & (known < 0.10) & (c("degradadas") == 0), "ALTA"), ((known < 0.30) & (c("degradadas") <= 2), "MEDIA"), default="BAJA")
    action = S.first_of((worst == 2, "DETENER"), (worst == 1, "CONTINUAR_CON_ALERTAS"), default="CONTINUAR")
    reason = S.first_of(*[(k == 2, name) for k, name in zip(checks, names, strict=True)])
    alerts = F.array_join(S.flags(*[(k > 0, name) for k, name in zip(checks, names, strict=True)]), ",")
    return stats.select("sinad", state.alias("status"), trust.alias("confianza"), action.alias("accion"), reason.alias("razon"), alerts.alias("alertas"))


def sections(routes: DataFrame) -> DataFrame:
    """A diagnostic row per alert, or one row without a detail."""
    details = F.when(F.col("alertas") != "", F.split("alertas", ","))
    return routes.select("sinad", "status", F.posexplode_outer(details).alias("pos", "detalle"))
