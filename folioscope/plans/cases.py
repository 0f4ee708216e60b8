"""Queries over cases, vouchers, cells, findings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import classify as C
from ..operators import custody as U
from ..operators import evidence as E
from ..operators import resolve as R
from ..operators import segment as G
from ..operators import sheets
from ..operators import validate as V
from ..sources import readers
from .pages import m
from .registry import Tables, query



def exact_rate(a: str, b: str) -> str:
    """a / b to four places, halves up, in whole numbers: doubles would lose some halves."""
    return f"CAST(CAST((20000 * {a} + {b}) // (2 * {b}) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(9,4))"


IGV_SQL = "CASE WHEN igv = 0 THEN true WHEN coalesce(subtotal, total - igv) IS NOT NULL AND igv IS NOT NULL THEN abs(igv - round(coalesce(subtotal, total - igv) * 0.18, 2)) <= 0.02 OR abs(igv - round(coalesce(subtotal, total - igv) * 0.10, 2)) <= 0.02 END"
TOTAL_SQL = "abs(total - (subtotal + coalesce(igv, 0))) <= 0.02"
ITEMS_SQL = "abs(items - subtotal) <= 0.02"
NIGHTS_SQL = "CASE WHEN noches > 0 THEN total / noches > 0 WHEN noches IS NOT NULL THEN false END"
VERDICTS = f"verdicts AS (SELECT sinad, voucher, {IGV_SQL} AS igv_ok, {TOTAL_SQL} AS total_ok, {ITEMS_SQL} AS suma_items_ok, {NIGHTS_SQL} AS noches_ok FROM vouchers)"
FINDINGS = f"{VERDICTS}, findings AS (" + " UNION ALL ".join(f"SELECT sinad, voucher, '{rule}' AS regla, '{level}' AS nivel FROM verdicts WHERE NOT {v}" for v, rule, level in V.ARITHMETIC) + ")"
TYPE_CASE = "CASE " + " ".join(f"WHEN starts_with(regla, '{k}') THEN '{v}'" for k, v in P.FINDING_TYPES.items()) + " ELSE 'OTRO' END"
SEVERITY_CASE = "CASE nivel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SEVERITY.items()) + " END"


#: Cases are the customers; only their urgent orders count as vouchers here, so some cases have none.
URGENT = "o_orderpriority = '1-URGENT'"


@query("J-0", f"SELECT c_custkey AS sinad, 'VAL_EXPEDIENTE_VACIO' AS regla, 'MAYOR' AS nivel FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def _(t: Tables):
    return V.empty_cases(t.customer.select(F.col("c_custkey").alias("sinad")), t.orders.where(URGENT).select(F.col("o_custkey").alias("sinad")))


for _v, _rule, _level in V.ARITHMETIC:

    @query(f"J-{[r[0] for r in V.ARITHMETIC].index(_v) + 1}", f", {FINDINGS} SELECT * FROM findings WHERE regla = '{_rule}'", "vouchers")
    def _(t: Tables, rule=_rule):
        return V.arithmetic_findings(t.vouchers, rule)


MODEL = """modelled AS (SELECT *, CASE WHEN voucher % 3 = 0 THEN CAST(10 AS DECIMAL(6,2)) WHEN voucher % 3 = 1 THEN CAST(18 AS DECIMAL(6,2)) END AS tasa, CAST(CASE WHEN voucher % 9 = 0 THEN 2 END AS DECIMAL(18,2)) AS otros, CAST(CASE WHEN voucher % 18 = 0 THEN 1 END AS DECIMAL(18,2)) AS descuentos,
    CAST(CASE WHEN voucher % 11 = 0 THEN 3 END AS DECIMAL(18,2)) AS exonerado, CAST(CASE WHEN voucher % 13 = 0 THEN 4 END AS DECIMAL(18,2)) AS inafecto, CASE WHEN voucher % 7 <> 0 THEN fecha END AS entrada, CASE WHEN voucher % 20 = 0 THEN noches + 1 ELSE noches END AS estancia FROM vouchers)"""


@query("J-5", f""", {MODEL} SELECT voucher, abs(items - subtotal) <= 0.02 AS suma_ok, abs(subtotal * coalesce(tasa, 18) / 100.0 - igv) <= 0.02 AS igv_ok,
    abs(subtotal + coalesce(igv, 0) + coalesce(otros, 0) - coalesce(descuentos, 0) + coalesce(exonerado, 0) + coalesce(inafecto, 0) - total) <= 0.02 AS total_ok, CASE WHEN entrada IS NOT NULL AND noches IS NOT NULL THEN estancia = noches END AS noches_ok FROM modelled""", "vouchers")
def _(t: Tables):
    k = F.col("voucher")
    some = lambda n, x: F.when(k % n == 0, F.lit(x)).cast("decimal(18,2)")
    stay = F.when(k % 20 == 0, F.col("noches") + 1).otherwise(F.col("noches"))
    given = t.vouchers.withColumns({"tasa": F.when(k % 3 == 0, 10).when(k % 3 == 1, 18).cast("decimal(6,2)"), "otros": some(9, 2), "descuentos": some(18, 1), "exonerado": some(11, 3), "inafecto": some(13, 4), "entrada": F.when(k % 7 != 0, F.col("fecha")), "salida": F.date_add("fecha", stay)})
    return V.model_verdicts(given)


@query("J-6", f", {VERDICTS} SELECT voucher, coalesce(igv_ok, true) AND coalesce(total_ok, true) AND coalesce(suma_items_ok, true) AND coalesce(noches_ok, true) AS todo_ok FROM verdicts", "vouchers")
def _(t: Tables):
    return V.verdicts(t.vouchers).select("voucher", "todo_ok")


@query("X-1", "SELECT voucher, line, part, first_one, nth FROM (SELECT *, row_number() OVER w AS nth, first(part) OVER w AS first_one FROM items WINDOW w AS (PARTITION BY voucher, line ORDER BY part, importe)) WHERE nth > 1", "items")
def _(t: Tables):
    return V.duplicates(t.items, ["voucher", "line"], ["part", "importe"]).select("voucher", "line", "part", "first_one", "nth")


DECLARED = "declared AS (SELECT sinad, CAST(sum(total) + CASE WHEN sinad % 3 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS declarado FROM vouchers WHERE sinad % 7 <> 0 GROUP BY sinad)"


def _declared(t: Tables) -> DataFrame:
    shift = F.when(F.col("sinad") % 3 == 0, 5).otherwise(0)
    return t.vouchers.where("sinad % 7 <> 0").groupBy("sinad").agg(F.sum("total").alias("s")).select("sinad", (F.col("s") + shift).cast("decimal(18,2)").alias("declarado"))


@query("X-2", f", {DECLARED} SELECT sinad, suma, declarado, CASE WHEN declarado IS NULL THEN 'VAL_SUMA_VS_ANEXO3_INFO' WHEN abs(suma - declarado) > 0.20 THEN 'VAL_SUMA_VS_ANEXO3' ELSE 'OK' END AS regla FROM (SELECT sinad, CAST(sum(total) AS DECIMAL(18,2)) AS suma FROM vouchers GROUP BY sinad) LEFT JOIN declared USING (sinad)", "vouchers")
def _(t: Tables):
    return V.declared_sum(t.vouchers, _declared(t))


REQUIRED = {"FACTURA": ("ruc", "serie", "subtotal", "igv", "total"), "BOLETA": ("ruc", "serie", "total"), "RECIBO": ("ruc", "noches", "total")}


@query(
    "X-3",
    "SELECT sinad, voucher, faltantes FROM (SELECT sinad, voucher, concat_ws(',', CASE WHEN tipo = 'RECIBO POR HONORARIOS' AND noches IS NULL THEN 'noches' END, CASE WHEN tipo = 'FACTURA' AND subtotal IS NULL THEN 'subtotal' END, CASE WHEN tipo = 'FACTURA' AND igv IS NULL THEN 'igv' END, CASE WHEN total IS NULL THEN 'total' END) AS faltantes FROM vouchers) WHERE faltantes <> ''",
    "vouchers",
)
def _(t: Tables):
    return V.missing_fields(t.vouchers, REQUIRED)


@query("X-4", f", {FINDINGS} SELECT nivel, count(*) AS n, count(DISTINCT voucher) AS vouchers FROM findings GROUP BY nivel", "vouchers")
def _(t: Tables):
    return V.rule_counts(V.arithmetic_findings(t.vouchers))


TRIPS = "trips AS (SELECT sinad, min(fecha) AS salida, max(fecha) AS regreso, CAST(sum(total) AS DECIMAL(18,2)) AS gastado, count(DISTINCT fecha) AS dias_con_gasto, count(*) AS n, greatest(datediff('day', min(fecha), max(fecha)) + 1, 1) AS dias FROM vouchers GROUP BY sinad)"


@query("V-1", f"SELECT c_custkey AS sinad, 'VIAT_DOC_ANEXO3' AS regla, 'MAYOR' AS nivel FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 0) UNION ALL SELECT c_custkey, 'VIAT_DOC_COMPROBANTES', 'MAYOR' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def _(t: Tables):
    cases = t.customer.select(F.col("c_custkey").alias("sinad"))
    return V.missing_documents(cases, _declared(t), t.orders.where(URGENT).select(F.col("o_custkey").alias("sinad")))


@query("V-2", f", {TRIPS} SELECT sinad, CAST(dias AS INT) AS dias, gastado, CASE WHEN dias IS NULL OR gastado IS NULL THEN 'VIAT_TOPE_DIARIO_INFO' WHEN gastado > 320 * dias + 0.20 THEN 'VIAT_TOPE_DIARIO' ELSE 'OK' END AS regla FROM trips", "vouchers")
def _(t: Tables):
    return V.daily_cap(V.trips(t.vouchers))


@query("V-3", f", {TRIPS} SELECT sinad, voucher, fecha, 'VIAT_FECHA_FUERA_PERIODO' AS regla FROM vouchers JOIN trips USING (sinad) WHERE NOT fecha BETWEEN salida + INTERVAL 30 DAY - INTERVAL 1 DAY AND regreso - INTERVAL 30 DAY + INTERVAL 1 DAY", "vouchers")
def _(t: Tables):
    periods = V.trips(t.vouchers).select("sinad", F.date_add("salida", 30).alias("desde"), F.date_sub("regreso", 30).alias("hasta"))
    return V.outside_period(t.vouchers, periods)


@query("V-4", f", {TRIPS} SELECT sinad, CAST(320 * dias AS DECIMAL(18,2)) AS otorgado, gastado, CASE WHEN gastado IS NULL THEN 'VIAT_MONTO_INFO' WHEN gastado > 320 * dias + 0.20 THEN 'VIAT_MONTO_EXCEDE_ASIGNADO' WHEN abs(320 * dias - gastado - CASE WHEN sinad % 2 = 0 THEN 320 * dias - gastado ELSE 0 END) > 0.20 THEN 'VIAT_DEVOLUCION_INCONSISTENTE' ELSE 'OK' END AS regla FROM trips", "vouchers")
def _(t: Tables):
    granted = (F.col("dias") * P.DAILY_CAP).cast("decimal(18,2)")
    return V.allowance(V.trips(t.vouchers), granted, F.when(F.col("sinad") % 2 == 0, granted - F.col("gastado")).otherwise(0).cast("decimal(18,2)"))


@query("V-5", f", {TRIPS} SELECT sinad, CAST(dias AS INT) AS dias, dias_con_gasto, CASE WHEN dias_con_gasto = 0 THEN 'VIAT_COBERTURA_INFO' WHEN dias_con_gasto < dias THEN 'VIAT_COBERTURA_DIAS' ELSE 'OK' END AS regla FROM trips", "vouchers")
def _(t: Tables):
    return V.day_coverage(V.trips(t.vouchers))


@query("V-6", "SELECT voucher, sinad FROM vouchers WHERE voucher % 5 = 0", "vouchers")
def _(t: Tables):
    claimant = F.concat(F.lit("4"), F.lpad(F.col("sinad").cast("string"), 7, "0"))
    buyer = F.when(F.col("voucher") % 5 == 0, F.concat_ws("-", F.substring(claimant, 1, 4), F.substring(claimant, 5, 4))).otherwise("20131370998")
    return t.vouchers.where(V.buyer_is_claimant(buyer, claimant)).select("voucher", "sinad")


@query("V-7", f", {TRIPS} SELECT CASE WHEN gastado IS NULL THEN 'INFO' WHEN gastado > 320 * dias + 0.20 THEN 'FALLA' ELSE 'OK' END AS resultado, count(*) AS n FROM trips GROUP BY 1", "vouchers")
def _(t: Tables):
    rule = F.col("regla")
    return V.daily_cap(V.trips(t.vouchers)).groupBy(S.first_of((rule == "OK", "OK"), (F.endswith(rule, F.lit("_INFO")), "INFO"), default="FALLA").alias("resultado")).agg(F.count("*").alias("n"))


@query(
    "V-8",
    "SELECT voucher, coalesce(CASE WHEN subtotal <= 0 THEN true WHEN abs(igv - subtotal * 0.18) <= 0.06 THEN true ELSE abs(igv - subtotal * 0.18) <= subtotal * 0.18 * 0.035 END, true) AS igv_ok, CASE WHEN total IS NULL OR total = 0 OR subtotal IS NULL OR igv IS NULL THEN true ELSE abs(subtotal + igv - total) <= greatest(0.12, abs(total) * 0.018) END AS desglose_ok FROM vouchers",
    "vouchers",
)
def _(t: Tables):
    c = F.col
    return t.vouchers.select("voucher", V.loose_igv_ok(c("subtotal"), c("igv")).alias("igv_ok"), V.breakdown_ok(c("total"), c("subtotal"), c("igv")).alias("desglose_ok"))


# -- findings -----------------------------------------------------------------


@query("CLS-18", f", {FINDINGS} SELECT voucher, regla, {TYPE_CASE} AS tipo, {SEVERITY_CASE} AS severidad FROM findings", "vouchers")
def _(t: Tables):
    return V.arithmetic_findings(t.vouchers).select("voucher", "regla", C.finding_type(F.col("regla")).alias("tipo"), C.severity_label(F.col("nivel")).alias("severidad"))


DESCRIBED = "regla || ': el comprobante ' || CAST(voucher AS VARCHAR(20)) || ' no cumple. ' || repeat('Revise el documento. ', CAST(voucher % 12 AS INT))"
ACTION = "CASE WHEN voucher % 5 <> 0 THEN repeat('Corrija el importe. ', CAST(voucher % 10 AS INT)) END"


@query("SRT-1", f", {FINDINGS} SELECT sinad, row_number() OVER (PARTITION BY sinad ORDER BY CASE nivel WHEN 'CRITICA' THEN 0 WHEN 'MAYOR' THEN 1 WHEN 'MENOR' THEN 2 ELSE 3 END, voucher, regla) AS nro, voucher, regla, {SEVERITY_CASE} AS severidad, {TYPE_CASE} AS tipo, substr({DESCRIBED}, 1, 200) AS descripcion, coalesce(substr({ACTION}, 1, 150), '') AS accion FROM findings", "vouchers")
def _(t: Tables):
    return R.ordered_findings(V.arithmetic_findings(t.vouchers).withColumns({"descripcion": F.expr(DESCRIBED), "accion": F.expr(ACTION)}))


@query("AGG-8", f", {FINDINGS} SELECT {SEVERITY_CASE} AS severidad, count(*) AS n FROM findings GROUP BY 1", "vouchers")
def _(t: Tables):
    return R.severity_summary(V.arithmetic_findings(t.vouchers))


@query("TOP-2", "SELECT voucher, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT unnest(d[1:3]) AS x)) || CASE WHEN len(d) > 3 THEN ' ... +' || (len(d) - 3) || ' más' ELSE '' END AS detalle FROM (SELECT voucher, list_sort(list('p' || part)) AS d FROM items GROUP BY voucher)", "items")
def _(t: Tables):
    return R.first_details(t.items.select("voucher", F.concat(F.lit("p"), F.col("part")).alias("d")), "voucher", "d")


@query("SET-1", f", {FINDINGS}, {TRIPS} SELECT regla, count(*) AS n FROM (SELECT regla FROM findings UNION ALL SELECT 'VIAT_COBERTURA_DIAS' FROM trips WHERE dias_con_gasto > 0 AND dias_con_gasto < dias) GROUP BY regla", "vouchers")
def _(t: Tables):
    rules = V.arithmetic_findings(t.vouchers).select("regla").unionByName(V.day_coverage(V.trips(t.vouchers)).where("regla <> 'OK'").select("regla"))
    return rules.groupBy("regla").agg(F.count("*").alias("n"))


@query("SET-2", "SELECT coalesce(a.c_custkey, b.o_custkey) AS clave, CASE WHEN b.o_custkey IS NULL THEN 'BORRADO' ELSE 'MODIFICADO' END AS cambio FROM customer a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON c_custkey = o_custkey WHERE c_nationkey IS DISTINCT FROM n")
def _(t: Tables):
    before = t.customer.select(F.col("c_custkey").alias("clave"), F.col("c_nationkey").cast("long").alias("v"))
    after = t.orders.groupBy(F.col("o_custkey").alias("clave")).agg(F.count("*").alias("v"))
    return U.changed_files(before, after, "clave", "v")


@query("SET-3", f", {VERDICTS} SELECT sinad, CASE max(CASE WHEN NOT total_ok THEN 2 WHEN NOT suma_items_ok THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS estado FROM verdicts GROUP BY sinad", "vouchers")
def _(t: Tables):
    worst = F.max(S.first_of((~F.col("total_ok"), 2), (~F.col("suma_items_ok"), 1), default=0))
    return V.verdicts(t.vouchers).groupBy("sinad").agg(worst.alias("w")).select("sinad", S.first_of((F.col("w") == 2, "FAIL"), (F.col("w") == 1, "WARN"), default="PASS").alias("estado"))


# -- evidence and routing -----------------------------------------------------

LIMIT_SQL = "CASE lower(trim(tipo_campo)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.FIELD_THRESHOLDS.items()) + " ELSE 0.75 END"
JUDGED = f"judged AS (SELECT *, CASE WHEN valor IS NULL OR confianza = 0 THEN 'ILEGIBLE' WHEN confianza < {LIMIT_SQL} THEN 'INCOMPLETO' ELSE 'LEGIBLE' END AS status, CASE WHEN valor IS NULL THEN 'valor_ausente' WHEN confianza < {LIMIT_SQL} THEN 'confianza_baja' WHEN snippet IS NULL OR trim(snippet) = '' THEN 'snippet_vacio' WHEN pagina < 1 THEN 'pagina_invalida' END AS razon FROM cells)"


@query("RT-1", f"SELECT voucher, campo, CAST({LIMIT_SQL} AS DECIMAL(4,2)) AS umbral FROM cells", "cells")
def _(t: Tables):
    return t.cells.select("voucher", "campo", E.limit(F.col("tipo_campo")).alias("umbral"))


@query("RT-2", f", {JUDGED} SELECT voucher, campo, status FROM judged", "cells")
def _(t: Tables):
    return E.judged(t.cells).select("voucher", "campo", "status")


@query("RT-3", f", {JUDGED} SELECT voucher, campo, razon FROM judged WHERE razon IS NOT NULL", "cells")
def _(t: Tables):
    return E.judged(t.cells).where("razon is not null").select("voucher", "campo", "razon")


@query("RT-4", "SELECT v.voucher, f.campo, c.valor, coalesce(c.confianza, 0) AS confianza, CASE WHEN c.valor IS NULL THEN 'ABSTENCION' ELSE 'EXTRAIDO' END AS origen FROM vouchers v CROSS JOIN (VALUES ('ruc_emisor'), ('igv_monto')) f(campo) LEFT JOIN cells c ON c.voucher = v.voucher AND c.campo = f.campo", "vouchers", "cells")
def _(t: Tables):
    expected = t.vouchers.select("voucher", F.explode(F.array(F.lit("ruc_emisor"), F.lit("igv_monto"))).alias("campo"))
    return E.placeholders(expected, t.cells.select("voucher", "campo", "valor", "confianza"), ["voucher", "campo"])


@query("RT-5", f", {JUDGED} SELECT razon, count(*) AS n, {exact_rate("count(*)", "(SELECT count(*) FROM judged)")} AS tasa FROM judged WHERE razon IS NOT NULL GROUP BY razon", "cells")
def _(t: Tables):
    return E.by_reason(t.cells)


@query("RT-6", "SELECT sinad, count(*) AS celdas FROM cells GROUP BY sinad", "cells")
def _(t: Tables):
    return t.cells.groupBy("sinad").agg(F.count("*").alias("celdas"))


SUMMARY = "summary AS (SELECT sinad, count(*) AS total, count_if(status = 'LEGIBLE') AS legibles, count_if(status = 'INCOMPLETO') AS incompletos, count_if(razon IS NOT NULL) AS abstenidos FROM judged GROUP BY sinad)"


@query("RT-7", f", {JUDGED}, {SUMMARY} SELECT sinad, total, CAST(legibles AS BIGINT) AS legibles, CAST(incompletos AS BIGINT) AS incompletos, CAST(abstenidos AS BIGINT) AS abstenidos, {exact_rate("CAST(abstenidos AS BIGINT)", "total")} AS tasa FROM summary", "cells")
def _(t: Tables):
    return E.summary(t.cells)


@query("RT-8", "SELECT sinad, voucher, list_filter([CASE WHEN total IS NULL THEN 'sin_total' END, CASE WHEN subtotal IS NULL THEN 'sin_subtotal' END, CASE WHEN igv IS NULL THEN 'sin_igv' END, CASE WHEN coalesce(n_items, 0) = 0 THEN 'sin_items' END], lambda p: p IS NOT NULL) AS problemas FROM vouchers WHERE total IS NULL OR subtotal IS NULL OR igv IS NULL OR coalesce(n_items, 0) = 0", "vouchers")
def _(t: Tables):
    problems = S.flags((F.col("total").isNull(), "sin_total"), (F.col("subtotal").isNull(), "sin_subtotal"), (F.col("igv").isNull(), "sin_igv"), (F.coalesce("n_items", F.lit(0)) == 0, "sin_items"))
    return t.vouchers.select("sinad", "voucher", problems.alias("problemas")).where(F.size("problemas") > 0)


def _evidenced(t: Tables) -> DataFrame:
    """Findings with none, one or two evidences, some of them incomplete."""
    k = F.col("voucher") % 4
    proof = lambda text, page: F.struct(F.lit("f.pdf").alias("archivo"), F.lit(page).alias("pagina"), F.lit("1").alias("valor_detectado"), F.lit(text).alias("snippet"), F.lit("REGEX").alias("metodo"))
    none = F.array().cast("array<struct<archivo:string,pagina:int,valor_detectado:string,snippet:string,metodo:string>>")
    return V.arithmetic_findings(t.vouchers).withColumn("evidencias", S.first_of((k == 0, none), (k == 1, F.array(proof("x", 1))), (k == 2, F.array(proof("x", 1), proof(" ", 0))), default=F.array(proof("", 1))))


@query("RT-9", f", {FINDINGS} SELECT sinad, voucher, regla, nivel IN ('CRITICA', 'MAYOR') AND voucher % 4 <> 1 AS degradada, CASE WHEN nivel IN ('CRITICA', 'MAYOR') AND voucher % 4 <> 1 THEN 'INCIERTO' ELSE nivel END AS nivel_final FROM findings", "vouchers")
def _(t: Tables):
    return E.enforced(_evidenced(t)).select("sinad", "voucher", "regla", "degradada", "nivel_final")


@query("RT-10", f", {FINDINGS} SELECT voucher, regla, CASE voucher % 4 WHEN 2 THEN ['[1].snippet'] WHEN 3 THEN ['snippet'] ELSE [] END AS faltan FROM findings", "vouchers")
def _(t: Tables):
    return _evidenced(t).select("voucher", "regla", E.lacking(F.col("evidencias")).alias("faltan"))


@query("RT-11", f", {VERDICTS} SELECT voucher, list_filter([CASE WHEN NOT igv_ok THEN 'igv' END, CASE WHEN NOT total_ok THEN 'total' END, CASE WHEN NOT suma_items_ok THEN 'items' END], lambda e: e IS NOT NULL) AS errores FROM verdicts", "vouchers")
def _(t: Tables):
    return V.verdicts(t.vouchers).select("voucher", S.flags((~F.col("igv_ok"), "igv"), (~F.col("total_ok"), "total"), (~F.col("suma_items_ok"), "items")).alias("errores"))


STATS = f"""{JUDGED}, {FINDINGS}, stats AS (SELECT a.sinad, total, abstenidos, con_datos, coalesce(degradadas, 0) AS degradadas, coalesce(problemas, 0) AS problemas, CASE WHEN a.sinad % 9 = 0 THEN 1 ELSE 0 END AS duplicados, coalesce(errores, 0) AS errores FROM
    (SELECT sinad, count(*) AS total, count_if(razon IS NOT NULL) AS abstenidos, count(DISTINCT voucher) AS con_datos FROM judged GROUP BY sinad) a
    LEFT JOIN (SELECT sinad, count_if(nivel = 'MAYOR' AND voucher % 4 <> 1) AS degradadas, count(*) AS errores FROM findings GROUP BY sinad) f ON f.sinad = a.sinad
    LEFT JOIN (SELECT sinad, count_if(total IS NULL) AS problemas FROM vouchers GROUP BY sinad) p ON p.sinad = a.sinad)"""
CHECKS = (
    ("abstencion", "CASE WHEN abstenidos / total >= 0.50 THEN 2 WHEN abstenidos / total >= 0.30 THEN 1 ELSE 0 END"),
    ("datos_minimos", "CASE WHEN con_datos < 1 THEN 2 ELSE 0 END"),
    ("degradadas", "CASE WHEN degradadas > 5 THEN 2 WHEN degradadas > 2 THEN 1 ELSE 0 END"),
    ("completitud", "CASE WHEN problemas >= 3 THEN 2 ELSE 0 END"),
    ("duplicados", "CASE WHEN duplicados > 0 THEN 1 ELSE 0 END"),
    ("aritmetica", "CASE WHEN errores > 5 THEN 2 WHEN errores > 2 THEN 1 ELSE 0 END"),
)
WORST = "greatest(" + ", ".join(c for _, c in CHECKS) + ")"
ROUTES = f"""{STATS}, routes AS (SELECT sinad, CASE {WORST} WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS status,
    CASE WHEN {WORST} = 2 THEN 'BAJA' WHEN {WORST} = 0 AND abstenidos / total < 0.10 AND degradadas = 0 THEN 'ALTA' WHEN abstenidos / total < 0.30 AND degradadas <= 2 THEN 'MEDIA' ELSE 'BAJA' END AS confianza,
    CASE {WORST} WHEN 2 THEN 'DETENER' WHEN 1 THEN 'CONTINUAR_CON_ALERTAS' ELSE 'CONTINUAR' END AS accion,
    CASE {" ".join(f"WHEN {c} = 2 THEN '{n}'" for n, c in CHECKS)} END AS razon, concat_ws(',', {", ".join(f"CASE WHEN {c} > 0 THEN '{n}' END" for n, c in CHECKS)}) AS alertas FROM stats)"""


def _stats(t: Tables) -> DataFrame:
    a = E.judged(t.cells).groupBy("sinad").agg(F.count("*").alias("total"), F.count_if(F.col("razon").isNotNull()).alias("abstenidos"), F.count_distinct("voucher").alias("con_datos"))
    f = E.enforced(_evidenced(t)).groupBy("sinad").agg(F.count_if("degradada").alias("degradadas"), F.count("*").alias("errores"))
    p = t.vouchers.groupBy("sinad").agg(F.count_if(F.col("total").isNull()).alias("problemas"))
    return a.join(f, "sinad", "left").join(p, "sinad", "left").fillna(0, ["degradadas", "errores", "problemas"]).withColumn("duplicados", F.when(F.col("sinad") % 9 == 0, 1).otherwise(0))


@query("RT-12", f", {ROUTES} SELECT sinad, status, razon, alertas FROM routes", "vouchers", "cells")
def _(t: Tables):
    return E.routed(_stats(t)).select("sinad", "status", "razon", "alertas")


@query("RT-13", f", {ROUTES} SELECT sinad, confianza FROM routes", "vouchers", "cells")
def _(t: Tables):
    return E.routed(_stats(t)).select("sinad", "confianza")


@query("RT-14", f", {ROUTES} SELECT accion, count(*) AS n FROM routes GROUP BY accion", "vouchers", "cells")
def _(t: Tables):
    return E.routed(_stats(t)).groupBy("accion").agg(F.count("*").alias("n"))


@query("RT-15", f", {ROUTES} SELECT sinad, status, CASE WHEN alertas <> '' THEN unnest(range(0, len(string_split(alertas, ',')))) END AS pos, CASE WHEN alertas <> '' THEN unnest(string_split(alertas, ',')) END AS detalle FROM routes", "vouchers", "cells")
def _(t: Tables):
    return E.sections(E.routed(_stats(t)))


# -- joins, deduplication, calibration ----------------------------------------

PAIR = "ocr AS (SELECT voucher, campo, valor, confianza FROM cells WHERE voucher % 6 <> 0), vlm AS (SELECT voucher, campo, CASE WHEN voucher % 2 = 0 THEN lower(valor) ELSE valor || '9' END AS valor, CAST((voucher * 7) % 100 / 100.0 AS DECIMAL(4,2)) AS confianza FROM cells WHERE voucher % 5 <> 0)"
REASON = f"""CASE WHEN o.valor IS NULL AND v.valor IS NULL THEN 'sin_valor' WHEN v.valor IS NULL THEN 'solo_ocr' WHEN o.valor IS NULL THEN 'solo_vlm' WHEN upper(trim(o.valor)) = upper(trim(v.valor)) THEN 'coinciden'
    WHEN campo IN {P.PREFER_OCR} THEN 'campo_numerico_prefer_ocr' WHEN campo IN {P.PREFER_VLM} THEN 'campo_texto_prefer_vlm' WHEN o.confianza > v.confianza THEN 'confianza_mayor_ocr' WHEN v.confianza > o.confianza THEN 'confianza_mayor_vlm' ELSE 'empate_tiebreak_ocr' END"""
RESOLVED = f"""{PAIR}, joined AS (SELECT voucher, campo, o.valor AS ov, v.valor AS vv, o.confianza AS oc, v.confianza AS vc, {REASON} AS razon FROM ocr o FULL JOIN vlm v USING (voucher, campo)),
    won AS (SELECT *, CASE WHEN razon = 'sin_valor' THEN NULL WHEN razon IN ('solo_vlm', 'campo_texto_prefer_vlm', 'confianza_mayor_vlm') OR razon = 'coinciden' AND vc > oc THEN 'vlm' ELSE 'ocr' END AS ganador, razon NOT IN ('sin_valor', 'solo_ocr', 'solo_vlm', 'coinciden') AS conflicto FROM joined),
    resolved AS (SELECT voucher, campo, CASE WHEN ganador = 'vlm' THEN vv ELSE ov END AS valor, ganador, razon, conflicto, conflicto AND CASE WHEN ganador = 'vlm' THEN oc - vc ELSE vc - oc END > 0.3 AS revisar FROM won)"""


def _resolved(t: Tables) -> DataFrame:
    cells = t.cells.select("voucher", "campo", "valor", "confianza")
    vlm = cells.where("voucher % 5 <> 0").select("voucher", "campo", F.when(F.col("voucher") % 2 == 0, F.lower("valor")).otherwise(F.concat("valor", F.lit("9"))).alias("valor"), ((F.col("voucher") * 7) % 100 / 100).cast("decimal(4,2)").alias("confianza"))
    return R.resolve(cells.where("voucher % 6 <> 0"), vlm, ["voucher", "campo"])


@query("JN-1", f", {RESOLVED} SELECT voucher, campo, valor, ganador FROM resolved", "cells")
def _(t: Tables):
    return _resolved(t).select("voucher", "campo", "valor", "ganador")


@query("JN-2", f", {RESOLVED} SELECT voucher, campo, razon, conflicto, revisar FROM resolved", "cells")
def _(t: Tables):
    return _resolved(t).select("voucher", "campo", "razon", "conflicto", "revisar")


@query("AGG-9", f", {RESOLVED} SELECT razon, count(*) AS n, CAST(count_if(conflicto) AS BIGINT) AS conflictos, CAST(count_if(revisar) AS BIGINT) AS revisar FROM resolved GROUP BY razon", "cells")
def _(t: Tables):
    return R.conflict_summary(_resolved(t))


@query("JN-6", "SELECT v.sinad AS doc, v.offset, coalesce(min(p.page) FILTER (v.offset <= p.upto), max(p.page)) AS page FROM (SELECT DISTINCT sinad, (sinad * 13) % 40 AS offset FROM vouchers) v JOIN (SELECT sinad, voucher AS page, sum(length(prioridad)) OVER (PARTITION BY sinad ORDER BY voucher) AS upto FROM vouchers) p USING (sinad) GROUP BY ALL", "vouchers")
def _(t: Tables):
    pages = t.vouchers.select(F.col("sinad").alias("doc"), F.col("voucher").alias("page"), F.length("prioridad").alias("length"))
    asked = t.vouchers.select(F.col("sinad").alias("doc"), ((F.col("sinad") * 13) % 40).alias("offset")).distinct()
    return G.page_of_offset(pages, asked)


@query("JN-8", "SELECT v.voucher, v.subtotal, i.detalle, i.n, abs(i.detalle - v.subtotal) <= 0.02 AS cuadra FROM vouchers v LEFT JOIN (SELECT voucher, CAST(sum(importe) AS DECIMAL(18,2)) AS detalle, count(*) AS n FROM items WHERE line <> 2 GROUP BY voucher) i ON i.voucher = v.voucher", "vouchers", "items")
def _(t: Tables):
    """Headers with the totals of their details, of which some lack their second line."""
    return V.header_and_detail(t.vouchers, t.items.where("line <> 2"))


RANK = "CASE prioridad WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END"


@query("DED-1", "SELECT voucher, line, part, importe FROM (SELECT *, row_number() OVER (PARTITION BY voucher, line ORDER BY CASE WHEN cantidad >= 30 THEN 3 WHEN cantidad >= 10 THEN 2 ELSE 0 END DESC, part, importe) AS n FROM items) WHERE n = 1", "items")
def _(t: Tables):
    rank = S.first_of((F.col("cantidad") >= 30, 3), (F.col("cantidad") >= 10, 2), default=0)
    return R.keep_best(t.items, F.concat_ws("-", F.col("voucher").cast("string"), F.col("line").cast("string")), rank, ["part", "importe"]).select("voucher", "line", "part", "importe")


@query("DED-2", "SELECT sinad, serie, voucher FROM (SELECT *, row_number() OVER (PARTITION BY sinad, serie ORDER BY voucher) AS n FROM vouchers) WHERE n = 1", "vouchers")
def _(t: Tables):
    return R.keep_first(t.vouchers, [F.col("sinad"), F.col("serie")], ["voucher"]).select("sinad", "serie", "voucher")


@query("DED-3", "SELECT doc_id AS file, octet_length(encode(text)) AS bytes, sha256(text) AS hash, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'DUPLICADO' ELSE 'INGRESADO' END AS estado FROM documents")
def _(t: Tables):
    return U.ingest(t.documents.select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


OUTCOME = "CASE WHEN campo IS NULL THEN NULL END"


@query(
    "CMP-1",
    "SELECT voucher, CASE WHEN total IS NULL THEN 'SKIP_GT_NULL' WHEN voucher % 5 = 0 THEN 'NO_EXTRAIDO' WHEN voucher % 3 = 0 THEN 'ERROR' ELSE 'MATCH' END AS total, CASE WHEN voucher % 4 = 0 THEN 'MATCH_PARCIAL' ELSE 'MATCH' END AS serie FROM vouchers",
    "vouchers",
)
def _(t: Tables):
    k = F.col("voucher")
    got = S.first_of((k % 5 == 0, F.lit("")), (k % 3 == 0, (F.col("total") + 1).cast("string")), default=F.concat(F.lit("S/ "), F.col("total").cast("string")))
    series = F.concat_ws("-", "serie", "numero")
    return t.vouchers.select("voucher", R.compared(F.lit("total"), got, F.col("total").cast("string")).alias("total"), R.compared(F.lit("serie_numero"), F.when(k % 4 == 0, F.concat(F.lit("X"), series)).otherwise(F.lower(series)), series).alias("serie"))


RATES = exact_rate("CAST({0} AS BIGINT)", "nullif(CAST(evaluados AS BIGINT), 0)")


@query(
    "AGG-1",
    f"SELECT campo, CAST(evaluados AS BIGINT) AS evaluados, CAST(m AS BIGINT) AS match, CAST(e AS BIGINT) AS error, CAST(x AS BIGINT) AS no_extraido, CAST(s AS BIGINT) AS skip, CAST(p AS BIGINT) AS parcial, {RATES.format('m')} AS precision, {RATES.format('e')} AS tasa_error, {RATES.format('x')} AS tasa_no_extraido FROM (SELECT campo, count_if(resultado IN ('MATCH', 'ERROR', 'NO_EXTRAIDO')) AS evaluados, count_if(resultado = 'MATCH') AS m, count_if(resultado = 'ERROR') AS e, count_if(resultado = 'NO_EXTRAIDO') AS x, count_if(resultado = 'SKIP_GT_NULL') AS s, count_if(resultado = 'MATCH_PARCIAL') AS p FROM outcomes GROUP BY campo)",
    "outcomes",
)
def _(t: Tables):
    return R.accuracy(t.outcomes)


EVALUATED = "CAST(count_if(resultado IN ('MATCH', 'ERROR', 'NO_EXTRAIDO')) AS BIGINT)"


@query(
    "AGG-2",
    f"""SELECT CAST(100 * {exact_rate("CAST(count_if(resultado = 'MATCH') AS BIGINT)", EVALUATED)} AS DECIMAL(9,2)) AS precision,
        CAST(100 * {exact_rate("CAST(count_if(resultado IN ('ERROR', 'NO_EXTRAIDO')) AS BIGINT)", EVALUATED)} AS DECIMAL(9,2)) AS falla,
        min(confianza) AS minima, max(confianza) AS maxima, {exact_rate("CAST(sum(confianza) * 100 AS BIGINT)", "100 * count(confianza)")} AS media FROM outcomes""",
    "outcomes",
)
def _(t: Tables):
    return R.global_accuracy(t.outcomes)


PROFILES = " UNION ALL ".join(f"SELECT '{name}' AS perfil, unnest(map_keys(r)) AS clave, unnest(map_values(r)) AS umbral, '{group}' AS grupo FROM (SELECT MAP {{{', '.join(f"'{k}': CAST({v} AS DECIMAL(6,2))" for k, v in values.items())}}} AS r)" for name, router in P.ROUTER_PROFILES.items() for group, values in (("router", router), ("abstencion", P.FIELD_THRESHOLDS | {"default": P.DEFAULT_THRESHOLD})))


@query("AGG-3", f"SELECT perfil, grupo, clave, umbral FROM ({PROFILES})")
def _(t: Tables):
    return R.profiles(t._spark)


@query("AGG-4", "SELECT count(*) AS n, CAST(count_if(resultado = 'MATCH') AS BIGINT) AS aciertos, 100.0 * count_if(resultado = 'MATCH') / count(*) >= 85 AS pasa FROM outcomes WHERE resultado <> 'SKIP_GT_NULL'", "outcomes")
def _(t: Tables):
    hits = F.count_if(F.col("resultado") == "MATCH")
    return t.outcomes.where("resultado <> 'SKIP_GT_NULL'").agg(F.count("*").alias("n"), hits.alias("aciertos"), (100 * hits / F.count("*") >= 85).alias("pasa"))


@query("AGG-5", "SELECT tipo, count(*) AS n, count(total) AS con_total, count(igv) AS con_igv FROM vouchers GROUP BY tipo", "vouchers")
def _(t: Tables):
    return t.vouchers.groupBy("tipo").agg(F.count("*").alias("n"), F.count("total").alias("con_total"), F.count("igv").alias("con_igv")).orderBy(F.desc("n"), "tipo")


@query("AGG-6", "SELECT count(*) AS registros, CAST(count_if(doc_id = m) AS BIGINT) AS unicos, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m, octet_length(encode(text)) AS b FROM documents)")
def _(t: Tables):
    return U.custody_stats(U.ingest(t.documents.select(F.col("doc_id").alias("file"), F.col("text").alias("content"))))


@query("CUS-1", "SELECT doc_id AS file, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'es') THEN 'YA_REGISTRADO' WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'DUPLICADO' WHEN doc_id % 10 = 0 THEN 'COPIA_ALTERADA' ELSE 'INGRESADO' END AS estado, octet_length(encode(text)) AS bytes FROM documents")
def _(t: Tables):
    """All documents arrive; those in Spanish are registered already. Copies of every tenth are damaged on the way."""
    files = t.documents.select(F.col("doc_id").alias("file"), F.col("text").alias("content"), "lang")
    arrivals = files.select("file", "content")
    seen = U.ingest(arrivals, U.ingest(files.where("lang = 'es'").select("file", "content")))
    copies = arrivals.select("file", F.when(F.col("file") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return U.with_copies(seen, copies).select("file", "estado", "bytes")


@query("CUS-2", "SELECT doc_id AS file, CASE WHEN doc_id % 10 = 0 THEN 'NO_ENCONTRADO' WHEN doc_id % 10 = 1 THEN 'ALTERADO' WHEN doc_id % 10 = 2 THEN 'NO_REGISTRADO' ELSE 'OK' END AS estado FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 10
    then = t.documents.where(k != 2).select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("hash"))
    now = t.documents.where(k != 0).select(F.col("doc_id").alias("file"), F.sha2(F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return U.verify(then, now)


# -- trace log ----------------------------------------------------------------


@query("AGG-7", "SELECT count(*) AS entradas, count(DISTINCT trace_id) AS trazas, " + ", ".join(f"CAST(count_if(level = '{k}') AS BIGINT) AS {k.lower()}" for k in P.LEVELS) + " FROM trace", "trace")
def _(t: Tables):
    return U.trace_stats(t.trace)


@query("TOP-1", "SELECT entry, level, trace_id FROM trace WHERE level IN ('WARNING', 'ERROR', 'CRITICAL') ORDER BY moment DESC, entry DESC LIMIT 100", "trace")
def _(t: Tables):
    return U.recent(t.trace, "WARNING", 100).select("entry", "level", "trace_id")


@query("WIN-6", "SELECT trace_id, count(*) AS entradas, CAST(floor(epoch(max(moment))) - floor(epoch(min(moment))) AS BIGINT) AS segundos FROM trace GROUP BY trace_id", "trace")
def _(t: Tables):
    return U.durations(t.trace).select("trace_id", "entradas", "segundos")


@query("TRC-1", """SELECT entry, last_value(nullif(CASE WHEN level = 'INFO' THEN '' ELSE operation END, '') IGNORE NULLS) OVER w AS heredado, CASE WHEN row_number() OVER w = 1 THEN 'INICIO' WHEN lead(entry) OVER (PARTITION BY trace_id ORDER BY moment, entry) IS NULL THEN 'FIN' ELSE 'ACTIVA' END AS fase,
    CASE WHEN lead(entry) OVER (PARTITION BY trace_id ORDER BY moment, entry) IS NULL THEN CASE WHEN max(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1 ELSE 0 END) OVER w = 1 THEN 'ERROR' ELSE 'OK' END END AS cierre FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY moment, entry ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "trace")
def _(t: Tables):
    own = U.inherited(t.trace.withColumn("op", F.when(F.col("level") == "INFO", "").otherwise(F.col("operation"))), "op")
    return U.lifecycle(own).select("entry", "heredado", "fase", "cierre")


@query("TRC-2", "SELECT level, " + "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.LEVELS.items()) + " END AS peso, count(*) AS n FROM trace GROUP BY level", "trace")
def _(t: Tables):
    return t.trace.groupBy("level", U.weight(F.col("level")).alias("peso")).agg(F.count("*").alias("n"))


@query("TRC-3", "SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY moment, entry) AS paso, entry, level, operation FROM trace", "trace")
def _(t: Tables):
    return U.by_trace(t.trace).select("trace_id", "paso", "entry", "level", "operation")


@query("SRC-12", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


# -- layout -------------------------------------------------------------------


def _gap(axis: str, rest: str, size: str, share: str, least: str, by: str) -> str:
    return f"sum(CASE WHEN {axis}0 - p{axis}1 >= greatest({size} * {share}, {least}) OR c{axis} - pc{axis} >= greatest({size} * {share}, {least}) THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY c{axis}, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


REGIONS = f"""ext AS (SELECT *, max(x1) OVER p - min(x0) OVER p AS w, max(y1) OVER p - min(y0) OVER p AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes WINDOW p AS (PARTITION BY page)),
    lagx AS (SELECT *, lag(x1) OVER o AS px1, lag(cx) OVER o AS pcx FROM ext WINDOW o AS (PARTITION BY page ORDER BY cx, line)), cols AS (SELECT *, {_gap('x', '', 'w', '0.045', '14.0', 'page')} AS col FROM lagx),
    lagy AS (SELECT *, lag(y1) OVER o AS py1, lag(cy) OVER o AS pcy FROM cols WINDOW o AS (PARTITION BY page, col ORDER BY cy, line)), regs AS (SELECT *, {_gap('y', '', 'h', '0.085', '22.0', 'page, col')} AS reg FROM lagy)"""


@query("WIN-1", f", {REGIONS} SELECT page, line, CAST(col AS BIGINT) AS col, CAST(reg AS BIGINT) AS reg FROM regs", "boxes")
def _(t: Tables):
    return G.regions(t.boxes).select("page", "line", "col", "reg")


REGION_SCORE = f"""(CASE WHEN {m('n', P.VALID_SERIES)} THEN 2 ELSE 0 END + CASE WHEN {m('n', P.TOTAL_CONTEXT)} OR regexp_matches(n, '{P.REGION_AMOUNT}') THEN 1 ELSE 0 END + CASE WHEN {m('t', P.RUC_MARK)} THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(n, '{P.REGION_AMOUNT}')) >= 3 THEN 1 ELSE 0 END)"""


@query(
    "WIN-2",
    f""", {REGIONS}, texts AS (SELECT page, col, reg, count(*) AS lineas, string_agg(texto, chr(10) ORDER BY y0, x0, line) AS t FROM regs GROUP BY page, col, reg), scored AS (SELECT page, col, reg, lineas, CAST({REGION_SCORE} AS INT) AS score FROM (SELECT *, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS n FROM texts))
        SELECT page, row_number() OVER (PARTITION BY page ORDER BY col, reg) - 1 AS region, lineas, score FROM scored WHERE score >= 2""",
    "boxes",
)
def _(t: Tables):
    return G.scored_regions(t.boxes)


@query("WIN-5", "SELECT page, greatest(a - 50, 0) AS x0, greatest(b - 75, 0) AS y0, least(c + 50, 1000) AS x1, least(d + 75, 1500) AS y1 FROM (SELECT page, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM boxes WHERE conf >= 0.3 GROUP BY page HAVING count(*) >= 3) WHERE (least(c + 50, 1000) - greatest(a - 50, 0)) * (least(d + 75, 1500) - greatest(b - 75, 0)) >= 75000", "boxes")
def _(t: Tables):
    return G.roi(t.boxes, 1000, 1500)


@query("SRC-8", "SELECT o_custkey AS page, line % 3 AS block, 0 AS line, string_agg(texto, ' ' ORDER BY line) AS texto, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, " + exact_rate("CAST(sum(line % 100) FILTER (line % 4 <> 0) AS BIGINT)", "100 * count(*) FILTER (line % 4 <> 0)") + " AS confianza FROM (SELECT page AS o_custkey, * FROM boxes) GROUP BY o_custkey, line % 3", "boxes")
def _(t: Tables):
    words = t.boxes.select("page", (F.col("line") % 3).alias("block"), F.lit(0).alias("l"), F.col("line").alias("ord"), "texto", "x0", "y0", "x1", "y1", F.when(F.col("line") % 4 != 0, (F.col("line") % 100).cast("decimal(6,2)")).otherwise(-1).alias("conf"))
    return G.words_to_lines(words, "page", "block", "l", "ord").withColumnRenamed("l", "line")


@query("SRT-2", "SELECT page, string_agg(texto, chr(10) ORDER BY y0, x0, line) AS texto FROM boxes GROUP BY page", "boxes")
def _(t: Tables):
    return G.read_order(t.boxes)


# -- sinks --------------------------------------------------------------------


HEADER_SQL = f"""header AS (SELECT sinad, CAST(sinad AS VARCHAR) AS c1, CASE WHEN sinad % 5 <> 0 THEN 'comisionado ' || CAST(sinad AS VARCHAR) END AS c2, lpad(CAST(sinad AS VARCHAR), 8, '0') AS c3, CASE WHEN sinad % 2 = 0 THEN 'Lima' END AS c4, CAST(salida AS VARCHAR) AS c5, CAST(regreso AS VARCHAR) AS c6,
    CAST(CAST(320 * dias AS DECIMAL(18,2)) AS VARCHAR) AS c7, CAST(gastado AS VARCHAR) AS c8, CAST(CAST(320 * dias - gastado AS DECIMAL(18,2)) AS VARCHAR) AS c9 FROM trips)"""


@query(
    "SNK-4",
    f""", {TRIPS}, {HEADER_SQL} SELECT sinad, 'cabecera' AS parte, CAST(i AS INT) AS fila, ['SINAD', 'Comisionado', 'DNI', 'Destino', 'Fecha salida', 'Fecha regreso', 'Viático otorgado', 'Total gastado', 'Devolución'][i] AS etiqueta, coalesce([c1, c2, c3, c4, c5, c6, c7, c8, c9][i], '') AS valor
        FROM header, unnest(range(1, 10)) AS r(i)
        UNION ALL SELECT sinad, 'item', CAST(row_number() OVER (PARTITION BY sinad ORDER BY fecha, voucher) AS INT), tipo, concat_ws(' | ', CAST(fecha AS VARCHAR), ruc, serie || '-' || numero, prioridad, coalesce(CAST(total AS VARCHAR), '')) FROM vouchers""",
    "vouchers",
)
def _(t: Tables):
    """The declaration's sheet: nine header rows and the items of each case."""
    trip, text = V.trips(t.vouchers), lambda c: c.cast("string")
    granted = (F.col("dias") * P.DAILY_CAP).cast("decimal(18,2)")
    c = F.col
    head = {
        "SINAD": c("sinad"),
        "Comisionado": F.when(c("sinad") % 5 != 0, F.concat(F.lit("comisionado "), c("sinad"))),
        "DNI": F.lpad(text(c("sinad")), 8, "0"),
        "Destino": F.when(c("sinad") % 2 == 0, F.lit("Lima")),
        "Fecha salida": c("salida"),
        "Fecha regreso": c("regreso"),
        "Viático otorgado": granted,
        "Total gastado": c("gastado"),
        "Devolución": (granted - c("gastado")).cast("decimal(18,2)"),
    }
    number = F.row_number().over(Window.partitionBy("sinad").orderBy("fecha", "voucher"))
    shown = F.concat_ws(" | ", text(F.col("fecha")), "ruc", F.concat_ws("-", "serie", "numero"), "prioridad", F.coalesce(text(F.col("total")), F.lit("")))
    items = t.vouchers.select("sinad", F.lit("item").alias("parte"), number.alias("fila"), F.col("tipo").alias("etiqueta"), shown.alias("valor"))
    return sheets.header_rows(trip, "sinad", head).unionByName(items)


@query("SNK-5", "SELECT tipo AS \"Tipo\", serie AS \"Serie\", numero AS \"Número\", ruc AS \"RUC emisor\", CASE WHEN voucher % 3 = 0 THEN '' ELSE prioridad END AS \"Razón social\", fecha_texto AS \"Fecha emisión\", coalesce(CAST(total AS VARCHAR), '') AS \"Importe total\", coalesce(CAST(igv AS VARCHAR), '') AS \"IGV\", CASE WHEN voucher % 2 = 0 THEN 'ocr' ELSE '' END AS \"Motor\", CASE WHEN voucher % 12 = 0 THEN '' ELSE CAST(voucher % 12 AS VARCHAR) END AS \"Página\" FROM vouchers", "vouchers")
def _(t: Tables):
    k = F.col("voucher")
    return sheets.voucher_sheet(t.vouchers.withColumns({"razon_social": F.when(k % 3 != 0, F.col("prioridad")), "motor": F.when(k % 2 == 0, F.lit("ocr")), "pagina": k % 12, "fecha_emision": F.col("fecha_texto")}))


@query("SNK-8", "SELECT CAST(sinad AS VARCHAR) AS expediente, CASE WHEN voucher % 4 = 0 THEN 'NULL' ELSE 'f' || CAST(voucher % 4 AS VARCHAR) || '.pdf' END AS archivo_pdf, CASE WHEN voucher % 12 = 0 THEN 'NULL' ELSE CAST(voucher % 12 AS VARCHAR) END AS pagina, 'NULL' AS region_id, ruc, CASE WHEN voucher % 3 = 0 THEN 'NULL' ELSE prioridad END AS proveedor, tipo AS tipo_comprobante, serie, numero, fecha_texto AS fecha, coalesce(CAST(total AS VARCHAR), 'NULL') AS total, CASE voucher % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'NULL' END AS confianza, CASE WHEN voucher % 5 = 0 THEN 'revisar' ELSE 'NULL' END AS observaciones FROM vouchers", "vouchers")
def _(t: Tables):
    k = F.col("voucher")
    given = {"expediente": F.col("sinad"), "archivo_pdf": F.when(k % 4 != 0, F.concat(F.lit("f"), (k % 4).cast("string"), F.lit(".pdf"))), "pagina": F.when(k % 12 != 0, k % 12), "region_id": F.lit(None).cast("string"), "proveedor": F.when(k % 3 != 0, F.col("prioridad")), "tipo_comprobante": F.col("tipo")}
    given |= {"fecha": F.col("fecha_texto"), "confianza": F.when(k % 3 == 0, "alta").when(k % 3 == 1, "media"), "observaciones": F.when(k % 5 == 0, "revisar")}
    return sheets.summary_sheet(t.vouchers.withColumns(given))


FIELD_SQL = "CASE WHEN valor IS NULL THEN '(abstención)' ELSE substr(valor, 1, 60) || CASE WHEN length(valor) > 60 THEN '...' ELSE '' END END"


@query(
    "SNK-3",
    f""", {ROUTES}, shown AS (SELECT sinad, status, confianza, accion, razon, alertas FROM routes)
        SELECT sinad, 'banner' AS seccion, 0 AS fila, status AS campo, confianza || ' | ' || accion AS valor FROM shown
        UNION ALL SELECT sinad, 'secciones', 0, 'alertas', CASE WHEN len(a) = 0 THEN '' ELSE array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' ... +' || (len(a) - 3) || ' más' ELSE '' END END FROM (SELECT sinad, CASE WHEN alertas = '' THEN [] ELSE string_split(alertas, ',') END AS a FROM shown)
        UNION ALL SELECT sinad, 'campos', CAST(row_number() OVER (PARTITION BY sinad ORDER BY voucher, campo) AS INT), campo, {FIELD_SQL} || ' | ' || CAST(CAST(confianza * 100 AS INT) AS VARCHAR) || '% | ' || status FROM judged WHERE razon IS NOT NULL
        UNION ALL SELECT sinad, 'pie', 0, 'metricas', 'celdas: ' || total || ', abstenidas: ' || abstenidos FROM stats""",
    "vouchers",
    "cells",
)
def _(t: Tables):
    stats = _stats(t)
    return sheets.diagnostic(E.routed(stats), E.judged(t.cells), stats)


@query("SNK-7", "SELECT CASE WHEN total IS NULL THEN 'bloques_descartados' ELSE 'comprobantes' END AS hoja, count(*) AS filas, CAST(sum(coalesce(total, 0)) AS DECIMAL(18,2)) AS total FROM vouchers GROUP BY 1", "vouchers")
def _(t: Tables):
    """Both sheets of a workbook, written and read back."""
    rows = t.vouchers.select("voucher", "ruc", "serie", "numero", "total")
    folder = readers.work_folder(t._spark, "workbook")
    readers.write_sheets({"comprobantes": rows.where("total is not null"), "bloques_descartados": rows.where("total is null")}, folder)
    read = [t._spark.read.schema(rows.schema).parquet(f"{folder}/{name}.parquet").withColumn("hoja", F.lit(name)) for name in ("comprobantes", "bloques_descartados")]
    return read[0].unionByName(read[1]).groupBy("hoja").agg(F.count("*").alias("filas"), F.sum(F.coalesce("total", F.lit(0))).cast("decimal(18,2)").alias("total"))
