"""Queries over documents, blocks and answers, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import classify as C
from ..operators import blocks as B
from ..operators import extract as X
from ..operators import hits as H
from ..operators import rules as R
from ..operators import validate as V
from ..sources import readers
from ..streaming import watch
from .cases import FINDINGS, PROFILES
from .pages import AMOUNT, CELLS_SQL, SCORED, SERIES_LIST, SERIES_SQL, TRIMMED, TYPE_SQL, block_rows, m, names, x
from .registry import Tables, query



@query("CLS-6", "SELECT page, CASE " + " ".join(f"WHEN {m('texto', p)} THEN '{k}'" for k, p in P.P3_PAGES) + f" WHEN {m('texto', 'ruc.*[0-9]{11}')} AND {m('texto', P.P3_MONEY)} THEN 'COMPROBANTE' ELSE 'OTRO' END AS tipo FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", R.answer_page_class(F.concat(F.lit("<|LOC_12|>"), F.col("texto"))).alias("tipo"))


@query(
    "EXT-17",
    f"SELECT page, regexp_extract_all(texto, '{P.P3_RUC}', 1)[1] AS ruc, nullif(regexp_extract(texto, '{P.P3_SERIES}', 1), '') AS serie_numero, nullif(regexp_extract(texto, '{P.P3_DATE}', 1), '') AS fecha, coalesce(regexp_extract_all(texto, 'S/?\\.?\\s*([\\d,]+\\.\\d{{2}})', 1)[-1], regexp_extract_all(texto, '{P.P3_MONEY}', 1)[-1]) AS total, {x('texto', P.P3_IGV)} AS igv FROM pages",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", R.answer_fields(F.col("texto")).alias("f")).select("page", "f.*")


KIND_SQL = "CASE WHEN contains(upper(texto), 'BOLETA') THEN 1 WHEN contains(upper(texto), 'FACTURA') THEN 1 ELSE 0 END"
POISON_SQL = f"CASE WHEN len({SERIES_LIST}) >= 2 THEN 'veneno_multiples_series_en_bloque' WHEN {m('texto', P.P2_QUERY_NOISE)} THEN 'veneno_consulta_sunat' END"
POINTS_SQL = f"({KIND_SQL} + CASE WHEN {SERIES_SQL} IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN regexp_matches(texto, '{P.P2_RUC}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(texto, '{P.P2_MONEY}') THEN 1 ELSE 0 END)"


@query(
    "CLS-12",
    f"SELECT page, motivo = 'comprobante_aceptado' AS aceptado, motivo, CASE WHEN motivo <> 'comprobante_aceptado' THEN 'N/A' WHEN puntos >= 4 THEN 'ALTA' WHEN puntos = 3 THEN 'MEDIA' ELSE 'BAJA' END AS nivel, puntos FROM (SELECT page, coalesce({POISON_SQL}, CASE WHEN {POINTS_SQL} < 2 THEN 'score_insuficiente_post_extraccion' ELSE 'comprobante_aceptado' END) AS motivo, CAST(CASE WHEN {POISON_SQL} IS NULL THEN {POINTS_SQL} ELSE 0 END AS INT) AS puntos FROM pages)",
    "pages",
)
def _(t: Tables):
    d = R.decision(F.col("texto"), S.extract(F.col("texto"), P.P2_RUC), C.series_number(F.col("texto")), S.extract(F.col("texto"), P.P2_MONEY), X.inferred_type(F.col("texto")))
    return t.pages.select("page", d.alias("d")).select("page", "d.*")


@query("CLS-14")
def _(t: Tables):
    return t.pages.select("page", R.recoverable(F.col("texto"), S.extract(F.col("texto"), P.P2_RUC)).alias("recuperable"))


@query("CLS-15")
def _(t: Tables):
    return block_rows(t).select("page", R.visibility(F.col("texto"), F.lit("pymupdf"), F.col("r")).alias("v")).select("page", "v.*")


@query("CLS-17")
def _(t: Tables):
    return block_rows(t).select("page", R.tags(F.col("texto"), F.col("r")).alias("observaciones"))


TITLE = "CASE doc_id % 6 WHEN 0 THEN 'Términos de referencia' WHEN 1 THEN 'TDR 5 y contrato N° 3' WHEN 2 THEN 'especificaciones técnicas, factura' WHEN 3 THEN 'currículo y diploma' ELSE 'nota' END"
KINDS_OF_TEXT = names(*[(" OR ".join(m("t", p) for p in ps), k) for k, ps in P.DOCUMENT_KINDS.items()])


@query("CLS-22", f"SELECT doc_id, {KINDS_OF_TEXT} AS tipos, {' OR '.join(m('head', p) for p in P.REFERENCE_TERMS)} AS es_tdr, doc_id = min(CASE WHEN {' OR '.join(m('head', p) for p in P.REFERENCE_TERMS)} THEN doc_id END) OVER (PARTITION BY source) AS primero FROM (SELECT doc_id, source, {TITLE} || ' ' || substr(text, 1, 5000) AS t, {TITLE} || ' ' || substr(text, 1, 2000) AS head FROM documents)")
def _(t: Tables):
    """Kinds of each document by its name and the head of its text, and the first terms of reference of each source."""
    docs = t.documents.select("doc_id", "source", "text", F.expr(TITLE).alias("name"))
    first = R.reference_document(docs, "source", "doc_id", "name", "text").select("source", F.col("doc_id").alias("first"))
    return docs.join(first, "source", "left").select("doc_id", R.document_kinds(F.col("name"), F.col("text")).alias("tipos"), R.is_reference(F.col("name"), F.col("text")).alias("es_tdr"), (F.col("doc_id") == F.col("first")).alias("primero"))


@query("CLS-23", "SELECT voucher, minimos, minimos AND coherente AS apto FROM (SELECT voucher, subtotal IS NOT NULL AND igv IS NOT NULL AND total IS NOT NULL AND items IS NOT NULL AND fecha IS NOT NULL AND voucher % 7 <> 0 AS minimos, coalesce(abs(items - subtotal) <= 0.02, false) AS coherente FROM vouchers)", "vouchers")
def _(t: Tables):
    """The six documents of an agreement, as columns of which some are null; coherent if the items make the subtotal."""
    given = dict(zip(R.AGREEMENT_DOCUMENTS, (F.col("subtotal"), F.col("igv"), F.col("total"), F.col("items"), F.col("fecha"), F.when(F.col("voucher") % 7 != 0, F.lit("x"))), strict=True))
    ready = R.agreement_ready(given, F.coalesce(F.abs(F.col("items") - F.col("subtotal")) <= 0.02, F.lit(False)))
    return t.vouchers.select("voucher", ready.alias("a")).select("voucher", "a.*")


@query("CLS-24", "SELECT voucher, 'NO_AUTORIZADO' AS monto_total, tipo AS categoria, 'NO_AUTORIZADO' AS el_ruc FROM vouchers", "vouchers")
def _(t: Tables):
    fields = R.guarded(F.create_map(F.lit("monto_total"), F.col("numero"), F.lit("categoria"), F.col("tipo"), F.lit("El_RUC"), F.col("ruc")))
    return t.vouchers.select("voucher", fields.alias("m")).select("voucher", *[F.col("m").getItem(a).alias(b) for a, b in (("monto_total", "monto_total"), ("categoria", "categoria"), ("El_RUC", "el_ruc"))])


@query("CLS-26", "SELECT voucher, campo FROM cells WHERE confianza < 0.80 AND valor IS NOT NULL", "cells")
def _(t: Tables):
    return t.cells.where((F.col("confianza") < 0.80) & F.col("valor").isNotNull()).select("voucher", "campo")


@query("EXT-4", f", {SCORED}, {CELLS_SQL} SELECT f.page, campo, valor FROM found f JOIN classed c ON c.page = f.page WHERE voucher_points >= 2 AND valor IS NOT NULL", "pages")
def _(t: Tables):
    points = S.let(C.page_signs(F.col("texto")), lambda seen: C.voucher_score(seen)[0])
    return t.pages.select("page", F.explode(R.minimal_voucher(F.col("texto"), points)).alias("c")).select("page", "c.campo", "c.valor")


@query("EXT-12", "SELECT voucher, 'cliente ' || sinad AS cliente, '20' || lpad(concat(sinad), 9, '0') AS cliente_ruc FROM vouchers", "vouchers")
def _(t: Tables):
    text = F.concat_ws("\n", F.lit("EMISOR"), F.concat(F.lit("Señores: cliente "), "sinad"), F.lit("Av. Lima"), F.concat(F.lit("R.U.C.: 20"), F.lpad(F.col("sinad").cast("string"), 9, "0")))
    return R.customer_section(t.vouchers.select("voucher", text.alias("t")), "voucher", "t")


FIRST_OF = lambda p: f"list_filter(list_transform(L, lambda l: CASE WHEN {m('l', p)} THEN {AMOUNT('l')} END), lambda v: v IS NOT NULL)[1]"
OTHER_LINE = " AND ".join(["length(l) >= 4", f"regexp_matches(l, '{P.P2_LINE_MONEY}')", *[f"NOT {m('l', p)}" for p in (P.SALE_VALUE, P.TAX_LINE, P.CONSUMPTION_CHARGE, P.SERVICE_CHARGE, P.BAG_TAX)], "NOT contains(upper(l), 'SUBTOTAL')", "NOT regexp_matches(upper(l), '\\bTOTAL\\b')"])


@query(
    "EXT-15",
    f"""SELECT page, {FIRST_OF(P.CONSUMPTION_CHARGE)} AS recargo_consumo, {FIRST_OF(P.SERVICE_CHARGE)} AS cargo_servicio, {FIRST_OF(P.BAG_TAX)} AS icbper,
        nullif(array_to_string(list_filter(L, lambda l: {OTHER_LINE})[1:10], ' | '), '') AS otros_cargos FROM (SELECT page, {TRIMMED} AS L FROM pages)""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", B.extra_charges(F.col("texto")).alias("c")).select("page", "c.*")


@query("EXT-19", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(CASE event_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.75 ELSE 0.45 END AS DECIMAL(4,2)) AS confianza FROM events")
def _(t: Tables):
    label = S.first_of((F.col("event_id") % 3 == 0, "Alta"), (F.col("event_id") % 3 == 1, "media"), default="?")
    return t.events.select("event_id", F.from_json("props", "k string")["k"].alias("k"), R.label_confidence(label).alias("confianza"))


SERVICES = [("037", ("transporte", "movilidad")), ("022", ("hotel", "hospedaje")), ("019", ("factura",))]


@query("EXT-21", "SELECT page, " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(texto), '{w}')" for w in words) + f" THEN '{code}'" for code, words in SERVICES) + " END AS servicio FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", R.annex_service(F.col("texto"), SERVICES).alias("servicio"))


SPOT_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'Operación sujeta al SPOT' WHEN 1 THEN 'sujeto a detracción, cuenta de detracciones 00-123-456789-012' WHEN 2 THEN 'detracción aplicada; constancia de depósito N° 12345' ELSE 'nada' END"


@query("EXT-22", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['SPOT_SIN_CUENTA', 'SPOT_SIN_CONSTANCIA'] WHEN 1 THEN ['SPOT_SIN_CONSTANCIA'] WHEN 2 THEN ['SPOT_SIN_CUENTA'] ELSE [] END AS hallazgos FROM documents")
def _(t: Tables):
    return _spot(t).select("doc_id", "hallazgos")


def _spot(t: Tables):
    text = F.expr(SPOT_TEXT)
    applies = S.any_of([S.matches(text, p) for p in P.SPOT_APPLIES])
    account = S.any_of([S.matches(text, p) for p in P.SPOT_ACCOUNT])
    receipt = S.any_of([S.matches(text, p) for p in P.SPOT_RECEIPT])
    return t.documents.select("doc_id", R.withholding(applies, account, receipt).alias("hallazgos"))


@query("EXT-25", "SELECT sinad, max(total) AS monto FROM vouchers WHERE total BETWEEN 100 AND 10000000 GROUP BY sinad", "vouchers")
def _(t: Tables):
    text = F.concat(F.lit("pago de S/ "), F.format_number("total", 2), F.lit(" y S/ 5.00"))
    return t.vouchers.select("sinad", R.largest_amount(text).alias("m")).groupBy("sinad").agg(F.max("m").alias("monto")).where("monto is not null")


@query("SCL-2", "SELECT voucher, CASE WHEN voucher % 3 = 0 THEN NULL ELSE tipo END AS texto FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.nonempty(F.when(F.col("voucher") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "tipo"))).alias("texto"))


@query("SCL-3", "SELECT voucher, abs(items - subtotal) <= 0.02 AS cerca FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.close_to(F.col("items"), F.col("subtotal"), 0.02).alias("cerca"))


@query("SCL-9", "SELECT voucher, CASE WHEN subtotal IS NULL OR igv IS NULL OR total IS NULL THEN ['ARITMETICA_INCOMPLETA'] WHEN abs(subtotal + igv - total) > 0.02 THEN ['ARITMETICA_INCONSISTENTE'] ELSE [] END AS flags FROM vouchers", "vouchers")
def _(t: Tables):
    a, b, c = (F.col(n) for n in ("subtotal", "igv", "total"))
    blank = a.isNull() | b.isNull() | c.isNull()
    return t.vouchers.select("voucher", S.flags((blank, "ARITMETICA_INCOMPLETA"), (F.coalesce(~S.close_to(a + b, c, 0.02), F.lit(False)), "ARITMETICA_INCONSISTENTE")).alias("flags"))


@query("SCL-11", "SELECT voucher, coalesce(arg_min(snippet, campo) FILTER (trim(snippet) <> ''), '') AS archivo FROM cells GROUP BY voucher", "cells")
def _(t: Tables):
    kept = S.nonempty(F.col("snippet")).isNotNull()
    return t.cells.groupBy("voucher").agg(F.coalesce(F.min_by(F.when(kept, F.col("snippet")), F.when(kept, F.col("campo"))), F.lit("")).alias("archivo"))


CANONICAL = "'{' || " + " || ',' || ".join(f"""'"{c}":' || coalesce('"' || CAST({c} AS VARCHAR) || '"', 'null')""" for c in ("igv", "ruc", "sinad", "total")) + " || '}'"


@query("SCL-14", f"SELECT voucher, sha256({CANONICAL}) AS hash FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", R.canonical_hash(["sinad", "ruc", "total", "igv"]).alias("hash"))


@query("JN-3", "SELECT voucher, CASE WHEN contains(tipo, 'BOLETA') THEN '03' WHEN contains(tipo, 'FACTURA') THEN '01' WHEN contains(tipo, 'RECIBO') THEN '02' END AS codigo FROM vouchers", "vouchers")
def _(t: Tables):
    kinds = t._spark.createDataFrame([("BOLETA", "03", 1), ("FACTURA", "01", 0), ("RECIBO", "02", 2)], "variante string, codigo string, prio int")
    near = F.contains(F.col("tipo"), F.col("variante")) | F.contains(F.col("variante"), F.col("tipo"))
    types = t.vouchers.select("tipo").distinct()  # few: match types, not vouchers
    code = types.join(F.broadcast(kinds), near, "left").groupBy("tipo").agg(F.min_by("codigo", "prio").alias("codigo"))
    return t.vouchers.join(code, "tipo").select("voucher", "codigo")


NEEDS_SQL = "needs AS (SELECT voucher, CASE WHEN voucher % 2 = 0 THEN 'CV' ELSE 'TITULO' END AS tipo FROM vouchers), have AS (SELECT voucher, CASE WHEN voucher % 3 = 0 THEN 'CV' ELSE 'TITULO_PROFESIONAL' END AS documento FROM vouchers)"
UNMET_SQL = f"{NEEDS_SQL}, unmet AS (SELECT voucher, tipo, CASE tipo WHEN 'CV' THEN 'CV' ELSE 'TITULO_PROFESIONAL' END AS documento FROM needs n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.voucher = n.voucher AND h.documento = CASE n.tipo WHEN 'CV' THEN 'CV' ELSE 'TITULO_PROFESIONAL' END))"


def _unmet(t: Tables):
    needs = t.vouchers.select("voucher", F.when(F.col("voucher") % 2 == 0, "CV").otherwise("TITULO").alias("tipo"))
    have = t.vouchers.select("voucher", F.when(F.col("voucher") % 3 == 0, "CV").otherwise("TITULO_PROFESIONAL").alias("documento"))
    return R.unmet(needs, have, "voucher")


@query("JN-4", f", {UNMET_SQL} SELECT voucher, tipo, documento FROM unmet", "vouchers")
def _(t: Tables):
    return _unmet(t)


@query("JN-5", "SELECT voucher, list_filter(['ruc_emisor', 'importe_total', 'igv_monto'], lambda c: NOT list_contains(campos, c)) AS faltan FROM (SELECT voucher, list(campo) FILTER (valor IS NOT NULL) AS campos FROM cells GROUP BY voucher)", "cells")
def _(t: Tables):
    have = t.cells.groupBy("voucher").agg(F.collect_set(F.when(F.col("valor").isNotNull(), F.col("campo"))).alias("campos"))
    return have.select("voucher", F.array_except(F.array(*map(F.lit, ("ruc_emisor", "importe_total", "igv_monto"))), "campos").alias("faltan"))


@query("JN-7", "SELECT v.voucher, v.fecha FROM vouchers v JOIN (SELECT sinad, min(fecha) AS a FROM vouchers GROUP BY sinad) p ON p.sinad = v.sinad AND v.fecha BETWEEN p.a - INTERVAL 1 DAY AND p.a + INTERVAL 61 DAY", "vouchers")
def _(t: Tables):
    trip = t.vouchers.groupBy("sinad").agg(F.min("fecha").alias("a"))
    return t.vouchers.join(trip, "sinad").where(F.col("fecha").between(F.date_sub("a", 1), F.date_add("a", 61))).select("voucher", "fecha")


@query("JN-9", "SELECT hash, arg_min(doc_id, doc_id) AS registro FROM (SELECT doc_id, sha256(text) AS hash FROM documents) GROUP BY hash")
def _(t: Tables):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("registro"))


@query("JN-10", "SELECT v.voucher, c.valor, CASE WHEN v.total IS NULL THEN 'SKIP_GT_NULL' WHEN c.valor IS NULL THEN 'NO_EXTRAIDO' ELSE 'MATCH' END AS resultado FROM vouchers v LEFT JOIN (SELECT voucher, valor FROM cells WHERE campo = 'importe_total' AND voucher % 4 <> 0) c USING (voucher)", "vouchers", "cells")
def _(t: Tables):
    from ..operators.resolve import compared

    got = t.cells.where("campo = 'importe_total' and voucher % 4 <> 0").select("voucher", "valor")
    return t.vouchers.join(got, "voucher", "left").select("voucher", "valor", compared(F.lit("total"), F.col("valor"), F.col("total").cast("string")).alias("resultado"))


@query("JN-11", " UNION ALL ".join(f"SELECT page, '{k}' AS regla FROM pages WHERE {' OR '.join(m('texto', p) for p in ps)}" for k, ps in P.VOUCHER_TYPES.items()), "pages")
def _(t: Tables):
    hits = S.flags(*[(S.any_of([S.matches(F.col("texto"), p) for p in ps]), k) for k, ps in P.VOUCHER_TYPES.items()])
    return t.pages.select("page", F.explode(hits).alias("regla"))


@query("JN-12", "SELECT voucher FROM vouchers WHERE voucher % 5 = 0", "vouchers")
def _(t: Tables):
    claims = t.vouchers.select("sinad", F.col("sinad").cast("string").alias("dni")).distinct()
    buyer = F.when(F.col("voucher") % 5 == 0, F.concat_ws("-", F.substring(F.col("sinad").cast("string"), 1, 1), F.substring(F.col("sinad").cast("string"), 2, 9))).otherwise("x")
    bought = t.vouchers.select("voucher", "sinad", F.translate(buyer, " -", "").alias("dni"))
    return bought.join(claims, ["sinad", "dni"]).select("voucher")


@query("V-9", f", {UNMET_SQL} SELECT tipo AS regla, 'MAYOR' AS nivel, count(*) AS n FROM unmet GROUP BY tipo UNION ALL SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['SPOT_SIN_CUENTA', 'SPOT_SIN_CONSTANCIA'] WHEN 1 THEN ['SPOT_SIN_CONSTANCIA'] WHEN 2 THEN ['SPOT_SIN_CUENTA'] ELSE [] END) AS regla, 'MAYOR', count(*) FROM documents GROUP BY 1", "vouchers")
def _(t: Tables):
    both = _unmet(t).select(F.col("tipo").alias("regla")).unionByName(_spot(t).select(F.explode("hallazgos").alias("regla")))
    return both.groupBy("regla", F.lit("MAYOR").alias("nivel")).agg(F.count("*").alias("n"))


LEVELLED = "CASE WHEN regla = 'VAL_TOTAL_ARITMETICA' AND voucher % 3 = 0 THEN 'CRITICA' ELSE nivel END"


@query("V-10", f", {FINDINGS} SELECT sinad, count_if({LEVELLED} = 'CRITICA') = 0 AS exito, count(*) AS n, CAST(count_if({LEVELLED} = 'CRITICA') AS BIGINT) AS criticas FROM findings GROUP BY sinad", "vouchers")
def _(t: Tables):
    """Some of the findings are critical here."""
    return V.agent_result(V.arithmetic_findings(t.vouchers).withColumn("nivel", F.expr(LEVELLED)))


@query("AGG-10", f"SELECT {TYPE_SQL} AS tipo, count(*) AS n FROM pages GROUP BY 1", "pages")
def _(t: Tables):
    return t.pages.groupBy(C.voucher_type(F.col("texto")).alias("tipo")).agg(F.count("*").alias("n"))


@query("WIN-4")
def _(t: Tables):
    return H.blocks_of_text(t.pages, "page", "texto", whole=True)


@query("GOV-2", "SELECT voucher FROM vouchers WHERE NOT (voucher % 3 = 0 AND voucher % 5 <> 0)", "vouchers")
def _(t: Tables):
    done = t.vouchers.where("voucher % 3 = 0").select("voucher", F.lit(True).alias("exito"), F.lit(True).alias("completo"), (F.col("voucher") % 5 == 0).alias("invalidado"))
    return R.reusable(t.vouchers.select("voucher"), done, ["voucher"])


@query("SRC-9", "SELECT line, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM boxes", "boxes")
def _(t: Tables):
    poly = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    side = lambda k: F.transform(poly, lambda p: p[k])
    return t.boxes.select("line", F.array_min(side(0)).alias("x0"), F.array_min(side(1)).alias("y0"), F.array_max(side(0)).alias("x1"), F.array_max(side(1)).alias("y1"))


@query("SRC-10", "SELECT page, arg_max(angulo, (palabras, conf, -angulo)) AS angulo FROM (SELECT page, CAST((line % 4) * 90 AS INT) AS angulo, count(*) AS palabras, max(conf) AS conf FROM boxes GROUP BY page, line % 4) GROUP BY page", "boxes")
def _(t: Tables):
    tried = t.boxes.groupBy("page", ((F.col("line") % 4) * 90).cast("int").alias("angulo")).agg(F.count("*").alias("palabras"), F.max("conf").alias("conf"))
    return tried.groupBy("page").agg(F.max_by("angulo", F.struct("palabras", "conf", -F.col("angulo"))).alias("angulo"))


@query("SRC-15", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 6 = 0 THEN 'NUEVO' WHEN o_orderkey % 5 = 0 THEN 'BORRADO' ELSE 'MODIFICADO' END AS cambio FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def _(t: Tables):
    from ..operators.custody import changed_files

    k = F.col("o_orderkey")
    before = t.orders.where(k % 6 != 0).select(k.alias("path"), F.lit(1).alias("v"))
    after = t.orders.where((k % 5 != 0) | (k % 6 == 0)).select(k.alias("path"), F.when(k % 7 == 0, 2).otherwise(1).alias("v"))
    return changed_files(before, after, "path", "v")


@query("SRC-11", "SELECT voucher, sinad, tipo, total FROM vouchers", "vouchers")
def _(t: Tables):
    """A round trip through JSON."""
    kind = "voucher long, sinad long, tipo string, total decimal(18,2), sobra string"
    shown = t.vouchers.select(F.to_json(F.struct("voucher", "sinad", "tipo", "total", F.lit(1).alias("desconocido"))).alias("j"))
    return shown.select(F.from_json("j", kind).alias("c")).select("c.voucher", "c.sinad", "c.tipo", "c.total")


VOUCHER_KINDS = '[{"tipo": "FACTURA", "codigo": "01", "tasa": 0.18}, {"tipo": "BOLETA DE VENTA", "codigo": "03", "tasa": 0.18}, {"tipo": "NOTA DE CREDITO", "codigo": "07", "tasa": 0.18}]'


@query("SRC-13", "SELECT v.voucher, v.tipo, k.codigo, k.tasa FROM vouchers v LEFT JOIN (VALUES ('FACTURA', '01', CAST(0.18 AS DECIMAL(4,2))), ('BOLETA DE VENTA', '03', 0.18), ('NOTA DE CREDITO', '07', 0.18)) k(tipo, codigo, tasa) ON k.tipo = v.tipo", "vouchers")
def _(t: Tables):
    """A dimension from its JSON file; types that it hasn't stay without a code."""
    folder = readers.work_folder(t._spark, "dimension")
    t._spark.createDataFrame([(VOUCHER_KINDS,)], "value string").coalesce(1).write.text(folder)
    kinds = readers.read_dimension(t._spark, folder, "tipo string, codigo string, tasa decimal(4,2)")
    return t.vouchers.select("voucher", "tipo").join(kinds, "tipo", "left").select("voucher", "tipo", "codigo", "tasa")


@query("SNK-2", "SELECT voucher, CASE WHEN voucher % 2 = 0 THEN 'verificado' END AS estado FROM vouchers", "vouchers")
def _(t: Tables):
    events = t.vouchers.where("voucher % 2 = 0").select("voucher", F.explode(F.array(F.struct(F.lit(1).alias("orden"), F.lit("pendiente").alias("estado")), F.struct(F.lit(2).alias("orden"), F.lit("verificado").alias("estado")))).alias("e")).select("voucher", "e.*")
    return readers.latest_state(t.vouchers.select("voucher"), events, "voucher", "orden", ["estado"]).select("voucher", "estado")


@query("SNK-10", "SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z0-9_\\-.]+', '_', 'g'), 1, 120) AS nombre FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", S.slug(F.col("text")).alias("nombre"))


@query("SNK-6", f", {FINDINGS} SELECT regla, nivel, count(*) AS n FROM findings GROUP BY regla, nivel", "vouchers")
def _(t: Tables):
    return V.arithmetic_findings(t.vouchers).groupBy("regla", "nivel").agg(F.count("*").alias("n"))


@query("SNK-9", f"SELECT perfil, grupo, clave, umbral FROM ({PROFILES})")
def _(t: Tables):
    """All thresholds through their JSON and back."""
    from ..operators.resolve import profiles

    shown = profiles(t._spark).groupBy("perfil").agg(F.to_json(F.collect_list(F.struct("grupo", "clave", "umbral"))).alias("j"))
    return shown.select("perfil", F.explode(F.from_json("j", "array<struct<grupo:string,clave:string,umbral:decimal(6,2)>>")).alias("u")).select("perfil", "u.*")


@query("STR-1", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS desde, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables):
    return watch.counts_by_window(t.events, "ts", ["event_type"], "6 hours").select("desde", "event_type", "n")


@query("STR-2", "SELECT user_id, count(DISTINCT s) AS sesiones, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id")
def _(t: Tables):
    return watch.sessions(t.events, "ts", "user_id", "10 hours").groupBy("user_id").agg(F.count("*").alias("sesiones"), F.sum("n").alias("n"))


# -- sources and sinks with plug-ins --------------------------------------------


@query("SRC-1", "SELECT conv_id, count(*) AS paginas, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS texto, CAST(length(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS BIGINT) AS chars, CAST(len(list_filter(string_split_regex(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '\\s+'), lambda w: w <> '')) AS BIGINT) AS palabras FROM conversations GROUP BY conv_id")
def _(t: Tables):
    """Conversations as documents, their turns as pages."""
    return readers.document_texts(t.conversations, "conv_id", "turn", "text")


def _failing(image: dict) -> list:
    if image["k"] % 3 == 0:
        raise RuntimeError("no engine")
    return [(image["texto"] + "!", 0.0, 0.0, 1.0, 1.0, 0.9)]


def _fallback(image: dict) -> list:
    if image["k"] % 6 == 0:
        raise RuntimeError("no engine")
    return [(line, 0.0, float(n), 1.0, n + 1.0, 0.5) for n, line in enumerate((image["texto"], "fin"))]


ENGINES = {"primero": _failing, "segundo": _fallback}


def _images(t: Tables):
    """Turns of conversations as images that a made-up engine reads; some fail."""
    return t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.col("conv_id") * 7 + F.col("turn")).alias("k"), F.coalesce(F.left("text", F.lit(20)), F.lit("")).alias("texto"))


READ = "images AS (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INT) AS page, conv_id * 7 + turn AS k, coalesce(left(text, 20), '') AS t FROM conversations), read AS (SELECT doc, page, 0 AS line_no, CASE WHEN k % 3 <> 0 THEN t || '!' WHEN k % 6 <> 0 THEN t END AS texto, CASE WHEN k % 3 <> 0 THEN 0.9 WHEN k % 6 <> 0 THEN 0.5 ELSE 0.0 END AS confianza, CASE WHEN k % 3 <> 0 THEN 'primero' WHEN k % 6 <> 0 THEN 'segundo' END AS motor FROM images UNION ALL SELECT doc, page, 1, 'fin', 0.5, 'segundo' FROM images WHERE k % 3 = 0 AND k % 6 <> 0)"


@query("SRC-7", f"WITH {READ} SELECT doc, page, CAST(line_no AS INT) AS line_no, texto, CAST(confianza AS DOUBLE) AS confianza, motor FROM read")
def _(t: Tables):
    return readers.ocr_lines(_images(t), ENGINES).select("doc", "page", "line_no", "texto", "confianza", "motor")


@query("SRC-2", f"WITH {READ}, few AS (SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM images) WHERE n <= 3) SELECT doc, coalesce(string_agg(texto, chr(10) ORDER BY page, line_no), '') AS texto, round(avg(CASE WHEN texto IS NOT NULL THEN CAST(confianza AS DOUBLE) END), 4) AS confianza, count(DISTINCT page) AS muestra FROM read JOIN few USING (doc, page) GROUP BY doc")
def _(t: Tables):
    """Each document's first pages; the sample is the operator's own rule."""
    return readers.sampled_ocr(_images(t), ENGINES).select("doc", "texto", "confianza", "muestra")


@query("SRC-14")
def _(t: Tables):
    """The tables' own files, in the order of their names."""
    found = readers.scan_folder(t._spark, t._dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("archivo"), "bytes")
    return found.orderBy("archivo")


def _answer(prompt: str) -> str:
    k = int(prompt)
    if k % 4 == 0:
        raise ConnectionError("refused")
    return "no json" if k % 4 == 1 else f'{{"k": {k}}}'


@query("SRC-18", "SELECT item_id AS id, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no json' ELSE '{\"k\": ' || item_id || '}' END AS answer, CASE item_id % 4 WHEN 0 THEN 'connection: refused' WHEN 1 THEN 'json corrupto' END AS error, CAST(CASE item_id % 4 WHEN 1 THEN 3 ELSE 1 END AS INT) AS tries FROM benchmark")
def _(t: Tables):
    """A made-up model: it refuses some prompts and answers others badly."""
    asked = t.benchmark.select(F.col("item_id").alias("id"), F.col("item_id").cast("string").alias("prompt"))
    return readers.model_answers(asked, _answer).select("id", "answer", "error", "tries")


@query("SNK-1", "SELECT CAST(ts AS DATE) AS dia, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS suma FROM events GROUP BY 1")
def _(t: Tables):
    """The log, appended as JSON lines in two goes, and read back by day."""
    folder, entries = readers.work_folder(t._spark, "log"), t.events.select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"))
    for half in (0, 1):
        readers.append_log(entries.where(F.col("event_id") % 2 == half), folder)
    back = readers.read_log(t._spark, folder, "event_id long, timestamp timestamp, operation string, date date")
    return back.groupBy(F.col("date").alias("dia")).agg(F.count("*").alias("n"), F.sum("event_id").alias("suma"))
