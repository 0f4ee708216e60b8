"""Queries over page texts: sources, classification, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import blocks as B
from ..operators import classify as C
from ..operators import extract as X
from ..operators import hits as H
from .registry import Tables, query


def m(text: str, pattern: str) -> str:
    """A match in the SQL of the comparison, ignoring case."""
    return f"regexp_matches({text}, '(?i){quoted(pattern)}')"


def x(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '(?i){quoted(pattern)}', {group}), '')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def total(*terms: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {n} ELSE 0 END" for cond, n in terms)


def names(*terms: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in terms) + "], lambda s: s IS NOT NULL)"


NORM = "translate(trim(regexp_replace(lower(coalesce(texto, '')), '\\s+', ' ', 'g')), 'áéíóúüñàèìòùâêîôûäëïöç', 'aeiouunaeiouaeiouaeioc')"
STRUCTURE = "(CASE WHEN contains(n, 'cant') AND (contains(n, 'unid') OR contains(n, 'und')) THEN 1 ELSE 0 END + CASE WHEN contains(n, 'descripc') THEN 1 ELSE 0 END + CASE WHEN contains(n, 'op. gravada') OR contains(n, 'op gravada') OR contains(n, 'op.exonerada') OR contains(n, 'op exonerada') OR contains(n, 'op inafecta') THEN 1 ELSE 0 END + CASE WHEN contains(n, 'importe total') OR contains(n, 'subtotal') THEN 1 ELSE 0 END + CASE WHEN contains(n, 'valor venta') THEN 1 ELSE 0 END) >= 2"
TOTALS = "(" + " OR ".join([m("n", P.TOTAL_CONTEXT), *[m("n", p) for p in P.AMOUNT_BY_TOTAL]]) + ")"
LINES = "list_filter(list_transform(string_split(coalesce(texto, ''), chr(10)), lambda l: trim(l)), lambda l: l <> '')"
PORTAL = (
    ("contains(n, 'consulta de comprobante')", 2, "sunat.consulta_de_comprobante(+2)"),
    ("NOT contains(n, 'consulta de comprobante') AND contains(n, 'consulta') AND contains(n, 'comprobante')", 1, "sunat.consulta_y_comprobante_separados(+1)"),
    ("contains(n, 'resultado de la consulta')", 2, "sunat.resultado_de_la_consulta(+2)"),
    (f"contains(n, 'sunat') AND {m('n', P.VALID_STATE)}", 2, "sunat.sunat_y_estado_valido(+2)"),
    (f"NOT ({STRUCTURE})", 1, "sunat.ausencia_estructura_comprobante(+1)"),
    ("contains(n, 'sunat') AND (contains(n, 'resultado de la consulta') OR contains(n, 'consulta de comprobante'))", 1, "sunat.presencia_portal(+1)"),
)
VOUCHER = (
    (m("n", P.VALID_SERIES), 2, "comprobante.serie_valida(+2)"),
    (f"{m('texto', P.RUC_MARK)} AND {TOTALS}", 1, "comprobante.ruc_y_total(+1)"),
    (STRUCTURE, 1, "comprobante.estructura_items_totales(+1)"),
    (f"len({LINES}) BETWEEN 3 AND 28 AND {m('n', P.VALID_SERIES)} AND {TOTALS}", 1, "comprobante.ticket_termico(+1)"),
)
SCORED = f"""scored AS (SELECT page, texto, n, CASE WHEN n = '' THEN 0 ELSE {total(*[(c, k) for c, k, _ in PORTAL])} END AS portal, CASE WHEN n = '' THEN 0 ELSE {total(*[(c, k) for c, k, _ in VOUCHER])} END AS voucher_points,
    CASE WHEN n = '' THEN ['vacio.sin_texto'] ELSE list_concat({names(*[(c, s) for c, _, s in PORTAL])}, {names(*[(c, s) for c, _, s in VOUCHER])}) END AS signs FROM (SELECT page, texto, {NORM} AS n FROM pages)),
    classed AS (SELECT *, CASE WHEN n = '' THEN 'OTROS' WHEN portal >= 3 THEN 'SUNAT_VALIDACION' WHEN voucher_points >= 2 AND portal < 2 THEN 'COMPROBANTE' ELSE 'OTROS' END AS tipo FROM scored)"""


@query("CLS-1", f"SELECT page, {NORM} AS clave FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", S.normal_key(F.col("texto")).alias("clave"))


def _scored(t: Tables, of):
    score, signs = of(F.col("seen"))
    return t.pages.select("page", C.page_signs(F.col("texto")).alias("seen")).where("not seen.blank").select("page", score.alias("score"), signs.alias("senales"))


@query("CLS-2", f", {SCORED} SELECT page, portal AS score, list_filter(signs, lambda s: starts_with(s, 'sunat')) AS senales FROM classed WHERE n <> ''", "pages")
def _(t: Tables):
    return _scored(t, C.portal_score)


@query("CLS-3", f", {SCORED} SELECT page, voucher_points AS score, list_filter(signs, lambda s: starts_with(s, 'comprobante')) AS senales FROM classed WHERE n <> ''", "pages")
def _(t: Tables):
    return _scored(t, C.voucher_score)


@query("CLS-4", f", {SCORED} SELECT page, tipo, tipo = 'COMPROBANTE' AS pasa, portal AS score_sunat, voucher_points AS score_comprobante, signs AS senales FROM classed", "pages")
def _(t: Tables):
    return t.pages.select("page", C.page_class(F.col("texto")).alias("c")).select("page", "c.*")


SERIES_SQL = "coalesce(" + ", ".join(f"CASE WHEN {x('texto', p)} IS NOT NULL THEN upper({x('texto', p)}) || '-' || regexp_replace(regexp_replace({x('texto', p, 2)}, '^0+', ''), '^$', '0') END" for p in (P.P2_SERIES, P.P2_SERIES_LOOSE)) + ")"


@query(
    "CLS-5",
    f"""SELECT page, CASE WHEN texto IS NULL OR length(trim(regexp_replace(texto, '^\\s+|\\s+$', '', 'g'))) < 25 THEN 'OTRO'
        WHEN contains(upper(texto), 'DECLARACION') AND contains(upper(texto), 'JURADA') THEN 'DJ'
        WHEN regexp_matches(upper(texto), '\\bANEXO\\s*N') OR starts_with(ltrim(upper(texto)), 'ANEXO') THEN 'ANEXO'
        WHEN {SERIES_SQL} IS NULL AND {m('texto', P.P2_QUERY_RUC)} AND {m('texto', P.P2_TAXPAYER)} THEN 'SUNAT'
        WHEN (contains(upper(texto), 'FACTURA') OR contains(upper(texto), 'BOLETA')) AND contains(upper(texto), 'RUC') AND contains(upper(texto), 'TOTAL') AND {SERIES_SQL} IS NOT NULL THEN 'COMPROBANTE_REAL' ELSE 'OTRO' END AS tipo FROM pages""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", C.block_page_class(F.col("texto")).alias("tipo"))


TYPE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(m('texto', p) for p in ps)} THEN '{k}'" for k, ps in P.VOUCHER_TYPES.items()) + f" ELSE '{P.OTHER_TYPE}' END"


@query("CLS-7", f"SELECT page, {TYPE_SQL} AS tipo FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", C.voucher_type(F.col("texto")).alias("tipo"))


HITS_SQL = total(*[(m("texto", p), 1) for p in P.VOUCHER_KEYWORDS])


@query("CLS-8", f", {SCORED} SELECT page, {HITS_SQL} AS aciertos FROM classed WHERE tipo <> 'SUNAT_VALIDACION' AND {HITS_SQL} >= 2", "pages")
def _(t: Tables):
    return t.pages.where(C.is_candidate(F.col("texto"))).select("page", C.keyword_hits(F.col("texto")).alias("aciertos"))


# The SQL of the block extractor's rules, over a list L of trimmed lines.
TRIMMED = "list_transform(string_split(coalesce(texto, ''), chr(10)), lambda l: trim(l))"
AMOUNT = lambda l: f"regexp_extract_all({l}, '{P.P2_LINE_MONEY}', 1)[-1]"


def number(v: str) -> str:
    """The last . or , is the decimal sign."""
    digits, decimals = f"regexp_replace({v}, '[.,]', '', 'g')", f"length(regexp_extract({v}, '[.,](\\d+)$', 1))"
    return f"CASE WHEN regexp_matches({v}, '[.,]') THEN left({digits}, length({digits}) - {decimals}) || '.' || right({digits}, {decimals}) ELSE {v} END"


IS_ITEM = r"length(l) >= 3 AND NOT regexp_matches(upper(l), '\\bTOTAL\\b|\\bSUBTOTAL\\b|\\bIGV\\b|\\bI\\.?\\s*G\\.?\\s*V\\.?\\b') AND NOT regexp_matches(l, '^[\\d\\s.,\\-]+$')".replace("\\\\", "\\")
ITEMS = f"""lined AS (SELECT page, texto, {TRIMMED} AS L FROM pages),
    headed AS (SELECT *, coalesce(list_position(list_transform(L, lambda l: {m('l', P.ITEM_HEADER)}), true), 0) AS h FROM lined),
    windowed AS (SELECT *, CASE WHEN h > 0 THEN L[h + 1 : h + 45] ELSE [] END AS w FROM headed),
    stopped AS (SELECT *, coalesce(nullif(list_position(list_transform(w, lambda l: {m('l', P.ITEM_STOP)}), true), 0), 46) AS s FROM windowed),
    kept AS (SELECT *, list_filter(w[1 : s - 1], lambda l: l <> '' AND NOT regexp_matches(l, '{P.RULED_LINE}')) AS k FROM stopped),
    cleaned AS (SELECT *, list_filter(k, lambda l: {IS_ITEM}) AS c FROM kept),
    itemized AS (SELECT *, CASE WHEN len(k) > 0 THEN array_to_string(CASE WHEN len(c) > 0 THEN c ELSE k END, ' | ') END AS items, len(k) > 0 AND len(c) = 0 AS crudo FROM cleaned)"""
KINDS_SQL = names(*[(m("blob", p), kind) for p, kind in ((P.P2_FOOD, "ALIMENTACION"), (P.P2_TRANSPORT, "TRANSPORTE"), (P.P2_LODGING, "HOSPEDAJE"))])
MIDDLE = "CASE WHEN len(L) < 10 THEN texto ELSE array_to_string(L[greatest(CAST(floor(len(L) * 0.2) AS INT), 1) + 1 : least(CAST(floor(len(L) * 0.8) AS INT), len(L))], chr(10)) END"


@query("CLS-9", f", {ITEMS} SELECT page, CASE WHEN len({KINDS_SQL}) = 1 THEN ({KINDS_SQL})[1] END AS tipo_gasto, items IS NOT NULL AND {m('coalesce(items, chr(1))', P.P2_ALCOHOL)} AS alcohol FROM (SELECT page, items, coalesce(items, {MIDDLE}) AS blob FROM itemized)", "pages")
def _(t: Tables):
    return t.pages.select("page", B.expense(F.col("texto"), C.expense_kind).alias("g")).select("page", "g.*")


SOURCE_SQL = "CASE voucher % 3 WHEN 0 THEN 'pymupdf' WHEN 1 THEN 'ocr' ELSE 'otro' END"
STATE_SQL = "CASE WHEN fuente IN ('ocr', 'debil', 'vacio', 'error_ocr') THEN 'OCR_DUDOSO' WHEN igv IS NOT NULL AND subtotal IS NOT NULL AND total IS NOT NULL AND noches IS NOT NULL THEN 'COMPLETO' WHEN subtotal IS NOT NULL AND igv IS NULL AND total IS NULL THEN 'DESCARTADO' ELSE 'PARCIAL' END"


def _sourced(t: Tables):
    source = F.when(F.col("voucher") % 3 == 0, "pymupdf").when(F.col("voucher") % 3 == 1, "ocr").otherwise("otro")
    return t.vouchers.withColumn("fuente", source)


ROW = [F.col, ("igv", "subtotal", "total", "noches")]


@query("CLS-10", f"SELECT voucher, {STATE_SQL} AS estado FROM (SELECT *, {SOURCE_SQL} AS fuente FROM vouchers)", "vouchers")
def _(t: Tables):
    cols = [F.col(c) for c in ROW[1]]
    return _sourced(t).select("voucher", C.row_state(*cols, F.col("fuente")).alias("estado"))


@query(
    "CLS-11",
    f"""SELECT voucher, CAST(round(least(CASE estado WHEN 'COMPLETO' THEN b + 0.08 WHEN 'PARCIAL' THEN b + 0.04 WHEN 'OCR_DUDOSO' THEN b * 0.85 ELSE least(b, 0.38) END, 1), 3) AS DECIMAL(6,3)) AS confianza FROM
        (SELECT voucher, {STATE_SQL} AS estado, CAST(CASE WHEN igv IS NOT NULL THEN 0.22 ELSE 0 END + CASE WHEN subtotal IS NOT NULL THEN 0.22 ELSE 0 END + CASE WHEN total IS NOT NULL THEN 0.22 ELSE 0 END + CASE WHEN noches IS NOT NULL THEN 0.18 ELSE 0 END
         + CASE WHEN fuente = 'pymupdf' THEN 0.16 WHEN fuente = 'ocr' THEN 0.10 ELSE 0.06 END AS DECIMAL(9,6)) AS b FROM (SELECT *, {SOURCE_SQL} AS fuente FROM vouchers))""",
    "vouchers",
)
def _(t: Tables):
    cols = [F.col(c) for c in ROW[1]]
    return _sourced(t).select("voucher", C.row_confidence(*cols, F.col("fuente"), C.row_state(*cols, F.col("fuente"))).alias("confianza"))


SERIES_LIST = "list_distinct(list_concat(" + ", ".join(f"list_transform(range(1, len(regexp_extract_all(texto, '(?i){p}', 1)) + 1), lambda i: upper(regexp_extract_all(texto, '(?i){p}', 1)[i]) || '-' || regexp_replace(regexp_replace(regexp_extract_all(texto, '(?i){p}', 2)[i], '^0+', ''), '^$', '0'))" for p in (P.P2_SERIES, P.P2_SERIES_LOOSE)) + "))"


@query(
    "CLS-13",
    f"SELECT page, CASE WHEN len({SERIES_LIST}) >= 2 THEN 'VARIAS_SERIES' WHEN {m('texto', P.P2_QUERY_NOISE)} THEN 'CONSULTA_SUNAT' WHEN starts_with(texto, 'ANEXO') AND len({LINES}) >= 8 AND len(list_filter({LINES}, lambda l: regexp_matches(l, '\\d+[.,]\\d{{2}}'))) >= 5 THEN 'ANEXO_TABLA' END AS veneno FROM pages",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", C.poison(F.col("texto"), F.startswith(F.col("texto"), F.lit("ANEXO"))).alias("veneno"))


@query(
    "CLS-16",
    f"""SELECT page, CASE WHEN length(trim(texto)) < 30 THEN 'bloque_muy_corto' WHEN {m('texto', P.P2_QUERY_NOISE)} THEN 'patron_sunat_consulta' WHEN len({SERIES_LIST}) >= 2 THEN 'multiples_series_tabla'
        WHEN {m('texto', P.P2_LIST_NOISE)} THEN 'patron_anexo_listado' WHEN {SERIES_SQL} IS NULL THEN 'sin_serie_numero_valida' WHEN NOT regexp_matches(texto, '{P.P2_RUC}') THEN 'sin_ruc_11_digitos'
        WHEN NOT regexp_matches(upper(texto), '\\b(TOTAL|IMPORTE|MONTO)\\b') THEN 'sin_total_importe_o_monto' ELSE 'ok' END AS motivo FROM pages""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", C.block_check(F.col("texto")).alias("motivo"))


@query(
    "CLS-19",
    "SELECT doc_id, CASE WHEN contains(m, 'json') THEN 'json_corrupto' WHEN contains(m, 'timeout') OR contains(m, 'timed out') THEN 'timeout' WHEN contains(m, 'connection') OR contains(m, 'conexion') OR contains(m, 'urlopen') THEN 'conexion' WHEN contains(m, 'empty') OR contains(m, 'vacía') OR contains(m, 'vacia') THEN 'respuesta_vacia' WHEN contains(m, 'not found') OR contains(m, 'no disponible') THEN 'modelo_no_disponible' ELSE 'error_inesperado' END AS razon FROM (SELECT doc_id, lower(CASE doc_id % 6 WHEN 0 THEN 'JSON corrupto en la respuesta' WHEN 1 THEN 'Request timed out' WHEN 2 THEN 'urlopen error' WHEN 3 THEN 'Respuesta vacía' WHEN 4 THEN 'model not found' ELSE text END) AS m FROM documents)",
)
def _(t: Tables):
    k = F.col("doc_id") % 6
    message = S.first_of((k == 0, "JSON corrupto en la respuesta"), (k == 1, "Request timed out"), (k == 2, "urlopen error"), (k == 3, "Respuesta vacía"), (k == 4, "model not found"), default=F.col("text"))
    return t.documents.select("doc_id", C.model_failure(message).alias("razon"))


@query("CLS-20", "SELECT voucher, campo, CASE WHEN confianza >= 0.70 THEN 'verde' WHEN confianza >= 0.40 THEN 'amarillo' ELSE 'rojo' END AS color FROM cells", "cells")
def _(t: Tables):
    return t.cells.select("voucher", "campo", C.confidence_colour(F.col("confianza")).alias("color"))


@query("CLS-21", "SELECT voucher, campo, CASE WHEN confianza >= 0.9 THEN 'HIGH' WHEN confianza >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS nivel FROM cells", "cells")
def _(t: Tables):
    return t.cells.select("voucher", "campo", C.confidence_level(F.col("confianza")).alias("nivel"))


@query(
    "CLS-25",
    "SELECT page_id, CASE WHEN p IS NULL OR trim(p) = '' THEN 'RUTA_VACIA' WHEN length(p) > 500 THEN 'RUTA_MUY_LARGA' WHEN list_contains(string_split_regex(p, '[/\\\\]'), '..') THEN 'RUTA_CON_RETROCESO' WHEN lower(regexp_extract(p, '\\.[^./\\\\]+$')) NOT IN ('.html', '.pdf') THEN 'EXTENSION_NO_PERMITIDA' END AS error FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '../' || url WHEN page_id % 7 = 0 THEN ' ' ELSE url END AS p FROM pages)",
)
def _(t: Tables):
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "url")).when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("url"))
    return t._spark.read.parquet(f"{t._dir}/pages.parquet").select("page_id", C.unsafe_path(path, (".html", ".pdf")).alias("error"))


# -- sources ------------------------------------------------------------------


@query(
    "SRC-3",
    "SELECT doc_id, CASE WHEN length(text) >= 200 AND n >= 30 THEN 'direct_text' WHEN doc_id % 100 / 100.0 >= 0.60 AND doc_id % 50 >= 20 THEN 'ocr' ELSE 'manual_review' END AS metodo, concat_ws(' | ', CASE WHEN length(text) < 200 THEN 'chars ' || length(text) END, CASE WHEN n < 30 THEN 'palabras ' || n END) AS razon FROM (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)",
)
def _(t: Tables):
    g = X.gated_method(F.col("text"), F.col("doc_id") % 100 / 100, F.col("doc_id") % 50)
    return t.documents.select("doc_id", g.alias("g")).select("doc_id", "g.*")


@query("SRC-4", "SELECT doc_id, CASE WHEN length(text) >= length(coalesce(source, '')) THEN 'pymupdf' ELSE 'pdfplumber' END AS fuente, greatest(length(text), length(source)) < 40 AS debil FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.when(F.length("text") >= F.length(F.coalesce("source", F.lit(""))), "pymupdf").otherwise("pdfplumber").alias("fuente"), (F.greatest(F.length("text"), F.length("source")) < 40).alias("debil"))


@query("SRC-5", "SELECT page, CASE WHEN length(trim(texto)) >= 100 THEN 'digital' ELSE 'image' END AS capa FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", F.when(F.length(F.trim("texto")) >= 100, "digital").otherwise("image").alias("capa"))


@query("SRC-17", "SELECT resultado, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 8 THEN 'FALLO_OCR' WHEN (event_id * 3 + length(props)) % 8 = 0 THEN 'ESCANEADO_PROCESADO' WHEN (event_id * 3 + length(props)) % 8 = 6 THEN 'NATIVO_DIGITAL' ELSE 'FALLO_OCR' END AS resultado FROM events) GROUP BY resultado")
def _(t: Tables):
    """Exit codes (of a process that some never started) and what they mean."""
    code = F.when(F.col("event_id") % 9 != 8, (F.col("event_id") * 3 + F.length("props")) % 8)
    return t.events.groupBy(C.preprocessor_outcome(code).alias("resultado")).agg(F.count("*").alias("n"))


# -- extraction ---------------------------------------------------------------

RUC_SQL = f"list_filter(list_concat(regexp_extract_all(texto, '(?i){P.RUC}', 1), regexp_extract_all(texto, '(?i){P.RUC}', 2)), lambda r: r <> '')[1]"
SN_SQL = f"CASE WHEN {x('texto', P.SERIES_NUMBER)} IS NOT NULL THEN upper({x('texto', P.SERIES_NUMBER)}) || '-' || {x('texto', P.SERIES_NUMBER, 2)} END"
FIELDS = (
    ("ruc_emisor", RUC_SQL, "0.80"),
    ("fecha_emision", f"coalesce({x('texto', P.ISSUE_DATE)}, {x('texto', P.ANY_DATE)})", f"CASE WHEN {x('texto', P.ISSUE_DATE)} IS NOT NULL THEN 0.85 ELSE 0.60 END"),
    ("serie_numero", SN_SQL, "0.85"),
    ("tipo_comprobante", f"nullif({TYPE_SQL}, '{P.OTHER_TYPE}')", "0.90"),
    ("importe_total", f"replace({x('texto', P.TOTAL)}, ',', '')", "0.80"),
    ("igv_monto", f"replace({x('texto', P.IGV)}, ',', '')", "0.80"),
    ("subtotal", f"replace({x('texto', P.SUBTOTAL)}, ',', '')", "0.80"),
)
CELLS_SQL = "found AS (" + " UNION ALL ".join(f"SELECT page, texto, '{name}' AS campo, {value} AS valor, CAST({conf} AS DECIMAL(4,2)) AS confianza FROM pages" for name, value, conf in FIELDS) + ")"


def _cells(t: Tables):
    text = F.col("texto")
    return t.pages.select("page", F.explode(X.fields(text, C.voucher_type(text))).alias("c")).select("page", "c.*")


@query("EXT-1", f", {CELLS_SQL} SELECT page, campo, valor, confianza FROM found WHERE valor IS NOT NULL", "pages")
def _(t: Tables):
    return _cells(t).select("page", "campo", "valor", "confianza")


@query("EXT-2", f", {CELLS_SQL} SELECT page, campo, CASE WHEN campo = 'tipo_comprobante' OR instr(texto, valor) = 0 THEN '' ELSE substr(texto, greatest(instr(texto, valor) - 30, 1), instr(texto, valor) - greatest(instr(texto, valor) - 30, 1) + length(valor) + 30) END AS snippet FROM found WHERE valor IS NOT NULL", "pages")
def _(t: Tables):
    return _cells(t).select("page", "campo", "snippet")


EXPECTED_SQL = "CASE tipo " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in P.EXPECTED_FIELDS.items()) + " END"


@query(
    "EXT-3",
    f""", {CELLS_SQL}, per AS (SELECT page, {TYPE_SQL} AS tipo FROM pages), have AS (SELECT page, list(campo) AS campos FROM found WHERE valor IS NOT NULL GROUP BY page),
        e AS (SELECT per.page, {EXPECTED_SQL} AS esperados, coalesce(campos, []) AS campos FROM per LEFT JOIN have USING (page)),
        f AS (SELECT page, CAST((len(esperados) - len(list_filter(esperados, lambda c: NOT list_contains(campos, c)))) / len(esperados) AS DECIMAL(6,4)) AS score, list_filter(esperados, lambda c: NOT list_contains(campos, c)) AS faltantes FROM e)
        SELECT page, score, faltantes, CASE WHEN score >= 0.60 THEN 'alta' WHEN score >= 0.40 THEN 'media' ELSE 'escalar' END AS decision FROM f""",
    "pages",
)
def _(t: Tables):
    text = F.col("texto")
    found = F.transform(X.fields(text, C.voucher_type(text)), lambda c: c["campo"])
    return t.pages.select("page", X.sufficiency(C.voucher_type(text), found).alias("s")).select("page", "s.*")


@query("EXT-6", f"SELECT page, {SERIES_SQL} AS serie_numero FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", C.series_number(F.col("texto")).alias("serie_numero"))


@query("EXT-5")
def _(t: Tables):
    return block_rows(t).select("page", "r.*")


def block_rows(t: Tables):
    dated = t.pages.select("page", "texto", H.issue_date(F.col("texto")).alias("fecha"))
    return dated.select("page", "texto", X.block_row(F.col("texto"), F.lit("pymupdf"), F.col("fecha")).alias("r"))


@query(
    "EXT-7",
    f""", l AS (SELECT page, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM pages), n AS (SELECT *, lead(line) OVER (PARTITION BY page ORDER BY i) AS next FROM l),
        c AS (SELECT page, i, coalesce({x('line', P.P2_RUC)}, {x("coalesce(next, '')", P.P2_RUC)}) AS r FROM n WHERE i <= 35 AND regexp_matches(line, '(?i)\\bR\\.?\\s*U\\.?\\s*C\\.?\\b')),
        a AS (SELECT page, arg_min(r, i) AS r FROM c WHERE r IS NOT NULL GROUP BY page), h AS (SELECT page, {x("array_to_string((" + LINES + ")[1:18], chr(10))", P.P2_RUC)} AS r FROM pages)
        SELECT h.page, coalesce(a.r, h.r) AS ruc FROM h LEFT JOIN a USING (page)""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", X.header_ruc(F.col("texto")).alias("ruc"))


FLAT = "regexp_replace(coalesce(texto, ''), '\\s+', ' ', 'g')"
TOTAL_LINE = f"list_filter(list_transform({TRIMMED}, lambda l: CASE WHEN regexp_matches(upper(l), '\\bTOTAL\\b') AND NOT contains(upper(l), 'SUBTOTAL') AND NOT regexp_matches(upper(l), '^\\s*IGV\\b') THEN {AMOUNT('l')} END), lambda v: v IS NOT NULL)[1]"
ALONE = x(FLAT, P.P2_TOTAL_ALONE.replace("(?<!SUB)", ""), 2)  # (a sign that is no letter stands before it anyway)


@query("EXT-8", f"SELECT page, {number('v')} AS monto FROM (SELECT page, coalesce({x(FLAT, P.P2_TO_PAY)}, {x(FLAT, P.P2_TOTAL)}, {TOTAL_LINE}, {ALONE}) AS v FROM pages)", "pages")
def _(t: Tables):
    return t.pages.select("page", B.amount_by_priority(F.col("texto")).alias("monto"))


@query("EXT-9")
def _(t: Tables):
    return t.pages.select("page", H.issue_date(F.col("texto")).alias("fecha"))


@query("EXT-10", "SELECT page, CASE WHEN contains(upper(texto), 'BOLETA') THEN 'BOLETA' WHEN contains(upper(texto), 'FACTURA') THEN 'FACTURA' END AS tipo, CASE WHEN regexp_matches(upper(texto), 'S/|SOLES|PEN') THEN 'PEN' WHEN regexp_matches(upper(texto), 'USD|DOLAR') THEN 'USD' END AS moneda FROM pages", "pages")
def _(t: Tables):
    return t.pages.select("page", X.inferred_type(F.col("texto")).alias("tipo"), X.inferred_currency(F.col("texto")).alias("moneda"))


ADDRESS_VALUE = r"\s*:\s*(.+)$"
NAMED = rf"""length(b) >= 4 AND NOT {m('b', P.STREET)} AND NOT {m('b', P.NUMBERS_APART)} AND NOT contains(left(upper(b), 8), 'RUC') AND upper(trim(b)) NOT IN {P.DOCUMENT_HEADS} AND NOT {m('b', P.P2_SERIES)} AND NOT {m('b', P.P2_SERIES_LOOSE)}
    AND ((upper(b) = b AND lower(b) <> b) OR (regexp_matches(b, '\pL') AND NOT regexp_matches(b, '(^|\s)\p{{Ll}}')))"""


@query(
    "EXT-11",
    f"""SELECT page, CASE WHEN {NAMED} THEN b END AS nombre, list_filter(list_transform(L, lambda l: {x('l', P.ADDRESS_LABEL + ADDRESS_VALUE)}), lambda a: a IS NOT NULL)[1] AS direccion,
        list_filter(list_transform(L, lambda l: CASE WHEN {m('l', P.PHONE_LABEL)} THEN {x('l', P.PHONE, 0)} END), lambda a: a IS NOT NULL)[1] AS telefono, {x('texto', P.P2_URL, 0)} AS web, {x('texto', P.P2_EMAIL, 0)} AS email
        FROM (SELECT page, texto, L, CASE WHEN i > 1 THEN L[i - 1] END AS b FROM (SELECT page, texto, L, list_position(list_transform(L, lambda l: regexp_matches(l, '{P.P2_RUC}') AND {m('l', r"\bR\.?U\.?C\.?\b")}), true) AS i FROM (SELECT page, texto, {LINES} AS L FROM pages)))""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", B.supplier(F.col("texto"), F.lit(None).cast("string")).alias("p")).select("page", "p.*")


@query("EXT-13", f", {ITEMS} SELECT page, items, crudo FROM itemized", "pages")
def _(t: Tables):
    return t.pages.select("page", B.item_block(F.col("texto")).alias("i")).select("page", "i.*")


LABELLED = lambda cond: f"list_filter(list_transform(L, lambda l: CASE WHEN {cond} THEN {AMOUNT('l')} END), lambda v: v IS NOT NULL)[1]"


@query(
    "EXT-14",
    f"""SELECT page, {number('v')} AS valor_venta, {number('g')} AS igv FROM (SELECT page, coalesce({LABELLED(m('l', P.SALE_VALUE))}, {x(FLAT, P.SALE_VALUE_FLAT)}) AS v,
        {LABELLED(m('l', P.TAX_LINE) + " AND NOT contains(upper(l), 'SUBTOTAL')")} AS g FROM (SELECT page, texto, {TRIMMED} AS L FROM pages))""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", B.sale_value_and_tax(F.col("texto")).alias("m")).select("page", "m.*")


PAID = "CASE " + " ".join(f"WHEN regexp_matches(b, '\\b{w}\\b') THEN '{w}'" for w in P.PAYMENTS) + " END"


@query(
    "EXT-16",
    f"""SELECT page, list_filter(list_transform(list_transform(range(1, len(L) + 1), lambda i: CASE WHEN {m('L[i]', P.PAYMENT_LABEL)} THEN upper(array_to_string(L[i : i + 2], ' ')) END), lambda b: {PAID}), lambda v: v IS NOT NULL)[1] AS forma_pago
        FROM (SELECT page, {TRIMMED} AS L FROM pages)""",
    "pages",
)
def _(t: Tables):
    return t.pages.select("page", B.payment_method(F.col("texto")).alias("forma_pago"))


@query("EXT-18", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS json FROM events")
def _(t: Tables):
    answer = F.concat(F.lit("<think>{no}</think>```json\n"), F.when(F.col("event_id") % 4 == 3, F.lit("{broken")).otherwise(F.col("props")), F.lit("\n```"))
    return t.events.select("event_id", X.json_of_answer(answer).alias("json"))


@query("WIN-3")
def _(t: Tables):
    return H.blocks_of_text(t.pages, "page", "texto")


SPOT_PAGES = ", spot AS (SELECT page, texto || CASE WHEN page % 3 = 0 THEN ' Operación sujeta al SPOT, cuenta de detracciones; cuenta de detracciones' WHEN page % 5 = 0 THEN ' depósito de detracción' ELSE '' END AS t FROM pages) "


@query("EXT-20", SPOT_PAGES + "SELECT page, indicio, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT page, unnest(regexp_extract_all(lower(t), '(?i){quoted(p)}')) AS indicio FROM spot" for p in P.SPOT_APPLIES) + ") GROUP BY page, indicio", "pages")
def _(t: Tables):
    text = F.concat("texto", F.when(F.col("page") % 3 == 0, " Operación sujeta al SPOT, cuenta de detracciones; cuenta de detracciones").when(F.col("page") % 5 == 0, " depósito de detracción").otherwise(""))
    hits = t.pages.select("page", F.explode(H.spot_hits(text)).alias("h")).select("page", "h.*")
    return hits.where("metodo = 'REGEX'").groupBy("page", "indicio").agg(F.count("*").alias("n"))


@query("EXT-23", "SELECT voucher, CASE WHEN total IS NULL THEN 'SIN_MONTO' WHEN total >= 700 THEN 'SOBRE_MINIMO' ELSE 'BAJO_MINIMO' END AS spot FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.first_of((F.col("total").isNull(), "SIN_MONTO"), (F.col("total") >= P.SPOT_MINIMUM, "SOBRE_MINIMO"), default="BAJO_MINIMO").alias("spot"))


REQUIRED_TEXT = "concat(text, CASE doc_id % 5 WHEN 0 THEN ' Debe adjuntar currículum vitae documentado y copia de DNI' WHEN 1 THEN ' deseable: 3 años de experiencia' WHEN 2 THEN ' título profesional, colegiado y habilitado' ELSE '' END)"


def _needed(p: str) -> str:
    return f"regexp_matches(lower(t), '(?i){quoted(p)}')"


OPTIONAL_SQL = "NOT regexp_matches(t, '(?is)(" + "|".join(P.OPTIONAL_WORDS) + ").{0,140}$')"  # the requirements stand at the texts' ends


@query("EXT-24", "WITH r AS (SELECT doc_id, " + REQUIRED_TEXT + " AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS tipo, {OPTIONAL_SQL} AS obligatorio FROM r WHERE {' OR '.join(_needed(p) for p in ps)}" for k, ps in P.REQUIREMENTS.items()))
def _(t: Tables):
    k = F.col("doc_id") % 5
    text = F.concat("text", S.first_of((k == 0, " Debe adjuntar currículum vitae documentado y copia de DNI"), (k == 1, " deseable: 3 años de experiencia"), (k == 2, " título profesional, colegiado y habilitado"), default=""))
    found = t.documents.select("doc_id", F.explode(H.requirements(text)).alias("r")).select("doc_id", "r.*")
    return found.groupBy("doc_id", "tipo").agg(F.bool_and("obligatorio").alias("obligatorio"))


# -- scalars ------------------------------------------------------------------


@query("SCL-1", "SELECT voucher, CAST(total AS DECIMAL(18,2)) AS monto FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.money(F.concat(F.lit(" S/. "), F.format_number("total", 2))).alias("monto"))


@query("SCL-4", "SELECT voucher, fecha FROM vouchers", "vouchers")
def _(t: Tables):
    shown = F.when(F.col("voucher") % 2 == 0, F.col("fecha_texto")).otherwise(F.date_format("fecha", "yyyy-MM-dd"))
    return t.vouchers.select("voucher", S.day(shown).alias("fecha"))


@query("SCL-5", "SELECT voucher, list_filter([CASE WHEN length(ruc) <> 11 THEN 'RUC_LONGITUD_INVALIDA' END, CASE WHEN left(ruc, 2) NOT IN ('10', '15', '17', '20') THEN 'RUC_PREFIJO_INVALIDO' END], lambda f: f IS NOT NULL) AS flags FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.ruc_flags(F.col("ruc")).alias("flags"))


@query("SCL-6", "SELECT voucher, CASE WHEN s IS NULL THEN 'SERIE_NUMERO_VACIO' WHEN NOT contains(s, '-') THEN 'SERIE_NUMERO_SIN_SEPARADOR' " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k in P.SERIES_FORMATS) + " ELSE 'SERIE_NUMERO_FORMATO_DESCONOCIDO' END AS tipo FROM (SELECT voucher, CASE voucher % 6 WHEN 0 THEN NULL WHEN 1 THEN serie || numero WHEN 2 THEN 'X1-' || numero ELSE serie || '-' || numero END AS s FROM vouchers)", "vouchers")
def _(t: Tables):
    k = F.col("voucher") % 6
    s = S.first_of((k == 0, F.lit(None).cast("string")), (k == 1, F.concat("serie", "numero")), (k == 2, F.concat(F.lit("X1-"), "numero")), default=F.concat_ws("-", "serie", "numero"))
    return t.vouchers.select("voucher", S.series_kind(s).alias("tipo"))


@query("SCL-7", "SELECT voucher, CASE WHEN total IS NULL THEN ['MONTO_VACIO'] WHEN voucher % 3 = 0 THEN ['MONTO_NO_NUMERICO'] WHEN voucher % 3 = 1 THEN ['MONTO_DECIMALES_EXCESIVOS'] ELSE [] END AS flags FROM vouchers", "vouchers")
def _(t: Tables):
    k = F.col("voucher") % 3
    return t.vouchers.select("voucher", S.amount_flags(F.when(F.col("total").isNotNull(), F.when(k == 0, F.lit("x1")).when(k == 1, F.concat("total", F.lit("5"))).otherwise(F.col("total").cast("string")))).alias("flags"))


@query("SCL-8", "SELECT voucher, CASE WHEN voucher % 4 = 0 THEN ['FECHA_FORMATO_INVALIDO'] WHEN fecha BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' THEN [] ELSE ['FECHA_FUERA_DE_RANGO'] END AS flags FROM vouchers", "vouchers")
def _(t: Tables):
    return t.vouchers.select("voucher", S.date_flags(F.when(F.col("voucher") % 4 == 0, "ayer").otherwise(F.col("fecha_texto")), "1994-01-01", "1996-12-31").alias("flags"))


@query("SCL-10", "SELECT voucher, CASE WHEN voucher % 4 = 0 THEN 'SIN_IDENTIFICAR' WHEN voucher % 4 = 1 THEN serie WHEN voucher % 4 = 2 THEN numero ELSE serie || '-' || numero END AS clave FROM vouchers", "vouchers")
def _(t: Tables):
    k = F.col("voucher") % 4
    return t.vouchers.select("voucher", S.series_key(F.when(k.isin(1, 3), F.col("serie")), F.when(k.isin(2, 3), F.col("numero"))).alias("clave"))


@query("SCL-12", "SELECT voucher, upper(trim(prioridad)) = upper(trim(tipo)) OR voucher % 2 = 0 AS igual FROM vouchers", "vouchers")
def _(t: Tables):
    other = F.when(F.col("voucher") % 2 == 0, F.concat(F.lit("  "), F.lower("prioridad"), F.lit(" "))).otherwise(F.col("tipo"))
    return t.vouchers.select("voucher", S.equivalent(F.col("prioridad"), other).alias("igual"))


@query("SCL-13", "SELECT doc_id, substr(regexp_replace(source || ' ' || lang || '/x', '[^A-Za-z0-9_\\-.]+', '_', 'g'), 1, 120) AS slug, sha256(text) AS hash, coalesce(nullif(source, 'src0'), 'NULL') AS celda FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", S.slug(F.concat_ws(" ", "source", F.concat("lang", F.lit("/x")))).alias("slug"), F.sha2("text", 256).alias("hash"), S.cell_text(F.nullif("source", F.lit("src0"))).alias("celda"))


ENDED = "CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10) WHEN 1 THEN text || chr(13) ELSE text END"


@query("SCL-15", f"SELECT doc_id, sha256(replace(t, chr(13) || chr(10), chr(10))) AS hash, contains(t, chr(13) || chr(10)) AS cambia FROM (SELECT doc_id, {ENDED} AS t FROM documents)")
def _(t: Tables):
    """Texts with line ends of both kinds; a carriage return by itself stays."""
    ended = t.documents.select("doc_id", F.expr(ENDED).alias("t"))
    return ended.select("doc_id", S.text_hash(F.col("t")).alias("hash"), (S.text_hash(F.col("t")) != F.sha2("t", 256)).alias("cambia"))


@query("SCL-16", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'MANUAL' END AS metodo FROM events")
def _(t: Tables):
    return t.events.select("event_id", S.decode(F.col("event_type"), ("view", "click"), "MANUAL").alias("metodo"))
