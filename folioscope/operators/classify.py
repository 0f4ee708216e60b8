"""Classification of pages, vouchers, blocks and findings. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S


def has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def points(*pairs: tuple[Column, int, str]) -> tuple[Column, Column]:
    """(sum of the points whose conditions hold, their names)."""
    total = F.lit(0)
    for cond, n, _ in pairs:
        total = total + F.when(cond, n).otherwise(0)
    return total, S.flags(*[(cond, name) for cond, _, name in pairs])


def has_structure(norm: Column) -> Column:
    """Two signs of a voucher's table of items and totals."""
    signs = [
        has(norm, "cant") & (has(norm, "unid") | has(norm, "und")),
        has(norm, "descripc"),
        S.any_of([has(norm, w) for w in ("op. gravada", "op gravada", "op.exonerada", "op exonerada", "op inafecta")]),
        has(norm, "importe total") | has(norm, "subtotal"),
        has(norm, "valor venta"),
    ]
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 2


def has_total(norm: Column) -> Column:
    return S.matches(norm, P.TOTAL_CONTEXT) | S.any_of([S.matches(norm, p) for p in P.AMOUNT_BY_TOTAL])


def page_signs(text: Column) -> Column:
    """struct of what a page shows, each sign looked for once; in blank all are false but that one."""

    def signs(norm: Column) -> Column:
        n_lines = F.size(S.lines(text))
        return F.struct(
            (norm == "").alias("blank"),
            has(norm, "consulta de comprobante").alias("query"),
            (has(norm, "consulta") & has(norm, "comprobante")).alias("both_words"),
            has(norm, "resultado de la consulta").alias("result"),
            has(norm, "sunat").alias("portal"),
            S.matches(norm, P.VALID_STATE).alias("valid"),
            has_structure(norm).alias("structure"),
            has_total(norm).alias("total"),
            S.matches(norm, P.VALID_SERIES).alias("series"),
            S.matches(text, P.RUC_MARK).alias("ruc"),
            ((n_lines >= 3) & (n_lines <= 28)).alias("few_lines"),
        )

    return S.let(S.normal_key(text), signs)


def portal_score(seen: Column) -> tuple[Column, Column]:
    """Points for a page of the tax portal. seen: its page_signs."""
    return points(
        (seen.query, 2, "sunat.consulta_de_comprobante(+2)"),
        (~seen.query & seen.both_words, 1, "sunat.consulta_y_comprobante_separados(+1)"),
        (seen.result, 2, "sunat.resultado_de_la_consulta(+2)"),
        (seen.portal & seen.valid, 2, "sunat.sunat_y_estado_valido(+2)"),
        (~seen.structure, 1, "sunat.ausencia_estructura_comprobante(+1)"),
        (seen.portal & (seen.result | seen.query), 1, "sunat.presencia_portal(+1)"),
    )


def voucher_score(seen: Column) -> tuple[Column, Column]:
    return points(
        (seen.series, 2, "comprobante.serie_valida(+2)"),
        (seen.ruc & seen.total, 1, "comprobante.ruc_y_total(+1)"),
        (seen.structure, 1, "comprobante.estructura_items_totales(+1)"),
        (seen.few_lines & seen.series & seen.total, 1, "comprobante.ticket_termico(+1)"),
    )


def page_class(text: Column) -> Column:
    """struct(tipo, pasa, score_sunat, score_comprobante, senales). Blank pages are OTROS, with a sign of their own."""

    def scored(seen: Column) -> Column:
        (portal, portal_signs), (voucher, voucher_signs) = portal_score(seen), voucher_score(seen)
        return F.struct(seen.blank.alias("blank"), portal.alias("portal"), voucher.alias("voucher"), F.concat(portal_signs, voucher_signs).alias("signs"))

    def classed(s: Column) -> Column:
        kind = S.first_of((s.blank, "OTROS"), (s.portal >= 3, "SUNAT_VALIDACION"), ((s.voucher >= 2) & (s.portal < 2), "COMPROBANTE"), default="OTROS")
        return F.struct(
            kind.alias("tipo"),
            (kind == "COMPROBANTE").alias("pasa"),
            F.when(s.blank, 0).otherwise(s.portal).alias("score_sunat"),
            F.when(s.blank, 0).otherwise(s.voucher).alias("score_comprobante"),
            F.when(s.blank, F.array(F.lit("vacio.sin_texto"))).otherwise(s.signs).alias("senales"),
        )

    return S.let(S.let(page_signs(text), scored), classed)


def series_number(text: Column) -> Column:
    """First series-number of a block, strict before loose, as SERIES-number without leading zeros."""
    found = [F.when(S.extract(text, p).isNotNull(), F.concat_ws("-", F.upper(S.extract(text, p)), F.regexp_replace(S.extract(text, p, 2), r"^0+(?=\d)", ""))) for p in (P.P2_SERIES, P.P2_SERIES_LOOSE)]
    return F.coalesce(*found)


def series_numbers(text: Column) -> Column:
    """All distinct series-numbers of a block."""
    every = [F.zip_with(F.regexp_extract_all(text, F.lit(P.ci(p)), F.lit(1)), F.regexp_extract_all(text, F.lit(P.ci(p)), F.lit(2)), lambda a, b: F.concat_ws("-", F.upper(a), F.regexp_replace(b, r"^0+(?=\d)", ""))) for p in (P.P2_SERIES, P.P2_SERIES_LOOSE)]
    return F.array_distinct(F.concat(*every))


def block_page_class(text: Column) -> Column:
    """Page class of the block extractor: the first rule that fits."""
    u = F.upper(text)
    head = F.substring(u, 1, 2000)
    real = (has(u, "FACTURA") | has(u, "BOLETA")) & has(u, "RUC") & has(u, "TOTAL") & series_number(text).isNotNull()
    return S.first_of(
        (text.isNull() | (F.length(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))) < 25), "OTRO"),
        (has(head, "DECLARACION") & has(head, "JURADA"), "DJ"),
        (F.rlike(head, F.lit(r"\bANEXO\s*N")) | F.startswith(F.ltrim(u), F.lit("ANEXO")), "ANEXO"),
        (series_number(text).isNull() & S.matches(text, P.P2_QUERY_RUC) & S.matches(text, P.P2_TAXPAYER), "SUNAT"),
        (real, "COMPROBANTE_REAL"),
        default="OTRO",
    )


def voucher_type(text: Column) -> Column:
    """The first type with a pattern that matches."""
    return S.first_of(*[(S.any_of([S.matches(text, p) for p in ps]), kind) for kind, ps in P.VOUCHER_TYPES.items()], default=P.OTHER_TYPE)


def keyword_hits(text: Column) -> Column:
    return sum((S.matches(text, p).cast("int") for p in P.VOUCHER_KEYWORDS), F.lit(0))


def is_candidate(text: Column, least: int = 2) -> Column:
    """Pages worth extracting: not of the portal, with enough keywords."""
    return (page_class(text)["tipo"] != "SUNAT_VALIDACION") & (keyword_hits(text) >= least)


def expense_kind(text: Column) -> Column:
    """The one category whose words occur; null if none or several do."""
    found = S.flags((S.matches(text, P.P2_FOOD), "ALIMENTACION"), (S.matches(text, P.P2_TRANSPORT), "TRANSPORTE"), (S.matches(text, P.P2_LODGING), "HOSPEDAJE"))
    return S.let(found, lambda kinds: F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))))


def row_state(ruc: Column, series: Column, amount: Column, date: Column, source: Column) -> Column:
    return S.first_of(
        (source.isin(*P.P2_WEAK_SOURCES), "OCR_DUDOSO"),
        (ruc.isNotNull() & series.isNotNull() & amount.isNotNull() & date.isNotNull(), "COMPLETO"),
        (series.isNotNull() & ruc.isNull() & amount.isNull(), "DESCARTADO"),
        default="PARCIAL",
    )


def row_confidence(ruc: Column, series: Column, amount: Column, date: Column, source: Column, state: Column) -> Column:
    """0 to 1, from the fields that are there, the source and the state."""
    exact = lambda x: F.lit(x).cast("decimal(6,4)")
    base = sum((F.when(c.isNotNull(), exact(w)).otherwise(exact(0)) for c, w in ((ruc, 0.22), (series, 0.22), (amount, 0.22), (date, 0.18))), exact(0))
    base = base + S.first_of((source.isin(*P.P2_NATIVE_SOURCES), exact(0.16)), (source == "ocr", exact(0.10)), default=exact(0.06))
    shifted = S.first_of((state == "COMPLETO", base + exact(0.08)), (state == "PARCIAL", base + exact(0.04)), (state == "OCR_DUDOSO", base * exact(0.85)), default=F.least(base, exact(0.38)))
    return F.round(F.least(shifted, exact(1)), 3).cast("decimal(6,3)")


def poison(text: Column, is_annex: Column) -> Column:
    """Why a block can't be one voucher; null if nothing speaks against it."""
    table_like = F.size(F.filter(S.lines(text), lambda x: F.rlike(x, F.lit(r"\d+[.,]\d{2}"))))
    several = F.size(series_numbers(text)) >= 2
    return S.first_of(
        (several, "VARIAS_SERIES"),
        (S.matches(text, P.P2_QUERY_NOISE), "CONSULTA_SUNAT"),
        (is_annex & (F.size(S.lines(text)) >= 8) & (several | (table_like >= 5)), "ANEXO_TABLA"),
    )


def block_check(text: Column) -> Column:
    """ok, or the first reason against taking a block for a voucher."""
    u = F.upper(text)
    return S.first_of(
        (F.length(F.trim(text)) < 30, "bloque_muy_corto"),
        (S.matches(text, P.P2_QUERY_NOISE), "patron_sunat_consulta"),
        (F.size(series_numbers(text)) >= 2, "multiples_series_tabla"),
        (S.matches(text, P.P2_LIST_NOISE), "patron_anexo_listado"),
        (series_number(text).isNull(), "sin_serie_numero_valida"),
        (~F.rlike(text, F.lit(P.P2_RUC)), "sin_ruc_11_digitos"),
        (~F.rlike(u, F.lit(r"\b(TOTAL|IMPORTE|MONTO)\b")), "sin_total_importe_o_monto"),
        default="ok",
    )


def finding_type(rule: Column) -> Column:
    return S.first_of(*[(F.startswith(rule, F.lit(prefix)), kind) for prefix, kind in P.FINDING_TYPES.items()], default="OTRO")


def severity_label(level: Column) -> Column:
    return S.first_of(*[(level == k, v) for k, v in P.SEVERITY.items()])


def model_failure(message: Column) -> Column:
    m = F.lower(message)
    return S.first_of(*[(S.any_of([has(m, w) for w in words]), kind) for kind, words in P.MODEL_FAILURES], default="error_inesperado")


def confidence_level(confidence: Column) -> Column:
    return S.first_of((confidence >= 0.9, "HIGH"), (confidence >= 0.7, "MEDIUM"), default="LOW")


def confidence_colour(confidence: Column) -> Column:
    return S.first_of((confidence >= 0.70, "verde"), (confidence >= 0.40, "amarillo"), default="rojo")


def preprocessor_outcome(code: Column) -> Column:
    """What the exit code of the scan preprocessor means; none means that it didn't run."""
    return S.first_of((code == 0, "ESCANEADO_PROCESADO"), (code == 6, "NATIVO_DIGITAL"), default="FALLO_OCR")


def unsafe_path(path: Column, extensions: tuple[str, ...]) -> Column:
    """Why a path isn't accepted; null if it is."""
    extension = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    return S.first_of(
        (path.isNull() | (F.trim(path) == ""), "RUTA_VACIA"),
        (F.length(path) > 500, "RUTA_MUY_LARGA"),
        (has(path, "\0"), "RUTA_CON_NULO"),
        (F.array_contains(F.split(path, r"[/\\]"), ".."), "RUTA_CON_RETROCESO"),
        (~extension.isin(*extensions), "EXTENSION_NO_PERMITIDA"),
    )
