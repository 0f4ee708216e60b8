"""Extraction of fields from the text of pages and blocks. Columns in, columns out.

The block extractor's rules about lines are in `blocks`; extractors that need the
offsets of all matches, which built-in expressions don't give, are in `hits`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from . import blocks as B
from . import classify as C

ROW_FIELDS = ("ruc", "serie_numero", "monto_total", "fecha", "tipo", "moneda", "proveedor", "detalle", "montos", "cargos", "forma_pago", "gasto")
CELL = "struct<campo:string,valor:string,confianza:decimal(4,2),snippet:string>"


def snippet(text: Column, value: Column, around: int = 30) -> Column:
    """The text around the first place of value."""

    def cut(at: Column) -> Column:
        start = F.greatest(at - around, F.lit(1))
        return F.when(at > 0, F.substring(text, start, at - start + F.length(value) + around))

    return S.let(F.position(value, text), cut)


def fields(text: Column, kind: Column, payers: tuple[str, ...] = ()) -> Column:
    """Evidence cells of a voucher page: (campo, valor, confianza, snippet) for each field that is found.

    payers: tax ids that are never the issuer. The type's cell has an empty snippet.
    """
    ids = F.concat(*[F.regexp_extract_all(text, F.lit(P.ci(P.RUC)), F.lit(g)) for g in (1, 2)])
    ruc = F.get(F.filter(ids, lambda x: (x != "") & ~x.isin(*(payers or ("",)))), 0)
    issued, any_date = S.extract(text, P.ISSUE_DATE), S.extract(text, P.ANY_DATE)
    series = F.when(S.extract(text, P.SERIES_NUMBER).isNotNull(), F.concat_ws("-", F.upper(S.extract(text, P.SERIES_NUMBER)), S.extract(text, P.SERIES_NUMBER, 2)))
    amount = lambda p: F.replace(S.extract(text, p), F.lit(","), F.lit(""))

    def cell(name: str, value: Column, confidence: Column | float, shown: Column | None = None) -> Column:
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)

        def made_of(v: Column) -> Column:
            return F.when(v.isNotNull(), F.struct(F.lit(name).alias("campo"), v.alias("valor"), conf.cast("decimal(4,2)").alias("confianza"), F.coalesce(snippet(text, v) if shown is None else shown, F.lit("")).alias("snippet")))

        return S.let(value, made_of)

    made = [
        cell("ruc_emisor", ruc, P.CONFIDENCE["ruc_emisor"]),
        cell("fecha_emision", F.coalesce(issued, any_date), F.when(issued.isNotNull(), P.CONFIDENCE["fecha_emision"]).otherwise(P.CONFIDENCE["fecha_general"])),
        cell("serie_numero", series, P.CONFIDENCE["serie_numero"]),
        cell("tipo_comprobante", F.nullif(kind, F.lit(P.OTHER_TYPE)), P.CONFIDENCE["tipo_comprobante"], F.lit("")),
        cell("importe_total", amount(P.TOTAL), P.CONFIDENCE["importe_total"]),
        cell("igv_monto", amount(P.IGV), P.CONFIDENCE["igv_monto"]),
        cell("subtotal", amount(P.SUBTOTAL), P.CONFIDENCE["subtotal"]),
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def sufficiency(kind: Column, found: Column) -> Column:
    """struct(score, faltantes, decision) of the found field names against those that a type should have."""
    expected = S.let(kind, lambda k: S.first_of(*[(k == name, F.array(*map(F.lit, fields))) for name, fields in P.EXPECTED_FIELDS.items()], default=F.array(F.lit("fecha_emision"))))
    both = S.let(expected, lambda e: F.struct(F.array_except(e, found).alias("missing"), F.size(e).alias("n")))

    def scored(s: Column) -> Column:
        return F.struct(((s.n - F.size(s.missing)) / s.n).cast("decimal(6,4)").alias("score"), s.missing.alias("missing"))

    return S.let(S.let(both, scored), lambda s: F.struct(s.score.alias("score"), s.missing.alias("faltantes"), S.first_of((s.score >= P.ENOUGH, "alta"), (s.score >= P.HALF_ENOUGH, "media"), default="escalar").alias("decision")))


def header_ruc(text: Column) -> Column:
    """The tax id on a labelled line, or the line after it, of the first 35; else the first of the first 18 lines."""
    every = S.lines(text)
    labelled = F.transform(
        F.slice(every, 1, 35),
        lambda line, i: F.when(F.rlike(line, F.lit(P.ci(r"\bR\.?\s*U\.?\s*C\.?\b"))), F.coalesce(S.extract(line, P.P2_RUC), S.extract(F.coalesce(F.get(every, i + 1), F.lit("")), P.P2_RUC))),
    )
    return F.coalesce(F.get(F.filter(labelled, lambda x: x.isNotNull()), 0), S.extract(F.array_join(F.slice(every, 1, 18), "\n"), P.P2_RUC))


def normal_number(text: Column) -> Column:
    """The last of . and , is the decimal sign, others group thousands."""
    return F.regexp_replace(F.regexp_replace(text, r"[.,](?=.*[.,])", ""), ",", ".")


def inferred_type(text: Column) -> Column:
    return S.first_of((F.contains(F.upper(text), F.lit("BOLETA")), "BOLETA"), (F.contains(F.upper(text), F.lit("FACTURA")), "FACTURA"))


def inferred_currency(text: Column) -> Column:
    """Soles win where both are named."""
    return S.let(F.upper(text), lambda u: S.first_of((F.rlike(u, F.lit(r"S/|SOLES|PEN")), "PEN"), (F.rlike(u, F.lit(r"USD|DOLAR")), "USD")))


def block_row(text: Column, source: Column, date: Column) -> Column:
    """All that the block extractor takes from a block, with its state and confidence. date: its issue_date."""

    def fields_of(known: Column) -> Column:
        ruc, detail = known.ruc, known.detail
        return F.struct(
            ruc.alias("ruc"),
            C.series_number(text).alias("serie_numero"),
            B.amount_by_priority(text).alias("monto_total"),
            date.alias("fecha"),
            inferred_type(text).alias("tipo"),
            inferred_currency(text).alias("moneda"),
            B.supplier(text, ruc).alias("proveedor"),
            detail.alias("detalle"),
            B.sale_value_and_tax(text).alias("montos"),
            B.extra_charges(text).alias("cargos"),
            B.payment_method(text).alias("forma_pago"),
            B.expense_of(detail.items, text, C.expense_kind).alias("gasto"),
        )

    def judged(r: Column) -> Column:
        state = C.row_state(r.ruc, r.serie_numero, r.monto_total, r.fecha, source)
        return S.let(state, lambda e: F.struct(*[r[c].alias(c) for c in ROW_FIELDS], e.alias("estado"), C.row_confidence(r.ruc, r.serie_numero, r.monto_total, r.fecha, source, e).alias("confianza")))

    return S.let(S.let(F.struct(header_ruc(text).alias("ruc"), B.item_block(text).alias("detail")), fields_of), judged)


def json_of_answer(answer: Column) -> Column:
    """The outermost object in a model's answer, without its thoughts and code fences; null if it is no JSON."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def gated_method(direct: Column, ocr_confidence: Column, ocr_words: Column, chars: int = 200, words: int = 30) -> Column:
    """Which text to trust: struct(metodo, razon)."""
    n_words = F.size(F.filter(F.split(F.coalesce(direct, F.lit("")), r"\s+"), lambda x: x != ""))
    n_chars = F.length(F.coalesce(direct, F.lit("")))
    method = S.first_of(((n_chars >= chars) & (n_words >= words), "direct_text"), ((ocr_confidence >= 0.60) & (ocr_words >= 20), "ocr"), default="manual_review")
    reason = F.concat_ws(" | ", F.when(n_chars < chars, F.concat(F.lit("chars "), n_chars)), F.when(n_words < words, F.concat(F.lit("palabras "), n_words)))
    return F.struct(method.alias("metodo"), reason.alias("razon"))
