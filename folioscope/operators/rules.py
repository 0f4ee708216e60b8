"""Rules over documents, blocks and answers: kinds, requirements, withholding, guards, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from . import classify as C
from . import extract as X


#: The documents that an agreement must have.
AGREEMENT_DOCUMENTS = ("convenio_vigente", "documento_cobranza", "detalle_consumo", "informe_tecnico", "certificacion_presupuestal", "derivacion_sinad")


def bare(text: Column) -> Column:
    """Text of a model that marks places, without the marks."""
    return F.regexp_replace(text, P.POSITION_TOKEN, "")


def answer_page_class(text: Column) -> Column:
    t = bare(text)
    money = S.matches(t, r"ruc.*\d{11}") & S.matches(t, P.P3_MONEY)
    return S.first_of(*[(S.matches(t, p), kind) for kind, p in P.P3_PAGES], (money, "COMPROBANTE"), default="OTRO")


def answer_fields(text: Column, payers: tuple[str, ...] = ()) -> Column:
    """ruc (not of a payer, if there is another), serie_numero, fecha, total (the last amount) and igv."""
    t = bare(text)
    every = F.regexp_extract_all(t, F.lit(P.P3_RUC), F.lit(1))
    amounts = F.regexp_extract_all(t, F.lit(r"S/?\.?\s*([\d,]+\.\d{2})"), F.lit(1))
    amounts = F.when(F.size(amounts) > 0, amounts).otherwise(F.regexp_extract_all(t, F.lit(P.P3_MONEY), F.lit(1)))
    return F.struct(
        F.coalesce(F.get(F.filter(every, lambda r: ~r.isin(*(payers or ("",)))), 0), F.get(every, 0)).alias("ruc"),
        F.nullif(F.regexp_extract(t, P.P3_SERIES, 1), F.lit("")).alias("serie_numero"),
        F.nullif(F.regexp_extract(t, P.P3_DATE, 1), F.lit("")).alias("fecha"),
        F.try_element_at(amounts, F.lit(-1)).alias("total"),
        S.extract(t, P.P3_IGV).alias("igv"),
    )


def some_amount(text: Column) -> Column:
    return F.rlike(text, F.lit(P.P2_MONEY))


def ruc_seen(text: Column) -> Column:
    return F.rlike(text, F.lit(P.P2_RUC)) | S.matches(text, P.P2_RUC_SEEN) | (F.contains(F.upper(text), F.lit("RUC")) & F.rlike(text, F.lit(r"\b\d{9,11}\b")))


def decision(text: Column, ruc: Column, series: Column, amount: Column, kind: Column) -> Column:
    """struct(aceptado, motivo, nivel, puntos) after extraction: poison first, then points."""
    bad = C.poison(text, F.startswith(F.upper(F.ltrim(text)), F.lit("ANEXO")))
    score = sum((c.isNotNull().cast("int") for c in (series, ruc, amount)), F.lit(0)) + F.coalesce(kind.isin("FACTURA", "BOLETA"), F.lit(False)).cast("int")
    reason = S.first_of((bad == "VARIAS_SERIES", "veneno_multiples_series_en_bloque"), (bad == "CONSULTA_SUNAT", "veneno_consulta_sunat"), (bad == "ANEXO_TABLA", "veneno_anexo_tabla"), (score < 2, "score_insuficiente_post_extraccion"), default="comprobante_aceptado")
    ok = reason == "comprobante_aceptado"
    level = S.first_of((~ok, "N/A"), (score >= 4, "ALTA"), (score == 3, "MEDIA"), default="BAJA")
    return F.struct(ok.alias("aceptado"), reason.alias("motivo"), level.alias("nivel"), F.when(bad.isNull(), score).otherwise(0).alias("puntos"))


def recoverable(text: Column, ruc: Column) -> Column:
    """A block refused for its points only may still be taken, at the lowest level, for a person to look at."""
    clean = C.poison(text, F.startswith(F.upper(F.ltrim(text)), F.lit("ANEXO"))).isNull()
    count, u = F.size(S.lines(text)), F.upper(text)
    ticket = count.between(3, 45) & some_amount(text) & F.rlike(u, F.lit("TOTAL|IMPORTE|PAGO"))
    return clean & ((S.matches(text, P.P2_CURRENCY) & some_amount(text)) | ((ruc.isNotNull() | ruc_seen(text)) & some_amount(text)) | ticket)


def visibility(text: Column, source: Column, row: Column) -> Column:
    """struct(visible, parcial): something of a voucher can be seen; something was seen but not extracted."""
    pairs = [(row["serie_numero"], S.matches(text, P.P2_SERIES) | S.matches(text, P.P2_SERIES_LOOSE)), (row["ruc"], ruc_seen(text)), (row["monto_total"], some_amount(text)), (row["fecha"], F.rlike(text, F.lit(P.P2_DATE)))]
    seen = S.any_of([v.isNotNull() | p for v, p in pairs])
    part = source.isin("ocr", "debil", "error_ocr") | S.any_of([v.isNull() & p for v, p in pairs])
    return F.struct(seen.alias("visible"), part.alias("parcial"))


def tags(text: Column, row: Column) -> Column:
    """What a reader should doubt in a row, joined by bars."""
    return F.concat_ws(" | ", F.when(row["ruc"].isNull() & ruc_seen(text), "RUC_VISIBLE_NO_EXTRAIDO"), F.when(row["monto_total"].isNull() & some_amount(text), "MONTO_VISIBLE_NO_EXTRAIDO"), F.when(F.size(C.series_numbers(text)) >= 2, "VARIAS_SERIES"))


def document_kinds(name: Column, text: Column, chars: int = 5000) -> Column:
    t = F.concat_ws(" ", name, F.substring(text, 1, chars))
    return S.flags(*[(S.any_of([S.matches(t, p) for p in ps]), kind) for kind, ps in P.DOCUMENT_KINDS.items()])


def is_reference(name: Column, text: Column, chars: int = 2000) -> Column:
    """A document that is terms of reference, by its name or the head of its text."""
    t = F.concat_ws(" ", name, F.substring(text, 1, chars))
    return S.any_of([S.matches(t, p) for p in P.REFERENCE_TERMS])


def reference_document(documents: DataFrame, case: str, order: str, name: str, text: str) -> DataFrame:
    """The first document of each case that is its terms of reference."""
    return documents.where(is_reference(F.col(name), F.col(text))).groupBy(case).agg(F.min(order).alias(order))


def agreement_ready(documents: dict[str, Column], coherent: Column) -> Column:
    """struct(minimos, apto) of an agreement: all six documents are there; and its amounts are coherent."""
    every = S.any_of([documents[name].isNull() for name in AGREEMENT_DOCUMENTS])
    return F.struct((~every).alias("minimos"), (~every & coherent).alias("apto"))


def unmet(requirements: DataFrame, present: DataFrame, case: str) -> DataFrame:
    """Requirements (case, tipo) whose document isn't among those present (case, documento)."""
    needs = S.first_of(*[(F.col("tipo") == k, v) for k, v in P.REQUIREMENT_DOCUMENTS.items()])
    return requirements.withColumn("documento", needs).join(present, [case, "documento"], "left_anti").select(case, "tipo", "documento")


def withholding(applies: Column, account: Column, receipt: Column) -> Column:
    """Findings of a document that is subject to withholding."""
    return S.flags((applies & ~account, "SPOT_SIN_CUENTA"), (applies & ~receipt, "SPOT_SIN_CONSTANCIA"))


def annex_service(text: Column, services: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first service with a keyword in the text."""
    t = S.normal_key(text)
    return S.first_of(*[(S.any_of([F.contains(t, F.lit(w)) for w in words]), code) for code, words in services])


def largest_amount(text: Column, low: int = 100, high: int = 10_000_000) -> Column:
    every = F.transform(F.regexp_extract_all(text, F.lit(r"S/?\.?\s*([\d,]+\.\d{2})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))
    return F.array_max(F.filter(every, lambda x: x.between(low, high)))


def guarded(fields: Column) -> Column:
    """A map of answers in which protected names (that hold, or are held by, one of the list) are blanked."""
    touches = lambda k: S.any_of([F.contains(F.lower(k), F.lit(p)) | F.contains(F.lit(p), F.lower(k)) for p in P.PROTECTED])
    return F.transform_values(fields, lambda k, v: F.when(touches(k), F.lit("NO_AUTORIZADO")).otherwise(v))


def minimal_voucher(text: Column, points: Column, least: int = 2) -> Column:
    """Cells of a voucher without a model, if its region or page scores enough."""
    return F.when(points >= least, X.fields(text, C.voucher_type(text)))


def label_confidence(label: Column) -> Column:
    return S.first_of(*[(F.lower(label) == k, F.lit(v).cast("decimal(4,2)")) for k, v in P.LABEL_CONFIDENCE.items()], default=F.lit(0.45).cast("decimal(4,2)"))


def canonical_hash(columns: list[str]) -> Column:
    """A hash of columns by name order, with nulls kept, the same for equal rows."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def customer_section(table: DataFrame, key: str, text: str) -> DataFrame:
    """Name and tax id in the twelve lines after the customer's label."""
    every = S.lines(F.col(text))
    at = F.array_position(F.transform(every, lambda x: F.rlike(x, F.lit(P.ci(r"\b(ADQUIRIENTE|CLIENTE)\s*:|SE[NÑ]OR(?:ES)?\s*:")))), True).cast("int")
    section = F.when(at > 0, F.slice(every, at, F.lit(12)))
    name = F.nullif(F.trim(F.regexp_extract(F.get(section, 0), P.ci(r":\s*(.*)$"), 1)), F.lit(""))
    ids = F.filter(F.transform(section, lambda x: F.regexp_extract(x, P.ci(r"\bR\.?U\.?C\.?\s*:?\s*(\d{11})\b"), 1)), lambda x: x != "")
    return table.select(key, name.alias("cliente"), F.get(ids, 0).alias("cliente_ruc"))


def reusable(asked: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """What has to be computed: keys without a successful, complete and valid result."""
    return asked.join(results.where("exito and completo and not invalidado").select(*key), key, "left_anti")
