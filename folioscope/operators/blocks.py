"""Fields of a voucher's block, line by line: payment, items, charges, amounts, supplier.

Lines are an array that is split once; a rule is a transform, a filter or, where it
depends on the lines before, a fold over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S

def raw_lines(text: Column) -> Column:
    """All lines, trimmed, blank ones too."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))


def first_some(values: Column) -> Column:
    """The first of an array that isn't null."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _found(line: Column, *patterns: str) -> Column:
    return S.any_of([S.matches(line, p) for p in patterns])


def last_amount(line: Column) -> Column:
    """The last amount of a line, as it is written."""
    return F.try_element_at(F.regexp_extract_all(line, F.lit(P.P2_LINE_MONEY), F.lit(1)), F.lit(-1))


def payment_method(text: Column) -> Column:
    """The first known method in the three lines from a label on; null without a label."""

    def of_window(window: Column) -> Column:
        return S.first_of(*[(F.rlike(window, F.lit(rf"\b{w}\b")), w) for w in P.PAYMENTS])

    def of_lines(every: Column) -> Column:
        windows = F.transform(every, lambda line, i: F.when(S.matches(line, P.PAYMENT_LABEL), F.upper(F.array_join(F.slice(every, i + 1, 3), " "))))
        return first_some(F.transform(windows, of_window))

    return S.let(raw_lines(text), of_lines)


def amount_by_priority(text: Column) -> Column:
    """TOTAL A PAGAR, else IMPORTE TOTAL, else the last amount of the first line that says TOTAL (and isn't of a subtotal
    or the tax), else the amount after the first TOTAL by itself."""
    from .extract import normal_number

    def of_line(line: Column) -> Column:
        u = F.upper(line)
        other = F.contains(u, F.lit("SUBTOTAL")) | (F.rlike(u, F.lit(r"\bIGV\b")) & ~F.contains(u, F.lit("TOTAL"))) | F.rlike(u, F.lit(r"^\s*IGV\b"))
        return F.when(~other & F.rlike(u, F.lit(r"\bTOTAL\b")), last_amount(line))

    flat = S.one_line(F.coalesce(text, F.lit("")))
    by_line = S.let(raw_lines(text), lambda every: first_some(F.transform(every, of_line)))
    return normal_number(F.coalesce(S.extract(flat, P.P2_TO_PAY), S.extract(flat, P.P2_TOTAL), by_line, S.extract(flat, P.P2_TOTAL_ALONE, 2)))


def item_block(text: Column, longest: int = 45, chars: int = 5000) -> Column:
    """struct(items, crudo): the lines from the header of the items to the totals, joined by bars. crudo: none of them looks
    like an item, so all are kept. Null items where there is no header or nothing under it."""
    empty = F.array().cast("array<string>")

    def step(state: Column, line: Column) -> Column:
        done = state.done | S.matches(line, P.ITEM_STOP) | ((line == "") & (F.size(state.kept) > 12))
        keep = ~done & (line != "") & ~F.rlike(line, F.lit(P.RULED_LINE))
        return F.struct(F.when(keep, F.concat(state.kept, F.array(line))).otherwise(state.kept).alias("kept"), done.alias("done"))

    def is_item(line: Column) -> Column:
        u = F.upper(line)
        return (F.length(line) >= 3) & ~F.rlike(u, F.lit(r"\bTOTAL\b|\bSUBTOTAL\b|\bIGV\b|\bI\.?\s*G\.?\s*V\.?\b")) & ~F.rlike(line, F.lit(r"^[\d\s.,\-]+$"))

    def joined(kept: Column) -> Column:
        return S.let(F.filter(kept, is_item), lambda clean: F.struct(F.when(F.size(kept) > 0, F.substring(F.array_join(F.when(F.size(clean) > 0, clean).otherwise(kept), " | "), 1, chars)).alias("items"), ((F.size(kept) > 0) & (F.size(clean) == 0)).alias("crudo")))

    def of_lines(every: Column) -> Column:
        first = F.array_position(F.transform(every, lambda x: S.matches(x, P.ITEM_HEADER)), True).cast("int")
        return S.let(first, lambda at: F.when(at > 0, F.aggregate(F.slice(every, at + 1, longest), F.struct(empty.alias("kept"), F.lit(False).alias("done")), step).kept).otherwise(empty))

    return S.let(S.let(raw_lines(text), of_lines), joined)


def sale_value_and_tax(text: Column) -> Column:
    """struct(valor_venta, igv): the last amount of the first line with the label and one; the value also right after its
    label, across lines."""
    from .extract import normal_number

    def of_lines(every: Column) -> Column:
        value = first_some(F.transform(every, lambda x: F.when(S.matches(x, P.SALE_VALUE), last_amount(x))))
        tax = first_some(F.transform(every, lambda x: F.when(S.matches(x, P.TAX_LINE) & ~F.contains(F.upper(x), F.lit("SUBTOTAL")), last_amount(x))))
        flat = S.extract(S.one_line(F.coalesce(text, F.lit(""))), P.SALE_VALUE_FLAT)
        return F.struct(normal_number(F.coalesce(value, flat)).alias("valor_venta"), normal_number(tax).alias("igv"))

    return S.let(raw_lines(text), of_lines)


def extra_charges(text: Column) -> Column:
    """struct(recargo_consumo, cargo_servicio, icbper, otros_cargos). A line that names a charge not yet found is looked at for
    that charge only; other charges are up to ten lines with an amount that no label explains."""
    from .extract import normal_number

    kinds = (("recargo_consumo", P.CONSUMPTION_CHARGE), ("cargo_servicio", P.SERVICE_CHARGE), ("icbper", P.BAG_TAX))

    def step(state: Column, line: Column) -> Column:
        out, taken = [], F.lit(False)
        for name, pattern in kinds:
            mine = ~taken & state[name].isNull() & S.matches(line, pattern)
            out.append(F.when(mine, last_amount(line)).otherwise(state[name]).alias(name))
            taken = taken | mine
        return F.struct(*out)

    def is_other(line: Column) -> Column:
        u = F.upper(line)
        labelled = _found(line, P.SALE_VALUE, P.TAX_LINE, *[p for _, p in kinds]) | F.contains(u, F.lit("SUBTOTAL")) | F.rlike(u, F.lit(r"\bTOTAL\b"))
        return (F.length(line) >= 4) & F.rlike(line, F.lit(P.P2_LINE_MONEY)) & ~labelled

    def of_lines(every: Column) -> Column:
        start = F.struct(*[F.lit(None).cast("string").alias(name) for name, _ in kinds])
        others = F.slice(F.filter(every, is_other), 1, 10)
        shown = F.when(F.size(others) > 0, F.substring(F.array_join(F.transform(others, lambda x: F.substring(x, 1, 200)), " | "), 1, 2000))
        return S.let(F.aggregate(every, start, step), lambda found: F.struct(*[normal_number(found[name]).alias(name) for name, _ in kinds], shown.alias("otros_cargos")))

    return S.let(raw_lines(text), of_lines)


def is_supplier_name(line: Column) -> Column:
    """A line that can be a company's name: no address, id or kind of document, and written in capitals."""
    u = F.upper(line)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: F.rlike(w, F.lit(r"\p{L}")))
    lead = F.transform(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}"))), lambda w: F.substring(w, 1, 1))
    capitals = ((u == line) & (F.lower(line) != line)) | ((F.size(words) > 0) & F.forall(lead, lambda c: F.upper(c) == c))
    refused = _found(line, P.STREET, P.NUMBERS_APART, P.P2_SERIES, P.P2_SERIES_LOOSE) | F.contains(F.substring(u, 1, 8), F.lit("RUC")) | F.trim(u).isin(*P.DOCUMENT_HEADS)
    return (F.length(line) >= 4) & ~refused & capitals


def supplier(text: Column, ruc: Column) -> Column:
    """struct(nombre, direccion, telefono, web, email) of the issuer, from the first lines. ruc: its id, if known."""

    def name_before_ruc(every: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            mine = F.when(ruc.isNotNull(), F.contains(F.regexp_replace(line, r"\s+", ""), ruc)).otherwise(S.matches(line, r"\bR\.?U\.?C\.?\b"))
            before = F.get(every, i - 1)
            return F.when((i > 0) & F.rlike(line, F.lit(P.P2_RUC)) & mine & is_supplier_name(before), F.substring(before, 1, 300))

        return first_some(F.transform(F.slice(every, 1, 45), of_line))

    def labelled_name(every: Column) -> Column:
        def here(value: Column) -> Column:
            plain = (F.length(value) > 3) & ~_found(value, P.STREET, P.NUMBERS_APART)
            return F.when(value.isNotNull() & ~F.rlike(value, F.lit(r"^\d{11}$")) & (is_supplier_name(value) | plain), value)

        def of_line(line: Column, i: Column) -> Column:
            after = F.get(every, i + 1)
            value = S.let(F.trim(S.extract(line, P.NAME_LABEL + r"\s*:\s*(.+)$", 2)), here)
            below = F.when(S.matches(line, P.NAME_LABEL + r"\s*:?\s*$") & (F.length(after) > 2) & ~F.startswith(F.upper(after), F.lit("RUC")) & ~S.matches(after, P.P2_SERIES) & is_supplier_name(after), after)
            return F.when(S.matches(line, P.NAME_LABEL), F.substring(F.coalesce(value, below), 1, 300))

        return first_some(F.transform(F.slice(every, 1, 45), of_line))

    def address(every: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            after = F.get(every, i + 1)
            below = F.when(S.matches(line, P.ADDRESS_LABEL + r"\s*:?\s*$") & ~S.matches(after, r"^(RUC|TELEF|CORREO|EMAIL)\b"), after)
            return F.substring(F.coalesce(F.trim(S.extract(line, P.ADDRESS_LABEL + r"\s*:\s*(.+)$")), below), 1, 400)

        return first_some(F.transform(F.slice(every, 1, 45), of_line))

    def of_lines(every: Column) -> Column:
        phone = first_some(F.transform(F.slice(every, 1, 40), lambda x: F.when(S.matches(x, P.PHONE_LABEL), F.substring(F.trim(S.extract(x, P.PHONE, 0)), 1, 40))))
        head = F.array_join(F.slice(every, 1, 32), "\n")
        return F.struct(
            F.coalesce(name_before_ruc(every), labelled_name(every)).alias("nombre"),
            address(every).alias("direccion"),
            phone.alias("telefono"),
            F.substring(S.extract(head, P.P2_URL, 0), 1, 250).alias("web"),
            F.substring(S.extract(head, P.P2_EMAIL, 0), 1, 120).alias("email"),
        )

    return S.let(S.lines(text), of_lines)


def middle_lines(text: Column) -> Column:
    """Lines from a fifth to four fifths of the way; the whole text if it has fewer than ten."""

    def cut(every: Column) -> Column:
        n = F.size(every)
        a, b = F.greatest(F.floor(n * 0.2).cast("int"), F.lit(1)), F.least(F.floor(n * 0.8).cast("int"), n)
        return F.when(n < 10, text).otherwise(F.array_join(F.slice(every, a + 1, F.greatest(b - a, F.lit(0))), "\n"))

    return S.let(F.split(text, r"\r?\n"), cut)


def expense_of(items: Column, text: Column, classed: Callable[[Column], Column]) -> Column:
    """struct(tipo_gasto, alcohol), from the items; without items the type is that of the text's middle. classed: of a text."""
    kind = S.let(F.coalesce(items, middle_lines(text)), classed)
    return F.struct(kind.alias("tipo_gasto"), (items.isNotNull() & S.matches(items, P.P2_ALCOHOL)).alias("alcohol"))


def expense(text: Column, classed: Callable[[Column], Column]) -> Column:
    return S.let(item_block(text).items, lambda items: expense_of(items, text, classed))
