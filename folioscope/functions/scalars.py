"""Cleaning, parsing and validating single values. Every function takes and returns columns.

Nulls give null, unless a function's own text says what they give.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DEFAULT_THRESHOLD, RUC_PREFIXES, SERIES_FORMATS, ci

MONEY = "decimal(18,2)"


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())


def first_of(*pairs: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds."""
    chain = F.when(pairs[0][0], pairs[0][1] if isinstance(pairs[0][1], Column) else F.lit(pairs[0][1]))
    for cond, value in pairs[1:]:
        chain = chain.when(cond, value if isinstance(value, Column) else F.lit(value))
    return chain if default is None else chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row: the planner would write it out anew for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(ci(pattern))), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null if there is none or it is empty."""
    return let(F.regexp_extract(text, ci(pattern), group), lambda found: F.when(found != "", found))


def money(text: Column) -> Column:
    """S/ 1,234.50 -> 1234.50; null if it is no number."""
    return F.regexp_replace(F.trim(text), r"(?i)S/\.?|,|\s", "").try_cast(MONEY)


def nonempty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast(MONEY)


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def folded(text: Column) -> Column:
    """Compatibility composition (NFKC) and full case folding, by the ICU classes that Spark brings; ASCII needs neither."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True)))


def without_marks(text: Column) -> Column:
    """Without accents and other combining marks."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(apart, r"\p{Mn}", ""))


def normal_key(text: Column) -> Column:
    """Compatible signs as one, case folded, single spaces, no accents."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.trim(F.regexp_replace(folded(t), r"(?U)\s+", " ")), without_marks))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def day(text: Column) -> Column:
    """Dates as d/m/y, d-m-y, d.m.y or y-m-d; two-digit years are of this century."""
    parts = [F.try_to_timestamp(text, F.lit(f)) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d/M/yy", "d-M-yy")]
    return F.coalesce(*parts).cast("date")


def ruc_flags(value: Column) -> Column:
    """Everything that is wrong with a tax id; empty if nothing is."""
    v = F.trim(value)
    blank = v.isNull() | (v == "")
    wrong = flags((~F.rlike(v, F.lit(r"^\d+$")), "RUC_NO_NUMERICO"), (F.length(v) != 11, "RUC_LONGITUD_INVALIDA"), ((F.length(v) >= 2) & ~F.substring(v, 1, 2).isin(*RUC_PREFIXES), "RUC_PREFIJO_INVALIDO"))
    return F.when(blank, F.array(F.lit("RUC_VACIO"))).otherwise(wrong)


def series_kind(value: Column) -> Column:
    """What a series-number looks like, or why it is none."""
    v = F.upper(F.trim(value))
    return first_of((v.isNull() | (v == ""), "SERIE_NUMERO_VACIO"), (~F.contains(v, F.lit("-")), "SERIE_NUMERO_SIN_SEPARADOR"), *[(F.rlike(v, F.lit(p)), kind) for p, kind in SERIES_FORMATS], default="SERIE_NUMERO_FORMATO_DESCONOCIDO")


def amount_flags(value: Column) -> Column:
    v = F.trim(value)
    number = v.try_cast("decimal(38,6)")
    blank = v.isNull() | (v == "")
    decimals = F.length(F.split_part(v, F.lit("."), F.lit(2)))
    return first_of((blank, F.array(F.lit("MONTO_VACIO"))), (number.isNull(), F.array(F.lit("MONTO_NO_NUMERICO"))), default=flags((number < 0, "MONTO_NEGATIVO"), (decimals > 2, "MONTO_DECIMALES_EXCESIVOS")))


def date_flags(value: Column, low: str = "2020-01-01", high: str = "2030-12-31") -> Column:
    d = day(F.trim(value))
    blank = value.isNull() | (F.trim(value) == "")
    return first_of((blank, F.array(F.lit("FECHA_VACIA"))), (d.isNull(), F.array(F.lit("FECHA_FORMATO_INVALIDO"))), default=flags((~d.between(F.lit(low).cast("date"), F.lit(high).cast("date")), "FECHA_FUERA_DE_RANGO")))


def series_key(serie: Column, numero: Column) -> Column:
    s, n = nonempty(serie), nonempty(numero)
    return F.coalesce(F.nullif(F.concat_ws("-", s, n), F.lit("")), F.lit("SIN_IDENTIFICAR"))


def equivalent(a: Column, b: Column) -> Column:
    """Equal but for case and spaces; two nulls are."""
    clean = lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return clean(a).eqNullSafe(clean(b))


def text_hash(text: Column) -> Column:
    """The same for a text with either kind of line ends."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def slug(text: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_\-.]+", "_"), 1, longest)


def cell_text(value: Column) -> Column:
    """How a sink shows a value: NULL for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def decode(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def threshold(kind: Column, known: dict[str, float], default: float = DEFAULT_THRESHOLD) -> Column:
    k = F.lower(F.trim(kind))
    return first_of(*[(k == name, F.lit(v).cast("decimal(4,2)")) for name, v in known.items()], default=F.lit(default).cast("decimal(4,2)"))
