"""Numbers as reports write them: parsing, units, tolerances, shares.

Every function takes and returns Columns; bad input gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUPED = r"(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?"

#: fixed values: cell contents that stand for "no value"
DASHES = ("-", "—", "–", "— —", "— — —", "— — — —", "")
#: fixed values: words that stand for "no value" in imported tables
MISSING_WORDS = ("N/A", "NULL", "-", "--", "—", "")
#: fixed values: factors to units of ten thousand
UNIT_FACTORS = {"元": 0.0001, "万元": 1.0, "亿元": 10000.0}

_SPACE = r"(?U)^\s+|\s+$"


def stripped(s: Column) -> Column:
    """s without leading and trailing Unicode white space."""
    return F.regexp_replace(s, _SPACE, "")


def parse_number(s: Column) -> Column:
    """Strict: optional minus, digits with or without thousands separators, an
    optional percent sign (its value as written).  Dashes and blanks are NULL.  Plain
    numbers and texts without a digit, which most cells are, take none of the replacements."""
    plain, some = s.rlike(rf"^-?{_GROUPED}\z"), s.rlike(r"\d")
    t = stripped(s)
    digits = F.regexp_replace(t, r"[,%\s]", "")
    return F.when(plain, F.translate(s, ",", "").try_cast("double")).when(~some, F.lit(None)).when(t.rlike(rf"^-?\s*{_GROUPED}\s*%?$"), digits.try_cast("double"))


def parse_amount(s: Column) -> Column:
    """Tolerant: full-width signs, unit words, (x) for -x; dashes are blank.  What is written
    plainly, as most cells are, takes none of the replacements."""
    plain = F.translate(s, ",", "")
    t = F.regexp_replace(stripped(s), r"[,，\s　%]|亿元|千元|万元|元", "")
    t = F.replace(F.regexp_replace(t, "—|--", ""), F.lit("－"), F.lit("-"))
    t = F.translate(t, "（）", "()")
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return F.when(s.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\z"), plain.try_cast("double")).when(t.rlike(r"^\(?-?\d+(?:\.\d+)?\)?$"), t.try_cast("double"))


def parse_plain(s: Column) -> Column:
    """Unsigned digits with an optional fraction, separators dropped."""
    t = F.replace(stripped(s), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), t.try_cast("double"))


def parse_lenient(s: Column, missing: tuple[str, ...] = MISSING_WORDS) -> Column:
    """Whatever casts, with separators dropped; missing words are NULL."""
    t = stripped(s)
    return F.when(F.upper(t).isin(*missing), F.lit(None)).otherwise(F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def is_blank_cell(s: Column) -> Column:
    return s.isNull() | F.upper(stripped(s)).isin(*MISSING_WORDS)


def amount_problem(s: Column, low: float, high: float, required: bool = False) -> Column:
    """NULL for a valid amount, else what is wrong with it."""
    v = parse_lenient(s)
    return (
        F.when(is_blank_cell(s), F.lit("missing") if required else F.lit(None))
        .when(v.isNull(), F.lit("not a number"))
        .when((v < low) | (v > high), F.lit("out of range"))
    )


def to_ten_thousands(v: Column, unit: Column) -> Column:
    """Unknown units count as ten thousands."""
    factor = F.lit(1.0)
    for name, f in UNIT_FACTORS.items():
        factor = F.when(F.trim(unit) == name, F.lit(f)).otherwise(factor)
    return v * factor


def share(x: Column, total: Column, digits: int = 2) -> Column:
    """Percentage of a total, half-even like written reports; NULL for no total."""
    return F.bround(F.try_divide(x, total) * 100, digits)


def tolerance(a: Column, b: Column, absolute: float, relative: float = 0.0) -> Column:
    return F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.abs(a), F.lit(float(relative)) * F.abs(b))


def close(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.0, nulls: str = "false", strict: bool = False) -> Column:
    """Whether a and b agree.

    nulls: "false" (a NULL never agrees), "zero" (a NULL counts as 0) or "null"
    (a NULL gives NULL).  strict: the bound itself no longer agrees.
    """
    if nulls == "zero":
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    d, t = F.abs(a - b), tolerance(a, b, absolute, relative)
    ok = d < t if strict else d <= t
    return F.coalesce(ok, F.lit(False)) if nulls == "false" else ok


def banded_tolerance(a: Column, b: Column, base: float = 1.0) -> Column:
    """Small amounts: the base; from 100: 0.5 %; from 10 000: 0.3 %."""
    m = F.greatest(F.abs(a), F.abs(b))
    return F.when(m < 100, F.lit(float(base))).when(m < 10000, F.greatest(F.lit(float(base)), m * 0.005)).otherwise(F.greatest(F.lit(float(base)), m * 0.003))


#: fixed values: rounding that a unit leaves open
UNIT_ROUNDING = {"%": 0.1, "亿元": 0.0001, "元": 100.0}


def within_rounding(a: Column, b: Column, unit: Column) -> Column:
    """Whether two amounts differ by no more than their unit's rounding."""
    t = F.lit(0.01)
    for name, v in UNIT_ROUNDING.items():
        t = F.when(unit == name, F.lit(v)).otherwise(t)
    return F.coalesce(F.abs(a - b) <= t, F.lit(False))
