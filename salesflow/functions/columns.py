"""Column expressions shared by the conform and metric plans.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; there are no Python UDFs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Cell texts a spreadsheet reader treats as missing (pandas' default NA set).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Chinese date marks: year and month become '-', day is removed.
CN_YEAR, CN_MONTH, CN_DAY = "年", "月", "日"

# White space at the ends of a text, as Python's ``strip`` sees it.
EDGE_SPACE = r"[\s\x1c-\x1f]*"

# Shapes of a free-text date once its marks and slashes are '-' and its day mark is gone: the usual one, whose
# text a cast reads as it is, and the rarer ones (20240315, 2024.3.15, 3-15-2024), rewritten to the usual one.
_TIME = r"[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}%s)?"
DATE_SHAPE = (r"(?U)^" + EDGE_SPACE + r"([0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2}(?:[ T]" + _TIME % r"(?:\.[0-9]{1,9})?"
              + r")?)?)" + EDGE_SPACE + "$")
RARE_DATE_SHAPE = (r"(?U)^" + EDGE_SPACE + r"(?:([0-9]{4})([0-9]{2})([0-9]{2})|([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})"
                   r"|([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})((?:[ T]" + _TIME % "" + r")?))" + EDGE_SPACE + "$")
RARE_DATE_PARTS = "$1$4$9-$2$5$7-$3$6$8$10"

# A plain decimal number, optionally signed, with optional exponent.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Month label of a missing date (what a missing monthly period prints as).
MISSING_MONTH = "NaT"

# Money of one line: two decimals, as in the source systems, and wide enough for any amount.
MONEY = "decimal(28,2)"


# ---------------------------------------------------------------------------
# Rounding: half-to-even, like numpy's round
# ---------------------------------------------------------------------------

def round0(c: Column) -> Column:
    """Round to an integer value, ties to even (returns double)."""
    return F.rint(c.cast("double"))


def round1(c: Column) -> Column:
    """Round to one decimal, ties to even on the scaled value."""
    return F.rint(c.cast("double") * F.lit(10.0)) / F.lit(10.0)


# ---------------------------------------------------------------------------
# Parsing free text
# ---------------------------------------------------------------------------

def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def na_to_null_sql(expr: str) -> str:
    """SQL text: ``expr`` with spreadsheet missing-value tokens mapped to NULL."""
    tokens = ", ".join(_q(t) for t in NA_TOKENS)
    return f"CASE WHEN {expr} IN ({tokens}) THEN NULL ELSE {expr} END"


def try_number_sql(expr: str) -> str:
    """SQL text: ``expr`` (text) as double, NULL unless it is a plain number.

    The pattern guard rejects forms Spark's cast would accept but a numeric
    coercion would not (``12d``, ``12f``, ``nan``, ``Infinity``).
    """
    number = f"TRY_CAST(TRIM(CAST({expr} AS STRING)) AS DOUBLE)"
    return (f"CASE WHEN CAST({expr} AS STRING) RLIKE {_q(NUMBER_PATTERN)} "
            f"AND abs({number}) < double('Infinity') THEN {number} END")


def cn_date_sql(expr: str) -> str:
    """SQL text: a free-text date such as '2024年3月15日' as timestamp_ntz.

    One extraction recognises the shape of the usual cell and one cast reads
    it; only a cell of another shape is looked at again. Blank or unparseable
    text and invalid calendar dates (2024-2-30, month 13) give NULL.
    """
    s = f"translate(CAST({expr} AS STRING), {_q(CN_YEAR + CN_MONTH + '/' + CN_DAY)}, '---')"
    usual = f"regexp_extract({s}, {_q(DATE_SHAPE)}, 1)"
    rare = (f"regexp_replace(regexp_extract({s}, {_q(RARE_DATE_SHAPE)}, 0), {_q(RARE_DATE_SHAPE)}, "
            f"{_q(RARE_DATE_PARTS)})")
    return f"coalesce(TRY_CAST({usual} AS TIMESTAMP_NTZ), TRY_CAST({rare} AS TIMESTAMP_NTZ))"


def na_to_null(c: Column | str) -> Column:
    """Map spreadsheet missing-value tokens to NULL; keep everything else."""
    if isinstance(c, str):
        return F.expr(na_to_null_sql(_ident(c)))
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def try_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain finite number gives NULL."""
    if isinstance(c, str):
        return F.expr(try_number_sql(_ident(c)))
    s = c.cast("string")
    number = F.trim(s).try_cast("double")
    return F.when(s.rlike(NUMBER_PATTERN) & (F.abs(number) < F.lit(float("inf"))), number)


def cn_date(c: Column | str) -> Column:
    """Parse a free-text date such as '2024年3月15日' into timestamp_ntz."""
    if isinstance(c, str):
        return F.expr(cn_date_sql(_ident(c)))
    s = F.translate(c.cast("string"), CN_YEAR + CN_MONTH + "/" + CN_DAY, "---")
    rare = F.regexp_replace(F.regexp_extract(s, RARE_DATE_SHAPE, 0), RARE_DATE_SHAPE, RARE_DATE_PARTS)
    return F.coalesce(F.regexp_extract(s, DATE_SHAPE, 1).try_cast("timestamp_ntz"), rare.try_cast("timestamp_ntz"))


def month_of(ts: Column) -> Column:
    """'yyyy-MM' label of a timestamp; a missing date labels as 'NaT'."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(MISSING_MONTH))


# ---------------------------------------------------------------------------
# Money and ratios
# ---------------------------------------------------------------------------

# Whole cents up to this amount are summed as longs; ninety million lines of it fit one total.
_CENTS_BELOW = 1e9
# Other amounts below this are summed as decimals with ten places; anything larger as doubles.
_EXACT_BELOW = 1e20


def exact_money(c: Column) -> Column:
    """Exact sum (decimal) of all amounts below 1e20: whole cents as longs, others with ten decimals.

    0 when there is nothing to sum. A total beyond the long or decimal range raises.
    """
    v = c.cast("double")
    whole = F.rint(v * F.lit(100.0))
    plain = (F.abs(v) < _CENTS_BELOW) & (whole / F.lit(100.0) == v)
    some = F.count(F.when(plain, F.lit(1))) > 0
    cents = F.when(some, F.coalesce(F.try_sum(F.when(plain, whole.cast("bigint"))),
                                    F.raise_error(F.lit("money total out of range")).cast("bigint"))).otherwise(F.lit(0))
    odd = F.when(~plain & (F.abs(v) < _EXACT_BELOW), v.cast("decimal(38,10)"))
    odd_total = F.when(F.count(odd) > 0, F.coalesce(
        F.try_sum(odd), F.raise_error(F.lit("money total out of range")).cast("decimal(38,10)")))
    return ((cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,10)")
            + F.coalesce(odd_total, F.lit(Decimal(0)).cast("decimal(38,10)")))


def huge_money(c: Column) -> Column:
    """Sum (double) of the amounts that ``exact_money`` leaves out; NULL when there is none."""
    v = c.cast("double")
    return F.sum(F.when(F.abs(v) >= _EXACT_BELOW, v))


def whole_money(exact: Column, huge: Column) -> Column:
    """Double total of the two parts."""
    return exact.cast("double") + F.coalesce(huge, F.lit(0.0))


def money_sum(c: Column) -> Column:
    """Sum of money, as double; an empty or all-null group sums to 0."""
    return whole_money(exact_money(c), huge_money(c))


def ratio(num: Column, den: Column) -> Column:
    """num / den in double; NULL when den is 0 or either side is NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent1(num: Column, den: Column) -> Column:
    """num / den * 100, rounded to 1 decimal (half-even); NULL on /0."""
    return round1(ratio(num, den) * F.lit(100.0))

