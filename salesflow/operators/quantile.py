"""Exact quantile with linear interpolation, selected in rounds without a single-task sort.

``percentile`` keeps a value→count map of the whole column in one task and
``percentile_approx`` is not exact. This operator counts each distinct value
once (partial aggregation, so a value that holds a third of all rows collapses
to one row map-side) and then selects by rank:

1. round one cuts the values into slices of a 64th of a power of two, by sign
   and logarithm, and takes each slice's rows and extremes in one aggregate;
2. the slice that holds the wanted rank is cut again, linearly between its own
   extremes, into ``SLICES`` parts; and so is the part chosen then;
3. what is left spans less than 2**-40 of its magnitude, so it holds about a
   thousand doubles at most, however the values crowd: those are ranked one by
   one. The value after the rank is among them or the smallest one above.

Every round reads the same counts. They are the result of one exchange that
Spark reuses: no round filters them (a filter would be pushed below the
exchange and make it another one); rows outside the chosen slice fall into a
group of their own with weight 0. So the input is scanned once, a round's
histogram has a bounded number of rows, and no window sees more than those.

Nothing is collected to the driver; the result is a one-row DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of a chosen slice, and slices of a power of two in the first round.
SLICES = 1 << 18
PER_OCTAVE = 64


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation a→b at t, evaluated from the nearer end (numpy's form)."""
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)


# What a round knows of the slice that it chose is one array, so that the next round names it once: a plan that
# named its fields would hold the round before several times, and its rounds again. The places are 0 slice,
# 1 rows in all, 2 position (n - 1) q, 3 its whole part (the rank), 4 rows below the slice, 5 and 6 its extremes.
_CHOSEN = "SELECT v, c, {body} AS s FROM (SELECT v, c, (SELECT z FROM {before}) AS z FROM counts)"
_SLICE = """CASE WHEN v < z[5] OR v > z[6] THEN -1D WHEN z[5] = z[6] THEN 0D
            ELSE least({slices} - 1D, floor((v - z[5]) / (z[6] - z[5]) * {slices}D)) END"""
_ROUND = """
{name} AS (
  SELECT min(CASE WHEN s[0] >= 0 AND cum > s[3] THEN array(s[0], s[1], s[2], s[3], cum - rows_in, lo, hi) END) AS z
  FROM (
    SELECT *, s[4] + sum(CASE WHEN s[0] >= 0 THEN rows_in ELSE 0D END)
                     OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM (SELECT s, min(v) AS lo, max(v) AS hi, CAST(sum(c) AS DOUBLE) AS rows_in
          FROM ({chosen}) GROUP BY s)))"""

_QUANTILE_SQL = """
WITH counts AS (
  SELECT v, COUNT(*) AS c
  FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {df})
  WHERE v IS NOT NULL AND NOT isnan(v)
  GROUP BY v),
first AS (
  SELECT min(CASE WHEN cum > floor(pos) THEN array(slice, n, pos, CAST(floor(pos) AS DOUBLE), cum - rows_in, lo, hi) END) AS z
  FROM (
    SELECT *, (n - 1) * {q}D AS pos
    FROM (
      SELECT *, sum(rows_in) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(rows_in) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n
      FROM (
        SELECT sign(v) * coalesce(floor({per_octave} * (1100 + least(log2(abs(v)), 1090D))), 0) AS slice,
               min(v) AS lo, max(v) AS hi, CAST(sum(c) AS DOUBLE) AS rows_in
        FROM counts GROUP BY 1)))),{rounds},
ranked AS (
  SELECT *, s[4] + sum(CASE WHEN s[0] = 0 THEN rows_in ELSE 0D END)
                   OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT s, min(v) AS v, CAST(sum(c) AS DOUBLE) AS rows_in FROM ({last}) GROUP BY s))
SELECT CAST(coalesce(max(s[1]), 0) AS BIGINT) AS n,
       min(CASE WHEN s[0] = 0 AND cum > s[3] THEN v END) AS lo_value,
       coalesce(min(CASE WHEN s[0] = 0 AND cum > least(s[3] + 1, s[1] - 1) THEN v END),
                min(CASE WHEN s[0] = 1 THEN v END)) AS hi_value,
       max(s[2] - s[3]) AS frac
FROM ranked
"""


def exact_quantile(df: DataFrame, column: str, q: float, slices: int = SLICES) -> DataFrame:
    """One row: ``n`` (count of numbers), ``lo_value``, ``hi_value`` and ``value``.

    ``value`` is the q-quantile of the values of ``column`` with linear
    interpolation between order statistics ``floor((n-1)q)`` and the next one;
    NULL when there are no values. NULL and NaN are left out.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be within [0, 1]")
    slices = max(2, int(slices))
    body = "array(" + _SLICE.format(slices=slices) + ", z[1], z[2], z[3], z[4])"
    rounds = ",".join(_ROUND.format(name=name, chosen=_CHOSEN.format(before=before, body=body))
                      for name, before in (("second", "first"), ("third", "second")))
    # Values of the last slice stay apart (0); all smaller and all larger ones form a group each (-1, 1).
    place = "CASE WHEN v < z[5] THEN -1D WHEN v > z[6] THEN 1D ELSE 0D END"
    single = f"array({place}, z[1], z[2], z[3], z[4], CASE WHEN v >= z[5] AND v <= z[6] THEN v END)"
    text = _QUANTILE_SQL.format(column="`" + column.replace("`", "``") + "`", q=repr(float(q)), df="{df}",
                                per_octave=PER_OCTAVE, rounds=rounds, last=_CHOSEN.format(before="third", body=single))
    picked = df.sparkSession.sql(text, df=df)
    return picked.select(
        "n", "lo_value", "hi_value",
        F.when(F.col("frac") == 0, F.col("lo_value"))
        .otherwise(lerp(F.col("lo_value"), F.col("hi_value"), F.col("frac"))).alias("value"))
