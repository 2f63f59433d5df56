"""Scalar helpers: rounding, strict exceedance, clipping, quantiles of sorted arrays."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_arith(c: Column, ndigits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` in double arithmetic.

    Unlike ``round`` (exact decimal rounding) this is plain IEEE arithmetic, so any engine
    gives the same bits for the same input; used where results are compared across engines.
    """
    p = F.lit(float(10**ndigits))
    # |x| * 10^n must fit a long (floor returns BIGINT); larger values keep their own bits.
    fits = F.abs(c) < F.lit(9.0e18 / 10**ndigits)
    return F.when(fits, F.floor(c * p + F.lit(0.5)).cast("double") / p).otherwise(c)


def maybe_round(c: Column, ndigits: int | None) -> Column:
    """Round to ``ndigits`` places (see ``round_arith``) or leave the value as is."""
    return c if ndigits is None else round_arith(c, ndigits)


def exceed_flag(value: Column, threshold: Column, ndigits: int | None = None) -> Column:
    """Strict ``value > threshold`` as 0/1; a missing value or threshold is *not* an exceedance.

    ``ndigits`` rounds both sides first, so that a threshold equal to a sample stays
    equal after last-bit differences of floating sums.
    """
    v = maybe_round(value, ndigits)
    th = maybe_round(threshold, ndigits)
    return F.coalesce(v > th, F.lit(False)).cast("int")


def clip_scale(c: Column, lo: float, hi: float, scale: bool = False) -> Column:
    """Clip to ``[lo, hi]``; optionally map the range to ``[0, 1]``.  A missing value stays missing."""
    clipped = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))
    if scale:
        return (clipped - F.lit(float(lo))) / F.lit(float(hi - lo))
    return clipped


def sorted_array_quantile(arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array without NULLs (NULL if empty).

    Position ``q * (n - 1)``; between neighbours ``lo + (hi - lo) * frac``.
    """
    n = F.size(arr)
    pos = F.lit(float(q)) * (n - F.lit(1)).cast("double")
    lo_i = F.floor(pos).cast("int")
    hi_i = F.ceil(pos).cast("int")
    lo = F.try_element_at(arr, lo_i + 1)  # NULL, not an error, for an empty array
    hi = F.try_element_at(arr, hi_i + 1)
    frac = pos - lo_i.cast("double")
    val = F.when(lo_i == hi_i, lo).otherwise(lo + (hi - lo) * frac)
    return F.when(n > 0, val)


def dense_line(entries: Column, n: Column | int, index: str = "i", value: str = "v") -> Column:
    """An array of ``n`` values by position from an array of (``index``, ``value``) structs: NULL where no entry has it.

    The entries are sorted once; each then gives the NULLs between the entry before it and itself,
    and its value, and the pieces are joined. So the cost is that of the sort and of writing ``n`` values;
    nothing is looked up. Indices must be distinct and within 0 to ``n`` - 1.
    """
    n = F.lit(n) if isinstance(n, int) else n
    # bound once: what a lambda refers to outside of it is worked out anew for every element
    blanks = F.transform(F.array_repeat(F.lit(0), n), lambda _: F.when(F.lit(False), F.get(entries, F.lit(0))[value]))
    bound = F.array(F.struct(F.sort_array(entries).alias("e"), blanks.alias("blanks")))

    def line(s: Column) -> Column:
        def upto(k: Column) -> Column:  # positions up to entry k
            return F.coalesce(F.get(s["e"], k)[index].cast("int"), F.lit(-1)) + 1

        def piece(x: Column, k: Column) -> Column:
            return F.concat(F.slice(s["blanks"], F.lit(1), x[index].cast("int") - upto(k - 1)), F.array(x[value]))

        return F.concat(F.flatten(F.transform(s["e"], piece)), F.slice(s["blanks"], F.lit(1), n - upto(F.size(s["e"]) - 1)))

    return F.get(F.transform(bound, line), F.lit(0))


def lit_array(values) -> Column:
    """A literal array as one SQL expression (one call to the JVM, whatever its length).

    Consecutive integers become ``sequence(lo, hi)``; doubles are written with a ``D`` suffix
    from their shortest exact decimal form, dates as ``DATE'...'`` literals.
    """
    vals = list(values)
    if not vals:
        raise ValueError("empty literal array")
    if all(isinstance(v, bool) for v in vals):
        raise TypeError("boolean arrays are not supported")
    if all(isinstance(v, int) for v in vals):
        if vals == list(range(vals[0], vals[0] + len(vals))):
            return F.sequence(F.lit(vals[0]), F.lit(vals[-1]))
        return F.expr("array(" + ", ".join(str(int(v)) for v in vals) + ")")
    if all(isinstance(v, (int, float)) for v in vals):
        return F.expr("array(" + ", ".join(f"CAST({float(v)!r}D AS DOUBLE)" if float(v) < 0 else f"{float(v)!r}D" for v in vals) + ")")
    if all(isinstance(v, _dt.date) and not isinstance(v, _dt.datetime) for v in vals):
        return F.expr("array(" + ", ".join(f"DATE'{v.isoformat()}'" for v in vals) + ")")
    raise TypeError("unsupported literal array element type")
