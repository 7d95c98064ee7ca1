"""Field similarities between two records, as column expressions."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.binding import bind
from likeness.functions.normalize import WHITESPACE, parse_date, strip, text
from likeness.schemas import MISSING_DATE_DELTA


def exact_match(a: Column, b: Column) -> Column:
    """1.0 when both are equal and non-empty."""
    return F.when((a == b) & (a != ""), 1.0).otherwise(0.0)


def text_key(c: Column) -> Column:
    """What the text similarity compares."""
    return strip(F.lower(text(c)))


def tokens(c: Column) -> Column:
    """Distinct lower-cased words; none for empty text."""
    words = F.split(text_key(c), f"[{WHITESPACE}]+")
    return F.array_remove(F.array_distinct(words), "")


def token_overlap(ta: Column, tb: Column) -> Column:
    """Jaccard overlap of two token sets, 0 when either is empty."""
    def share(shared):
        return shared / (F.size(ta) + F.size(tb) - shared)
    filled = (F.size(ta) > 0) & (F.size(tb) > 0)
    return F.when(filled, share(F.size(F.array_intersect(ta, tb)))).otherwise(0.0)


def addr_overlap(a: Column, b: Column) -> Column:
    return bind(
        F.struct(tokens(a).alias("a"), tokens(b).alias("b")),
        lambda s: token_overlap(s["a"], s["b"]))


def same_area(x: Column, y: Column) -> Column:
    """1.0 for equal codes, 0.5 for six-digit codes equal but for the last."""
    near = (
        (F.char_length(x) == 6)
        & (F.char_length(y) == 6)
        & (F.left(x, F.lit(5)) == F.left(y, F.lit(5)))
    )
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(near, 0.5)
        .otherwise(0.0)
    )


def pincode_match(a: Column, b: Column) -> Column:
    return same_area(strip(text(a)), strip(text(b)))


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates, a large sentinel when either is missing."""
    days = F.abs(F.datediff(a, b)).cast("double")
    return F.coalesce(days, F.lit(MISSING_DATE_DELTA))


def dob_delta_days(a: Column, b: Column) -> Column:
    return day_gap(parse_date(a), parse_date(b))


# The prefix bonus of Winkler's variant and the similarity above
# which it applies.
PREFIX_LENGTH = 4
PREFIX_WEIGHT = 0.1
PREFIX_FROM = 0.7


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two texts, lower-cased and trimmed."""
    return key_similarity(text_key(a), text_key(b))


def key_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two text keys."""
    sides = F.struct(a.alias("x"), b.alias("y"))
    return bind(sides, lambda s: (
        F.when((s["x"] == "") | (s["y"] == ""), 0.0)
        .when(s["x"] == s["y"], 1.0)
        .otherwise(bind(_jaro(s["x"], s["y"]), lambda j: _boosted(j, s["x"], s["y"])))))


def _jaro(x: Column, y: Column) -> Column:
    """One pass over ``x`` claims equal characters of ``y`` within reach.

    A claimed character is overwritten by NUL, so that it is claimed once; a
    second pass over the claimed places counts those that differ in order.
    """
    lx, ly = F.char_length(x), F.char_length(y)
    one, taken = F.lit(1), F.lit("\0")
    reach = F.greatest((F.greatest(lx, ly) / 2).cast("int") - 1, F.lit(0))

    def claim(s, i):
        char = F.substr(x, i, one)
        at = F.call_function("locate", char, s["rest"], F.greatest(one, i - reach))
        return F.when(
            (at > 0) & (at <= i + reach),
            F.struct(
                F.overlay(s["rest"], taken, at, one).alias("rest"),
                F.concat(s["seen"], char).alias("seen")),
        ).otherwise(s)

    def compare(seen):
        def step(s, place):
            differs = F.substr(seen, s["n"] + 1, one) != F.substr(y, place, one)
            return F.struct(
                (s["n"] + 1).alias("n"),
                (s["moved"] + differs.cast("int")).alias("moved"))
        return step

    def similarity(s):
        m = F.char_length(s["seen"]).cast("double")
        places = F.filter(
            F.sequence(one, ly), lambda p: F.substr(s["rest"], p, one) == taken)
        moved = F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("moved")),
            compare(s["seen"]), lambda t: F.floor(t["moved"] / 2))
        return F.when(
            m > 0, (m / lx + m / ly + (m - moved) / m) / 3).otherwise(0.0)

    return F.aggregate(
        F.sequence(one, lx),
        F.struct(y.alias("rest"), F.lit("").alias("seen")), claim, similarity)


def _boosted(jaro: Column, x: Column, y: Column) -> Column:
    prefix = F.lit(0)
    for n in range(1, PREFIX_LENGTH + 1):
        same = F.left(x, F.lit(n)) == F.left(y, F.lit(n))
        long = (F.char_length(x) >= n) & (F.char_length(y) >= n)
        prefix = F.when(same & long, n).otherwise(prefix)
    return F.when(
        jaro > PREFIX_FROM, jaro + prefix * PREFIX_WEIGHT * (1 - jaro)).otherwise(jaro)


def _char_codes(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row per text padded with zeros, and the lengths."""
    lengths = values.str.len().to_numpy(dtype=np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    codes = np.array(values.tolist(), dtype=f"U{width}").view(np.uint32)
    return codes.reshape(len(values), width), lengths


def _jaro_winkler_kernel(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler over all rows at once; the loop is over character places.

    Rows are taken in order of length, in slices, so that one long text does
    not widen the arrays of the others.
    """
    sim = np.zeros(len(a))
    longest = np.maximum(a.str.len().to_numpy(), b.str.len().to_numpy())
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(order):
        stop = min(start + 2048, len(order))
        # A slice holds at most some 4M character cells, one row at least.
        while stop - start > 1 and (stop - start) * longest[order[stop - 1]] > 4 << 20:
            stop = start + (stop - start) // 2
        rows = order[start:stop]
        sim[rows] = _jaro_winkler_slice(a.iloc[rows], b.iloc[rows])
        start = stop
    return sim


def _jaro_winkler_slice(a: pd.Series, b: pd.Series) -> np.ndarray:
    ca, la = _char_codes(a)
    cb, lb = _char_codes(b)
    rows, place = np.arange(len(la)), np.arange(cb.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = place < lb[:, None]
    inside = free.copy()
    claimed = np.zeros(ca.shape, dtype=bool)
    for i in range(ca.shape[1]):
        lo = max(i - int(reach.max(initial=0)), 0)
        hi = i + int(reach.max(initial=0)) + 1
        window = slice(lo, hi)
        hit = (
            (cb[:, window] == ca[:, i:i + 1])
            & free[:, window]
            & (np.abs(place[window] - i) <= reach[:, None])
            & (i < la)[:, None]
        )
        if not hit.shape[1]:
            break
        first = hit.argmax(axis=1)
        found = hit[rows, first]
        claimed[:, i] = found
        free[rows[found], lo + first[found]] = False
    m = claimed.sum(axis=1)
    width = min(ca.shape[1], cb.shape[1])
    seen_a = np.take_along_axis(
        ca, np.argsort(~claimed, axis=1, kind="stable"), axis=1)[:, :width]
    seen_b = np.take_along_axis(
        cb, np.argsort(~(inside & ~free), axis=1, kind="stable"), axis=1)[:, :width]
    moved = ((seen_a != seen_b) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    n = min(PREFIX_LENGTH, width)
    same = (ca[:, :n] == cb[:, :n]) & (np.arange(n) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(sim > PREFIX_FROM, sim + prefix * PREFIX_WEIGHT * (1 - sim), sim)


def _once_a_pair(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Each two texts that meet are compared once: cities and states are few."""
    (x, xs), (y, ys) = pd.factorize(a), pd.factorize(b)
    pairs, at = np.unique(x * np.int64(len(ys)) + y, return_inverse=True)
    return _jaro_winkler_kernel(pd.Series(xs[pairs // len(ys)]), pd.Series(ys[pairs % len(ys)]))[at]


def key_similarity_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same similarity of arrays of text keys."""
    sim = np.zeros(len(a))
    equal = a == b
    filled = (a != "") & (b != "")
    sim[equal & filled] = 1.0
    differing = np.flatnonzero(~equal & filled)
    if len(differing):
        sim[differing] = _jaro_winkler_kernel(pd.Series(a[differing]), pd.Series(b[differing]))
    return sim


def key_similarity_batch(a: Column, b: Column) -> Column:
    """The same similarity over Arrow batches.

    Several times faster than the column expression, whose lambdas Spark
    interprets, and so the choice where millions of pairs are scored.
    """
    @F.pandas_udf("double")
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        sim = np.zeros(len(x))
        differing = np.flatnonzero(x.notna().to_numpy())
        if len(differing):
            sim[differing] = _once_a_pair(x.iloc[differing], y.iloc[differing])
        return pd.Series(sim)

    # Python sees only texts that differ.
    asked = F.when((a != b) & (a != "") & (b != ""), a)
    return F.when((a == b) & (a != ""), 1.0).otherwise(batch(asked, b))
