"""Vector arithmetic and the built-in identity encoder, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.binding import bind
from likeness.schemas import VECTOR_DIM


def fit_width(v: Column, dim: int = VECTOR_DIM) -> Column:
    """Pad with zeros, or cut, to ``dim`` values."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.slice(F.concat(v, padding), 1, dim)


def has_width(v: Column, dim: int = VECTOR_DIM) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    squares = lambda total, x: total + x.cast("double") * x
    return F.sqrt(F.aggregate(v, F.lit(0.0), squares))


def l2_normalise(v: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    def scale(s):
        return F.when(
            s["length"] > 0,
            F.transform(s["v"], lambda x: (x / s["length"]).cast("float"))
        ).otherwise(s["v"])
    return bind(v, lambda u: bind(F.struct(u.alias("v"), norm(u).alias("length")), scale))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at 1 from any other and at 0 from a zero."""
    def distance(length):
        return (
            F.when(length["a"] * length["b"] > 0,
                   F.greatest(1 - dot(a, b) / (length["a"] * length["b"]), F.lit(0.0)))
            .when(length["a"] + length["b"] > 0, 1.0)
            .otherwise(0.0)
        )
    return bind(F.struct(norm(a).alias("a"), norm(b).alias("b")), distance)


def euclidean_distance(a: Column, b: Column) -> Column:
    def squared_gap(x, y):
        gap = x.cast("double") - y
        return gap * gap
    squares = F.zip_with(a, b, squared_gap)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    return DISTANCES[metric](a, b)


def vector_from_json(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def trigram_buckets(text: Column, dim: int = VECTOR_DIM) -> Column:
    """The bucket of every character trigram of the text, in text order."""
    def bucket(i):
        digest = F.md5(F.substr(text, i, F.lit(3)).cast("binary"))
        return (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % dim).cast("int")

    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - 2, F.lit(1)))
    return F.when(
        F.char_length(text) >= 3, F.transform(places, bucket)
    ).otherwise(F.array().cast("array<int>"))


def hashed_trigram_vector(text: Column, dim: int = VECTOR_DIM) -> Column:
    """Counts of the hashed character trigrams of a text, at unit length.

    Buckets are sorted among all places, each of which stands there once; so the run of a
    place is one longer than its count, and one pass over the sorted list gives all.
    """
    def last_of_runs(places):
        return F.filter(
            F.sequence(F.lit(1), F.size(places)),
            lambda i: F.coalesce(F.get(places, i) != F.get(places, i - 1), F.lit(True)))

    def lengths(ends):
        return F.transform(
            ends, lambda end, b: (end - F.coalesce(F.get(ends, b - 1), F.lit(0)) - 1).cast("float"))

    def counts(buckets):
        places = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1))))
        return bind(bind(places, last_of_runs), lengths)

    return bind(
        text, lambda t: l2_normalise(bind(trigram_buckets(t, dim), counts)))
