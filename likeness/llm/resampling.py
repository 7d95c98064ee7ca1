"""Importance resampling of documents towards a target text, by hashed word runs.

1. Texts are folded: A-Z to lower case, every byte that is in no word to a blank. The
   distinct words of a slice of texts, each between two blanks, make an Aho-Corasick
   dictionary. A word's payload is its CRC-32 and its length.
2. The automaton scans the slice and gives out the payloads in order.
   Payloads of adjacent words are composed: the CRC of ``a b`` follows from the CRC of
   ``a``, one blank, and the CRC and length of ``b``, so that no run of words is ever spelled out.
   The CRC of a run of one to three words, modulo the number of buckets, is its bucket.
3. Buckets are summed over all texts of both tables, a task at a time, then by Spark. A bucket's
   gain is the (floored) logarithm of how much likelier the target is to hold it.
4. A second scan adds up the gains of each document. With Gumbel noise from a hash of its id
   the highest sums are a sample without replacement, in proportion to the weights.
5. Ranks come from a range partitioning of narrow rows: no step holds all scores in one task.

A dictionary lives as long as its slice, so a task's memory is bounded by ``SLICE_BYTES`` and its
longest text. What grows with no table are the buckets, all that reaches the driver.

Null and empty texts have no features and weight 0; they are scored, and drawn only if ``least_words``
is 0. Long texts are read whole. Ties in score go to the smaller id; repeated rows are
scored and ranked each. A null id counts as empty text in its hash. Empty tables count nothing: an empty
target still gives weights, no documents give no rows. Other columns play no part.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.words import ALPHANUMERIC, slices, span_hashes
from likeness.sources.checkpoints import written

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
SLICE_BYTES = 4 << 20
#: Bytes of the longest word that the automaton holds.
DEPTH = 48
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if ALPHANUMERIC[b] else 32 for b in range(256))
ONES = np.uint32(0xFFFFFFFF)


def _step_table() -> np.ndarray:
    """The CRC-32 register after one more byte, for each value of its low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


STEP = _step_table()


def _shifted(table: np.ndarray) -> np.ndarray:
    return STEP[table & 0xFF] ^ (table >> 8)


def _look_up(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, as four tables of 256."""
    return table[0][x & 0xFF] ^ table[1][x >> 8 & 0xFF] ^ table[2][x >> 16 & 0xFF] ^ table[3][x >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps that append 0 to 63 zero bytes, and 64, 128, 256 ... of them."""
    table = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    few = [table]
    for _ in range(64):
        few.append(_shifted(few[-1]))
    many = [few.pop()]
    while len(many) < 26:
        many.append(_look_up(many[-1], many[-1]))
    return np.stack(few), many


FEW, MANY = _shift_tables()
FLAT = FEW.reshape(-1)


def after_blank(crc: np.ndarray) -> np.ndarray:
    """The CRCs of the same texts with a blank behind them."""
    register = crc ^ ONES
    return STEP[(register ^ np.uint32(32)) & 0xFF] ^ (register >> 8) ^ ONES


def composed(crc: np.ndarray, next_crc: np.ndarray, next_length: np.ndarray) -> np.ndarray:
    """The CRCs of two texts put together, from each one's CRC and the second's length."""
    base = (next_length & 63).astype(np.int64) * 1024
    found = FLAT[base + (crc & 0xFF)]
    for k in (1, 2, 3):
        found ^= FLAT[base + 256 * k + (crc >> (8 * k) & 0xFF)]
    rest = next_length >> 6
    for table in MANY:
        at = np.flatnonzero(rest & 1)
        found[at] = _look_up(table, found[at])
        rest = rest >> 1
        if not rest.any():
            break
    return found ^ next_crc


class Dictionary:
    """The distinct words of folded bytes as an automaton, each with its CRC and length.

    Every word stands between two blanks and holds none, so a failure can only lead to the state
    behind the next blank: the automaton is the trie of the words and that one link. Its goto table
    is kept by depth, ``table[state * classes + class of byte]``.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        first = np.unique(span_hashes(data, begin, end), return_index=True)[1]
        begin, end = begin[first], end[first]
        inside = end - begin <= DEPTH
        begin, end = begin[inside], end[inside]
        view = memoryview(data)
        self.length = end - begin
        self.crc = np.fromiter((zlib.crc32(view[b:e]) for b, e in zip(begin.tolist(), end.tolist())), np.uint32)
        self.class_of = np.cumsum(np.bincount(data, minlength=256) > 0) - 1  # a blank is the lowest byte
        self.classes = int(self.class_of[-1]) + 1
        self.tables, self.words = [], []
        state, states, live = np.zeros(len(begin), np.int64), 1, np.arange(len(begin))
        while len(live):
            depth = len(self.tables)
            key = state[live] * self.classes + self.class_of[data[begin[live] + depth]]
            edges, state[live] = np.unique(key, return_inverse=True)
            table = np.full(states * self.classes, -1, np.int32)
            table[edges] = np.arange(len(edges))
            states = len(edges)
            done = self.length[live] == depth + 1
            word = np.full(states, -1, np.int32)
            word[state[live[done]]] = live[done]
            self.tables.append(table)
            self.words.append(word)
            live = live[~done]

    def scan(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each word, in order.

        The automaton is in the state behind a blank wherever a word begins, so all words are
        walked side by side, a byte of each at a time. Words longer than ``DEPTH`` bytes are not in it; their
        CRCs are computed where they stand.
        """
        found = np.full(len(begin), -1, np.int32)
        live, state, place = np.arange(len(begin)), np.zeros(len(begin), np.int64), begin
        ahead = self.class_of[data[place]]
        for table, word in zip(self.tables, self.words):
            state = table[state * self.classes + ahead]
            place = place + 1
            ahead = self.class_of[data[place]]
            closed = (ahead == 0) & (state >= 0)
            found[live[closed]] = word[state[closed]]
            on = (ahead != 0) & (state >= 0)
            live, state, place, ahead = live[on], state[on].astype(np.int64), place[on], ahead[on]
        crc, length = self.crc[found] if len(self.crc) else np.zeros(len(found), np.uint32), end - begin
        view = memoryview(data)
        for i in np.flatnonzero(found < 0).tolist():
            crc[i] = zlib.crc32(view[begin[i]:end[i]])
        return crc, length


class Features:
    """Buckets of all runs of words in a slice of texts."""

    def __init__(self, texts: pa.Array, longest: int, buckets: int):
        rows = texts.cast(pa.large_binary()).fill_null(b"").to_pylist()
        # A blank before each text, and one at the end.
        data = np.frombuffer(b" ".join([b"", *rows, b""]).translate(FOLD), np.uint8)
        opens = np.cumsum([1, *[len(r) + 1 for r in rows]])
        blank = data == 32
        begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        crc, length = Dictionary(data, begin, end).scan(data, begin, end)
        text = np.searchsorted(opens, begin, "right") - 1
        self.n_words = np.bincount(text, minlength=len(rows))
        self.runs = [(crc % np.uint32(buckets), text)]
        run = crc
        for n in range(1, longest):
            if len(run) < 2:
                break
            run = composed(after_blank(run[:-1]), crc[n:], length[n:])
            inside = text[:-n] == text[n:]
            self.runs.append((run[inside] % np.uint32(buckets), text[:-n][inside]))


def _counted(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for begin, end in slices(texts, SLICE_BYTES):
                for bucket, _ in Features(texts.slice(begin, end - begin), longest, buckets).runs:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of words of ``text`` fall into each bucket."""
    rows = texts.select("text").mapInArrow(_counted(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target is to hold a bucket."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([
        math.floor(1000.0 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
        for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for begin, end in slices(texts, SLICE_BYTES):
                features = Features(texts.slice(begin, end - begin), longest, len(gain))
                n = end - begin
                weight, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for bucket, text in features.runs:
                    # Whole numbers far below 2**53: sums in doubles are exact.
                    weight += np.bincount(text, gain[bucket], n).astype(np.int64)
                    count += np.bincount(text, minlength=n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, n), pa.array(features.n_words.astype(np.int64)),
                    pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
    return run


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Adds ``rank`` (1 for the highest score) to the best ``percent`` hundredths.

    Rows are dealt by ranges of score; a row's rank is the number of rows in the ranges before
    its own and its place in it.
    """
    order = [F.col("score").desc(), F.col("doc_id")]
    rows = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "ranked")
    place = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn(
        "_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = sorted(place.groupBy("_range").agg(F.count("*")).collect())  # one row a range
    before = np.cumsum([0, *[n for _, n in sizes]])
    offsets = rows.sparkSession.createDataFrame(
        [(r, int(b)) for (r, _), b in zip(sizes, before)], "_range long, _before long")
    rank = F.col("_before") + F.col("_place") + 1
    drawn = percent * int(before[-1]) // 100
    return place.join(F.broadcast(offsets), "_range").select(
        *scored.columns, F.when(rank <= drawn, rank).alias("rank"))


def importance(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document.

    ``rank`` is null for documents that are not among the drawn: the highest ``percent`` hundredths by
    score of those with at least ``least_words`` words.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_weighed(gain, longest), (
        f"doc_id {kind}, n_words long, n_features long, weight long"))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(rows.withColumn("score", F.col("weight") + noise), "scored")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(scored.where(F.col("n_words") >= least_words), percent).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with their own columns."""
    drawn = importance(docs, target, **options).where(F.col("rank").isNotNull())
    return docs.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi").select(
        *[f"`{c}`" for c in docs.columns])


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
