"""Benchmark decontamination with suffix arrays of the training texts.

Every slice of the documents (a shard) gets an array of its word suffixes in sorted
order, without those that begin like no test text: a suffix stays if its first four
words (or, for test items shorter than that, its first words) stand somewhere in the
benchmark, so that nothing that could match is left out. Every test suffix of the window
length is then found by binary search: the range of its matches gives all places, and
places that follow each other along test and training text make the longest verbatim
matches.

The documents are read once and not shuffled. The benchmark goes to the tasks in blocks
of bounded size, each in a pass of its own over the rows of a task.

Null and empty texts have no words, no hits and are not contaminated. Repeated rows
give repeated results; a long text is searched whole. Test items without words match
nothing; repeated item ids count once, items
with a null id hit as others do and count as one item without a name. An empty benchmark leaves all clean. Other
columns of the documents are kept by ``decontaminate``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.words import ALPHANUMERIC, Members, runs, slices, words_of

WINDOW = 13
ANCHOR = 4
SLICE_BYTES = 2 << 20
#: Words of test text sent to the tasks at a time (about 16 bytes each).
BLOCK_WORDS = 1_000_000

FOUND = ("hits array<struct<first:long,words:long>>, items array<string>, "
         "longest long, n_words long")


class Suffixes:
    """Test suffixes, ready to be searched in the suffix array of a slice."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        words = words_of(pa.array([t for _, t in items], pa.large_string()), ALPHANUMERIC)
        self.vocabulary = np.unique(words.hashes)
        # Items without an id are one item, the last.
        self.names = sorted({None if i is None else str(i) for i, _ in items}, key=lambda i: (i is None, i))
        at = {n: i for i, n in enumerate(self.names)}
        ids = (np.searchsorted(self.vocabulary, words.hashes) + 1).astype(">u4")
        anchors: dict[int, list[np.ndarray]] = {}
        keys, owners = [], []
        for i, (name, _) in enumerate(items):
            low, high = words.first[i], words.first[i + 1]
            n = min(window, high - low)
            if not n:
                continue
            short = min(n, ANCHOR)
            anchors.setdefault(short, []).append(runs(words.hashes[low:high], short))
            for p in range(low, high - n + 1):
                keys.append(ids[p:p + n].tobytes())
                owners.append((at[None if name is None else str(name)], p - low))
        self.anchors = {n: Members(np.concatenate(x)) for n, x in anchors.items()}
        by_key: dict[bytes, list[tuple[int, int]]] = {}
        for key, owner in zip(keys, owners):
            by_key.setdefault(key, []).append(owner)
        ordered = sorted(by_key)
        width = 4 * window
        self.low = np.array(ordered, f"S{width}")
        self.high = np.array([k + b"\xff" * (width - len(k)) for k in ordered], f"S{width}")
        self.length = np.array([len(k) // 4 for k in ordered], np.int64)
        # All items that have the suffix, and one place of it.
        self.items = [sorted({i for i, _ in by_key[k]}) for k in ordered]
        self.place = np.array([by_key[k][0] for k in ordered], np.int64).reshape(-1, 2)

    def suffix_array(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes that may match, in the order of their words; the keys."""
        places = [self.anchors[n].positions(runs(words.hashes, n)) for n in self.anchors]
        at = np.unique(np.concatenate(places)) if places else np.empty(0, np.int64)
        if not len(at):
            return at, np.empty(0, f"S{4 * self.window}")
        ends = words.first[np.searchsorted(words.first, at, "right")]
        key = np.zeros((len(at), self.window), ">u4")
        for j in range(self.window):
            inside = np.flatnonzero(at + j < ends)
            values = words.hashes[at[inside] + j]
            found = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
            key[inside, j] = np.where(self.vocabulary[found] == values, found + 1, 0)
        key = key.view(f"S{4 * self.window}").ravel()
        order = np.argsort(key, kind="stable")
        return at[order], key[order]

    def search(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences: the place of a word and the number of the test suffix it begins."""
        at, key = self.suffix_array(words)
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left = np.searchsorted(key, self.low, "left")
        n = np.maximum(np.searchsorted(key, self.high, "right") - left, 0)
        suffix = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)
        return at[left[suffix] + offset], suffix


def _longest(place, suffix, tests: Suffixes, texts, n_texts: int) -> np.ndarray:
    """Words in the longest match of each text, along one test item."""
    best = np.zeros(n_texts, np.int64)
    item, offset = tests.place[suffix].T
    order = np.lexsort((place, place - offset, item))
    place, offset, item, suffix = place[order], offset[order], item[order], suffix[order]
    text = texts[order]
    breaks = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(item) != 0)
                                  | (np.diff(place - offset) != 0) | (np.diff(text) != 0)])
    lengths = np.diff(np.r_[breaks, len(place)]) - 1 + tests.length[suffix[breaks]]
    np.maximum.at(best, text[breaks], lengths)
    return best


def _find(tests: Suffixes):
    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            column = batch.column("text")
            for begin, end in slices(column, SLICE_BYTES):
                part = rows.slice(begin, end - begin)
                texts = part.column("text").combine_chunks()
                yield from _search_slice(part, texts, tests).to_batches()
    return run


def _search_slice(part: pa.Table, texts: pa.Array, tests: Suffixes) -> pa.Table:
    words = words_of(texts, ALPHANUMERIC)
    n = len(texts)
    place, suffix = tests.search(words)
    longest = np.zeros(n, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    if len(place):
        text = np.searchsorted(words.first, place, "right") - 1
        steps = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(steps, place, 1)
        np.add.at(steps, place + tests.length[suffix], -1)
        covered = np.r_[False, np.cumsum(steps[:-1]) > 0, False]
        opens, closes = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
        longest = _longest(place, suffix, tests, text, n)
        # A covered stretch may run on into the next text: cut it at the texts' ends.
        for low, high in zip(opens.tolist(), closes.tolist()):
            while low < high:
                t = int(np.searchsorted(words.first, low, "right")) - 1
                stop = min(high, int(words.first[t + 1]))
                spans[t].append({"first": low - int(words.first[t]), "words": stop - low})
                low = stop
        pairs = np.unique(np.stack([text, suffix]), axis=1)
        found: dict[int, set[int]] = {}
        for t, s in pairs.T.tolist():
            found.setdefault(t, set()).update(tests.items[s])
        for t, numbers in found.items():
            items[t] = [tests.names[i] for i in sorted(numbers)]
    new = {
        "hits": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
        "items": pa.array(items, pa.list_(pa.string())),
        "longest": pa.array(longest, pa.int64()),
        "n_words": pa.array(np.diff(words.first), pa.int64()),
    }
    for name, values in new.items():
        part = part.append_column(name, values)
    return part


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """Test items, at most about ``block_words`` words at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t") / 2 + 1).alias("n")).first()["n"] or 0
    n = max(1, int(-(-total // block_words)))
    if n == 1:
        yield [tuple(r) for r in rows.collect()]
        return
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, item: str = "item_id",
                 text: str = "text", window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the verbatim matches of each text.

    Adds ``n_words``, ``matches`` (stretches of words that windows cover, as first word
    and number), ``match_items`` (ids of items with windows in the text) and
    ``longest_match`` (words). Columns of these names are replaced.
    """
    added = ("n_words", "matches", "match_items", "longest_match")
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col("text"))
    found = []
    for b, items in enumerate(_blocks(benchmark, item, text, block_words)):
        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "words") + ", " + FOUND
        rows = rows.drop("words").mapInArrow(_find(Suffixes(items, window)), schema)
        one = {c: f"{c}{b}" for c in ("hits", "items", "longest")}
        rows = rows.withColumnsRenamed(one).withColumnRenamed("n_words", "words")
        found.append(one)
        rows = rows.select("doc", "text", F.col("words"), *[c for f in found for c in f.values()])
    merged = F.array_sort(F.concat(*[F.col(f["hits"]) for f in found]))
    return rows.select(
        *[F.col("doc")[c].alias(c) for c in kept],
        F.col("words").alias("n_words"),
        (merged if len(found) == 1 else _union(merged)).alias("matches"),
        F.array_sort(F.array_distinct(F.concat(*[F.col(f["items"]) for f in found]))).alias("match_items"),
        F.greatest(*[F.col(f["longest"]) for f in found], F.lit(0)).alias("longest_match"))


def _union(spans):
    """Stretches joined where they touch or overlap; they come in order."""
    def add(done, x):
        last = F.element_at(done, -1)
        end = last["first"] + last["words"]
        wider = F.struct(last["first"].alias("first"),
                         (F.greatest(end, x["first"] + x["words"]) - last["first"]).alias("words"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (x["first"] <= end), joined).otherwise(
            F.concat(done, F.array(x)))
    empty = F.array().cast("array<struct<first:long,words:long>>")
    return F.aggregate(spans, empty, add)


def contaminated(n_hit, n_words):
    """At least a twentieth of the words stand in matches."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hit_words() -> Column:
    return F.aggregate("matches", F.lit(0).cast("long"), lambda s, x: s + x["words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find_matches(docs, benchmark)
    return found.where(~contaminated(hit_words(), F.col("n_words"))).select(*[f"`{c}`" for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n,
                    unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
             FROM d CROSS JOIN sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("match_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "match_items"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"))
