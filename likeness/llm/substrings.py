"""Repeated passages between documents, by compaction of a De Bruijn graph of words.

1. Documents are dealt by id into slices of bounded text. A text that a document of a smaller id has too,
   by two 64-bit hashes, is a copy: all its runs repeat, and it takes no further part.
2. Every run of ``k`` words is an edge between its first and its last ``k - 1`` words, and is named by the
   hashes of these two nodes. Only edges that may repeat are built: a run's minimiser is the least hash of
   the shorter runs inside it, so equal runs have equal minimisers, and neighbours mostly share one. A
   minimiser that one document alone holds rules out all runs under it. Each slice names a minimiser once,
   so one that is everywhere gives no more rows than there are slices.
3. The edges of the rest are named once per slice, with the coordinates of their first place (smallest
   id, then place). The least of all slices is the edge's source. An edge that only one document holds
   does not repeat and leaves the graph.
4. Paths without branches are compacted: a join at the nodes gives each edge the one before it, where a node
   has one edge in and one out, and the path runs on if the two follow each other at the source too.
5. Back in its slice, a document's runs are looked up. Runs that follow each other along one path, at
   consecutive source coordinates, are stitched into spans; so a span is verbatim a stretch of its
   source document, and its length and both places are known. Words of spans whose source is a
   document with a smaller id are removed.

All is judged on the input, not on what is left of it. No step holds all places of an edge: hot
passages meet as one row a slice.

Null and empty texts have no words; texts of fewer than ``k`` words have no runs and stay whole. Long
texts are read whole, by one task each. Rows with the same id are one document, whose rows do not remove
each other's words. A null id is no source and loses nothing. Columns other than id and text are kept by
:func:`without_repeats`, whatever their names. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from likeness.llm.words import EXACT, VISIBLE, runs, words_of
from likeness.sources.checkpoints import written

WINDOW = 13
MINIMISER = 6
SLICE_BYTES = 4 << 20

SPANS = "array<struct<first:long,words:long,source:{kind},source_first:long>>"


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


class Runs:
    """The runs of ``k`` words of a slice of texts, in order."""

    def __init__(self, texts: pa.Array, k: int):
        self.words = words_of(texts, VISIBLE, EXACT)
        text = self.words.text
        self.at = np.flatnonzero(text[:len(text) - k + 1] == text[k - 1:]) if len(text) >= k else np.empty(0, np.int64)
        self.text = text[self.at]
        self.place = self.at - self.words.first[self.text]
        self.k = k

    def minimisers(self, m: int) -> np.ndarray:
        """The least hash of the runs of ``m`` words inside each run."""
        least, width = runs(self.words.hashes, m), 1
        wanted = self.k - m + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        return least[self.at]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the nodes that each run leaves and enters."""
        node = runs(self.words.hashes, self.k - 1)
        return node[self.at], node[self.at + 1]


def edge_key(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    return source ^ (target << np.uint64(1))


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in sorted order."""
    if not len(order):
        return np.empty(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return np.flatnonzero(new)


def _slice_of(table: pa.Table) -> int:
    return table.column("slice")[0].as_py() if table.num_rows else 0


def _copies(table: pa.Table, side: pa.Table) -> list:
    """The first document with the same text of each row of a slice; null for what is no copy."""
    side = side.filter(side.column("copy").is_valid())
    first = dict(zip(zip(side.column("copy").to_pylist(), side.column("digest").to_pylist()), side.column("first").to_pylist()))
    return [first.get(x) for x in zip(table.column("doc_id").to_pylist(), table.column("digest").to_pylist())]


def _originals(table: pa.Table, side: pa.Table) -> pa.Table:
    """Documents with an id that are no copies, in order of the id."""
    alone = pa.array([f is None for f in _copies(table, side)], pa.bool_())
    table = table.filter(pa.compute.and_(alone, table.column("doc_id").is_valid()))
    return table.select(["slice", "doc_id", "text"]).sort_by("doc_id")


def _marks(k: int, m: int):
    """One row per minimiser of a slice; ``held`` is odd if more than one of its documents holds it."""
    def run(table: pa.Table, copies: pa.Table) -> pa.Table:
        table = _originals(table, copies)
        found = Runs(_text(table), k)
        least, text = found.minimisers(m) if len(found.at) else np.empty(0, np.uint64), found.text
        new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])] if len(least) else np.empty(0, bool)
        least, text = least[new], text[new]
        order = np.argsort(least, kind="stable")
        begin = _groups(order, least)
        several = text[order[begin]] != text[order[np.r_[begin[1:], len(order)][:len(begin)] - 1]]
        return pa.table({
            "mark": pa.array(least[order[begin]].view(np.int64)),
            "held": pa.array(2 * _slice_of(table) + several.astype(np.int64))})
    return run


def _edges(k: int, m: int):
    """One row per edge under a live minimiser of a slice, with its first place there."""
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        table = _originals(table, side)
        found = Runs(_text(table), k)
        marks = np.sort(side.column("mark").drop_null().to_numpy().view(np.uint64))
        keep = np.empty(0, np.int64)
        if len(found.at) and len(marks):
            least = found.minimisers(m)
            near = np.minimum(np.searchsorted(marks, least), len(marks) - 1)
            keep = np.flatnonzero(marks[near] == least)
        source, target = (x[keep] for x in found.nodes()) if len(keep) else (np.empty(0, np.uint64),) * 2
        text, place = found.text[keep], found.place[keep]
        order = np.argsort(edge_key(source, target), kind="stable")  # texts and places stay in order
        begin = _groups(order, source, target)
        last = order[np.r_[begin[1:], len(order)][:len(begin)] - 1]
        first = order[begin]
        return pa.table({
            "node": pa.array(source[first].view(np.int64)),
            "next": pa.array(target[first].view(np.int64)),
            "slice": pa.array(np.full(len(begin), _slice_of(table)), pa.int64()),
            "doc_id": table.column("doc_id").take(pa.array(text[first])),
            "place": pa.array(place[first].astype(np.int64)),
            "several": pa.array(text[first] != text[last])})
    return run


def compacted(places: DataFrame) -> DataFrame:
    """Repeated edges of each slice: ``node, next, slice, several, source`` and whether the path ``goes_on``.

    ``places`` has one row per edge and slice: ``node``, ``next``, ``slice``, the ``doc_id`` and ``place`` of the
    first holder there, and whether there are ``several``. A path goes on at an edge if its node has one edge in
    and one out, and both follow each other in the same document. A window over an edge holds as many rows as
    there are slices.
    """
    edge, node = W.partitionBy("node", "next"), W.partitionBy("node")
    own = F.struct("doc_id", "place", "slice")
    rows = places.repartition("node").select(
        "*", F.min(own).over(edge).alias("source"), F.count("*").over(edge).alias("_slices"),
        F.max("several").over(edge).alias("_any")).where("_slices > 1 OR _any").withColumn(
            "_source", (own == F.col("source")).cast("int"))
    ins = rows.where("_source = 1").groupBy(F.col("next").alias("n")).agg(
        F.count("*").alias("ins"), F.max("source.doc_id").alias("before_doc"), F.max("source.place").alias("before_place"))
    goes_on = ((F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("before_doc") == F.col("source.doc_id"))
               & (F.col("before_place") + 1 == F.col("source.place")))
    return rows.withColumn("outs", F.sum("_source").over(node)).join(ins, F.col("node") == F.col("n"), "left").select(
        "node", "next", "slice", "several", "source", F.coalesce(goes_on, F.lit(False)).alias("goes_on"))


def _found(k: int, row, schema: pa.Schema):
    """``row`` of every document of a slice, given its repeated edges and its copies."""
    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        found, copies = Runs(_text(table), k), _copies(table, side)
        repeated = side.filter(side.column("edge").is_valid())
        key = repeated.column("edge").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, repeated = key[order], repeated.take(pa.array(order))
        at = source = np.empty(0, np.int64)
        if len(found.at) and len(key):
            wanted = edge_key(*found.nodes())
            near = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            at = np.flatnonzero(key[near] == wanted)
            source = near[at]
        text, place = found.text[at], found.place[at]
        ids, sources = table.column("doc_id"), repeated.column("doc_id")
        own, their = _values(ids, text), _values(sources, source)
        earlier = np.array(their < own, bool) & ids.is_valid().to_numpy()[text] if len(at) else np.empty(0, bool)
        text, place, source, their = text[earlier], place[earlier], source[earlier], their[earlier]
        source_place = repeated.column("place").to_numpy()[source]
        goes_on = repeated.column("goes_on").to_numpy(zero_copy_only=False)[source].astype(bool)
        # Runs one after the other in the text, along one path of the same source.
        new = np.ones(len(text), bool)
        new[1:] = ~(goes_on[1:] & (text[1:] == text[:-1]) & (place[1:] == place[:-1] + 1)
                    & (their[1:] == their[:-1]) & (source_place[1:] == source_place[:-1] + 1))
        begin = np.flatnonzero(new)
        words = np.diff(np.r_[begin, len(text)]) + k - 1
        names = sources.take(pa.array(source[begin])).to_pylist()
        spans = list(zip(place[begin].tolist(), words.tolist(), names, source_place[begin].tolist()))
        bounds = np.searchsorted(text[begin], np.arange(table.num_rows + 1))
        n_words = np.diff(found.words.first).tolist()
        rows = []
        for i, t in enumerate(_text(table).to_pylist()):
            whole = copies[i] is not None and n_words[i] >= k
            rows.append(row(t or "", [(0, n_words[i], copies[i], 0)] if whole else spans[bounds[i]:bounds[i + 1]]))
        columns = {n: table.column(n) for n in table.column_names if n in schema.names}
        for i, name in enumerate(n for n in schema.names if n not in columns):
            columns[name] = pa.array([r[i] for r in rows], schema.field(name).type)
        return pa.table([columns[n] for n in schema.names], names=schema.names)
    return run


def _values(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Values that compare as the ids do; nulls compare as anything."""
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy()[at]
    known = next((v for v in column.to_pylist() if v is not None), None)
    return np.array([known if v is None else v for v in column.to_pylist()], object)[at]


def _kept(text: str, spans: list[tuple]) -> tuple[list[bytes], int]:
    """The words of a text outside the spans, and how many it has in all."""
    words = text.encode().split()
    keep = np.ones(len(words), bool)
    for first, n, *_ in spans:
        keep[first:first + n] = False
    return [w for w, k in zip(words, keep.tolist()) if k] if spans else words, len(words)


def _sliced(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """Documents with ``slice``, so many that one holds about ``slice_bytes`` of text, and a ``digest``."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.withColumn("slice", F.pmod(dealt, F.lit(max(1, -(-total // slice_bytes))))).withColumn(
        "digest", F.xxhash64("text"))


def _copied(sliced: DataFrame, k: int) -> DataFrame:
    """``slice, copy, digest, first`` of documents whose text one of a smaller id has; ``first`` is the least."""
    rows = sliced.where((F.octet_length("text") >= 2 * k - 1) & F.col("doc_id").isNotNull()).select(
        "slice", F.col("doc_id").alias("copy"), "digest", F.xxhash64(F.lit(k), "text").alias("check"))
    groups = rows.groupBy("digest", "check").agg(F.min("copy").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, ["digest", "check"]).where(F.col("copy") > F.col("first")).select(
        "slice", "copy", "digest", "first")


def _repeats(docs: DataFrame, row, added: dict[str, str], k: int, minimiser: int, slice_bytes: int) -> DataFrame:
    """``doc_id``, the columns of ``docs`` but the text, and those that ``row`` makes of text and spans.

    The texts are shuffled once, by slice, and so are the marks and the edges: what reads them again
    reads the same shuffle, as long as it names the same columns (and no filter for nulls slips under it).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sliced = _sliced(docs, slice_bytes)
    copies = written(_copied(sliced, k), "copies")
    slices = sliced.groupBy("slice")
    marks = slices.cogroup(copies.groupBy("slice")).applyInArrow(
        _marks(k, minimiser), "mark long not null, held long").repartition("mark")
    live = marks.groupBy("mark").agg(F.count("*").alias("n"), F.max(F.col("held").bitwiseAND(1)).alias("several")).where(
        "n > 1 OR several = 1").select("mark")
    wanted = marks.join(live, "mark").select(F.shiftright("held", 1).alias("slice"), "mark")
    places = slices.cogroup(wanted.unionByName(copies, allowMissingColumns=True).groupBy("slice")).applyInArrow(
        _edges(k, minimiser), f"node long not null, next long not null, slice long not null, doc_id {kind}, place long, several boolean")
    repeated = compacted(places).where("several OR slice <> source.slice").select(
        "slice", F.col("node").bitwiseXOR(F.shiftleft("next", 1)).alias("edge"), "source.doc_id", "source.place", "goes_on")
    fields = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*fields, *T._parse_datatype_string(
        ", ".join(f"{n} {t.format(kind=kind)}" for n, t in added.items()))])
    return slices.cogroup(repeated.unionByName(copies, allowMissingColumns=True).groupBy("slice")).applyInArrow(
        _found(k, row, to_arrow_schema(schema)), schema)


def _digest(text: str, spans: list[tuple]) -> tuple:
    kept, n = _kept(text, spans)
    named = [dict(zip(("first", "words", "source", "source_first"), s)) for s in spans]
    return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), named


def repeats(docs: DataFrame, k: int = WINDOW, minimiser: int = MINIMISER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, spans``.

    ``spans`` are the stretches of words that a document with a smaller id holds too: first word
    and number of words, and the source's id and first word there. Spans may overlap.
    """
    added = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "spans": SPANS}
    return _repeats(docs.select("doc_id", "text"), _digest, added, k, minimiser, slice_bytes)


def without_repeats(docs: DataFrame, k: int = WINDOW, minimiser: int = MINIMISER,
                    slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with the words of their texts that no document of a smaller id has in a run of ``k``.

    The words that stay are joined by single blanks; a null text stays null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(
        F.col("text").isNull().alias("none"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    found = _repeats(rows, lambda text, spans: (b" ".join(_kept(text, spans)[0]).decode(),),
                     {"kept": "string"}, k, minimiser, slice_bytes)
    made = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("rest.none"), F.col("kept"))}
    return found.select(*[made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS source FROM r GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q
      FROM r JOIN f ON r.g = f.g WHERE f.source < r.doc_id),
k AS (SELECT doc_id, list(q) AS gone FROM x GROUP BY doc_id),
s AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM s
"""


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
