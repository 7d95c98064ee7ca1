"""Conflict-constrained best-fit packing of documents into training sequences.

A sequence (bin) holds at most ``capacity`` words, and no two documents of one source or
of one cluster of copies. A document longer than that fills whole bins of its own with
its first words; its rest is packed. Pieces are dealt by a hash to shards of about
``shard_pieces``, whatever their source, and each shard is packed by itself, the longest
piece first: bins are kept in the order of what is left in them, each with a bitmap of its
sources and one of its clusters. The search starts at the tightest bin that has room and
goes on to the next larger until one has neither bit in common with the piece. If none
has, a bin is opened.

Null, empty and blank texts have no words and go to no bin (null). A null source and a
cluster with one member in the shard conflict with nothing. Ties in length go to the
smaller id and piece, ties in room to the older bin. Repeated rows are packed as often as
they come, each in another bin, as they are copies (full pieces by their number among equal rows). Long texts are cut, never
shortened. Other columns play no part.
"""

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.sources.checkpoints import written

CAPACITY = 2048
SHARD_PIECES = 4096
BIN_SCHEMA = ("doc_id long, source string, text_hash long, piece long, first_word long, n_words long, "
              "bin_id long, bin_offset long")


def best_fit(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """Bin number and offset of each piece ``(words, source bits, cluster bits)``.

    Pieces come in the order in which they are to be placed.
    """
    room: list[tuple[int, int]] = []  # (words left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for words, source, cluster in pieces:
        at = bisect_left(room, (words, -1))
        while at < len(room) and (sources[room[at][1]] & source or clusters[room[at][1]] & cluster):
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((number, capacity - left))
        sources[number] |= source
        clusters[number] |= cluster
        if left > words:
            insort(room, (left - words, number))
    return placed


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"),
                               ("piece", "ascending"), ("cluster", "ascending")])
        source, cluster = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        seen: dict = {}
        for c in cluster:
            seen[c] = seen.get(c, 0) + 1
        source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(source))} | {None: 0}
        shared = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)} | {None: 0}
        placed = best_fit([
            (w, source_bit[s], shared.get(c, 0))
            for w, s, c in zip(table.column("n_words").to_pylist(), source, cluster)], capacity)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        return table.select(["doc_id", "source", "text_hash", "piece", "first_word", "n_words"]).append_column(
            "bin_id", pa.array([(shard << 32) + b for b, _ in placed], pa.int64())).append_column(
            "bin_offset", pa.array([o for _, o in placed], pa.int64()))
    return run


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def piece_texts(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(_id, text_hash, piece, text), the text of each piece once, however often rows repeat.

    A document of one piece is its whole text; others are cut before words, once a document,
    so that its pieces joined are the text again.
    """
    cut = F.regexp_extract_all("text", F.lit(r"^\s*\S+\s*|\S+\s*"), 0)
    pieces = F.when(words(F.col("text")) <= capacity, F.array(F.col("text"))).otherwise(F.transform(
        F.sequence(F.lit(0), (F.ceil(words(F.col("text")) / capacity) - 1).cast("int")),
        lambda i: F.array_join(F.slice(cut, i * capacity + 1, capacity), "")))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), _text_hash().alias("text_hash"),
        F.posexplode(pieces).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long")).groupBy(
            "_id", "text_hash", "piece").agg(F.first("text").alias("text"))


def _text_hash() -> Column:
    return F.xxhash64("text", F.crc32(F.col("text").cast("binary")))


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
               cluster: Column | None = None) -> DataFrame:
    """As :func:`pack`, with ``text``: what each piece puts into its bin (null where it goes to none).

    Texts are shuffled once, to their pieces; packing itself moves none.
    """
    # No id counts as 0 here: equal texts of both are the same pieces.
    packed = _pack(docs, capacity, shard_pieces, cluster).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    texts = piece_texts(docs.where(words(F.col("text")) > 0), capacity)
    return packed.join(texts, ["_id", "text_hash", "piece"], "left").select(
        *[c for c in packed.columns if c not in ("_id", "text_hash")], "text")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
         cluster: Column | None = None) -> DataFrame:
    """One row per piece: document, words of the document, bin, and place in the bin.

    ``cluster`` names the copies of one text (by default, equal texts but for case and
    white space at the ends).
    """
    return _pack(docs, capacity, shard_pieces, cluster).drop("text_hash")


def _pack(docs: DataFrame, capacity: int, shard_pieces: int, cluster: Column | None) -> DataFrame:
    if cluster is None:
        cluster = F.xxhash64(F.lower(F.trim("text")))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        cluster.alias("cluster"), _text_hash().alias("text_hash"), words(F.col("text")).alias("words"))
    whole = F.floor(F.col("words") / capacity)
    pieces = written(sized.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("long")))).select(
        "doc_id", "source", "cluster", "text_hash", "piece", (F.col("piece") * capacity).alias("first_word"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long").alias("n_words"),
        (F.col("piece") < whole).alias("full")), "pieces")
    part = pieces.where("NOT full AND n_words > 0")
    shards = max(1, -(-part.count() // shard_pieces))
    packed = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards))).groupBy(
        "shard").applyInArrow(_pack_shard(capacity), BIN_SCHEMA)
    # Full pieces need no search; their bins are numbered below zero, by document, piece and,
    # as rows may repeat, the row's number among equal ones.
    equal = W.partitionBy("doc_id", "piece", "cluster", "source").orderBy("n_words")
    full = pieces.where("full").withColumn("copy", F.row_number().over(equal)).select(
        "doc_id", "source", "text_hash", "piece", "first_word", "n_words",
        (-1 - F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "copy"), F.lit(1 << 62))).alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"))
    empty = pieces.where("n_words = 0").select(
        "doc_id", "source", "text_hash", "piece", "first_word", "n_words", F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(full).unionByName(empty)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
