"""Token counts of documents in flat token files that have no index.

A flat file is the ids of all its documents one after the other, an end-of-document id after
each, and nothing that says where documents begin. It is kept as a table of equal blocks
(``file``, ``block``, ``ids``: little-endian unsigned numbers of 2 or 4 bytes); blocks pay no heed
to documents. Each block is searched at once for the end id, by itself and in any order.
What crosses blocks is stitched by a prefix scan over one narrow row per block: the ids
before it, and the last end before it, give the place and the length of the document that
the first end of the block closes.

``count_tokens`` gives one row per document: empty ones count 0, what follows the last end of a
file is a document that has not ended, a document may span any number of blocks, a file
without ids has none. ``write_flat`` keeps row order within a task; null and empty texts
are empty documents, repeated rows are repeated documents, a null id stays null. The end id is
50256, which no text gives, as strings of special tokens count as ordinary text.
"""

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.llm.tokenfiles import SLICE_BYTES, _encoder
from likeness.llm.words import slices
from likeness.sources.checkpoints import checkpoint_dir

END_ID = 50_256
BLOCK_IDS = 1 << 16
FLAT = "file int, block int, ids binary, doc_ids array<long>"


def _flat_block(file: int, block: int, ids: np.ndarray, docs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([file], pa.int32()), pa.array([block], pa.int32()),
        pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.array([docs], pa.list_(pa.int64()))],
        ["file", "block", "ids", "doc_ids"])


def _encode_flat(path: str, end_id: int, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, file, block = _encoder(path), TaskContext.get().partitionId(), 0
        held, docs = np.empty(0, np.uint32), []
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                tokens, _ = encoder.encode([t or "" for t in part.column("text").to_pylist()], end_id)
                held = np.concatenate([held, tokens])
                docs += part.column("doc_id").to_pylist()
                while len(held) >= block_ids:
                    n = int((held[:block_ids] == end_id).sum())
                    yield _flat_block(file, block, held[:block_ids], docs[:n])
                    held, docs, block = held[block_ids:], docs[n:], block + 1
        if len(held):
            yield _flat_block(file, block, held, docs)
    return run


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
               block_ids: int = BLOCK_IDS) -> None:
    """A flat file per task, without a shuffle; ids of the documents stand in a column of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_encode_flat(tokenizer, end_id, block_ids), FLAT).write.parquet(path)


def _find_ends(end_id: int, width: int):
    def run(batches):
        for batch in batches:
            counts, ends = [], []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer() or b"", f"<u{width}")
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([
                batch.column("file"), batch.column("block"), pa.array(counts, pa.int64()),
                pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])
    return run


def find_ends(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Of each block: ``before`` (ids before it), ``documents`` ended before it, ``last`` (place of
    the last end before it, -1 if none), its number of ids, and its ``ends``."""
    found = blocks.select("file", "block", "ids").mapInArrow(
        _find_ends(end_id, width), "file int, block int, n_ids long, ends array<long>")
    up_to = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("n_ids").over(up_to), F.lit(0)))
    own_last = F.when(F.size("ends") > 0, F.col("before") + F.try_element_at("ends", F.lit(-1)))
    return placed.withColumn("own_last", own_last).withColumns({
        "documents": F.coalesce(F.sum(F.size("ends")).over(up_to), F.lit(0)),
        "last": F.coalesce(F.max("own_last").over(up_to), F.lit(-1))}).drop("own_last")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """``file, block, document, start, n_tokens, ended`` of each document, in the block of its end."""
    scanned = find_ends(blocks, end_id, width)
    ended = scanned.where(F.size("ends") > 0).select(
        "file", "block", "documents", "before", "last", "ends", F.posexplode("ends").alias("place", "at")).select(
            "file", "block", "place", (F.col("documents") + F.col("place")).alias("document"),
            (F.when(F.col("place") == 0, F.col("last")).otherwise(
                F.col("before") + F.get("ends", F.col("place") - 1)) + 1).alias("start"),
            (F.col("before") + F.col("at")).alias("stop"), F.lit(True).alias("ended"))
    total = scanned.groupBy("file").agg(
        F.max("block").alias("block"), F.sum("n_ids").alias("stop"), F.sum(F.size("ends")).alias("document"),
        F.greatest(F.max("last"), F.max(F.col("before") + F.try_element_at("ends", F.lit(-1)))).alias("last"))
    open_ = total.where(F.col("stop") > F.col("last") + 1).select(
        "file", "block", F.lit(None).cast("int").alias("place"), F.col("document").cast("long").alias("document"),
        (F.col("last") + 1).alias("start"), "stop", F.lit(False).alias("ended"))
    return ended.unionByName(open_).select(
        "file", "block", "place", "document", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/flat-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_flat(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    flat = spark.read.schema(FLAT).parquet(path)
    names = flat.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    return count_tokens(flat).join(names, ["file", "block", "place"]).select("doc_id", "n_tokens")
