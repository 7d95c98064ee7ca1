"""Token files in Simple-8b blocks: written in order of the documents, and read back.

The texts are sorted by ``doc_id`` over the partitions, so that each partition is one
shard of the file: a Parquet table with one row per block. A block holds whole
documents, about 64 thousand ids or one longer document, as 64-bit words (see
``simple8b``), with the ids of its documents, the offsets of their first tokens in
the block, and its own offset in the shard. Blocks decode by themselves and all at
once; the offsets of shards are sums of one number each. As Spark commits the
table, a lost task writes its shard again and none is half there.

Texts are cut at spaces between words, where the tokenizer cuts in any case, and each
piece is encoded once per worker; texts with runs of white space, where that might
differ, are encoded whole. Strings of special tokens count as ordinary text, unless
``special`` is set: then they become the tokens, as by the library's default (``op3_tokens``).
Ids from 1,048,575 on are written as escapes.

Null and empty texts have the end id alone. Rows with equal ids follow each other in the
order of their texts; a null id comes first. A long text is one block. Other columns are
not written. An empty table gives an empty file.
"""

import json
import re
import sys
import types
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.llm import simple8b
from likeness.llm.words import slices
from likeness.sources.checkpoints import checkpoint_dir

END_ID = 2
BLOCK_IDS = 1 << 16
SLICE_BYTES = 4 << 20
#: Pieces a worker remembers before it starts anew (about 200 bytes each).
PIECES = 1_000_000
#: Pieces encoded at a time.
TOGETHER = 20_000
BLOCKS = ("shard int, block int, first_token long, doc_ids array<long>, doc_offsets array<long>, "
          "n_tokens long, words binary, escaped binary")
# White space next to white space or to an end of the text, or a mark used below.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
UNSURE = re.compile(r"\s\s|\A\s|\s\Z|\x00")
SPACE = re.compile(r"\s")
#: All white space but the blank and the line end.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EDGES = (" ", "\n")
#: How a byte-level model spells bytes: visible ones as they stand, the others from U+0100 on.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(0x100)) - set(VISIBLE)))}
ASCII_SPACES = sum(c.isascii() for c in OTHER_SPACE)  # they come first


class Store:
    """Arrays of ids one after the other, growing as needed."""

    def __init__(self):
        self.flat, self.first, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append ``len(lengths)`` arrays given as one."""
        begin, end = self.first[self.n], self.first[self.n] + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[begin:end] = ids
        self.first[self.n + 1:self.n + len(lengths) + 1] = begin + np.cumsum(lengths)
        self.n += len(lengths)

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the arrays of these numbers one after the other, and their lengths."""
        lengths = self.first[number + 1] - self.first[number]
        total = np.cumsum(lengths)
        shift = np.repeat(self.first[number] - total + lengths, lengths)
        return self.flat[shift + np.arange(len(shift))], lengths


class Encoder:
    """Ids of texts, remembering those of pieces between spaces."""

    def __init__(self, path: str, special: bool = False):
        from unicodedata import ucd_3_2_0

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # Strings that are tokens wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.model = self.tokenizer.model if _spells_letters(self.tokenizer) else None
        # What was a letter in an old Unicode and is one now is one to the pre-tokenizer, too.
        self.letters = {c for c in map(chr, range(0x10000)) if c.isalpha() and ucd_3_2_0.category(c)[0] == "L"}
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.store = Store()

    def whole(self, text: str) -> np.ndarray:
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; places in the text, which nobody asks for, are not worked out."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(pieces, range(self.store.n, self.store.n + len(pieces))))
        self.store.add(ids, lengths)

    def learn_words(self, words: list[str], space: str) -> None:
        """Encode words many at a time, line ends in between; ``space`` comes before each."""
        if self.model is not None:
            plain = [w for w in words if w.isascii() or self.letters.issuperset(w.lstrip("\x00"))]
            self.learn_plain(plain, space)
            if len(plain) == len(words):
                return
            words = [w for w in words if w not in self.known]
        for i in range(0, len(words), TOGETHER):
            some = words[i:i + TOGETHER]
            joined = self.whole(space + ("\n" + space).join([w.lstrip("\x00") for w in some]))
            ends = np.flatnonzero(joined == self.line) if self.line is not None else []
            if len(ends) != len(some) - 1:
                self.learn_each(some)
                continue
            inside = np.ones(len(joined), bool)
            inside[ends] = False
            self.keep(some, joined[inside], np.diff(np.r_[-1, ends, len(joined)]) - 1)

    def learn_plain(self, words: list[str], space: str) -> None:
        """Encode words of letters, which the pre-tokenizer would leave whole, by the tokenizer's model itself."""
        tokenize, before = self.model.tokenize, BYTES[ord(" ")] if space else ""
        ids, ends = [], [0]
        for w in words:
            w = w.lstrip("\x00")
            ids += [t.id for t in tokenize(before + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)))]
            ends.append(len(ids))
        self.keep(words, np.array(ids, np.uint32), np.diff(ends))

    def learn_each(self, pieces: list[str]) -> None:
        ids = self.each([p[1:] if p[:1] == "\x00" else p if p == "\n" else " " + p for p in pieces])
        if ids:
            self.keep(pieces, np.concatenate(ids), np.array([len(x) for x in ids]))

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces; a word and the marks after it are encoded apart."""
        words, first, marked, others = {}, {}, [], {}
        for p in pieces:
            word = p.rstrip(MARKS)
            kind = words if word.isalpha() else first if word[:1] == "\x00" and word[1:].isalpha() else None
            if kind is None:
                others[p] = None
                continue
            kind[word] = None
            if len(word) < len(p):
                tail = "\x00" + p[len(word):]
                others[tail] = None
                marked.append((p, word, tail))
        self.learn_words([w for w in words if w not in self.known], " ")
        self.learn_words([w for w in first if w not in self.known], "")
        self.learn_each([p for p in others if p not in self.known])
        if marked:
            ids, lengths = self.store.take(np.array([self.known[x] for _, w, t in marked for x in (w, t)], np.int64))
            self.keep([p for p, _, _ in marked], ids, lengths.reshape(-1, 2).sum(axis=1))

    def uncuttable(self, text: str) -> bool:
        """Whether a cut at blanks and line ends might change the ids."""
        other = OTHER_SPACE[:ASCII_SPACES] if text.isascii() else OTHER_SPACE
        if any(c in text for c in other):
            if UNSURE.search(text):
                return True
        elif text[:1] in EDGES or text[-1:] in EDGES or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return True
        return "\x00" in text or any(a in text for a in self.added)

    def encode(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id after it; and how many each has."""
        if len(self.known) > PIECES:
            self.forget()
        cut, counts, odd = [], [], {}
        for i, t in enumerate(texts):
            if self.uncuttable(t):
                odd[i] = self.whole(t)
                counts.append(0)
            elif t:
                # \x00 marks what no space comes before.
                cut.append("\x00" + t)
                counts.append(t.count(" ") + 2 * t.count("\n") + 1)
            else:
                counts.append(0)
        # Each piece of these texts is looked up once.
        joined = pa.array([" ".join(cut).replace("\n", " \n \x00")] if cut else [], pa.large_string())
        pieces = pc.split_pattern(joined, " ").flatten().dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.known.get, own))
        new = [i for i, n in enumerate(number) if n is None]
        if new:
            self.learn([own[i] for i in new])
            for i in new:
                number[i] = self.known[own[i]]
        ids, lengths = self.store.take(np.array(number, np.int64)[pieces.indices.to_numpy()])
        total = np.r_[0, np.cumsum(lengths)]
        ends = np.r_[0, np.cumsum(counts)]
        per_text = total[ends[1:]] - total[ends[:-1]]
        n = per_text + 1
        for i, x in odd.items():
            n[i] = len(x) + 1
        out = np.empty(int(n.sum()), np.uint32)
        stops = np.cumsum(n)
        out[stops - 1] = end_id
        inside = np.ones(len(out), bool)
        inside[stops - 1] = False
        for i, x in odd.items():
            out[stops[i] - n[i]:stops[i] - 1] = x
            inside[stops[i] - n[i]:stops[i] - 1] = False
        out[inside] = ids
        return out, n


def _spells_letters(tokenizer) -> bool:
    """Whether letters between blanks reach the tokenizer's model as one word, their bytes spelt by ``BYTES``."""
    from tokenizers import models, pre_tokenizers

    cut = tokenizer.pre_tokenizer
    if not (isinstance(tokenizer.model, models.BPE) and isinstance(cut, pre_tokenizers.ByteLevel)):
        return False
    options = json.loads(cut.__getstate__())
    return options["use_regex"] and not options["add_prefix_space"] and (
        tokenizer.normalizer is tokenizer.truncation is tokenizer.padding is None)


def _encoder(path: str, special: bool = False) -> Encoder:
    """One per Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if (path, special) not in kept.by_path:
        kept.by_path[path, special] = Encoder(path, special)
    return kept.by_path[path, special]


def _block(shard: int, number: int, first: int, docs: list, sizes: list, ids: list) -> pa.RecordBatch:
    ids = np.concatenate(ids)
    words, escaped = simple8b.encode(ids)
    offsets = (np.cumsum(sizes) - sizes).tolist()
    return pa.RecordBatch.from_pylist([{
        "shard": shard, "block": number, "first_token": first, "doc_ids": docs, "doc_offsets": offsets,
        "n_tokens": len(ids), "words": words.astype("<u8").tobytes(),
        "escaped": escaped.astype("<u4").tobytes()}], schema=pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
            ("n_tokens", pa.int64()), ("words", pa.binary()), ("escaped", pa.binary())]))


def _encode_shard(path: str, special: bool):
    def run(batches):
        from pyspark import TaskContext

        encoder, shard = _encoder(path, special), TaskContext.get().partitionId()
        number = first = held = 0
        docs, sizes, ids = [], [], []
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                tokens, n = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                at = 0
                for doc, size in zip(part.column("doc_id").to_pylist(), n.tolist()):
                    docs.append(doc)
                    sizes.append(size)
                    ids.append(tokens[at:at + size])
                    at, held = at + size, held + size
                    if held >= BLOCK_IDS:
                        yield _block(shard, number, first, docs, sizes, ids)
                        number, first, held = number + 1, first + held, 0
                        docs, sizes, ids = [], [], []
        if docs:
            yield _block(shard, number, first, docs, sizes, ids)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, special: bool = False) -> None:
    """Write the token file of ``docs`` (``doc_id``, ``text``) as a table at ``path``.

    ``special``: strings of special tokens become these tokens, else they are ordinary text.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(
        shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_encode_shard(tokenizer, special), BLOCKS).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escaped"], "<u4"), row["n_tokens"])
            bounds = row["doc_offsets"] + [row["n_tokens"]]
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array([row["shard"]] * len(row["doc_ids"]), pa.int32()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(np.array(row["doc_offsets"], np.int64) + row["first_token"], pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
            ], ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in a token file."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row a shard.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    return blocks.mapInArrow(_decode, "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long").join(
        totals, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escaped"], "<u4"), row["n_tokens"])
            bounds = row["doc_offsets"] + [row["n_tokens"]]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of each document in a token file."""
    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return read_index(spark, path)
