"""Language identification: script ranges, then Viterbi over per-word scores.

A word is a longest run of letters. Its score in a language is the sum of
log-probabilities of its hashed character trigrams (with the edges of the word), from
counts over all labelled rows that are not held out: each task counts its rows into one
matrix of languages by 32,768 buckets, and the matrices are summed. The script of a
word's first letter, by ranges of code points, leaves only the languages that were seen
with that script (all, if none was). The labels of the words are the best path
through the scores, with a penalty for each switch of language, so that texts in several
languages come out as spans.

A path of one language is the best if no stretch of words gains more by other languages than
its switches cost; that is tested on sums for all texts of a slice at once, and only the
others are searched word by word, which gives the same result.

A text that is null or has no letter is ``und`` with score 0 and no spans. Languages with a
null label teach nothing, an empty training set makes all ``und``. Ties go to the language
that comes first in order. Repeated rows get equal results, long texts are read whole. The
matrix grows with the number of languages (256 KB each), not with the rows; other
columns are kept by ``with_language``.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.words import slices

BUCKETS = 1 << 15
SWITCH = 12.0
SLICE_BYTES = 1 << 19
SCRIPT_SHARE = 0.01
# First code points of script ranges, and the scripts; 0 is no letter range of its own.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han")]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF_RANGE = np.array([NAMES.index(n) for _, n in SCRIPTS])


def _letters(limit: int = 0x30000) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter, and what it is in lower case."""
    letter, lower = np.zeros(limit, bool), np.arange(limit, dtype=np.uint32)
    for c in range(limit):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            if len(s.lower()) == 1:
                lower[c] = ord(s.lower())
    return letter, lower


_TABLES: list = []


def tables():
    if not _TABLES:
        _TABLES.extend(_letters())
    return _TABLES


@dataclass
class Spelled:
    """The words of a slice of texts, as code points and trigram buckets."""
    first: np.ndarray  # of each text, its first word
    begin: np.ndarray  # of each word, its first character in its text
    end: np.ndarray
    script: np.ndarray  # of each word
    gram_first: np.ndarray  # of each word, its first bucket
    buckets: np.ndarray


def spelled(texts: pa.Array) -> Spelled:
    letter, lower = tables()
    strings = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("\0".join([*strings, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in strings])].astype(np.int64)
    low = np.minimum(points, len(letter) - 1)
    inside = letter[low]
    points = np.where(points < len(letter), lower[low], points)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(begin, bounds)
    # A word of n letters with a blank at each end has n trigrams.
    spaced = np.where(inside, points, 32).astype(np.uint64)
    spaced = np.r_[np.uint64(32), spaced, np.uint64(32)]
    code = (spaced[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ spaced[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            ^ spaced[2:] * np.uint64(0x165667B19E3779F9))
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)
    buckets = code[inside].astype(np.int32)
    lengths = end - begin
    script = SCRIPT_OF_RANGE[np.searchsorted(STARTS, points[begin], "right") - 1]
    text_start = bounds[np.searchsorted(first, np.arange(len(begin)), "right") - 1]
    return Spelled(first, begin - text_start, end - text_start, script, np.cumsum(lengths) - lengths, buckets)


def _count(names: list[str]):
    at = {n: i for i, n in enumerate(names)}

    def run(batches):
        grams = np.zeros((len(names), BUCKETS), np.int64)
        scripts = np.zeros((len(names), len(NAMES)), np.int64)
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                s = spelled(part.column("text"))
                langs = np.array([at[x] for x in part.column("lang").to_pylist()])
                of_word = np.repeat(langs, np.diff(s.first))
                of_gram = np.repeat(of_word, np.diff(np.r_[s.gram_first, len(s.buckets)]))
                grams += np.bincount(of_gram * BUCKETS + s.buckets, minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of_word * len(NAMES) + s.script, minlength=scripts.size).reshape(scripts.shape)
        counts = np.concatenate([grams, scripts], axis=1)
        lang, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[lang, cell])], ["lang", "cell", "n"])
    return run


@dataclass
class LanguageModel:
    names: list[str]
    grams: np.ndarray  # buckets by languages, log-probabilities
    scripts: np.ndarray  # scripts by languages, 0 or a large penalty

    def word_scores(self, s: Spelled) -> np.ndarray:
        if not len(s.begin):
            return np.zeros((0, len(self.names)))
        scores = np.add.reduceat(self.grams[s.buckets], s.gram_first, axis=0, dtype=np.float64)
        return scores + self.scripts[s.script]


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from all rows with a text and a language that are not held out."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~F.coalesce(held_out(), F.lit(False)))
    # One row a language.
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0)))
    # Counts of buckets, scripts after them; at most so many cells a language come to the driver.
    tasks = rows.select("text", "lang").mapInArrow(_count(names), "lang int, cell int, n long")
    sums = tasks.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS + len(NAMES)), np.int64)
    counts[sums.column("lang").to_numpy(), sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS].T.astype(float), counts[:, BUCKETS:].T.astype(float)
    smooth = 0.5
    log_grams = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS))
    seen = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    seen[~seen.any(axis=1)] = True
    return LanguageModel(names, log_grams.astype(np.float32), np.where(seen, 0.0, -1000.0))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best languages of the words, a switch costing ``penalty``."""
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    value = scores[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        best = int(value.argmax())
        switch = value[best] - penalty > value
        back[t] = np.where(switch, best, stay)
        value = np.where(switch, value[best] - penalty, value) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _gains(scores: np.ndarray, first: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the most that any stretch, and any stretch at an end, gains by leaving ``main``.

    Over-estimates only where rounding does.
    """
    n = np.diff(first)
    of_word = np.repeat(main, n)
    rows = np.arange(len(scores))
    own = scores[rows, of_word]
    others = scores.copy()
    others[rows, of_word] = -np.inf
    gain = others.max(axis=1) - own if scores.shape[1] > 1 else np.full(len(own), -1.0)
    within, at_end = np.zeros(len(n)), np.zeros(len(n))
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            sums = np.r_[0.0, np.cumsum(gain[a:b])]
            within[t] = (sums - np.minimum.accumulate(sums)).max()
            at_end[t] = max(sums.max(), (sums[-1] - sums).max())
    return within, at_end


def label_words(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word, by the best path through each text."""
    n = np.diff(first)
    full = n > 0
    main = np.zeros(len(n), np.int64)
    if full.any():
        main[full] = np.add.reduceat(scores, first[:-1][full], axis=0).argmax(axis=1)
    labels = np.repeat(main, n)
    within, at_end = _gains(scores, first, main)
    for t in np.flatnonzero((within > 2 * penalty) | (at_end > penalty)):
        labels[first[t]:first[t + 1]] = viterbi(scores[first[t]:first[t + 1]], penalty)
    return labels


def _predict(model: LanguageModel, penalty: float, spans: bool):
    k = max(1, len(model.names))

    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("_text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                s = spelled(part.column("_text"))
                n = np.diff(s.first)
                known = n > 0 if model.names else np.zeros(len(n), bool)
                letters = np.zeros((len(n), k))
                labels = np.zeros(len(s.begin), np.int64)
                if model.names:
                    labels = label_words(model.word_scores(s), s.first, penalty)
                    np.add.at(letters, (np.repeat(np.arange(len(n)), n), labels), s.end - s.begin)
                best = letters.argmax(axis=1)
                score = letters[np.arange(len(n)), best] / np.maximum(letters.sum(axis=1), 1)
                columns = [part.column("_doc"),
                           pa.array([model.names[b] if y else "und" for b, y in zip(best, known)], pa.string()),
                           pa.array(np.where(known, score, 0.0))]
                if spans:
                    columns.append(_spans(s, labels, known, model.names))
                yield pa.RecordBatch.from_arrays(columns, ["_doc", "language", "language_score", "language_spans"][:len(columns)])
    return run


def _spans(s: Spelled, labels: np.ndarray, known: np.ndarray, names: list[str]) -> pa.Array:
    found = []
    for t, y in enumerate(known.tolist()):
        a, b = int(s.first[t]), int(s.first[t + 1])
        own = labels[a:b]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if y else np.empty(0, np.int64)
        stops = np.r_[cuts[1:], b - a][:len(cuts)]
        found.append([{"start": int(s.begin[a + i]), "end": int(s.end[a + j - 1]), "lang": names[own[i]]}
                      for i, j in zip(cuts.tolist(), stops.tolist())])
    return pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))


def with_language(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """``docs`` with ``language``, ``language_score`` (its share of the letters) and spans.

    ``language_spans`` (``start``, ``end`` in characters, ``lang``) is left out unless asked for.
    Columns of these names are replaced.
    """
    added = ["language", "language_score"] + ["language_spans"] * spans
    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col("text").alias("_text"))
    schema = f"_doc {packed.dtypes[0][1]}, language string, language_score double" + (
        ", language_spans array<struct<start:long,end:long,lang:string>>" if spans else "")
    return packed.mapInArrow(_predict(model, penalty, spans), schema).select(
        *[F.col("_doc")[c].alias(c) for c in kept], *added)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", "text"), model, spans=False).select(
        "doc_id", held_out().alias("held_out"), F.col("language").alias("lang_pred"),
        F.col("language_score").alias("score"))
