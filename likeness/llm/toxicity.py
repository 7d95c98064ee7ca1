"""Toxicity scores by weak supervision.

1. Voters. Every word and every word beginning (4, 6 or 8 bytes) that is found
   oftener in rows labelled toxic, and by more than chance (for as many as are tested),
   votes: the 256 with the highest likelihood ratio each for itself, all others in groups
   of like strength. Of words and beginnings that stand for the same words
   only the shortest is taken. A voter votes "toxic" for the texts that have its word or beginning.
   Further voters need no labels: each list of ``LEXICONS`` (a word of it occurs) and each of
   ``PATTERNS`` (shouting, repeated marks, masked, spaced-out and stretched letters).
2. A generative label model estimates, by expectation maximisation, how often each voter
   fires on toxic and on clean texts, and from the correlations that remain within a class
   how much a voter only repeats others; repeated evidence is divided among the voters that
   share it. The given label is one more voter: how often it is 1 on toxic and on clean texts is
   estimated from its agreement with the others and has no floor, so that labels that the
   others contradict are turned over, and given ones are kept where the others are silent.
   The result is a posterior label.
3. A linear (logistic) classifier of the votes, of the number of words voted for and of
   their share is fitted to the posterior labels by Newton steps, and scores all texts.

The voters' counts come from all labelled rows, summed in the tasks first. Label model and
classifier are fitted on at most ``sample_rows`` ids of these, chosen by a hash of the id.
Held-out rows (crc32 of the id as text divisible by 5) are never among either.

Null and empty texts get the score of a text without votes. Repeated rows get
equal scores; long texts are read whole. A label that is null is none; of
several labels of one id the highest counts. Without labels of both kinds there are
no voters and all scores are the share of toxic labels (0 without any). Other columns are
kept by ``with_toxicity``.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.words import ALPHANUMERIC, Members, slices, span_hashes, utf8, word_bounds
from likeness.sources.checkpoints import written

SAMPLE_ROWS = 16384
VOTERS = 256
#: From here on (log odds against the share of toxic rows) begin the groups of further voters.
GROUPS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
LEAST_ROWS = 4
BEGINNINGS = (4, 6, 8)
SLICE_BYTES = 1 << 20

# Short lists of open insults and threats; a caller's own may take their place.
LEXICONS = {
    "insults": ("idiot", "idiots", "moron", "morons", "stupid", "scum", "pathetic", "worthless",
                "dumm", "trottel", "abschaum", "imbécile", "crétin", "estúpido", "basura"),
    "threats": ("kill", "murder", "strangle", "hurt", "umbringen", "töten", "tuer", "matar"),
}
PATTERNS = {
    "shouting": r"\b[A-Z]{4,}\b[^a-z]{1,3}\b[A-Z]{4,}\b",
    "repeated marks": r"[!?]{2,}",
    "masked letters": r"\b[A-Za-z]+[*@$#]+[A-Za-z]+\b",
    "spaced-out letters": r"\b[A-Za-z](?:[ .-][A-Za-z]){3,}\b",
    "stretched letters": "(?i:" + "|".join(f"{c}{{4,}}" for c in "abcdefghijklmnopqrstuvwxyz") + ")",
}


@dataclass
class Votes:
    """What may vote in a slice of texts: per kind, hashes and the words they stand in."""
    hashes: list[np.ndarray]
    words: list[np.ndarray]
    text: np.ndarray  # of each word
    n_words: np.ndarray  # of each text


def evidence(texts: pa.Array) -> Votes:
    """Hashes of all words and word beginnings; those of beginnings differ from words'."""
    data, bounds = utf8(texts)
    begin, end = word_bounds(data, bounds, ALPHANUMERIC)
    text = np.searchsorted(bounds, begin, "right") - 1
    hashes, words = [span_hashes(data, begin, end)], [np.arange(len(begin))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - begin > k)
        hashes.append(span_hashes(data, begin[longer], begin[longer] + k) ^ np.uint64(0x5555 * k))
        words.append(longer)
    return Votes(hashes, words, text, np.bincount(text, minlength=len(texts)))


def _counts(batches):
    """Rows with each hash, and toxic rows with it, of each slice; the least and greatest
    hash of a word that it stands for, and its length if it is a beginning."""
    for batch in batches:
        for begin, end in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(begin, end - begin)
            toxic = np.asarray(part.column("toxic").to_pylist(), np.int64)
            votes = evidence(part.column("text"))
            hashes = np.concatenate(votes.hashes)
            of = votes.hashes[0][np.concatenate(votes.words)].view(np.int64)
            length = np.repeat([127, *BEGINNINGS], [len(h) for h in votes.hashes])
            by_hash = np.argsort(hashes, kind="stable")
            pairs = np.stack([hashes, np.concatenate([votes.text[w] for w in votes.words]).astype(np.uint64)])
            order = np.lexsort((pairs[1], pairs[0]))
            pairs = pairs[:, order]
            new = np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)][:pairs.shape[1]]
            pairs = pairs[:, new]
            first = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]][:pairs.shape[1]])
            if len(first):
                ones = toxic[pairs[1].astype(np.int64)]
                same = np.flatnonzero(np.r_[True, np.diff(hashes[by_hash]) != 0])
                yield pa.RecordBatch.from_arrays([
                    pa.array(pairs[0, first].view(np.int64)),
                    pa.array(np.add.reduceat(ones, first)),
                    pa.array(np.diff(np.r_[first, pairs.shape[1]]).astype(np.int64)),
                    pa.array(np.minimum.reduceat(of[by_hash], same)),
                    pa.array(np.maximum.reduceat(of[by_hash], same)),
                    pa.array(length[by_hash][same].astype(np.int64))],
                    ["hash", "toxic", "n", "low", "high", "length"])


def lexicon_hashes(words) -> np.ndarray:
    votes = evidence(pa.array([" ".join(words)]))
    return np.unique(votes.hashes[0])


@dataclass
class Voters:
    members: Members
    vote: np.ndarray  # of each member, the number of its vote
    n_members: int  # numbers of votes that members have; those of lists and patterns follow
    lexicons: tuple = ()  # hashes of the words of each list
    patterns: tuple = ()

    @property
    def n_votes(self) -> int:
        return self.n_members + len(self.lexicons) + len(self.patterns)

    def fired(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts and numbers of their votes (each pair once); words voted for; words."""
        votes = evidence(texts)
        at, number = [], []
        for hashes, words in zip(votes.hashes, votes.words):
            found = self.members.positions(hashes)
            at.append(words[found])
            number.append(self.vote[np.searchsorted(self.members.keys, hashes[found])])
        at, number = np.concatenate(at), np.concatenate(number)
        marked = np.bincount(votes.text[np.unique(at)], minlength=len(texts))
        text, next_vote = [votes.text[at]], self.n_members
        numbers = [number]
        for members in self.lexicons:
            text.append(votes.text[members.positions(votes.hashes[0])])
            numbers.append(np.full(len(text[-1]), next_vote))
            next_vote += 1
        whole = pc.fill_null(texts.cast(pa.large_string()), "") if self.patterns else None
        for pattern in self.patterns:
            text.append(np.flatnonzero(pc.match_substring_regex(whole, pattern).to_numpy(zero_copy_only=False)))
            numbers.append(np.full(len(text[-1]), next_vote))
            next_vote += 1
        n = max(1, self.n_votes)
        pairs = np.unique(np.concatenate(text) * n + np.concatenate(numbers))
        return pairs // n, pairs % n, marked, votes.n_words


def _shares(marked: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Two features: words voted for (logarithm), and their share of all."""
    return np.stack([np.log1p(marked), np.minimum(50.0 * marked / np.maximum(n_words, 1), 5.0)], axis=1)


def _fire(voters: Voters):
    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                text, number, marked, n_words = voters.fired(part.column("text"))
                first = np.searchsorted(text, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([
                    part.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(number, pa.int32())),
                    pa.array(marked, pa.int64()), pa.array(n_words, pa.int64())],
                    ["toxic", "fired", "marked", "n_words"])
    return run


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def posterior_labels(fired: np.ndarray, given: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Chance that each row is toxic, by the generative label model.

    ``fired``: rows by voters, 0 or 1. ``given``: the labels, one more voter, from which the
    rates of the others start only.
    """
    q = np.clip(given, 0.05, 0.95)
    # What each class is taken to hold beforehand, as one row: a voter's share in all rows, so
    # that a voter that never fires says nothing, and a label that is right in 95 of 100 cases.
    share, usual = given.mean(), np.clip(fired.mean(axis=0), 1e-6, 1 - 1e-6)
    for _ in range(rounds):
        prior = np.clip((q.sum() + share) / (len(q) + 1), 1e-6, 1 - 1e-6)
        on = np.stack([(fired * w[:, None]).sum(0) + usual for w in (1 - q, q)])
        rate = np.clip(on / np.array([[(1 - q).sum() + 1], [q.sum() + 1]]), 1e-9, 1 - 1e-9)
        rest = fired - (rate[0] + q[:, None] * (rate[1] - rate[0]))
        spread = np.sqrt((rest ** 2).mean(0)) + 1e-9
        correlation = rest.T @ rest / len(fired) / np.outer(spread, spread)
        repeats = np.where(correlation > 0.2, correlation, 0).sum(0)
        yes, no = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        votes = (fired * yes + (1 - fired) * no) @ (1 / np.maximum(repeats, 1))
        right = ((given * q).sum() + 0.95) / (q.sum() + 1)
        wrong = ((given * (1 - q)).sum() + 0.05) / ((1 - q).sum() + 1)
        label = np.where(given > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        before, q = q, np.clip(_sigmoid(np.log(prior / (1 - prior)) + votes + label), 1e-4, 1 - 1e-4)
        if np.abs(q - before).max() < 1e-4:
            break
    return q


def fit_logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last; Newton steps, halved while the loss would rise."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - target @ z + (ridge * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - target) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-4:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1, abs(now)):
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    weights: np.ndarray  # of the voters, the two shares, and the intercept

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, number, marked, n_words = self.voters.fired(texts)
        z = _shares(marked, n_words) @ self.weights[-3:-1] + self.weights[-1]
        np.add.at(z, text, self.weights[:-3][number])
        return _sigmoid(z)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        voters: int = VOTERS, lexicons: dict = LEXICONS, patterns: dict = PATTERNS,
        join: str = "merge") -> ToxicityModel:
    """Learn from the labelled rows of ``docs`` that are not held out.

    ``join``: as labels are taken to grow with the documents, texts and labels meet by a
    shuffle, at every size; "broadcast" is for labels known to be few, and shuffles no text.
    """
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("long").alias("toxic"))
    labelled = written(docs.select("doc_id", "text").where(~held_out()).join(chosen.hint(join), "doc_id"), "labelled")
    total, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    toxic = toxic or 0
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        intercept = np.log(max(share, 1e-15) / max(1 - share, 1e-15))
        none = np.empty(0, np.uint64)
        return ToxicityModel(Voters(Members(none), none.astype(np.int64), 0), np.array([0.0, 0.0, intercept]))
    counts = labelled.select("text", "toxic").mapInArrow(
        _counts, "hash long, toxic long, n long, low long, high long, length long").groupBy("hash").agg(
            F.sum("toxic").alias("t"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.min("length").alias("length")).where(F.col("t") >= LEAST_ROWS)
    # In as many rows and with the same words: one of them says all.
    counts = written(counts.groupBy("t", "n", "low", "high").agg(
        F.min(F.struct("length", "hash")).alias("shortest")).select("shortest.hash", "t", "n"), "counts")
    rate = toxic / total

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    t, n = F.col("t"), F.col("n")
    ratio = (part(t, n * rate) + part(n - t, n * (1 - rate)) + part(toxic - t, (total - n) * rate)
             + part(total - toxic - n + t, (total - n) * (1 - rate)))
    # Twice the ratio is distributed as chi square: of m without a tie to the labels, less than one exceeds log m.
    ranked = counts.where((t > n * rate) & (n < total)).withColumn("ratio", ratio).where(
        F.col("ratio") >= float(np.log(max(1, counts.count()))))
    best = ranked.orderBy(F.col("ratio").desc(), "hash").limit(voters).select("hash").toArrow()
    beyond = ranked.select("hash", "t", "n").toArrow()
    own = best.column("hash").to_numpy().view(np.uint64)
    members = Members(beyond.column("hash").to_numpy().view(np.uint64))
    vote = np.empty(len(members.keys), np.int64)
    t, n = beyond.column("t").to_numpy(), beyond.column("n").to_numpy()
    strength = np.log((t + 0.5) / (n - t + 0.5)) - np.log(rate / (1 - rate))
    at = np.searchsorted(members.keys, beyond.column("hash").to_numpy().view(np.uint64))
    vote[at] = len(own) + np.digitize(strength, GROUPS)
    vote[np.searchsorted(members.keys, own)] = np.arange(len(own))
    found = Voters(
        members, vote, len(own) + len(GROUPS) + 1,
        tuple(Members(lexicon_hashes(words)) for words in lexicons.values()), tuple(patterns.values()))
    n_votes = found.n_votes
    # At most sample_rows ids: small enough for every task.
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = labelled.join(F.broadcast(ids), "doc_id").select("text", "toxic")
    rows = sample.mapInArrow(_fire(found), "toxic long, fired array<int>, marked long, n_words long").toArrow()
    given = rows.column("toxic").to_numpy().astype(float)
    fired = np.zeros((len(given), n_votes), np.float32)
    lists = rows.column("fired").combine_chunks()
    fired[np.repeat(np.arange(len(given)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    target = posterior_labels(fired, given)
    shares = _shares(rows.column("marked").to_numpy(), rows.column("n_words").to_numpy())
    return ToxicityModel(found, fit_logistic(np.column_stack([fired, shares]), target))


def with_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` and a column ``toxicity`` (0 to 1); one of that name is replaced."""
    docs = docs.drop("toxicity")

    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column("_text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), pa.array(model.scores(part.column("_text")), pa.float64())],
                    ["_doc", "toxicity"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    schema = f"_doc {packed.dtypes[0][1]}, toxicity double"
    return packed.mapInArrow(run, schema).select(
        *[F.col("_doc")[c].alias(c) for c in docs.columns], "toxicity")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = with_toxicity(docs, fit(docs, labels))
    return scored.where(F.col("toxicity") < threshold).select(*[f"`{c}`" for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
