"""The label model of toxicity: what it makes of wrong labels, and the voters without labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from likeness.llm import toxicity


def drawn(rng, n=3000, voters=24, share=0.2):
    truth = rng.random(n) < share
    rates = np.where(truth[:, None], rng.uniform(0.2, 0.5, voters), rng.uniform(0.002, 0.03, voters))
    return truth.astype(float), (rng.random((n, voters)) < rates).astype(np.float32)


@pytest.mark.parametrize("wrong", [0.0, 0.1, 0.2])
def test_the_posterior_turns_over_planted_wrong_labels(wrong):
    rng = np.random.default_rng(5)
    truth, fired = drawn(rng)
    given = np.where(rng.random(len(truth)) < wrong, 1 - truth, truth)
    q = toxicity.posterior_labels(fired, given)
    assert ((q > 0.5) == truth).mean() >= 0.985
    turned = (q > 0.5) != given
    assert turned.sum() >= 0.9 * (given != truth).sum() and (given[turned] != truth[turned]).mean() >= 0.9 if wrong else not turned.any()


def test_repeated_voters_count_once():
    rng = np.random.default_rng(6)
    truth, fired = drawn(rng, voters=12)
    given = np.where(rng.random(len(truth)) < 0.1, 1 - truth, truth)
    # One voter that is often wrong, twelve times over, does not outvote the others.
    bad = (rng.random(len(truth)) < np.where(truth > 0, 0.5, 0.2)).astype(np.float32)
    q = toxicity.posterior_labels(np.column_stack([fired, *[bad] * 12]), given)
    assert ((q > 0.5) == truth).mean() >= 0.97


def test_labels_are_kept_where_no_voter_speaks():
    given = np.r_[np.zeros(90), np.ones(10)]
    assert ((toxicity.posterior_labels(np.zeros((100, 3), np.float32), given) > 0.5) == given).all()
    for same in (np.zeros(20), np.ones(20)):  # one kind of label only
        q = toxicity.posterior_labels(np.zeros((20, 2), np.float32), same)
        assert np.isfinite(q).all() and ((q > 0.5) == same).all()


def test_lists_and_patterns_vote():
    found = toxicity.Voters(
        toxicity.Members(np.empty(0, np.uint64)), np.empty(0, np.int64), 0,
        tuple(toxicity.Members(toxicity.lexicon_hashes(w)) for w in toxicity.LEXICONS.values()),
        tuple(toxicity.PATTERNS.values()))
    names = [*toxicity.LEXICONS, *toxicity.PATTERNS]
    texts = ["You IDIOT", "i will kill you", "GO AWAY NOW THEN PLEASE", "what?!", "an i*iot, a m@ron", "so s t u p i d it is",
             "nooooo", "A calm text. With marks? Yes! I B M", "", None, "é" * 5000 + " skills"]
    text, number, marked, n_words = found.fired(pa.array(texts))
    votes = {(int(t), names[v]) for t, v in zip(text, number)}
    assert votes == {(0, "insults"), (1, "threats"), (2, "shouting"), (3, "repeated marks"), (4, "masked letters"),
                     (5, "spaced-out letters"), (6, "stretched letters")}
    assert not marked.any() and n_words[8] == n_words[9] == 0


def test_a_classifier_from_partly_wrong_labels_finds_the_truth(spark):
    rng = np.random.default_rng(7)
    plain = [f"word{i}" for i in range(300)]
    bad = [f"{c}{c}rgh{i}" for i, c in enumerate("bcdfghjklmnp")]
    rows = []
    for i in range(4000):
        toxic = i % 5 == 0
        words = [*rng.choice(plain, 25), *(rng.choice(bad, 4) if toxic else [])]
        rows.append((i, " ".join(rng.permutation(words)), int(toxic), int(toxic != (rng.random() < 0.15))))
    table = spark.createDataFrame(rows, "doc_id long, text string, truth int, toxic int")
    repeated = table.select("doc_id", "text").union(table.select("doc_id", "text").where("doc_id < 40"))
    model = toxicity.fit(repeated, table.select("doc_id", "toxic"))
    scored = toxicity.with_toxicity(table, model).where(toxicity.held_out()).select(
        ((F.col("toxicity") >= 0.5).cast("int") == F.col("truth")).alias("right"),
        (F.col("toxic") == F.col("truth")).alias("label_right")).toPandas()
    assert scored.right.mean() >= 0.98 and scored.label_right.mean() < 0.9
