"""Near duplicates among many documents of one template, against all pairs."""

import random

from likeness.llm import neardup, topk


def template(rng, n, words, least, most):
    base = [f"t{i}" for i in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(least, most)):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 7)}"
        yield " ".join(own)


def components_by_hand(sets, percent):
    numbers, parent = {}, list(range(len(sets)))
    bits = [sum(1 << numbers.setdefault(x, len(numbers)) for x in s) for s in sets]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            common = (bits[i] & bits[j]).bit_count()
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [root(i) for i in range(len(sets))], links


def test_no_link_is_lost_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD_ROWS", 100)
    rng = random.Random(3)
    texts = [*template(rng, 900, 300, 5, 13), *template(rng, 20, 60, 0, 3)]
    sets = [frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) for w in map(str.split, texts)]
    wanted, links = components_by_hand(sets, 80)
    assert links > 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, n=4).collect()}
    assert found == dict(enumerate(wanted))


def test_prefix_pairs_hold_all_similar_pairs(spark):
    rng = random.Random(4)
    texts = [*template(rng, 60, 80, 0, 9), *template(rng, 30, 12, 0, 3), "a b", "", "a b c d e"]
    sets = [frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) or frozenset([tuple(w)] if w else []) for w in map(str.split, texts)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, component long, text string")
    for percent in (60, 80, 95):
        found = {(r.a, r.b) for r in neardup.prefix_pairs(df, 4, percent).collect()}
        for i in range(len(sets)):
            for j in range(i):
                common = len(sets[i] & sets[j])
                if common and 100 * common >= percent * len(sets[i] | sets[j]):
                    assert (j, i) in found


def test_repeated_ids_do_not_use_up_the_places_of_copies(spark):
    rows = [(50, [100, 0])] * 8 + [(51, [100, 0]), (52, [90, 0])] + [(53, [80, 0])] * 7
    df = spark.createDataFrame(rows, "id long, vector array<long>").repartition(3)
    found = topk.top_k(df.where("id = 50"), df, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(51, 10_000), (52, 9000), (53, 8000), (53, 8000), (53, 8000)]
