"""Every operator on odd tables: nulls, empty and long texts, ties, repeats, clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

from likeness.llm import (components, contamination, htmltext, language, neardup, packing, pii,
                          tokencounts, tokenfiles, topk, toxicity)

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, spans int, matches string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "a"), (2, "One two three four five six", "en", "a"),
            (3, None, None, None), (4, "", "en", "b"), (5, LONG, "en", "a"), (6, LONG + " end", "fr", "a"),
            (7, "  \n ", None, "b"), (8, "one two three four five six", None, None), (9, "☃ 123", "de", "c"),
            (10, "two", "de", "c"), (10, "two", "de", "c"), (None, "no id here at all", None, "z")]
    return spark.createDataFrame([(*r, 0, "clash", 1, "m") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_components_of_paths_stars_and_loops(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(200, i) for i in range(201, 240)] + [(300, 300), (5, 4)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {i: 200 for i in range(201, 240)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, none):
    rows = neardup.near_duplicates(docs, n=4)
    assert rows.count() == docs.count()
    found = by_id(rows, "n_shingles", "component_id", "kept")
    assert found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[8] == (3, 1, False)
    assert found[3] == (0, 3, True) and found[4] == (0, 4, True) and found[7] == (0, 7, True)
    assert found[5][1:] == (5, True) and found[6][1:] == (5, False)
    assert found[10] == (1, 10, True) and found[None][1] is None
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.without_near_duplicates(docs, n=4)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_near_duplicates_equal_comparing_all(spark):
    import random

    rng = random.Random(2)
    texts = []
    for g in range(40):
        base = [f"{rng.randrange(5000)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = "x" + str(rng.randrange(100))
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    assert by_id(neardup.near_duplicates(df, n=4), "n_shingles", "component_id") == expected


def test_near_duplicates_dealt_to_several_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_DOCS", 7)
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + [f"own{i}"] + base[i + 1:])) for i in range(60)] + [(99, "quite another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(neardup.near_duplicates(df, n=4), "component_id")
    assert found == {i: (0,) for i in range(60)} | {99: (99,)}


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, "ONE two, three"), (2, ""), (3, None), (1, "ONE two, three"), (4, "w5 " * 20)], "item_id int, text string")
    found = contamination.find_matches(docs, items)
    assert set(found.columns) == set(docs.columns) | {"n_words", "matches", "match_items", "longest_match"}
    rows = by_id(found, "n_words", "match_items", "longest_match")
    assert rows[1] == (6, ["1"], 3) and rows[3] == (0, [], 0) and rows[9] == (2, [], 0)
    split = contamination.find_matches(docs, items, block_words=20)
    columns = ["doc_id", "n_words", "matches", "match_items"]
    assert sorted(map(str, split.select(columns).collect())) == sorted(map(str, found.select(columns).collect()))
    kept = contamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 9, 10, None}
    assert contamination.find_matches(none, items).count() == 0
    nameless = items.withColumn("item_id", F.when(F.col("item_id") == 4, F.col("item_id")))
    rows = by_id(contamination.find_matches(docs, nameless), "match_items", "longest_match")
    assert rows[1] == ([None], 3) and rows[9] == ([], 0)
    assert contamination.decontaminate(docs, items.where("false")).count() == docs.count()


def test_toxicity(spark, docs, none):
    words = "good day to you my friend and all others here".split()
    rows = [(i, " ".join(words[i % 5:] + (["vile", "rotten"][:1 + i % 2] if i % 4 == 0 else [])), i % 4 == 0) for i in range(400)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    scored = by_id(toxicity.with_toxicity(train, model), "toxicity")
    assert all((scored[i][0] >= 0.5) == y for i, _, y in rows)
    odd = docs.withColumn("toxicity", F.lit("clash"))
    found = toxicity.with_toxicity(odd, model)
    assert found.count() == docs.count() and found.where("toxicity < 0 OR toxicity > 1 OR toxicity IS NULL").isEmpty()
    assert toxicity.with_toxicity(none, model).count() == 0
    for unlabelled in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.without_toxic(train, unlabelled).count() == 400
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_language(docs, none, spark):
    train = spark.createDataFrame(
        [(i, t, g) for i in range(40) for t, g in (("the house and the garden with this thing", "en"), ("der hund und die katze mit einem haus", "de"), ("дом и сад это хорошо", "ru"))],
        "doc_id long, text string, lang string")
    model = language.fit(train)
    found = by_id(language.with_language(docs, model), "language", "language_score", "language_spans")
    assert found[3] == ("und", 0.0, []) and found[4] == ("und", 0.0, []) and found[9] == ("und", 0.0, [])
    assert found[1][0] == "en" and found[5][1] > 0
    mixed = spark.createDataFrame([(1, "the house and the garden with the house and thing, der hund und die katze mit dem hund. сад")], "doc_id long, text string")
    spans = language.with_language(mixed, model).first()["language_spans"]
    text = mixed.first()["text"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert [text[s["start"]:s["end"]][:3] for s in spans] == ["the", "der", "сад"]
    empty = language.fit(none)
    assert {r.language for r in language.with_language(docs, empty).collect()} == {"und"}
    assert language.with_language(none, model).count() == 0


def test_language_paths_equal_word_by_word_search():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (1, 2, 30):
        lengths = rng.integers(0, 40, 50)
        first = np.r_[0, np.cumsum(lengths)]
        scores = rng.normal(0, size, (first[-1], 3))
        labels = language.label_words(scores, first, 2.0)
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                assert (labels[a:b] == language.viterbi(scores[a:b], 2.0)).all()


def test_pii(spark, docs, none):
    text = ("mail: a.b@c.de, 😀 ip 10.0.0.255 not 10.0.0.256; card 4111-1111 1111 1111 no 4111111111111112 "
            "+49 (170) 123-4567. IBAN GB82WEST12345698765432, GB82WEST12345698765433 SSN 123-45-6789 and x@y")
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "9" * 50_000 + "a" * 50_000, "x"), (4, "a@b.c_x@d.e" * 300, "x"), (5, "", "x")], "doc_id long, text string, spans string")
    found = by_id(pii.with_spans(df), "spans")
    kinds = [k for k, *_ in pii.KINDS]
    got = [(kinds[s["kind"]], text[s["start"]:s["end"]]) for s in found[1][0]]
    assert got == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111-1111 1111 1111"),
                   ("phone", "+49 (170) 123-4567"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789")]
    assert found[2] == ([],) and found[3] == ([],) and len(found[4][0]) == 301
    clean = by_id(pii.redacted(df), "text", "spans")
    assert clean[1][0].startswith("mail: <EMAIL>, 😀 ip <IP> not 10.0.0.256; card <CARD> no 4111111111111112 <PHONE>.")
    assert clean[1][1] == "x" and clean[2][0] is None and "@b" not in clean[4][0]
    assert pii.with_spans(none).count() == 0 and pii.redacted(docs).columns == docs.columns
    own = pii.with_spans(df.withColumnsRenamed({"spans": "_email"}).withColumn("__Card", F.lit(7)))
    assert own.columns == ["doc_id", "text", "_email", "__Card", "spans"]
    assert own.where("doc_id = 1").select("_email", "__Card", F.size("spans")).first() == ("x", 7, 6)


def test_packing(docs, none, spark):
    rows = packing.pack(docs, capacity=100, shard_pieces=5).collect()
    pieces = sorted((r.doc_id, r.piece, r.first_word, r.n_words) for r in rows if r.doc_id == 5)
    assert pieces == [(5, i, 100 * i, 100) for i in range(600)]
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    bins = {}
    for r in rows:
        if r.bin_id is None:
            assert r.n_words == 0
            continue
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 100
        sources = [r.source for r in held if r.source is not None]
        assert len(sources) == len(set(sources))
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
    assert packing.pack(none).count() == 0
    twice = spark.createDataFrame([(1, "w " * 250, "a")] * 3, "doc_id long, text string, source string")
    held = {r.bin_id: r.words for r in packing.pack(twice, capacity=100).groupBy("bin_id").agg(F.sum("n_words").alias("words")).collect()}
    assert sorted(held.values()) == [50] * 3 + [100] * 6


def test_packing_equals_plain_best_fit_on_one_shard(spark):
    from test_codes_and_search import _plain_best_fit

    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}") for i in range(200)]
    got = by_id(packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100), "bin_id", "bin_offset")
    ordered = sorted(rows, key=lambda r: (-len(r[1].split()), r[0]))
    texts = [r[1].strip() for r in ordered]
    bit = {t: 1 << i for i, t in enumerate(sorted(set(texts)))}
    plain = _plain_best_fit([(len(r[1].split()), 1 << int(r[2][1:]), bit[t] if texts.count(t) > 1 else 0) for r, t in zip(ordered, texts)], 100)
    assert {r[0]: p for r, p in zip(ordered, plain)} == got


def test_token_files(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = docs.unionByName(spark.createDataFrame(
        [(20, "a  b\n\n c\t d", ), (21, " lead and trail \n"), (22, "x\ny\n\nz  w   v"), (23, "it's <|endoftext|> we'll go"), (24, "\x00 nul"), (25, "a\r\nb \n c")],
        "doc_id long, text string"), allowMissingColumns=True)
    tokenfiles.write_tokens(odd, str(tmp_path / "t"), path)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    start = 0
    found = sorted(tokenfiles.read_index(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    ids = {r.doc_id: r.ids for r in tokenfiles.read_tokens(spark, str(tmp_path / "t")).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert [r.doc_id for r in found] == [None] + sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    for r in found:
        expected = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(expected)) and ids[r.doc_id] == expected
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in expected))
        start += len(expected)
    tokenfiles.write_tokens(none, str(tmp_path / "e"), path)
    assert tokenfiles.read_index(spark, str(tmp_path / "e")).count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    expected = sorted((r.doc_id or 0, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for block in (7, 1000, 1 << 16):
        folder = str(tmp_path / f"flat{block}")
        tokencounts.write_flat(docs, folder, path, block_ids=block)
        flat = spark.read.parquet(folder)
        rows = tokencounts.count_tokens(flat)
        names = flat.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
        found = rows.join(names, ["file", "block", "place"]).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == expected and rows.count() == len(expected)
    tokencounts.write_flat(none, str(tmp_path / "none"), path)
    assert tokencounts.count_tokens(spark.read.schema(tokencounts.FLAT).parquet(str(tmp_path / "none"))).count() == 0


def test_flat_files_with_and_without_an_end(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows, expected = [], []
    for file in range(12):
        ids = rng.integers(0, 4, rng.integers(0, 60))
        start = 0
        for i, x in enumerate(ids):
            if x == 3:
                expected.append((file, start, i - start, True))
                start = i + 1
        if start < len(ids):
            expected.append((file, start, len(ids) - start, False))
        rows += [(file, b, ids[b * 5:b * 5 + 5].astype("<u4").tobytes()) for b in range(-(-len(ids) // 5))]
    blocks = spark.createDataFrame([(f, b, bytearray(x)) for f, b, x in rows], "file int, block int, ids binary")
    found = tokencounts.count_tokens(blocks, end_id=3, width=4).orderBy("file", "document").collect()
    assert [(r.file, r.start, r.n_tokens, r.ended) for r in found] == expected


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [0.5, 0.5]), (50, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf")]), (4, [None, 1.0]), (5, []),
            (6, [0.5, 0.5]), (7, [0.5, 0.5]), (100, [-1.0, 0.0]), (0, [0.5, 0.5])] + [(i, [0.25, 0.25]) for i in range(10, 30)]
    df = spark.createDataFrame(rows, "id long, v array<double>").where(topk.usable(F.col("v"))).select(
        "id", F.transform("v", lambda x: F.floor(x * 256)).alias("vector"))
    found = topk.top_k(df.where("id % 50 = 0"), df, 3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got[0][:2] == [(1, 6, 32768), (2, 7, 32768)] and got[0][2] == (3, 50, 32768)
    assert got[100][0] == (1, 5, 0)
    assert topk.top_k(df.where("false"), df, 3).count() == 0 and topk.top_k(df, df.where("false"), 3).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and you accept them all.</p></div>
<div id="content"><h2>Title &amp; more</h2><p>First paragraph, with <b>bold</b>
   text and a <a href="x">link</a>.<p>Short.<script>var a = "</p>";</script><p>A&nbsp;third paragraph<br>goes on here.</p>
<div class="ad">Buy now, the best of all things.</div><p>Last one.</p></div>
<div class="comments"><p>I liked this very much, thanks.</p></div>
<form><label>Name</label><input name=q></form><aside>Related things</aside><footer>&copy; us</footer></body></html>"""
MAIN = "Title & more\nFirst paragraph, with bold text and a link.\nShort.\nA third paragraph goes on here.\nLast one."


def test_main_text(spark):
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<p>unclosed <b>and", "x"), (5, "a < b plain", "x"), (1, PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    found = {r.page_id: r.main_text for r in htmltext.with_main_text(pages, htmltext.DEFAULT_WEIGHTS).collect()}
    assert found[1] == MAIN and found[2] == "" and found[3] == ""
    long = spark.createDataFrame([(1, "<article>" + "<p>One more paragraph, like the others.</p>" * 3000 + "</article><nav>x</nav>")], "page_id long, html string")
    assert htmltext.with_main_text(long, htmltext.fit(long)).first()["main_text"].count("\n") == 2999
    none = pages.where("false")
    assert htmltext.with_main_text(none, htmltext.fit(none)).count() == 0
    drawn = ("<article><p>First of them.</p><svg width=4 /><p>Second is <math><mi>x</mi></math> here.</p>"
             "<object><p>Third one of them.</p></object><script>no</script></article>")
    assert htmltext.main_text(drawn, htmltext.DEFAULT_WEIGHTS) == "First of them.\nSecond is x here.\nThird one of them."


def test_minimum_cut_equals_trying_all_labels():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(1, 9)
        scores = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(rng.uniform(0, 2), 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(labels):
            return (sum(s for s, y in zip(scores, labels) if s > 0 and not y) - sum(s for s, y in zip(scores, labels) if s < 0 and y)
                    + sum(w for i, j, w in edges if labels[i] != labels[j]))
        best = min(cost(y) for y in itertools.product([False, True], repeat=n))
        assert cost(htmltext.labels_by_cut(scores, edges)) == pytest.approx(best)


def test_a_cut_of_very_many_blocks():
    import random
    import time

    rng = random.Random(5)
    scores = [rng.uniform(-6, 6) for _ in range(100_000)]
    begin = time.monotonic()
    labels = htmltext.labels_by_cut(scores, [(i, i + 1, htmltext.SIBLINGS) for i in range(len(scores) - 1)])
    assert time.monotonic() - begin < 30
    # The best labels of a chain, place by place.
    off = on = 0.0
    for i, s in enumerate(scores):
        w = htmltext.SIBLINGS if i else 0.0
        off, on = min(off, on + w) + max(s, 0), min(on, off + w) + max(-s, 0)
    cost = sum(abs(s) for s, y in zip(scores, labels) if (s > 0) != y) + htmltext.SIBLINGS * sum(a != b for a, b in zip(labels, labels[1:]))
    assert cost == pytest.approx(min(off, on))


def test_toxicity_counts_all_labelled_rows_and_takes_all_significant_terms(spark):
    # 90 long terms, each with its three beginnings, in 12 toxic rows (a fifth held out); sample and lexicon are small.
    terms = [f"{i:02d}zq{'abcdefghij'[i % 10]}kterm" for i in range(90)]
    rows = [(i, f"good day to all {terms[i // 12]}", 1) for i in range(1080)]
    rows += [(i, "good day to all of you", 0) for i in range(1080, 4000)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i in range(10_000, 14_000)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels, sample_rows=400, voters=20)
    scored = by_id(toxicity.with_toxicity(spark.createDataFrame(
        [(i, f"good day to all {t}") for i, t in enumerate(terms)] + [(1000, "good day to all")], "doc_id long, text string"), model), "toxicity")
    assert [i for i in range(90) if scored[i][0] < 0.5] == [] and scored[1000][0] < 0.5
    # One voter stands for a term and its beginnings.
    assert len(model.voters.members.keys) <= 100


def test_the_cut_keeps_what_the_classifier_alone_drops():
    page = ("<div><p>The first sentence of it is long, and it ends here.</p><p>Not so</p>"
            "<p>The last sentence of it is long, and it ends here.</p></div>")
    blocks, w = htmltext.blocks_of(page), htmltext.DEFAULT_WEIGHTS
    alone = [sum(a * b for a, b in zip(htmltext.features(b), w)) + w[-1] for b in blocks]
    assert [s > 0 for s in alone] == [True, False, True] and not any(b.evidence for b in blocks)
    assert htmltext.main_text(page, w).count("\n") == 2
