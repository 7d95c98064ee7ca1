"""Word hashes, Simple-8b, suffix search, top-k, packing: small parts against plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from likeness.llm import contamination, neardup, packing, simple8b, topk, words


def test_words_equal_plain_splitting():
    texts = ["The cat, the CAT", "", None, "ünï 12x", "the", " a\tb "]
    found = words.words_of(pa.array(texts), words.ALPHANUMERIC)
    plain = [["the", "cat", "the", "cat"], [], [], ["ünï", "12x"], ["the"], ["a", "b"]]
    assert np.diff(found.first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    by_word = {}
    for w, h in zip(flat, found.hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_long_texts_do_not_depend_on_their_place():
    word = "x" * (words.CHUNK + 5)
    found = words.words_of(pa.array(["a " * 300_000 + word, word + " a"]), words.VISIBLE)
    assert found.hashes[300_000] == found.hashes[300_001]
    assert len(set(found.hashes.tolist())) == 2


@pytest.mark.parametrize("ids", [
    [], [0], [0] * 1000, [1, 2, 3], [50_256] * 7, list(range(5000)),
    [(1 << 20) - 2, (1 << 20) - 1, 1 << 20, (1 << 32) - 1, 0], [5] * 239 + [1 << 19]])
def test_simple8b_round_trip(ids):
    coded, escaped = simple8b.encode(np.array(ids, np.uint32))
    assert simple8b.decode(coded, escaped, len(ids)).tolist() == ids


def test_simple8b_random_round_trips():
    rng = np.random.default_rng(3)
    for _ in range(60):
        ids = (rng.integers(0, 1 << 32, rng.integers(1, 2000), dtype=np.uint64) >> rng.integers(0, 32, 1, dtype=np.uint64)[0])
        coded, escaped = simple8b.encode(ids.astype(np.uint32))
        assert (simple8b.decode(coded, escaped, len(ids)) == ids).all()
        assert len(coded) <= len(ids)


def test_suffix_search_equals_scanning():
    rng = random.Random(5)
    letters = "abcd"
    texts = [" ".join(rng.choices(letters, k=rng.randrange(0, 40))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(letters, k=rng.randrange(0, 9)))) for i in range(20)]
    tests = contamination.Suffixes(items, window=5)
    part = pa.table({"text": texts})
    found = contamination._search_slice(part, part.column("text").combine_chunks(), tests)
    for text, hits, names, longest in zip(texts, found["hits"].to_pylist(), found["items"].to_pylist(), found["longest"].to_pylist()):
        w, covered, own = text.split(), set(), set()
        for i, item in items:
            v = item.split()
            n = min(5, len(v))
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q:q + n] == v[p:p + n]:
                        covered.update(range(q, q + n))
                        own.add(str(i))
        assert {p for h in hits for p in range(h["first"], h["first"] + h["words"])} == covered
        assert set(names) == own
        assert (longest > 0) == bool(covered)


def test_longest_match_runs_over_windows():
    words_ = [f"w{i}" for i in range(60)]
    tests = contamination.Suffixes([("a", " ".join(words_[10:40]))])
    part = pa.table({"text": ["x y " + " ".join(words_[5:38]) + " z", "x"]})
    found = contamination._search_slice(part, part.column("text").combine_chunks(), tests)
    assert found["longest"].to_pylist() == [28, 0]
    assert found["hits"].to_pylist()[0] == [{"first": 7, "words": 28}]


@pytest.mark.parametrize("spread", [1, 3, 40, 10 ** 9])
def test_threshold_search_equals_sorting(spread):
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread + 1, (700, 6))
    ids = rng.permutation(5000)[:700]
    queries = np.concatenate([vectors[:10], rng.integers(-spread, spread + 1, (5, 6)), np.zeros((1, 6), int)])
    block = topk.SortedLists(vectors, int(np.abs(queries).max()))
    sought = queries.astype(block.vectors.dtype)
    depths = block.depths()
    for q, t, raw, own in zip(sought, block.thresholds(sought, depths), queries, [*ids[:10], *[-1] * 6]):
        rows, scores = block.search(q, ids, own, 5, depths, t)
        exact = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, raw))), int(i)) for v, i in zip(vectors, ids) if i != own)[:5]
        assert [(-int(s), int(ids[r])) for r, s in zip(rows, scores)] == exact


def test_threshold_search_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(0, 10, (4000, 4)), np.full((6, 4), 1000)])
    block = topk.SortedLists(vectors, 1)
    depths = block.depths()
    q = np.ones((1, 4))
    reads = []
    order = block.order

    class Watched:
        def __getitem__(self, key):
            reads.append(key)
            return order[key]
    block.order = Watched()
    block.search(q[0], np.arange(len(vectors)), -1, 5, depths, block.thresholds(q, depths)[0])
    assert len(reads) == 2 and reads[-1].stop <= 16 * topk.STRETCH


def _plain_best_fit(pieces, capacity):
    bins, placed = [], []
    for w, s, c in pieces:
        fits = [(left, i) for i, (left, ss, cc) in enumerate(bins) if left >= w and not ss & s and not cc & c]
        if fits:
            _, i = min(fits)
        else:
            i = len(bins)
            bins.append((capacity, 0, 0))
        left, ss, cc = bins[i]
        placed.append((i, capacity - left))
        bins[i] = (left - w, ss | s, cc | c)
    return placed


def test_best_fit_equals_trying_every_bin():
    rng = random.Random(9)
    for _ in range(30):
        pieces = sorted(((rng.randrange(1, 50), 1 << rng.randrange(4), rng.choice([0, 1, 2, 4])) for _ in range(80)), reverse=True)
        assert packing.best_fit(pieces, 60) == _plain_best_fit(pieces, 60)


def test_shingle_sets_equal_plain_sets():
    texts = ["a b c d e", "A b  c D", "a", "", None, "a b c d a b c d a b c d", "x y z"]
    values, first = neardup.shingle_sets(pa.array(texts), 4)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 4, 1]
    assert sets[1] < sets[0] and not sets[2] & sets[6] and sets[1] < sets[5]


@pytest.mark.parametrize("n", [4, 5])
def test_shingles_of_slices_with_few_words(n):
    for k in range(n + 2):
        text = " ".join(f"w{i}" for i in range(k))
        values, first = neardup.shingle_sets(pa.array([text]), n)
        assert len(values) == first[1] == (max(1, k - n + 1) if k else 0)
        assert len(words.runs(np.arange(k, dtype=np.uint64), n)) == max(0, k - n + 1)
        # The shingles do not depend on what stands in the slice besides.
        both, at = neardup.shingle_sets(pa.array([text, "u v w x y z"]), n)
        assert both[:at[1]].tolist() == values.tolist()


def test_ids_of_odd_white_space_and_special_strings_equal_plain_encoding():
    import sys

    import public_tokenizers
    from tokenizers import Tokenizer

    from likeness.llm import tokenfiles

    assert set(tokenfiles.OTHER_SPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} - {" ", "\n"}
    texts = ["a\tb\tc\n\n\nd", "Oui\xa0! Non\xa0?\n\n", "a\tb\tc\n\n", "a\tb c", "a \t b\tc", "\tx", "", " ", "it's <|endoftext|> we go",
             "x<|endoftext|>y", "<|endoftext|>", "plain words\non lines, with marks."]
    rng = random.Random(6)
    for _ in range(400):
        texts.append("".join(rng.choices(["ab", "c", "'s", "7", "!", "é", " ", " ", "\n", "\t", "\xa0", "\r", " ", "<|endoftext|>"], k=rng.randrange(1, 25))))
    path = public_tokenizers.path("byte_bpe_50k.json")
    for special in (False, True):
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = not special
        ids, n = tokenfiles.Encoder(path, special).encode(texts)
        at = 0
        for t, size in zip(texts, n.tolist()):
            assert ids[at:at + size].tolist() == plain.encode(t, add_special_tokens=False).ids + [tokenfiles.END_ID], repr(t)
            at += size


def test_op3_takes_the_default_for_special_strings(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from likeness.llm import tokenfiles

    text = "a\tb\tc\n\n\nd <|endoftext|> e"
    spark.createDataFrame([(1, text), (2, "next")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: (r.start, r.n_tokens) for r in tokenfiles.op3_tokens(spark, str(tmp_path)).collect()}
    n = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1
    assert rows == {1: (0, n), 2: (n, 2)}
