"""Conversation repair, repeated passages and importance resampling against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from likeness.llm import resampling, substrings, turns

SF = "/root/testdata/sf0.01"
sys.setrecursionlimit(20_000)


# Conversations

def cheapest(symbols):
    """The least cost and the ASCII-least of its edit strings, over all edit strings."""
    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == len(symbols) and state in (turns.START, turns.ASSISTANT) else []
        if inserts < 3:
            cost, rest = best(i, turns.FOLLOWS[state], inserts + 1)
            options.append((cost + 5, "I" + rest))
        for edit, cost, to in turns.edits(symbols[i], state) if i < len(symbols) else ():
            more, rest = best(i + 1, to, 0)
            options.append((cost + more, edit + rest))
        return min(options, default=(10**9, ""))
    return best(0, turns.START, 0) if symbols else (0, "")


def repaired_by_hand(rows):
    """The contract's row of one conversation after damage, from (turn, role, text) in order."""
    white = " \t\n\x0b\x0c\r"
    seen, symbols, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        if not text.strip(white):
            fault = 1
        elif (role, text) in seen:
            fault = 2
        else:
            fault = 3 * (text.rstrip(white)[-1] not in ".!?")
        seen.add((role, text))
        counts[fault] += 1
        symbols.append(8 if fault in (1, 2) else ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * (fault == 3))
    cost, audit = cheapest(tuple(symbols))
    out, state, it = [], 0, iter(rows)
    for edit in audit:
        role, text = next(it)[1:] if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = turns.SYSTEM
            out.append(f"{role}:{text}")
            continue
        state = turns.FOLLOWS[state]
        name = role if edit == "K" else "user" if state == turns.USER else "assistant"
        out.append(f"{name}:{text}")
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_hand(rows):
    done = {}
    for conv, turn, role, text in rows:
        here = done.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        here += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    for here in done.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return done


def test_block_tables_trace_as_all_edit_strings():
    rng, tables = random.Random(5), turns.tables()
    for _ in range(400):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(0, 13)))
        vector, cost, state = (x[0] for x in tables.summary(symbols))
        audit = "".join(tables.trace(symbols, 0, turns.START)) if symbols else ""
        end = int(state[turns.START])
        audit += "" if end in (turns.START, turns.ASSISTANT) else "I" if end == turns.USER else "II"
        assert (cost + tables.vectors[vector][turns.START], audit) == cheapest(symbols)


def test_block_tables_of_other_lengths_agree():
    rng, tables, other = random.Random(6), turns.tables(), turns.Tables(3)
    for n in (1, 2, 5, 40):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        for state in range(4):
            assert all((a == b).all() for a, b in zip(tables.summary(symbols), other.summary(symbols)))
            for behind in range(len(tables.vectors)):
                assert tables.trace(symbols, behind, state) == other.trace(symbols, behind, state)


def check(spark, rows):
    schema = "conv_id long, turn long, role string, text string, symbols int, at string"
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], schema).repartition(3)
    found = {r["conv_id"]: tuple(r)[1:] for r in turns.audits(turns.damaged(df), df).collect()}
    assert found == {c: repaired_by_hand(r) for c, r in damaged_by_hand(rows).items()}


def test_odd_conversations(spark):
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "Yes."), (1, None, "assistant", "a."), (1, None, "assistant", "a."),
            (2, 3, "", "Hello."), (3, 1, "USER", "hey!"), (4, 1, "system", "s."), (5, 1, "user", "?\t\n"), (6, 2, "user", " \x0b"),
            (7, 1, "user", "ç "), (8, 10**12, "user", "x."), (8, -5, "assistant", "y.")]
    for conv in range(20, 60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None, turn // 2]), rng.choice(["user", "assistant", "system", "tool", None]),
                         rng.choice(["One.", "Two", "", None, "Three! ", "four?\n", "long " * 3000 + "."])))
    rows += rows[20:40]
    check(spark, rows)


def test_a_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT_BITS", 3)
    rng = random.Random(10)
    check(spark, [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", f"b{t}.", f"c{t}", ""]))
                  for t in range(450)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")])


def test_conversations_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in turns.op12_conversations(spark, SF).collect()}
    assert found == {c: repaired_by_hand(r) for c, r in damaged_by_hand(rows).items()}


def test_repaired_rows_and_empty_table(spark):
    schema = "conv_id string, turn int, role string, text string"
    df = spark.createDataFrame([("a", 1, "assistant", "Well."), ("a", 2, "user", "So."), ("a", 3, "assistant", "Cut"),
                                ("b", 1, "user", "")], schema)
    rows = turns.repaired(df).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in rows] == [("a", 0, "R", "user", "Well."), ("a", 1, "R", "assistant", "So.")]
    none = spark.createDataFrame([], schema)
    assert turns.repaired(none).count() == 0 and turns.audits(none, none).count() == 0
    only = turns.audits(none, df).collect()
    assert {r.conv_id: (r.cost, r.audit, r.gaps) for r in only} == {"a": (0, "", 0), "b": (0, "", 0)}


# Repeated passages

def removed_by_hand(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - k + 1 if i is not None else 0):
            g = tuple(w[p:p + k])
            first[g] = min(first.get(g, i), i)
    found = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[p:p + k])] < i:
                gone.update(range(p, p + k))
        kept = [x for q, x in enumerate(w) if q not in gone]
        found.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(found, key=str)


def passages(seed, n=90):
    rng = random.Random(seed)
    shared = [[f"p{s}w{i}" for i in range(rng.randrange(10, 70))] for s in range(8)] + [["la"] * 40]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            if rng.random() < 0.6:
                part = rng.choice(shared)
                a = rng.randrange(0, len(part) - 8)
                words += part[a:a + rng.randrange(8, 60)]
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 20))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t\t "]).join(words)))
    return rows


@pytest.mark.parametrize("slice_bytes", [300, 1 << 22])
def test_passages_equal_comparing_all(spark, slice_bytes):
    long = " ".join(f"z{i % 701}" for i in range(30_000))
    rows = passages(3) + [(900, None), (901, ""), (902, " \n"), (903, long), (904, long + " end"), (905, long.upper()),
                          (6, "row with an id that is given twice " * 4), (6, "row with an id that is given twice " * 4),
                          (None, "row with an id that is given twice " * 4), (7, "row with an id that is given twice " * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slice int, rest string").repartition(4)
    found = substrings.repeats(df, slice_bytes=slice_bytes)
    assert sorted([tuple(r)[:4] for r in found.collect()], key=str) == removed_by_hand(rows)
    kept = substrings.without_repeats(df, slice_bytes=slice_bytes)
    assert kept.columns == df.columns and kept.count() == len(rows)
    texts = {r.doc_id: r.text for r in kept.where("doc_id >= 900").collect()}
    assert texts[900] is None and texts[901] == "" and texts[904].startswith("z") is False or texts[904] != long


def test_spans_are_verbatim_stretches_of_their_sources(spark):
    rows = passages(4)
    words = {i: t.split() for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = 0
    for r in substrings.repeats(df, slice_bytes=2000).collect():
        for s in r.spans:
            assert s.source < r.doc_id and s.words >= 13
            assert words[r.doc_id][s.first:s.first + s.words] == words[s.source][s.source_first:s.source_first + s.words]
            spans += s.words > 13
    assert spans > 20


def test_paths_end_at_branches_and_where_the_source_does(spark):
    edges = [(1, 2, 5, 0), (2, 3, 5, 1), (3, 4, 5, 2), (3, 9, 6, 4), (4, 7, 5, 3), (7, 8, 6, 9), (8, 10, 6, 10)]
    rows = [(*e[:2], s, e[2] + s, e[3], False) for e in edges for s in (0, 1)] + [(10, 11, 0, 6, 11, False)]
    found = substrings.compacted(spark.createDataFrame(
        rows, "node long, next long, slice long, doc_id long, place long, several boolean")).collect()
    assert len(found) == 2 * len(edges)
    assert {(r.node, r.next) for r in found if r.goes_on} == {(2, 3), (4, 7), (8, 10)}
    assert all(tuple(r.source)[2] == 0 for r in found)


def test_text_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substrings.repeats(df).collect()} == {"a": 0, "b": 20, None: 0}
    none = df.limit(0)
    assert substrings.repeats(none).count() == 0 and substrings.without_repeats(none).columns == ["doc_id", "text"]


# Importance resampling

def features_by_hand(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def resampled_by_hand(docs, target):
    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(features_by_hand(text)[1])
    for text in target:
        aim.update(features_by_hand(text)[1])
    s_all, t_all = float(sum(raw.values())), float(sum(aim.values()))
    rows = []
    for i, text in docs:
        n, buckets = features_by_hand(text)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + 10000) / ((raw[b] + 1.0) * (t_all + 10000)))) for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(enough[:5 * len(enough) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


ROW = ("doc_id", "n_features", "weight", "score", "rank")


def test_composed_crcs_and_automaton():
    rng = np.random.default_rng(1)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 90, 200)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, 9000, 200)]
    crc = [np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b)]
    got = resampling.composed(*crc, np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
    assert resampling.after_blank(crc[0]).tolist() == [zlib.crc32(x + b" ") for x in a]
    texts = ["A b-c", None, "", "x" * 100 + " Yé" + "z" * 47 + " z", "  ", "é ü" + "q" * 48 + "." + "r" * 49, "\x00\x7f0"]
    features = resampling.Features(pa.array(texts), 3, 10000)
    by_hand = [features_by_hand(t) for t in texts]
    assert features.n_words.tolist() == [n for n, _ in by_hand]
    assert Counter(int(x) for f, _ in features.runs for x in f) == Counter(b for _, f in by_hand for b in f)


def test_odd_documents_are_weighed(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "Cat", "é9", "runs", f"w{i % 7}"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "-- "), (1003, "Long " * 50_000), (1004, "q" * 200_000), (5, docs[5][1]), (5, docs[5][1]), (None, "")]
    target = ["the cat runs", None, "", "the cat runs", "é9 é9"]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, rank string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.importance(df, aim)
    assert sorted((tuple(r) for r in found.select(*ROW).collect()), key=str) == resampled_by_hand(docs, target)
    drawn = resampling.resampled(df, aim, percent=50)
    assert drawn.columns == df.columns and drawn.count() >= 100
    assert resampling.importance(df, aim.limit(0)).where("rank = 1").count() == 1
    assert resampling.importance(df.limit(0), aim).count() == 0


def test_importance_of_the_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    found = resampling.op13_importance(spark, SF).select(*ROW).collect()
    assert sorted((tuple(r) for r in found), key=str) == resampled_by_hand(docs, target)
