import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions import normalize as nz
from likeness.functions import quality, similarity, vectors
from likeness.functions.encode import hashed_trigrams, model_encoder
from likeness.functions.score import rule_score, rule_score_arrays
from likeness.schemas import FEATURES


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("raw, expected", [
    ("Foo.Bar+spam@gmail.com", "foobar@gmail.com"),
    ("User+spam@example.com", "user+spam@example.com"),
    ("A.b@GoogleMail.com", "ab@googlemail.com"),
    ("no at sign", "no at sign"), ("a@b@gmail.com", "a@b@gmail.com"),
    ("  ", ""), (None, ""), ("@gmail.com", "@gmail.com"),
])
def test_email(spark, raw, expected):
    assert one(spark, nz.norm_email, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("560001", "560001"), ("560 001", "560001"), ("056000", ""), ("56000A", ""),
    (None, ""), ("\t560001\n", "560001"),
])
def test_postal_code(spark, raw, expected):
    assert one(spark, nz.norm_postal_code, raw) == expected


def test_identity_text_ignores_postal_spacing(spark):
    def text(pc):
        return one(spark, lambda n, p, c: nz.canonical_identity_text(
            n, *[F.lit(None).cast("string")] * 7, p, c), "Alice", pc, "IN")
    assert text("560 001") == text("560001")
    assert text("560001") == (
        "name:alice | dob: | phone: | email: | govid: | addr: | city: | state: "
        "| pc:560001 | ctry:IN")


@pytest.mark.parametrize("normaliser, raw, expected", [
    # Worked by hand from the rules.
    (nz.norm_name, "  Dr. Ana-Maria  O'Neil 3rd\t", "dr ana maria o neil rd"),
    (nz.norm_name, "ÀB cd", "b cd"), (nz.norm_name, "１２ ٣", ""), (nz.norm_name, None, ""),
    (nz.norm_phone_e164, "+91 (80) 4123-4567", "+918041234567"), (nz.norm_phone_e164, "123-456", "123456"),
    (nz.norm_phone_e164, "٠١٢٣٤٥٦٧٨٩", "+٠١٢٣٤٥٦٧٨٩"), (nz.norm_phone_e164, "ext", ""), (nz.norm_phone_e164, None, ""),
    (nz.norm_govid, " \u3000ab 12c\x1f", "AB 12C"), (nz.norm_govid, "straße", "STRASSE"), (nz.norm_govid, None, ""),
    (nz.norm_email, "\tX.Y+z+w@GMAIL.com ", "xy@gmail.com"), (nz.norm_email, "x.y+z@gmail.com.au", "x.y+z@gmail.com.au"),
    (nz.norm_email, "+a@gmail.com", "@gmail.com"), (nz.norm_email, "a@b@googlemail.com", "a@b@googlemail.com"),
    (nz.norm_postal_code, "1 2 3 4 5 6", "123456"), (nz.norm_postal_code, "1234567", ""), (nz.norm_postal_code, "12345", ""),
])
def test_normalisers_by_hand(spark, normaliser, raw, expected):
    assert one(spark, normaliser, raw) == expected


def test_normalisers_keep_their_promises(spark):
    rng = random.Random(7)
    letters = "aBz Éß1290٣०+.@-_ \t\n\x1f　gmail.com"
    texts = [None, ""] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(16))) for _ in range(600)]
    normalisers = [nz.norm_name, nz.norm_email, nz.norm_phone_e164, nz.norm_govid, nz.norm_postal_code]
    once = [n(F.col("t")) for n in normalisers]
    twice = [n(c) for n, c in zip(normalisers, once)]
    for row in values(spark, [(t,) for t in texts], "t string", "t", *once, *twice):
        t, (name, mail, phone, gov, code), again = row[0] or "", row[1:6], row[6:]
        # Applied again they change nothing; an address may lose one more "+" part.
        assert again[0] == name and again[2:] == row[3:6]
        assert set(name) <= set("abcdefghijklmnopqrstuvwxyz ") and name == " ".join(name.split())
        assert mail == mail.lower() and len(mail) <= len(t.lower()) and mail.count("@") == t.count("@")
        assert phone.lstrip("+").isdecimal() or phone == ""
        assert phone.startswith("+") == (sum(c.isdecimal() for c in t) >= 10)
        assert len(gov) >= len(t.strip()) and gov == gov.upper()
        assert code == "" or len(code) == 6 and code[0] in "123456789"


def plain_jaro_winkler(a, b):
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    s = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + prefix * 0.1 * (1 - s) if s > 0.7 else s


def test_jaro_winkler_both_ways(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeéß x") for _ in range(rng.randrange(n)))
    pairs = [("Alice", "alice"), (None, "alice"), ("MARTHA", "marhta"), ("", "")]
    pairs += [(word(12), word(12)) for _ in range(1500)]
    pairs += [("x" * 3000 + word(9), word(9)), ("ab" * 2000, "ba" * 1500)]
    key = similarity.text_key
    got = values(
        spark, [(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string", "i",
        similarity.jaro_winkler(F.col("a"), F.col("b")),
        similarity.key_similarity_batch(key(F.col("a")), key(F.col("b"))))
    for i, native, batch in got:
        expected = plain_jaro_winkler(*pairs[i])
        assert native == pytest.approx(expected, abs=1e-12), pairs[i]
        assert batch == pytest.approx(expected, abs=1e-12), pairs[i]


def test_field_similarities(spark):
    f = similarity
    for b, expected in (("560001", 1.0), ("560002", 0.5), ("560101", 0.0), (None, 0.0)):
        assert one(spark, f.pincode_match, "560001", b) == expected
    assert one(spark, f.dob_delta_days, "1990-01-01", "1990-01-01") == 0
    assert one(spark, f.dob_delta_days, "1990-01-01", "1990-01-03") == 2
    assert one(spark, f.dob_delta_days, None, "1990-01-03") == 9999.0
    assert one(spark, f.dob_delta_days, "1990-02-30", "1990-01-03") == 9999.0
    assert one(spark, f.exact_match, "123", "123") == 1.0
    assert one(spark, f.exact_match, "123", "456") == 0.0
    assert one(spark, f.exact_match, "", "") == 0.0
    assert one(spark, f.exact_match, None, None) == 0.0
    assert one(spark, f.addr_overlap, "12 Main St", " 12  main\tRoad ") == 0.5
    assert one(spark, f.addr_overlap, " ", "12 Main St") == 0.0
    assert one(spark, f.addr_overlap, None, None) == 0.0


def scored(spark, *rows):
    schema = ", ".join(f"{f} double" for f in FEATURES)
    return [r[0] for r in values(spark, [tuple(map(float, r)) for r in rows], schema, rule_score())]


def test_rule_score_golden(spark):
    assert scored(spark, [1] * 9 + [0], [0] * 9 + [9999], [0] * 10) == [0.99, 0.0, 0.0]


def test_rule_score_by_hand(spark):
    rows = {
        (1, 0, 1, 0, 0, 0, 0, 0, 0, 9999): 0.5,      # phone and nearness
        (0.5, 0, 0, 0, 1, 0, 0, 0, 0, 0): 0.99,      # government id alone decides
        (0, 1, 0, 0, 0, 0, 0, 0, 0, 29): 0.2,        # name and a near date
        (0, 1, 0, 0, 0, 0, 0, 0, 0, 30): 0.15, (0, 1, 0, 0, 0, 0, 0, 0, 0, 364): 0.15,
        (0, 1, 0, 0, 0, 0, 0, 0, 0, 365): 0.1,
        (1, 0, 0, 0, 0, 1, 1, 1, 1, 0): 0.28,        # no name, no bonus for the date
        (1, 1, 1, 1, 0, 1, 1, 1, 1, 0): 0.99,        # never more
        (0, 0.5, 0, 1, 0, 0.5, 0, 0, 0.5, 100): 0.55}
    assert scored(spark, *rows) == pytest.approx(list(rows.values()), abs=1e-12)
    arrays = dict(zip(FEATURES, np.array(list(rows), float).T))
    assert rule_score_arrays(arrays).tolist() == pytest.approx(list(rows.values()), abs=1e-12)


def test_hashed_vector_is_the_same_both_ways(spark):
    texts = ["name:alice | dob:", "", "ab", "abc", "été 日本語 text", "x" * 700]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select(
            "t", vectors.hashed_trigram_vector(F.col("t"), 64).alias("a"),
            hashed_trigrams(64)(F.col("t")).alias("b")).collect():
        assert row.a == pytest.approx(row.b, abs=1e-7), row.t
        assert sum(x * x for x in row.a) == pytest.approx(float(len(row.t) > 2), abs=1e-5)


def test_vector_arithmetic(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 16)), rng.normal(size=(20, 16))
    a[0] = 0
    a[1] = b[1] = 0
    rows = [(x.tolist(), y.tolist()) for x, y in zip(a.astype("f4"), b.astype("f4"))]
    got = values(
        spark, rows, "a array<float>, b array<float>",
        vectors.cosine_distance(F.col("a"), F.col("b")),
        vectors.euclidean_distance(F.col("a"), F.col("b")),
        vectors.l2_normalise(F.col("a")), vectors.fit_width(F.col("a"), 20),
        vectors.fit_width(F.col("a"), 3), vectors.has_width(F.col("a"), 16))
    assert got[0][0] == 1.0 and got[1][0] == 0.0 and got[0][2] == [0.0] * 16
    for (cos, gap, unit, wide, narrow, ok), (x, y) in list(zip(got, rows))[2:]:
        x, y = np.array(x), np.array(y)
        assert cos == pytest.approx(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-9)
        assert gap == pytest.approx(np.linalg.norm(x - y), abs=1e-9)
        assert np.allclose(unit, x / np.linalg.norm(x), atol=1e-6)
        assert np.allclose(wide, [*x, 0, 0, 0, 0]) and np.allclose(narrow, x[:3]) and ok


def test_model_plug_in_is_loaded_per_worker_and_fed_in_batches(spark):
    def load():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts])
    df = spark.createDataFrame([("a" * i,) for i in range(100)], "t string").coalesce(1)
    got = df.select("t", model_encoder(load, batch=10)(F.col("t")).alias("v")).collect()
    assert all(r.v == [float(len(r.t)), 10.0] for r in got)


@pytest.mark.parametrize("check, good, bad", [
    (quality.valid_email, ["a@b.co"], ["a@b", "a b@c.d", "@b.co", "", None]),
    (quality.valid_phone, ["+911234567890"], ["911234567890", "+0123", "+1", "+1234567890123456", None]),
    (quality.valid_postal_code, ["012345"], ["12345", "1234567", "12345a", None]),
    (quality.valid_date, ["2020-02-29"], ["2020-02-30", "20200101", "2020-1-1", None]),
    (quality.valid_amount, ["10", "10.5", "0.01"], ["0", "1.234", "-1", "1,000", "", None]),
])
def test_format_checks(spark, check, good, bad):
    rows = [(v,) for v in good + bad]
    got = [r[0] for r in values(spark, rows, "v string", check(F.col("v")))]
    assert got == [True] * len(good) + [False] * len(bad)


def test_birth_date_range(spark):
    as_of = F.to_date(F.lit("2024-01-30"))
    got = values(
        spark, [("2024-01-30",), ("2024-01-31",), ("1900-12-31",), ("1901-01-01",)], "v string",
        quality.valid_birth_date(F.col("v"), as_of))
    assert [g[0] for g in got] == [True, False, False, True]


def test_the_encoder_counts_a_slice_of_a_batch_at_a_time(spark, monkeypatch):
    from likeness.functions import encode
    import pyarrow as pa
    seen, counted = [], encode._trigram_counts
    monkeypatch.setattr(encode, "_trigram_counts", lambda texts, dim: seen.append(len(texts)) or counted(texts, dim))
    texts = ["abcd", None, "", "ab"] * 300
    found = encode.hashed_trigrams(16).func(pa.array(texts))
    assert seen == [512, 512, 176] and len(found) == 1200
    assert found.to_pylist()[1028] == found.to_pylist()[0] and sum(found.to_pylist()[1]) == 0
    assert abs(sum(x * x for x in found.to_pylist()[0]) - 1) < 1e-6


def test_row_distances_of_a_sliced_batch():
    import numpy as np
    import pyarrow as pa
    from likeness.operators import blocks
    n = 2 * blocks.SLICE_ROWS + 5
    rng = np.random.default_rng(3)
    q, m = rng.normal(size=(n, 4)).astype("f4"), rng.normal(size=(n, 4)).astype("f4")
    batch = pa.RecordBatch.from_pydict({
        "query_id": np.arange(n), "customer_id": np.arange(n),
        "q_vec": pa.array(list(q)), "m_vec": pa.array(list(m))})
    parts = list(blocks.row_distances("euclidean")([batch]))
    assert [p.num_rows for p in parts] == [blocks.SLICE_ROWS, blocks.SLICE_ROWS, 5]
    gaps = np.concatenate([p["vdist"].to_numpy() for p in parts])
    assert np.allclose(gaps, np.linalg.norm(q.astype(float) - m.astype(float), axis=1))
