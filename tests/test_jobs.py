"""Ingest, pairs, training, checks, loans and streams end to end."""

import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness import schemas
from likeness.functions.encode import encode_texts
from likeness.functions.score import with_rule_score
from likeness.plans.check import check_duplicates, pair_features, split_by_width
from likeness.plans.ingest import ingest, new_customers, with_errors
from likeness.plans.loans import check_loans
from likeness.plans.pairs import labelled_pairs
from likeness.plans.records import candidate_rows, customer_rows, query_object
from likeness.plans.stats import stats
from likeness.plans.train import fit_mllib, fit_penalised, as_scorer, train_ranker
from likeness.operators.notes import latest_notes
from likeness.operators.ranking import sorted_by
from likeness.sources import readers
from likeness.sources.master import read_master, scan_customers
from likeness.sources.models import LinearRanker, load_scorer, save_ranker
from likeness.sources.vector_cache import cached_vectors, missing_texts
from likeness.streaming.jobs import check_and_ingest_stream, ingest_stream

PERSON = {
    "full_name": "Mira Okonkwo-Vance", "dob": "1971-11-23", "phone": "+4420794600",
    "email": "mira.vance@mail.test", "gov_id": "QX7781", "addr_line": "9 Quarry Lane",
    "city": "Harrowgate", "state": "KL", "postal_code": "682014", "country": "IN",
}


def raw(spark, *people, key="query_id"):
    rows = [(i, *[{**PERSON, **p}[f] for f in schemas.RAW_FIELDS]) for i, p in enumerate(people)]
    return spark.createDataFrame(
        rows, f"{key} bigint, " + ", ".join(f"{f} string" for f in schemas.RAW_FIELDS))


def master_of(spark, *people):
    return customer_rows(raw(spark, *people, key="customer_id"), "customer_id")


def now():
    return F.to_timestamp(F.lit("2024-01-30 10:00:00"))


def test_check_finds_the_identical_person(spark):
    got = check_duplicates(
        raw(spark, {}, {"full_name": "Zoe", "phone": "1", "email": "z@z.z", "gov_id": "",
                        "dob": None, "addr_line": None, "city": None, "state": None,
                        "postal_code": None}),
        master_of(spark, {"gov_id": " qx7781 "}, {"gov_id": "X", "email": "", "phone": ""}))
    first, second = got.orderBy("query_id").collect()
    assert first.is_duplicate and first.score > 0.95 and first.threshold == 0.82
    assert first.best_match.government_id == "QX7781" and len(first.candidates) == 2
    assert first.best_match.date_of_birth == "1971-11-23"
    assert not second.is_duplicate and second.score < 0.5


@pytest.mark.parametrize("method", ["exact", "keys", "default"])
def test_check_without_candidates(spark, method):
    master = master_of(spark, {}).filter("customer_id < 0")
    row = check_duplicates(raw(spark, {}), master, method=method).first()
    assert (row.is_duplicate, row.score, row.best_match, row.candidates) == (False, 0.0, None, [])


@pytest.mark.parametrize("holders", [100, 1500])
def test_the_verdict_does_not_depend_on_how_many_share_a_key(spark, holders):
    near = [{"phone": "+4420794600", "email": f"p{i}@x.test", "gov_id": f"P{i}", "dob": "1950-01-01"} for i in range(holders)]
    mail = [{"phone": f"+99{i:09d}", "email": "mira.vance@mail.test", "gov_id": f"M{i}", "dob": "1950-01-01"} for i in range(holders)]
    match = {"full_name": "zz", "addr_line": "1 x", "city": "q", "state": "w", "postal_code": "111111", "gov_id": "other", "dob": "1971-11-20"}
    row = check_duplicates(
        raw(spark, {"gov_id": ""}), master_of(spark, match, *near, *mail),
        method="keys", block_rows=512).first()
    assert row.is_duplicate and row.best_match.customer_id == 0
    assert row.score > 0.9 and len(row.candidates) == 10


def test_hot_keys_are_scored_like_listed_pairs(spark):
    rng = random.Random(3)
    people = [{"full_name": rng.choice(["ann lee", "bob ray", "anna lee", "robert ray"]), "phone": rng.choice(["+11111111111", "+22222222222", ""]),
               "email": f"{i}@x.y" if i % 3 else "same@x.y", "gov_id": f"G{rng.randrange(60)}", "dob": rng.choice(["1980-01-01", "1980-01-15", None]),
               "addr_line": rng.choice(["1 main st", "1 main road", "", "2 side st"]), "city": rng.choice(["A", "Ab", ""]),
               "state": "S", "postal_code": rng.choice(["560001", "560002", "x"])} for i in range(90)]
    master, asked = master_of(spark, *people), raw(spark, *people[:30])
    trained = as_scorer(fit_mllib(feature_table(spark)[2]))
    for scorer in (with_rule_score, trained):
        rows = [check_duplicates(asked, master, scorer, method="keys", hot_rows=h, block_rows=16).orderBy(
            "query_id").collect() for h in (10_000, 5)]
        for a, b in zip(*rows):
            assert [(c.customer_id, round(c.score, 9), round(c.vector_distance, 9)) for c in a.candidates] == [
                (c.customer_id, round(c.score, 9), round(c.vector_distance, 9)) for c in b.candidates]
            assert (a.is_duplicate, round(a.score, 9)) == (b.is_duplicate, round(b.score, 9))
    with pytest.raises(ValueError, match="no array form"):
        check_duplicates(asked, master, lambda df: with_rule_score(df), method="keys", hot_rows=5)


def test_features_of_an_identical_pair(spark):
    queries = query_object(raw(spark, {}), "query_id")
    pairs = spark.createDataFrame([(0, 0, 0.0)], "query_id bigint, customer_id bigint, vdist double")
    for batched in (True, False):
        row = pair_features(pairs, queries, candidate_rows(master_of(spark, {})), batched).first()
        assert [row[f] for f in schemas.FEATURES] == [1.0] * 9 + [0.0]


def test_vectors_of_another_width_are_set_aside(spark):
    df = spark.createDataFrame([(1, [0.0] * 512), (2, [0.0] * 511), (3, None)],
                               "id int, identity_vec array<float>")
    good, bad = split_by_width(df)
    assert [r.id for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}


def test_ingest_numbers_rows_and_sets_bad_ones_aside(spark, tmp_path):
    path = str(tmp_path / "master")
    people = raw(spark, *[{"full_name": f"N{i}"} for i in range(40)],
                 {"dob": "1980-02-31"}, {"full_name": "  "}, key="seq").repartition(5)
    loaded, rejects = ingest(people, path, "one", now(), order=["seq"])
    assert [(r.customer_id, r.full_name) for r in loaded.orderBy("customer_id").collect()] == [
        (i + 1, f"N{i}") for i in range(40)]
    assert {tuple(r.dq_errors) for r in rejects.collect()} == {
        ("Please enter a valid date (YYYY-MM-DD)",), ("Full name is required",)}
    ingest(people, path, "two", now())
    ids = lambda: sorted(r.customer_id for r in read_master(spark, path).collect())
    assert ids() == list(range(1, 81))
    ingest(people, path, "two", now())    # a batch loaded again replaces itself
    assert ids() == list(range(1, 81))
    days = read_master(spark, path).select("created_on").distinct().collect()
    assert [str(r.created_on) for r in days] == ["2024-01-30"]


def test_strict_ingest_applies_the_form_checks(spark):
    people = raw(spark, {}, {"phone": "123"}, {"dob": "2025-01-01"}, {"country": "XX"}, key="seq")
    good, rejects = new_customers(people, strict=True, as_of=F.to_date(F.lit("2024-01-30")))
    assert [r.seq for r in good.collect()] == [0]
    assert {r.seq: len(r.dq_errors) for r in rejects.collect()} == {1: 1, 2: 1, 3: 1}
    assert with_errors(raw(spark, {"city": " "})).first().dq_errors == ["City is required"]


def test_stats(spark):
    days = ["2024-01-30", "2024-01-29"]
    rows = [(g, days[i % 2]) for i, g in enumerate(["A"] * 5 + ["B"] * 2 + ["C"] + [""] * 7 + [None])]
    df = spark.createDataFrame(rows, "gov_id_norm string, created_on string").withColumn(
        "created_on", F.to_date("created_on"))
    as_of = F.to_date(F.lit("2024-01-30"))
    assert tuple(stats(df, as_of).first()) == (16, 8, 2, 1, 50.0)
    assert tuple(stats(df.limit(0), as_of).first()) == (0, 0, 0, 0, 0.0)


def test_pairs_of_upper_case_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "CUSTOMER_ID int, IDENTITY_TEXT string")
    pairs = labelled_pairs(df).collect()
    assert sorted((p.cand_customer_id, p.label) for p in pairs) == [(1, 1), (2, 1)]
    assert set(pairs[0].asDict()) == set(schemas.PAIR.names)


def test_pairs_need_ids(spark):
    with pytest.raises(KeyError):
        labelled_pairs(spark.createDataFrame([("a",)], "identity_text string"))


def sample(spark):
    """Five customers in two groups and one alone, vectors as JSON text."""
    rng = np.random.default_rng(0)
    rows = []
    for ids, name, vec in (([1, 2], "Alice Smith", rng.normal(size=512)),
                           ([3, 4], "Bob Brown", rng.normal(size=512)),
                           ([5], "Charlie Doe", rng.normal(size=512))):
        for i in ids:
            rows.append((str(i), name if i % 2 else name.upper(), "1990-01-01",
                         f"+9198765432{ids[0]:02d}", f"{ids[0]}@example.com", f"ID{ids[0]}",
                         "1 Main St", "Mumbai", "MH", "400001", "IND", None,
                         json.dumps(vec.round(6).tolist())))
    return spark.createDataFrame(rows, schemas.CUSTOMER_CSV)


def test_csv_round_trip_trains(spark, tmp_path):
    path = str(tmp_path / "customers.csv")
    sample(spark).write.option("header", True).option("escape", '"').csv(path)
    customers = readers.read_table(spark, path)
    assert customers.filter("phone_e164 like '+91%'").count() == 5
    pairs = labelled_pairs(customers)
    assert sorted((p.label, p.cand_customer_id) for p in pairs.collect() if p.label) == [
        (1, 1), (1, 2), (1, 3), (1, 4)]
    for fit in ("penalised", "mllib"):
        model = str(tmp_path / fit)
        report = train_ranker(
            spark, model, customers, fit=fit, cache_path=str(tmp_path / f"cache-{fit}"))
        assert report["success"] and report["details"]["pairs_processed"] == 8
        assert report["details"]["accuracy"] == 1.0
        row = spark.createDataFrame([tuple([1.0] * 9 + [0.0])],
                                    ", ".join(f"{f} double" for f in schemas.FEATURES))
        assert load_scorer(spark, model)(row).first().score > 0.5


def test_max_pairs_keeps_the_first(spark):
    table = sample(spark)
    key = lambda ps: [(p.query_email, p.cand_customer_id, p.label) for p in ps]
    whole = key(labelled_pairs(table).collect())
    assert len(whole) == 8
    for n in (1, 3, 5):
        cut = key(labelled_pairs(table, max_pairs=n).collect())
        assert len(cut) == n and set(cut) <= set(whole)


def test_missing_training_data_is_reported(spark, tmp_path):
    report = train_ranker(
        spark, str(tmp_path / "m"), sample(spark), pairs_path=str(tmp_path / "none.csv"))
    assert report["success"] is False and "Training data not found" in report["message"]


def feature_table(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.random((n, 10))
    x[:, 9] = np.where(rng.random(n) < 0.3, 9999, x[:, 9] * 500)
    y = (x[:, 1] + x[:, 2] - x[:, 9] / 9999 + rng.normal(size=n) * 0.4 > 0.8).astype(int)
    schema = ", ".join(f"{f} double" for f in schemas.FEATURES) + ", label int"
    return x, y, spark.createDataFrame(
        [(*map(float, r), int(v)) for r, v in zip(x, y)], schema)


def objective_gradient(x, y, w, b, penalise):
    s = len(y) / (2 * np.bincount(y))[y]
    p = 1 / (1 + np.exp(-(x @ w + b)))
    r = s * (p - y)
    return np.r_[x.T @ r + w, r.sum() + (b if penalise else 0)]


def test_fits_reach_their_optimum(spark):
    x, y, df = feature_table(spark)
    model = fit_penalised(df)
    g = objective_gradient(x, y, np.array(model.coefficients), model.intercept, True)
    assert np.abs(g).max() < 1e-5
    lr = fit_mllib(df).stages[-1]
    g = objective_gradient(x, y, lr.coefficients.toArray(), lr.intercept, False)
    # Relative to the scale of the date column, up to 9999.
    assert np.abs(g[:9]).max() < 1e-2 and np.abs(g[9]) < 50


def test_models_round_trip_and_one_class_scores_zero(spark, tmp_path):
    _, _, df = feature_table(spark, 60)
    for name, model in (("a", fit_penalised(df)), ("b", fit_mllib(df))):
        save_ranker(spark, model, str(tmp_path / name))
        loaded = load_scorer(spark, str(tmp_path / name))(df)
        expected = as_scorer(model)(df)
        assert loaded.columns == [*df.columns, "score"]
        assert [r.score for r in loaded.collect()] == [r.score for r in expected.collect()]
    one = df.filter("label = 1")
    for fit in (fit_penalised, fit_mllib):
        assert {r.score for r in as_scorer(fit(one))(df).collect()} == {0.0}
    assert load_scorer(spark, str(tmp_path / "absent")) is with_rule_score
    assert LinearRanker((0.0,) * 10, 0.0)(df).first().score == 0.5


def test_vector_cache_encodes_only_what_is_missing(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def encode(texts):
        asked.append(texts.count())
        return encode_texts(texts, 8)
    texts = spark.createDataFrame([("abc",), ("abc",), ("defg",)], "identity_text string")
    assert cached_vectors(texts.limit(1), path, encode, "e:8").count() == 1
    assert cached_vectors(texts, path, encode, "e:8").count() == 2
    assert asked == [1, 1]
    assert missing_texts(texts, spark.read.parquet(path), "e:8").count() == 0
    # Another width is another vector.
    wide = cached_vectors(texts, path, lambda t: encode_texts(t, 16), "e:16")
    assert {len(r.identity_vec) for r in wide.collect()} == {16}
    # A text that two writers appended is read once.
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    assert cached_vectors(texts, path + "-twice", encode, "e:8").count() == 2


def test_readers_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("1", "+91"), ("2", "007")], "a string, b string")
    df.coalesce(1).write.option("header", True).option("sep", "\t").csv(str(tmp_path / "x.TSV"))
    df.write.parquet(str(tmp_path / "x.pq"))
    for name in ("x.TSV", "x.pq"):
        got = readers.read_table(spark, str(tmp_path / name))
        assert sorted(map(tuple, got.collect())) == [("1", "+91"), ("2", "007")]
    (tmp_path / "x.xlsx").write_text("no")
    (tmp_path / "empty").mkdir()
    for bad in ("x.xlsx", "empty"):
        with pytest.raises(ValueError, match="neither delimited text nor Parquet"):
            readers.read_table(spark, str(tmp_path / bad))
    with pytest.raises(KeyError):
        scan_customers(df)


@pytest.mark.parametrize("text", [
    '{"full_name": "A",\n "date_of_birth": "1990-01-01", "government_id": "G"}',
    '[{"full_name": "A", "dob": "1990-01-01", "gov_id": "G"}]'])
def test_payloads_in_either_spelling(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    row = readers.read_payloads(spark, str(tmp_path / "p.json"), lines=False).first()
    assert (row.full_name, row.dob, row.gov_id, row.country) == ("A", "1990-01-01", "G", None)
    assert query_object(readers.read_payloads(spark, str(tmp_path / "p.json"), lines=False)).first().country == "IN"


def test_quoted_fields_keep_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('full_name,addr_line\n"Doe, ""J""","1 Main\nSt"\n')
    assert tuple(readers.read_table(spark, str(tmp_path / "q.csv"), multiline=True).first()) == ('Doe, "J"', "1 Main\nSt")


def test_sorting_by_any_column(spark):
    df = spark.createDataFrame([("b", 10), ("A", 9), ("C", 100)], "name string, n int")
    assert [r.name for r in sorted_by(df, "name", ascending=True).collect()] == ["A", "b", "C"]
    assert [r.n for r in sorted_by(df, "n").collect()] == [100, 10, 9]


def loan(spark, *rows):
    names = [*schemas.RAW_FIELDS, *schemas.LOAN_FIELDS]
    full = [{**PERSON, "account_number": "A", "loan_application_id": f"L{i}",
             "requested_amount": "10", "loan_type": "Home Loan", "branch_code": "B", **r}
            for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.LOAN_APPLICATION)


def test_loan_check_and_latest_note(spark):
    notes = spark.createDataFrame(
        [("L0", "old", "o", "2024-01-01 00:00:00", "pending"),
         ("L0", "new", "o", "2024-01-02 00:00:00", "rejected")],
        "applicant_id string, note string, officer string, timestamp string, decision string"
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    assert latest_notes(notes).first().note == "new"
    got = check_loans(
        loan(spark, {}, {"gov_id": "Q", "phone": "", "email": "", "full_name": "zz"}),
        master_of(spark, {}), notes).orderBy("loan_application_id").collect()
    assert [(r.verdict_text, r.risk, r.decision, r.loan_type) for r in got] == [
        ("DUPLICATE DETECTED", "high", "rejected", "Home Loan"),
        ("UNIQUE APPLICANT", "low", None, "Home Loan")]
    assert got[0].score_text == "99.0%" and got[0].threshold_text == "82%"


def one_file(spark, folder, name, *people):
    """One Parquet file; files arrive in order of their time."""
    import os
    import time

    raw(spark, *people).coalesce(1).write.mode("append").parquet(str(folder))
    for f in os.listdir(folder):
        if f.endswith(".parquet") and not f.startswith("done"):
            os.rename(folder / f, folder / f"done-{name}.parquet")
            stamp = time.time() - 1000 + name
            os.utime(folder / f"done-{name}.parquet", (stamp, stamp))


def finish(writer, progress):
    writer.option("checkpointLocation", str(progress)).trigger(availableNow=True).start().awaitTermination()


def test_streamed_batches_are_checked_then_loaded_and_can_be_replayed(spark, tmp_path):
    arrivals = tmp_path / "in"
    one_file(spark, arrivals, 0, {}, {"full_name": "Other", "gov_id": "O", "phone": "+19999999999", "email": "o@o.io"})
    one_file(spark, arrivals, 1, {"full_name": "MIRA OKONKWO-VANCE"})
    stream = spark.readStream.schema(raw(spark, {}).schema).option(
        "maxFilesPerTrigger", 1).parquet(str(arrivals))
    master, verdicts = str(tmp_path / "master"), str(tmp_path / "verdicts")
    finish(check_and_ingest_stream(
        stream, "s", master, verdicts, now(), rejects_path=str(tmp_path / "rejects")), tmp_path / "progress")
    rows = read_master(spark, master).orderBy("customer_id").collect()
    assert [(r.customer_id, r.batch_id) for r in rows] == [
        (1, "stream-s-000000000000"), (2, "stream-s-000000000000"), (3, "stream-s-000000000001")]
    seen = [(r.batch_id, r.is_duplicate) for r in spark.read.parquet(verdicts).orderBy("batch_id").collect()]
    assert seen == [("stream-s-000000000000", False)] * 2 + [("stream-s-000000000001", True)]
    # The last batch run again by the same writer: the same rows under the same ids.
    run = spark.read.parquet(f"{master}/_manifest").first()["writer"]
    assert run
    last = spark.read.parquet(str(arrivals / "done-1.parquet"))
    ingest(last, master, "stream-s-000000000001", now(), writer=run)
    again = read_master(spark, master).orderBy("customer_id").collect()
    assert [(r.customer_id, r.full_name) for r in again] == [(r.customer_id, r.full_name) for r in rows]


def test_other_streams_do_not_replace_loaded_batches(spark, tmp_path):
    one_file(spark, tmp_path / "in", 0, *[{"full_name": f"N{i}"} for i in range(30)])
    one_file(spark, tmp_path / "more", 0, *[{"full_name": f"M{i}"} for i in range(7)])
    schema, master = raw(spark, {}).schema, str(tmp_path / "master")
    read = lambda folder: spark.readStream.schema(schema).parquet(str(tmp_path / folder))
    finish(ingest_stream(read("in"), "a", master, now()), tmp_path / "p1")
    finish(ingest_stream(read("more"), "b", master, now()), tmp_path / "p2")
    assert sorted(r.customer_id for r in read_master(spark, master).collect()) == list(range(1, 38))
    # The same name on a fresh progress folder would start at batch 0 again.
    with pytest.raises(Exception, match="name the stream anew"):
        finish(ingest_stream(read("more"), "a", master, now()), tmp_path / "p3")
    assert read_master(spark, master).count() == 37


def test_ids_and_writers_of_a_batch_that_was_broken_off(spark, tmp_path, monkeypatch):
    from likeness.sources import master as m

    path = str(tmp_path / "master")
    m.refuse_other_writer(spark, path, "b2", "w")  # and then the driver is lost
    with pytest.raises(ValueError, match="name the stream anew"):
        m.refuse_other_writer(spark, path, "b2", "v")
    m.refuse_other_writer(spark, path, "b2", "w")
    people = raw(spark, *[{"full_name": f"N{i}"} for i in range(9)])
    ingest(people, path, "b1", now())
    # Rows without a line in the manifest: their ids are looked up.
    lost = read_master(spark, path).withColumn("customer_id", F.col("customer_id") + 100)
    lost.drop("batch_id").write.partitionBy("created_on").parquet(f"{path}/batch_id=b2")
    assert m.last_id(spark, path, "b3") == 109 and m.last_id(spark, path, "b2") == 9
    ingest(people, path, "b2", now(), writer="w")
    monkeypatch.setattr(m, "read_master", None)  # nothing is scanned where all are listed
    assert m.last_id(spark, path, "b3") == 18 and m.last_id(spark, path, "b2") == 9


def test_late_rows_of_a_stream_are_not_counted(spark, tmp_path):
    from likeness.streaming.jobs import daily_counts, latest, upsert_batch

    # Late rows are told by the watermark that the batch before began with.
    days = ["2024-01-10", "2024-01-10", "2024-01-20", "2024-01-20", "2024-01-10"]
    for i, part in enumerate((days[:2], days[2:3], days[3:4], days[4:])):
        spark.createDataFrame([(d,) for d in part], "d string").select(
            F.to_timestamp("d").alias("created_at")).coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    import os
    (tmp_path / "in").mkdir()
    for i in range(4):
        f, = [x for x in os.listdir(tmp_path / f"f{i}") if x.endswith(".parquet")]
        os.rename(tmp_path / f"f{i}" / f, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(daily_counts(stream, "1 day").writeStream.outputMode("update").foreachBatch(
        upsert_batch(str(tmp_path / "counts"))), tmp_path / "p")
    found = {str(r.created_on): r.customers for r in latest(spark, str(tmp_path / "counts"), ["created_on"]).collect()}
    assert found == {"2024-01-10": 2, "2024-01-20": 2}


def test_streamed_ingest_equals_bulk_ingest(spark, tmp_path):
    people = raw(spark, *[{"full_name": f"N{i}", "gov_id": f"G{i % 7}"} for i in range(30)])
    people.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    ingest_stream(stream, "s", str(tmp_path / "streamed"), now()).option(
        "checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    bulk, _ = ingest(people, str(tmp_path / "bulk"), uuid.uuid4().hex, now())
    columns = [c for c in bulk.columns if c not in ("customer_id", "batch_id")]
    streamed = read_master(spark, str(tmp_path / "streamed"))
    assert streamed.select("customer_id").distinct().count() == 30
    assert streamed.select(*columns).exceptAll(bulk.select(*columns)).count() == 0
    assert bulk.select(*columns).exceptAll(streamed.select(*columns)).count() == 0
