"""The pipeline: each stage on what the one before kept."""

import corpus_pipeline
from likeness.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near duplicates", "benchmark decontamination", "personal data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.cache()
        assert docs.count() < before if name != "personal data" else docs.count() == before
        before = docs.count()
    assert pii.with_spans(docs).where("size(spans) > 0").isEmpty()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_the_packed_texts_are_the_redacted_ones(spark):
    long = " ".join(f"w{i}" for i in range(5000)) + "\n end "
    rows = [(1, "mail me at jo@ex.org  please\n ok", "a", 3), (1, "mail me at jo@ex.org  please\n ok", "a", 3), (2, None, None, 0),
            (3, "  \n", "b", 0), (4, long, "a", 9), (None, "no id here", "c", 1), (5, "", "a", 0), (1, "other text of id 1", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = corpus_pipeline.packed(spark, corpus_pipeline.without_personal_data(spark, docs, SF), SF).collect()
    assert sorted((r.doc_id or 0, r.piece, r.n_words, r.bin_id is None) for r in found) == [
        (0, 0, 3, False), (1, 0, 5, False), (1, 0, 6, False), (1, 0, 6, False), (2, 0, 0, True), (3, 0, 0, True), (4, 0, 2048, False),
        (4, 1, 2048, False), (4, 2, 905, False), (5, 0, 0, True)]
    assert all((r.text is None) == (r.n_words == 0) for r in found)
    assert all(len(r.text.split()) == r.n_words for r in found if r.text)
    assert "".join(r.text for r in sorted(found, key=lambda r: r.piece) if r.doc_id == 4) == long
    assert [r.text for r in found if r.doc_id is None] == ["no id here"]
    one = [r.text for r in found if r.doc_id == 1 and r.n_words == 6]
    assert len(one) == 2 and one[0] == one[1] and "@" not in one[0] and one[0].startswith("mail me at") and one[0].endswith("  please\n ok")
