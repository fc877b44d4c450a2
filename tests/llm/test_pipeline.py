from collections import Counter

import corpus_pipeline as p


def test_stages_keep_columns_and_take_effect(spark, stored, awkward):
    near = " ".join(f"w{i}" for i in range(200))
    rows = awkward + [(60, near, "en", "a"), (61, near + " tail", "en", "a"), (62, "clean text of its own with a few more words", "en", "b")]
    docs = stored(rows)
    columns = docs.columns
    sizes = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, ""), name)
        assert docs.columns == columns
        sizes[name] = Counter(r.doc_id for r in docs.collect())
    assert not {4, 5, 6} & set(sizes["language"]) and {60, 61, 62, 7, 9} <= set(sizes["language"])
    assert sizes["exact"][7] == 1 and 2 not in sizes["exact"] and 3 not in sizes["exact"]
    assert 61 not in sizes["near"] and {60, 62} <= set(sizes["near"])
    packed = p.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == sizes["mix"]


def test_language_stage_without_labels_keeps_lettered_rows(spark, stored):
    rows = [(1, "words without a label", None, "a"), (2, "12 34", None, "a"), (3, None, None, "a"), (4, "é", None, "a")]
    assert {r.doc_id for r in p.language(spark, stored(rows), "").collect()} == {1, 4}


def test_language_stage_rejects_by_score(spark, stored):
    rows = [(i, text, lang, "a") for i, (text, lang) in enumerate([("the and of to in that", "en"), ("der die und das nicht mit", "de"), ("el los que una por para", "es")] * 20)]
    docs = stored([*rows, (100, "qq", None, "a")])
    found = {r.doc_id: r.score for r in p.language_id.identify(docs).collect()}
    assert {r.doc_id for r in p.language(spark, docs, "").collect()} >= set(range(60))
    margin = (found[100] - 1 / 3) * 3 / 2
    for least in (margin - 1e-6, margin + 1e-6):
        kept = {r.doc_id for r in docs.filter(p.language_id.stays(docs, least)).collect()}
        assert (100 in kept) == (least < margin)


def test_rows_are_the_same_when_the_number_of_cores_changes(spark, stored, monkeypatch):
    """Splits, and so numbers given by a scan, depend on the tasks that read it; decisions must not."""
    rows = [(i, f"text number {i // 3} of its own with words enough to be read", "en", "a") for i in range(300)]
    docs, seen = stored(rows, files=30), p.materialise
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")

    def then_more_cores(df, label):
        out = seen(df, label)
        spark.conf.set("spark.sql.files.minPartitionNum", "16" if label == "dropped" else "2")
        return out

    monkeypatch.setattr(p, "materialise", then_more_cores)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        kept = [r.doc_id for r in p.exact(spark, docs, "").collect()]
        assert sorted(kept) == list(range(0, 300, 3))
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        kept = [r.doc_id for r in p.near(spark, docs, "").collect()]
        assert sorted(kept) == list(range(0, 300, 3))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_clashing_and_null_columns(spark, stored):
    import pytest

    rows = [(None, "same words in two rows without an id here", None, None)] * 2 + [(5, "same words in two rows without an id here", "en", "a")]
    docs = stored(rows)
    assert [r.doc_id for r in p.exact(spark, docs, "").collect()] == [5]
    assert [r.doc_id for r in p.near(spark, docs, "").collect()] == [5]
    assert p.exact(spark, docs.filter("doc_id IS NULL"), "").count() == 1
    with pytest.raises(ValueError, match="driftline_row"):
        p.exact(spark, docs.withColumn("driftline_row", p.F.lit(1)), "")


def test_run_on_small_table(spark, stored, awkward, tmp_path):
    stored(awkward).write.parquet(f"{tmp_path}/documents.parquet")
    from driftline.llm import common

    before = set(common._written)
    packed = p.run(spark, str(tmp_path))
    assert packed.count() > 0
    assert len(set(common._written) - before) == 1  # only the last stage's input is still there
    assert [n for n, _ in p.STAGES] == ["language", "exact", "near", "mix", "pack"] and p.ORACLE_SQL is None


def test_empty_table(spark, stored, tmp_path):
    stored([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
