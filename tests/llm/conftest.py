import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, score double, kept boolean, rate double, n long, node long, pool string, part string"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Rows (doc_id, text, lang, source) as a stored table of two files, with columns whose names operators use too."""

    def make(rows, files=2):
        full = [(*r, len(r[1] or ""), "x", 1, 0.5, True, 1.0, 3, 4, "p", "q") for r in rows]
        path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


WORDS = "the and of to in is that for with on was are be this from by it as at not".split()


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty texts, white space only, repeated rows, equal texts, shared doc_ids and a very long text."""
    long_text = " ".join(f"{w}{i % 37}" for i in range(15_000) for w in ("alpha", "beta"))
    return [
        (1, "The same words here, again and again.", "en", "a"), (2, "The  same words\there, again and again.", "en", "a"), (3, "The same words here, again and again.", None, None),
        (4, None, "en", "b"), (5, "", "de", "b"), (6, " \n\t ", None, "b"), (7, long_text, "en", "a"), (7, long_text, "en", "a"), (8, long_text + " gamma", "en", None),
        (None, "no id here at all", "en", "a"), (None, None, None, None), (9, "one", "fr", "c"), (9, "two", "fr", "c"), (10, "12 34 !!", "fr", "c"),
    ]
