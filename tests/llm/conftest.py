import pytest

EXTRA = ", size int, score string, rules int, fp string, draws int, spans int, row int, host string, label int, k1_ int, copy int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with columns that clash with names the operators use."""
    long = " ".join(f"w{i % 997}x" for i in range(20_000))
    rows = [
        (1, "The same text of a few words, twice here and there.", "en", "a", 10), (1, "The same text of a few words, twice here and there.", "en", "a", 10), (2, None, "en", "b", None), (3, "", None, None, 0),
        (4, long, "de", "a", len(long)), (None, "No id, but mail me at x.y@z.example.org or +1 (555) 123-4567.", "en", "c", 1), (6, " \n\t ", "fr", "", 4), (7, "Ünïcode ﬁ 🙂 naïve\x85line　wide", "fr", "a", 9),
        (8, "THE SAME TEXT OF A FEW WORDS, TWICE HERE AND THERE.", "en", None, 5), (9, "a b", "en", "b", 3), (10, "x" * 30_000, "en", "b", 30_000),
    ]
    return spark.createDataFrame([(*r, 1, "s", 2, "f", 3, 4, 5, "h", 6, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)


@pytest.fixture(autouse=True)
def settings_stay(spark):
    """No operator changes the session's settings."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    yield
    assert [spark.conf.get(n) for n in names] == before


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
