import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, and columns with clashing names."""
    text = "One two three four five six seven eight nine ten eleven. Twelve words follow here and there and everywhere we look now."
    rows = [
        (1, text, "en", "s0", 1, "x"), (2, text, "en", "s0", 1, "x"), (2, text, "en", "s0", 1, "x"), (3, None, None, None, None, None), (4, "", "de", "s1", 0, "x"), (5, " \n\t ", "fr", "s1", 4, "x"),
        (6, "Wort " * 60_000, "de", "s1", 300_000, "x"), (None, "Kein Name hat dieses kleine Dokument mit Worten.", "de", None, 5, "x"), (7, "日本語のテキスト😀 <|endoftext|> é", "en", "s2", 9, None), (8, "Zeile eins.\nZeile zwei!", "de", "s2", 9, "x"),
    ]
    clashing = ("findings", "prior__", "__language", "evidence_", "places", "rep", "key", "h", "th")
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame([(*r, *clashing[:-1], None) for r in rows], shape).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def base():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, base):
    return spark.read.parquet(f"{base}/documents.parquet")
