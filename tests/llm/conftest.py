import pytest

#: Nulls, empty and wordless texts, repeats, a long text, accents; a column whose name operators use inside.
LONG = " ".join(f"w{i % 977}x{i // 3}" for i in range(30_000))
SHARED = " ".join(f"common{i}" for i in range(30))
ROWS = [
    (1, f"The first one. {SHARED} and its own end.", "en", "a", 1),
    (2, f"Another start entirely {SHARED} with another end.", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 0),
    (6, "Straße über Köln, naïve façade — 日本語 テスト 😀", "de", "b", 1),
    (7, f"The first one. {SHARED} and its own end.", "en", "c", 1),
    (7, f"The first one. {SHARED} and its own end.", "en", "c", 1),
    (8, LONG, "en", "c", 9),
    (9, "the the the the the the the the the the", "en", "c", 3),
    (10, "a<|endoftext|>b  c\n\n d <|im_end|>", "en", None, 3),
    (11, "1234 5678 !!! ???", "en", "d", 3),
    (None, "no id here at all", "en", "d", 3),
    (None, f"Nor here, {SHARED} but other words.", "en", "d", 3),
    (6, "Eine zweite Zeile mit derselben Nummer.", "de", "d", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, key long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf):
    """Rows of sf0.001 documents as (doc_id, text, lang)."""
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
