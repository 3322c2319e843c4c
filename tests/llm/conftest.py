import pytest

LONG = " ".join(f"wort{i % 97}a{i % 13}" for i in range(30_000))
COPY = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge near town tonight"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size int, kept string, label double, key string, n int, node int, target string, evidence int, _doc int"
)


def dirty_rows():
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows."""
    texts = [
        None, "", " \n\t ", "one", "One two\nthree", COPY, COPY, COPY.upper(), COPY + " at last", LONG, LONG,
        "líne\nlíne\nlíne\nother words here", "### $$$ %%% 12345 ||| <<>>", "ünïcödé wörds ñandú 日本語 😀 text",
        "a a a a a a a a a a a a a a a a a a a a a a a a", "password=b7db7aa4a5fcc78305aa and 4785380592391139 end",
    ]
    rows = []
    for i, text in enumerate(texts):
        lang, source = [None, "en", "de"][i % 3], [None, "src0", "src1", "src0"][i % 4]
        rows.append((i, text, lang, source, None if text is None else len(text), i, "x", 1.0, "k", 2, 3, "t", 4, 5))
    rows.append((None, "no id here but some words", "en", "src0", 25, 1, None, None, None, None, None, None, None, None))
    rows.append(rows[5])  # the same row twice
    return rows


@pytest.fixture(scope="session")
def dirty(spark):
    return spark.createDataFrame(dirty_rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
