import duckdb
import pytest

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def documents(data):
    return duckdb.sql(f"select doc_id, text, lang, source from '{data}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    passage = " ".join(f"shared{i}" for i in range(40))
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, passage + " one", "en", "a"), (2, passage + " two", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", "b"),
        (6, long, "en", "c"), (7, long, "en", "c"), (8, "short", "en", "a"), (9, "two words", "fr", "a"), (10, "Ünïcödé ñ ß é 漢字 🙂", "fr", None),
        (11, "x" * 20_000, "en", "b"), (12, "the the the the " * 50, "en", "b"), (None, passage + " one", "en", "a"), (1, passage + " one", "en", "a"), (13, "1234 !!! ???", None, "c"),
    ]
    extra = "size long, key string, shard int, n int, token long, rep long, score double, held_out boolean, component_id long, _id long, _copies int, before long, zone int, copy long, kept string, html string"
    names = [x.strip().split()[0] for x in extra.split(",")]
    df = spark.createDataFrame([r + (None,) * len(names) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
