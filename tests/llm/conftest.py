import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, size string, bucket string, key string, grp string, label int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while twelve boxing wizards sing of jars"
ODD = [
    (1, f"one two three four five six seven eight nine ten. {PASSAGE} and then some more words follow here", "en", "a"),
    (2, f"completely different opening words are here instead of those, {PASSAGE} but the ending differs as well", "en", "b"),
    (3, f"one two three four five six seven eight nine ten. {PASSAGE} and then some more words follow here", "en", "a"),
    (4, None, None, None),
    (5, "", "fr", "b"),
    (6, " \n\t  ", None, ""),
    (7, "wort", "de", "c"),
    (8, "  \x0b 12 !! ", "de", None),
    (9, LONG, "en", "a"),
    (10, LONG + " tail", "en", "a"),
    (11, "日本語 テキスト です\nñandú   über alles 🎉 é", "xx", "b"),
    (None, "a document without an id but with a few words in it", "en", "a"),
    (12, "same words again " * 60, "en", "c"),
    (12, "same words again " * 60, "en", "c"),
    (-3, "ONE two THREE four five six seven eight nine ten eleven twelve thirteen", None, "b"),
    (14, "one TWO three four five six seven eight nine ten eleven twelve thirteen", "en", "b"),
    (2**62, "line\nline\nline\n\nother line\n", "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, 0.5, "n", "s", "k", "y", "g", 1) for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
