import random

import pytest

CLASHES = ["size", "row", "v", "u", "id", "n", "bucket", "root", "kept", "shard", "curve", "gone", "piece_key", "word", "held_out", "score", "cell", "class", "members", "component_id", "n_shingles", "copies", "doc", "__dropped", "key", "runs", "spans", "terms", "words", "h", "a", "p"]


def prose(rng: random.Random, words: int, letters: str = "etaoinshrdlu") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, characters of many scripts, repeated rows and ids."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 12) for _ in range(2500))
    texts = [None, "", " \t\n ", "a", "one two three", "Ünïcödé ŝtraße — “quoted” 12³ don't", "日本語 テスト 𝒳 \x00 \x1f", "a  b\n\nc ", " lead", "!!! ### 42", long, "same text of nine words that stands here twice", "same text of nine words that stands here twice"]
    rows = [(k, t, ("en", None, "de")[k % 3], ("s1", "s2", None)[k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[11], (None, "no id here at all", "en", "s1", 17), (99, "x y z " * 50, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
