import pytest
from pyspark.sql import functions as F

PROSE = "The quiet harbour was full of small boats, and the fishermen mended their nets. Nobody spoke of the storm that had passed in the night. "


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, short and very long texts, repeated rows and columns whose names operators might use."""
    long = " ".join(f"mot{i % 7919} wort{i % 104729}" for i in range(60000))
    rows = [
        (0, None, "en", "s0", 0), (1, "", "en", "s0", 0), (2, " \n\t", "en", None, 3), (3, "one two", None, "s1", 7), (4, PROSE * 6, "en", "s1", 800), (4, PROSE * 6, "en", "s1", 800),
        (5, PROSE * 6, "en", "s1", 800), (None, PROSE * 3, "en", "s0", 400), (6, long, "fr", "s0", None), (7, "été " * 400, "fr", "s2", 1600), (8, "### $$$ " * 50, None, "s0", 400), (9, PROSE.lower() * 6, "en", "s1", 800),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = [
        "n", "d", "bands", "component_id", "score", "kept", "value", "piece", "length", "sequence_id", "rank", "count", "fp", "places",
        "label", "words", "rejected", "bucket", "part", "members", "mix", "c", "t", "r", "p", "k"
    ]
    return df.withColumns({c: F.lit(f"own {c}") for c in clashes}).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that have the names which the operators make on their way."""
    names = [
        "row", "q_n_words", "q_words", "q_kept", "q_vote_length", "q_quality", "q_base_failed", "__language", "found", "l", "o", "h", "mix_rate", "mix_cdf", "mix_low",
        "mix_source", "mix_copies", "mix_copy", "mix_key", "from", "name", "copies", "x", "fp", "least", "cut", "key", "block", "chapter", "b", "m", "seq"
    ]
    return odd.withColumns({c: F.lit(f"own {c}") for c in names if c not in odd.columns}).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
