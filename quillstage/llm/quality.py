"""Quality rules as weak supervision, in DataFrame functions alone.

Every rule looks at one figure of a text and votes good (1), bad (0) or abstains (null). How far a rule can be trusted is
not set by hand: documents are counted by their pattern of votes, of which there are at most 3 to the power of the
number of rules whatever the corpus, and expectation-maximisation over these counts estimates each rule's chances to
vote right, wrong or not at all on good and on bad documents, and the share of good ones. A document's quality probability is then the posterior given its
votes; it is kept from one half on, unless a base condition has failed. Where every rule abstains, the share of good
documents decides: silence alone is no evidence.

Words that stand in a 5-word window found twice are counted from the sorted (hash, position) pairs of the windows, and
only in texts that have fewer distinct windows than windows.

Defined results: a null or blank text has no words and fails the base conditions; equal rows have equal results; an empty
table gives an empty result and an estimate equal to the starting values; other columns are kept by ``keep_good`` and ignored by
the query, whatever their names; ``with_features`` adds columns that start with ``q_`` to rows that have none such.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import gram_hashes, read, words_of, written

#: Fewest words, and most repeated words in per cent of all.
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_stops", "n_chars")


def _shorter(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column ``q_<name>`` for each of FEATURES."""
    own, whole = [F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("q_words", words_of(F.col(text)))
    df = df.withColumn("q_lines", F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0))
    df = df.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    df = gram_hashes(df, "q_hashes", "q_grams")
    n = F.size("q_grams")
    again = (n > 1) & (F.size(F.array_distinct("q_grams")) < n)
    df = df.withColumn("q_sorted", F.when(again, F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def neighbours(x: Column, i: Column) -> Column:
        return (x["h"] == F.get("q_sorted", i + 1)["h"]) | (x["h"] == F.get("q_sorted", F.when(i > 0, i - 1))["h"])

    df = df.withColumn("q_at", F.when(F.col("q_sorted").isNotNull(), F.sort_array(F.transform(F.filter("q_sorted", neighbours), lambda x: x["i"]))))
    covered = F.aggregate(
        F.zip_with("q_at", F.slice("q_at", 2, F.greatest(F.size("q_at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))),
        F.lit(0), lambda total, x: total + x
    )
    figures = {
        "q_n_words": F.size("q_words").cast("long"),
        "q_word_chars": F.length(F.translate(whole, WHITE, "")).cast("long"),
        "q_n_symbols": _shorter(whole, SYMBOLS),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_distinct": F.size(F.array_distinct("q_hashes")).cast("long"),
        "q_n_upper": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
        "q_n_stops": F.regexp_count(whole, F.lit(r"[.!?。！？]")).cast("long"),
        "q_n_chars": F.length(whole).cast("long"),
    }
    # a generator over one row: the optimiser does not copy the figures into each of the rules that read them
    return df.select(*own, F.inline(F.array(F.struct(*(c.alias(k) for k, c in figures.items())))))


def base_failed() -> Column:
    return (F.col("q_n_words") < LEAST_WORDS) | (100 * F.col("q_n_repeat_words") > MOST_REPEATED * F.col("q_n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def votes() -> dict[str, Column]:
    """The rules over the features: 1 good, 0 bad, null where the rule abstains. Most rules know a defect and abstain without it."""
    words, f = F.col("q_n_words"), {k: F.col(f"q_{k}") for k in FEATURES}
    plain = 50 * f["n_symbols"] <= words
    never = F.lit(False)
    return {
        "length": _vote(never, words < 5),
        "symbols": _vote(never, 5 * f["n_symbols"] > words),
        "repeats": _vote(never, 5 * f["n_repeat_words"] > words),
        "lines": _vote(never, 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
        "capitals": _vote(never, 10 * f["n_upper"] > 3 * f["word_chars"]),
        "word_length": _vote(never, (f["word_chars"] < 2 * words) | (f["word_chars"] > 14 * words)),
        "variety": _vote(plain & (5 * f["n_distinct"] >= 2 * words), (words < 5000) & (5 * f["n_distinct"] < words)),
        "sentences": _vote(plain & (f["n_stops"] >= 1) & (60 * f["n_stops"] >= words), (words >= 40) & (200 * f["n_stops"] < words)),
    }


def count_patterns(voted: DataFrame, names: list[str]) -> list[tuple[tuple[int | None, ...], int]]:
    """How many rows have each pattern of votes: at most 3 ** len(names) rows reach the driver."""
    rows = voted.groupBy(*names).agg(F.count("*").alias("q_rows")).collect()
    return sorted(((tuple(r[n] for n in names), r["q_rows"]) for r in rows), key=lambda p: tuple(-1 if v is None else v for v in p[0]))


#: Votes in the order of the estimated chances.
OUTCOMES = (1, 0, None)
#: Chances of a vote on a good and on a bad document from which the estimate starts.
START = ((0.45, 0.05, 0.5), (0.05, 0.45, 0.5))
Model = tuple[float, list[tuple[tuple[float, ...], tuple[float, ...]]]]


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, rounds: int = 200, share: float = 0.8, weight: float = 2.0) -> Model:
    """Expectation-maximisation: the share of good rows, and per rule the chances of its votes on good and on bad ones.

    The chances are drawn to START with the weight of ``weight`` rows. Good rows are half of all at least, so that the
    classes cannot change places.
    """
    chances = [START] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, seen = 0.0, [[[weight * x for x in START[0]], [weight * x for x in START[1]]] for _ in range(n_rules)]
        for pattern, n in patterns:
            p = posterior(pattern, (share, chances))
            good += n * p
            for per_class, vote in zip(seen, pattern, strict=True):
                k = OUTCOMES.index(vote)
                per_class[0][k] += n * p
                per_class[1][k] += n * (1 - p)
        before = share
        share = min(0.999, max(0.5, good / total))
        chances = [tuple(tuple(x / sum(row) for x in row) for row in per_class) for per_class in seen]
        if abs(before - share) < 1e-10:
            break
    return share, chances


def accuracies(model: Model) -> list[float]:
    """Per rule the chance that a vote is right, when it does vote."""
    share, chances = model
    return [(share * g[0] + (1 - share) * b[1]) / (share * (g[0] + g[1]) + (1 - share) * (b[0] + b[1])) for g, b in chances]


def _log_odds(model: Model) -> tuple[float, list[list[float]]]:
    share, chances = model
    return math.log(share / (1 - share)), [[math.log(max(g, 1e-12) / max(b, 1e-12)) for g, b in zip(*pair, strict=True)] for pair in chances]


def posterior(pattern: tuple[int | None, ...], model: Model) -> float:
    prior, odds = _log_odds(model)
    total = prior + sum(o[OUTCOMES.index(v)] for o, v in zip(odds, pattern, strict=True)) * any(v is not None for v in pattern)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def probability(names: list[str], model: Model) -> Column:
    """The posterior as a column over the votes."""
    prior, odds = _log_odds(model)
    total = F.lit(0.0)
    for name, o in zip(names, odds, strict=True):
        total = total + F.when(F.col(name) == 1, o[0]).when(F.col(name) == 0, o[1]).otherwise(o[2])
    return 1 / (1 + F.exp(-(F.lit(prior) + F.when(F.coalesce(*names).isNotNull(), total).otherwise(0.0))))


def judged(featured: DataFrame) -> DataFrame:
    """Adds the votes, ``q_base_failed``, ``q_quality`` and ``q_kept`` to rows with features. Reads the rows once for the estimate."""
    rules = votes()
    names = [f"q_vote_{k}" for k in rules]
    voted = featured.withColumns(dict(zip(names, rules.values(), strict=True)))
    model = estimate(count_patterns(voted, names), len(names))
    scored = voted.withColumns({"q_base_failed": base_failed(), "q_quality": probability(names, model)})
    return scored.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_quality") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names. Texts are read once: documents and figures are one table, of which the estimate reads the figures alone."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    kept = judged(written(with_features(rows, "text").drop("text"), "featured")).filter("q_kept")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    featured = written(with_features(docs.select("doc_id", "text")).drop("text"), "features")
    return judged(featured).select(
        "doc_id", *(F.col(f"q_{k}").alias(k) for k in FEATURES[:5]), F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"), F.round("q_quality", 6).alias("quality")
    )


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
