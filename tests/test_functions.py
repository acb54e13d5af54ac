import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstage.functions import align, numbers, speech
from quillstage.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_number_words():
    said = [numbers.french(n) for n in range(1000)]
    assert len(set(said)) == 1000
    assert [said[n] for n in (0, 21, 71, 80, 81, 99, 100, 200, 201, 999)] == [
        "zero", "vingt et un", "soixante-onze", "quatre-vingts", "quatre-vingt-un", "quatre-vingt-dix-neuf", "cent", "deux cents",
        "deux cent un", "neuf cent quatre-vingt-dix-neuf"
    ]


@pytest.mark.parametrize(
    ("label", "style", "number"),
    [
        ("IV", "romain", 4), ("XIX. La nuit", "romain", 19), ("12", "arabe", 12), ("DEUXIEME", "ecrit", 2), ("DIX", "ecrit", 10),
        ("MCMXC", "romain", 1990), ("ALICE", None, None), ("", None, None)
    ]
)
def test_numerals(spark, label, style, number):
    row = spark.range(1).select(numbers.numeral_style(F.lit(label)).alias("s"), numbers.numeral_value(F.lit(label)).alias("v")).first()
    assert (row.s, row.v) == (style, number)


def test_speech_id(spark):
    assert value(spark, X.speech_id(F.array(F.lit("CLARISSA")), F.lit("Oui."), F.lit(0))) == "r_abf669b491bf"
    assert value(spark, X.speech_id(F.array(F.lit("CLARISSA")), F.lit(" *Oui.* "), F.lit(0))) == "r_abf669b491bf"
    assert value(spark, X.speech_id(F.array(F.lit("CLARISSA")), F.lit("Oui."), F.lit(1))) != "r_abf669b491bf"


def test_labels_and_names(spark):
    assert value(spark, X.label(F.lit(" **Scène II.** "))) == "SCENE II"
    assert value(spark, X.speaker(F.lit("L’HÔTE (bas) :"))) == "L'HÔTE"
    assert value(spark, X.speakers(F.lit("Jan / Martha et Paul"))) == ["Jan", "Martha", "Paul"]
    assert value(spark, X.speakers(F.lit("TOUS."))) == ["*"]
    assert value(spark, X.asides_of(F.lit("JAN (bas) [à part]"))) == ["bas", "à part"]
    assert value(spark, X.slug(F.lit("L’Été à Zürich !"))) == "l-ete-a-zurich"
    assert value(spark, X.initials(F.lit("Où vas-tu ?"))) == "O v-t ?"


def test_openings(spark):
    assert value(spark, X.opening(F.lit("— Ah ! c’est vous, monsieur ?"), 2)) == "— Ah ! c’est"
    assert value(spark, X.opening(F.lit("— !"), 2)) == ""
    assert value(spark, X.last_words(F.lit("un deux trois"), 2)) == "deux trois"


def test_recitation_scores():
    assert speech.judged("Le 22 mars, Mme Durand", "le vingt-deux mars madame durant")["expected"] == 5
    same = speech.judged("Je ne sais pas.", "je ne sais pas")
    assert (same["score"], same["correct"], same["added"]) == (100, 4, 0)
    other = speech.judged("Je ne sais pas", "je sais pas bien")
    assert (other["score"], other["judged"], other["added"]) == (60, 5, 1)
    swapped = speech.judged("bonjour monsieur", "bonjour madame")
    assert [d["state"] for d in swapped["details"]] == ["correct", "substitue"] and swapped["details"][1]["said"] == "madame"
    assert speech.judged("", "bonjour")["score"] == 0
    assert speech.judged("mot " * 500, "mot " * 500)["truncated"]


@given(st.text(max_size=80), st.text(max_size=80))
def test_recitation_bounds(a, b):
    r = speech.judged(a, b)
    assert 0 <= r["score"] <= 100 and r["correct"] <= r["expected"]
    assert speech.judged(a, a)["score"] in (0, 100)


def test_sounds():
    assert [speech.sound(w) for w in ("eaux", "philosophe", "quand", "verre", "vert", "e")] == ["o", "filosof", "kan", "ver", "ver", "e"]


def test_sounds_by_columns(spark):
    words = ["eaux", "philosophe", "quand", "verre", "vert", "e", "l'eau", "ceci", "aider"]
    got = [r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select(speech.sound_column(F.col("w")).alias("k")).collect()]
    assert got == [speech.sound(w) for w in words]


@given(st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32 - 1))
def test_draws(total, wanted, seed):
    got = speech.picked(total, wanted, seed)
    assert got == sorted(set(got)) == speech.picked(total, wanted, seed) and len(got) == min(total, wanted)
    assert all(0 <= i < total for i in got)


def test_seed_is_fnv():
    assert speech.seed_of("") == 0x811C9DC5 and speech.seed_of("a") == 0xE40C292C


@given(st.text("ab \n", max_size=40), st.text("ab \n", max_size=40))
def test_carried_spans_lie_inside(a, b):
    spans = align.carried(a, b, [(0, len(b))])
    assert all(0 <= s < e <= len(a) for s, e in spans)
    assert align.carried(a, a, [(1, 3)]) == ([(1, min(3, len(a)))] if len(a) > 1 else [])


def test_carry(spark):
    row = spark.createDataFrame(
        [("AAAA BBBB\nCC", "AAAA XX BBBB\nCC", [(0, 4)])], "a string, b string, c array<struct<start:int,stop:int>>"
    ).select(align.carry("a", "b", "c").alias("s")).first()
    assert [(s.start, s.stop) for s in row.s] == [(0, 4)]


def test_formats(spark):
    assert value(spark, numbers.duration(F.lit(3720))) == "1 h 02 min"
    assert value(spark, numbers.thousands(F.lit(1234567))) == "1 234 567"
    assert value(spark, numbers.back_off(F.lit(9))) == 60.0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_shortest_scripts(a, b):
    pairs = sorted(align._shortest(a, b))
    assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in itertools.pairwise(pairs))


@given(st.lists(st.sampled_from(["", "x", "y", "one", "two", "zed"]), max_size=12), st.lists(st.sampled_from(["", "x", "y", "one", "two", "zed"]), max_size=12))
def test_blocks_are_equal_and_in_order(a, b):
    blocks = align.matching(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
    assert all(i + n <= u and j + n <= v and (i + n, j + n) != (u, v) for (i, j, n), (u, v, _) in itertools.pairwise(blocks))
    stretches = list(align.equal_stretches("\n".join(a), "\n".join(b)))
    x, y = "\n".join(a) + "\n", "\n".join(b) + "\n"
    assert all(x[i : i + n] == y[j : j + n] for i, j, n in stretches)


@given(st.permutations(range(9)))
def test_rising_chains(order):
    chain = align.rising(list(enumerate(order)))
    assert chain == sorted(chain) and all(a[1] < b[1] for a, b in itertools.pairwise(chain))
    assert len(chain) == longest_common(order, range(9))


def test_cuts_are_carried_between_versions():
    source = "ACTE I\nJAN\nBonjour, ma mère.\nMARTHA\nComment vas-tu ?\nfin"
    reviewed = source.replace("JAN\n", "JAN\n(Il entre.)\n").replace("fin", "FIN")
    at = reviewed.index("Comment vas-tu ?")
    assert align.carried(source, reviewed, [(at, at + 16)]) == [(source.index("Comment"), source.index("Comment") + 16)]
    # curved apostrophes and hard spaces are like straight ones; corrected letters are not cut, what stands around them is
    assert align.carried("J'ai dit : oui", "J’ai dit : oui", [(0, 4), (9, 14)]) == [(0, 4), (9, 14)]
    assert align.carried("le chat noir", "le chien noir", [(0, 13)]) == [(0, 5), (7, 12)]
    assert align.carried("", "abc", [(0, 3)]) == align.carried("abc", "", []) == align.carried("abc", "xyz", [(0, 3)]) == []


def test_texts_of_a_megabyte_in_bounded_memory():
    import random
    import tracemalloc

    rng = random.Random(1)
    lines = [" ".join(rng.choices(["la", "mer", "est", "calme", "ce", "soir", str(k)], k=9)) for k in range(28_000)]
    other = list(lines)
    for k in rng.sample(range(len(lines)), 300):
        other[k] = other[k].replace("mer", "nuit") + "!"
    del other[5000:5100]
    other[9000:9000] = ["une ligne de plus"] * 50
    source, reviewed = "\n".join(lines), "\n".join(other)
    assert len(source) > 1_000_000
    tracemalloc.start()
    got = align.carried(source, reviewed, [(0, len(reviewed))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert sum(e - s for s, e in got) > 0.98 * len(source)


def test_batches_are_judged_in_parts():
    import pandas as pd

    held = []

    def judged(expected, heard):
        held.append(len(expected))
        return pd.DataFrame([speech.judged(a, b) for a, b in zip(expected, heard, strict=True)])

    batch = pd.Series([f"un mot {i}" for i in range(2 * speech.PART + 5)])
    out = pd.concat(speech.in_parts(iter([(batch, batch.str.upper()), (batch[:0], batch[:0])]), judged))
    assert max(held) <= speech.PART <= 1000 and out["score"].tolist() == [100] * len(batch)


def test_a_batch_of_recitations_is_answered_whole(spark):
    rows = spark.range(1003).repartition(1).select("id", F.concat(F.lit("mot "), F.col("id").cast("string")).alias("t"))
    got = rows.select("id", speech.compare("t", F.when(F.col("id") % 2 == 0, F.col("t")).otherwise("mot")).alias("r")).select("id", "r.correct", "r.expected").collect()
    assert len(got) == 1003 and all(r.correct == r.expected if r.id % 2 == 0 else r.correct == 1 for r in got)


def test_long_recitations_are_judged_whole(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeilmnortuvw", k=rng.randint(1, 3))) for _ in range(900)]
    heard = [w for w in words if rng.random() < 0.8] + ["encore"] * 30
    for a, b in ((words, heard), (words, words), (words[:401], words[:399]), ([], words), (words, [])):
        whole = speech.judged(" ".join(a), " ".join(b), None)
        assert whole["expected"] == len(a) and not whole["truncated"]
        assert [d["word"] for d in whole["details"] if d["state"] != "ajoute"] == a
    rows = spark.createDataFrame([(0, " ".join(words), " ".join(heard)), (1, "mot " * 399 + "fin", "mot " * 400 + "fin")], "id int, a string, b string")
    got = {r.id: r.r for r in rows.select("id", speech.compare("a", "b").alias("r")).collect()}
    assert got[0].expected == len(got[0].details) - got[0].added == 900 and (got[1].correct, got[1].added) == (400, 1)


def test_an_alignment_equals_that_by_a_whole_table(monkeypatch):
    def brute(a, b):
        n, m = len(a), len(b)
        c = [[0] * (m + 1) for _ in range(n + 1)]
        for i, j in itertools.product(range(n - 1, -1, -1), range(m - 1, -1, -1)):
            c[i][j] = c[i + 1][j + 1] + 1 if a[i] == b[j] else max(c[i + 1][j], c[i][j + 1])
        out, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and a[i] == b[j]:
                step, i, j = ("correct", i, j), i + 1, j + 1
            elif j == m or (i < n and c[i + 1][j] == c[i][j]):
                step, i = ("oublie", i, None), i + 1
            else:
                step, j = ("ajoute", None, j), j + 1
            if out and {out[-1][0], step[0]} == {"oublie", "ajoute"}:
                first = out.pop()
                step = ("substitue", first[1] if first[1] is not None else step[1], first[2] if first[2] is not None else step[2])
            out.append(step)
        return out

    rng = random.Random(4)
    for k in range(300):
        monkeypatch.setattr(speech, "OFTEN", k % 3 * 4)
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(2))
        assert speech.aligned(list(a), list(b)) == brute(a, b)


def test_parts_are_bounded_by_their_size(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(speech, "PART_SIZE", 100)
    batch = pd.Series(["x" * n for n in (40, 0, 70, 500, 1, 30, 30, 30, 30)] + [None])
    parts = list(speech.in_parts(iter([(batch, batch)]), lambda a, b: a))
    assert [list(p.map(lambda t: len(t or ""))) for p in parts] == [[40, 0], [70], [500], [1, 30], [30], [30], [30, 0]]


def test_short_ways_equal_the_patterns(spark):
    rng = __import__("random").Random(7)
    signs = [*X.WS_CHARS, *".:;,!?*[(aÉ’", "et", "**", "<<<PAGE_BREAK>>>", "[PAGE 1]"]
    rows = [("".join(rng.choices(signs, k=rng.randint(0, 14))),) for _ in range(3000)] + [(None,), ("",), ("a.\n",), ("a * * b",)]
    t = F.col("t")
    cut = X.strip(F.regexp_replace(X.strip(F.get(F.split(t, f"[{X.WS}]*[\\[(]"), F.lit(0))), X.TRAILING_POINTS, ""))
    pairs = {
        "points": (X.without_points(t), F.regexp_replace(t, X.TRAILING_POINTS, "")),
        "comparison": (X.for_comparison(t), X.squeeze(F.replace(X.for_counting(t), F.lit("*"), F.lit("")))),
        "stretches": (X.stretches(t), F.regexp_count(t, F.lit(X.NONSPACE))), "role": (X.canonical_role(t), F.upper(F.translate(cut, "’", "'")))
    }
    df = spark.createDataFrame(rows, "t string").select("t", *(c.alias(f"{k}{i}") for k, p in pairs.items() for i, c in enumerate(p)))
    assert [(r.t, k, r[f"{k}0"], r[f"{k}1"]) for r in df.collect() for k in pairs if r[f"{k}0"] != r[f"{k}1"]] == []
    plan = spark.createDataFrame(rows, "t string").select(X.label(t), X.stretches(t))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and ".:;,!?" in plan and "[.:;,!?" not in plan
