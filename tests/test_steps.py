"""Cases that the tables do not hold, on small fixtures."""

import csv

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstage.functions import speech
from quillstage.functions import text as X
from quillstage.operators import balance, editing, lines, model, quality, reading, rehearsal, stages
from quillstage.sources import store, texts
from quillstage.sources.folder import shared_folder, write_files

LONG = "Été après été, la forêt était là, où rien ne bougeait. " * 6


def found(spark, column, rows, names="t string"):
    return [r.x for r in spark.createDataFrame(rows, names).select(column.alias("x")).collect()]


def test_text_layers(spark):
    rows = [
        (None,), (" \n",), (LONG[:150],), (LONG,), (LONG.translate(dict.fromkeys(range(97, 110), "1")),), (LONG[:200] + "\x00" * 20,),
        (LONG.replace("é", "e").replace("è", "e").replace("ê", "e").replace("à", "a").replace("ù", "u").replace("É", "E"),)
    ]
    assert found(spark, quality.text_layer_refusals(F.col("t")), rows) == [
        ["no text layer"], ["no text layer"], ["too short"], [], ["few letters"], ["odd characters"], ["no accents"]
    ]


def test_declarations(spark):
    rows = [("Page vide.",), ("Je ne peux pas transcrire cette page",), ("Page vide. " * 30,), ("",), ("cette image est illisible",)]
    assert found(spark, quality.says_blank(F.col("t")), rows) == [True, False, False, False, False]
    assert found(spark, quality.says_failed(F.col("t")), rows) == [False, True, False, False, True]


def test_checks_of_cut_texts(spark):
    rows = [(LONG, LONG[: len(LONG) * 7 // 10]), (LONG, ""), (LONG, LONG + "\n```x"), ("", "x"), (LONG, LONG.replace("Été", "**Été**", 1))]
    names = "a string, b string"
    assert found(spark, quality.output_findings(F.col("a"), F.col("b")), rows, names) == [["too short"], ["empty output"], ["forbidden: code fence"], [], []]
    assert found(spark, quality.junction_findings(F.col("a"), F.col("b")), rows, names) == [["shortened"], ["empty"], [], [], []]
    assert found(spark, quality.transcript_findings(F.col("b")), rows, names) == [[], [], ["forbidden: code fence"], [], ["emphasis added"]]
    assert found(spark, quality.mechanical_findings(F.concat("a", F.lit("\nACTE I")), F.col("b")), rows, names)[0] == ["volume", "lines", "label lost: ACTE I"]


def test_junction_with_delimiters_inside(spark):
    reply = f"{editing.LEFT}a{editing.LEFT_END}{editing.RIGHT}b {editing.RIGHT} c{editing.RIGHT_END} d{editing.RIGHT_END}"
    assert [tuple(r) for r in found(spark, editing.junction_reply(F.col("t")), [(reply,)])] == [("a", f"b {editing.RIGHT} c")]
    assert found(spark, editing.junction_reply(F.col("t")), [(f"{editing.LEFT}a{editing.RIGHT}b",), (None,)]) == [None, None]


def test_books_in_pieces(spark):
    spine = spark.createDataFrame([("b", n) for n in (-1, 0, 1, 2, 5)], "book string, n long")
    parts = spark.createDataFrame([("b", 0, " x "), ("b", 1, " "), ("b", 5, "y")], "book string, n long, text string")
    got = {r.piece: r.content for r in stages.assembled(spine, parts, "book", "n", "text", "[%d]", 2).collect()}
    assert got == {-1: "[-1]", 0: "x\n\n[1]", 1: "[2]", 2: "y"}


def test_tracked_cuts_open_as_a_document(spark):
    hostile = 'a <b> & "c"\x00\x0b d\nnext'
    runs = spark.createDataFrame([("d", 0, hostile)], "doc string, start int, text string")
    spans = spark.createDataFrame([("d", 2, 8, 1)], "doc string, start int, stop int, category int")
    marked = editing.with_tracked_cuts(editing.cut_runs(runs, spans, "doc"), "doc", {1: '<A & "B">'}, "2026-01-01T00:00:00Z")
    (_, _, found), = texts.paragraphs_of(texts.packaged(marked, "doc").first().content)
    assert [(t, deleted) for t, _, _, deleted, _ in found] == [("a ", False), ("<b> & ", True), ('"c" d\nnext', False)]


def test_separators_and_stars_survive_in_word():
    kinds = {"separateur": ("S", False, False), "texte": ("T", False, False)}
    rows = texts.paragraphs_of(texts.word_bytes([("separateur", "***"), ("texte", "a *b* c * d"), ("texte", "")], kinds))
    assert ["".join(t for t, *_ in runs) for _, _, runs in rows] == ["***", "a b c * d", ""]
    assert [t for t, _, italic, *_ in rows[1][2] if italic] == ["b"]


def test_files_are_whole_and_sidecars_last(spark, tmp_path):
    rows = [(f"f{i}.txt", "x" * i, None if i % 2 else "{}") for i in range(6)]
    assert write_files(spark.createDataFrame(rows, "name string, content string, sidecar string"), f"file://{tmp_path}/out") == (6, 15)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted([r[0] for r in rows] + [f"{r[0]}.json" for r in rows if r[2]])
    assert not list((tmp_path / "out").glob(".*.tmp"))
    assert write_files(spark.createDataFrame([], "name string, content string, sidecar string"), f"file://{tmp_path}/none") == (0, 0)
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_blank_replies_and_refusals(spark):
    class Refused(Exception):
        def __init__(self, code):
            super().__init__(str(code))
            self.code = code

    def client(prompt):
        if prompt.isdigit():
            raise Refused(int(prompt))
        return "" if prompt == "blank" else prompt

    units = spark.createDataFrame([(1, "a"), (2, "blank"), (3, "403"), (4, "500")], "n int, t string")
    got = {r.n: (r.output, r.status, r.tries) for r in model.edited(units, ["n"], "t", client, first=0.0).collect()}
    assert got == {1: ("a", "termine", 1), 2: ("blank", "termine", 2), 3: (None, "echec", 1), 4: (None, "echec", 4)}


def test_stores_stages_and_pages(spark):
    kv = spark.createDataFrame([("a/1", "x"), ("b/1", "y")], "key string, value string")
    more = spark.createDataFrame([("a/1", "z"), ("a/2", "w")], "key string, value string")
    assert {(r.key, r.value) for r in stages.prefixed(stages.imported(kv, more), "a/").collect()} == {("a/1", "x"), ("a/2", "w")}
    made = spark.createDataFrame([("b", "x"), ("b", "z"), ("c", "x"), ("c", "y"), ("c", "z"), ("d", "q")], "book string, stage string")
    assert {r.book: (r.ready, r.missing) for r in stages.first_missing(made, "book", "stage", ["x", "y", "z"]).collect()} == {"b": (1, "y"), "c": (3, None), "d": (0, "x")}
    with pytest.raises(ValueError, match="at least one page"):
        lines.first_pages(kv, 0)
    stored = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "A")], "k string, role string")
    cast = spark.createDataFrame([("s", "B"), ("s", "B"), ("u", "A")], "k string, role string")
    assert {r.k: r.roles for r in reading.restored_roles(stored, cast, "k", "role").collect()} == {"s": ["B"], "t": None}


def test_name_lists(spark):
    rows = [(["B", "A"],), ([],)]
    assert found(spark, X.role_key(F.col("p")), rows, "p array<string>") == ["A+B", ""]
    assert found(spark, X.listed(F.col("p")), rows, "p array<string>") == ["|B|A|", ""]
    assert found(spark, X.unlisted(X.listed(F.col("p"))), rows, "p array<string>") == [["B", "A"], []]


def test_corrected_recitation(spark):
    ranked = spark.createDataFrame([("k", 1, 30, 40.0), ("k", 2, 20, 95.0), ("k", 3, 10, 95.0)], "k string, rank int, at long, score double")
    plain = rehearsal.progress(ranked, ["k"], "at", "score", F.lit(40)).first()
    mended = rehearsal.progress(rehearsal.newest_corrected(ranked), ["k"], "at", "score", F.lit(40), "corrected").first()
    assert (plain.streak, plain.status) == (0, "en_cours") and (mended.streak, mended.status, mended.last_score) == (3, "maitrisee", 40.0)


def test_words_left(spark):
    rows = [
        ("d", 0, "SCÈNE 1", True, False), ("d", 8, "JAN et ANNE", True, False), ("d", 20, "un deux trois", False, False),
        ("d", 34, "il sort", False, True), ("d", 42, "TOUS", True, False), ("d", 47, "quatre", False, False)
    ]
    paragraphs = spark.createDataFrame(rows, "doc string, start int, text string, bold boolean, italic boolean")
    spans = spark.createDataFrame([("d", 23, 28, 1)], "doc string, start int, stop int, category int")
    got = editing.words_left(paragraphs, spans, "doc", F.col("text").startswith("SCÈNE")).collect()
    assert {(r.scene, r.role): r.words for r in got} == {("SCÈNE 1", "JAN"): 2, ("SCÈNE 1", "ANNE"): 2}


def test_draws_of_one_key_in_many_parts(spark):
    rows = [("k", i, float(w)) for i, w in enumerate([3, 0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5] * 200)] + [("l", 7, 2.0), (None, 1, 1.0), (None, 2, 3.0), ("none", 1, 0.0)]
    weighted = spark.createDataFrame(rows, "part string, id int, weight double").repartition(7)
    for point in (0.0, 0.37, 0.5, 0.999999, 1.0):
        got = {r.part: r.id for r in rehearsal.drawn(weighted, ["part"], "id", "weight", F.lit(point)).collect()}
        expected = {}
        for key in ("k", "l", None):
            own = [(i, w) for k, i, w in rows if k == key and w > 0]
            total, upto = sum(w for _, w in own), 0.0
            for i, w in own:
                upto += w
                if upto > point * total or i == own[-1][0]:
                    expected[key] = i
                    break
        assert got == expected


def test_heat_is_by_actor_and_the_most_of_all(spark):
    cells = spark.createDataFrame(
        [(1, "ACTE I Scène 1", "a", 10), (1, "ACTE I Scène 1", "b", 30), (2, "ACTE I Scène 2", "c", 20), (3, "ACTE II Scène 1", "a", 0), (3, "ACTE II Scène 1", "x", 99)],
        "place int, scene string, role string, words long"
    )
    cast = spark.createDataFrame([("Ann", "a", 0), ("Ann", "c", 1), ("Ben", "b", 2), ("Old", "a", -1)], "actor string, role string, place int")
    got = {(r.actor, r.place): (r.words, r.roles, r.heat, r.background, r.colour, r.quick) for r in balance.heat(cells, cast, "place", "scene").collect()}
    assert got == {
        ("Ann", 1): (10, "A 10", 0.333333, "rgb(180,211,190)", "#222", True), ("Ben", 1): (30, "B 30", 1.0, "rgb(30,125,60)", "#fff", False),
        ("Ann", 2): (20, "C 20", 0.666667, "rgb(105,168,125)", "#fff", False), ("Ann", 3): (0, "A 0", 0.0, "rgb(255,255,255)", "#222", False)
    }


def test_presence_as_csv_is_read_back(spark):
    names = ["JAN", "LES GENDARMES, EN CHŒUR", 'DIT "X"']
    said = spark.createDataFrame([(1, 'I, "one"', names[0]), (1, 'I, "one"', names[1]), (2, "II", names[2])], "unit int, label string, role string")
    lines = balance.presence_csv(said, "unit", F.col("label"), "role", names).orderBy(F.asc_nulls_first("unit")).collect()
    assert list(csv.reader([r.line for r in lines])) == [["Unite", *names], ['I, "one"', "X", "X", ""], ["II", "", "", "X"]]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_alignment_by_bits_equals_the_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    steps, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append("correct")
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            steps.append("oublie")
            i += 1
        else:
            steps.append("ajoute")
            j += 1
    merged = []
    while steps:
        if len(steps) > 1 and {steps[0], steps[1]} == {"oublie", "ajoute"}:
            merged.append("substitue")
            steps = steps[2:]
        else:
            merged.append(steps.pop(0))
    assert [s for s, _, _ in speech.aligned(a, b)] == merged


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_stores_are_merged_where_they_lie(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = spark.range(0, 400).selectExpr("id AS user_id", "if(id % 3 = 0, 'maitrisee', 'en_cours') AS status", "id * 2 AS checked_at")
        two = spark.range(200, 600).selectExpr("id AS user_id", "'a_reviser' AS status", "id + 300 AS checked_at")
        plain = rehearsal.merged_progress(one, two, ["user_id"])
        a, b = store.stored(one, ["user_id"]), store.stored(two, ["user_id"])
        near = rehearsal.merged_progress(a.rows(), b.rows(), ["user_id"])
        assert exchanges(plain) > 0 and exchanges(near) == 0
        expected = sorted(plain.collect())
        assert sorted(near.collect()) == expected
        # a merge in place: only the rows that come in are shuffled
        assert a.merge(two, rehearsal.merged_progress) and sorted(a.rows().collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_merge_rewrites_the_touched_parts_alone(spark):
    kept = store.stored(spark.range(1000).selectExpr("id AS k", "id AS v"), ["k"], parts=8)
    files = lambda: {r.f for r in spark.table(kept.name).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    incoming = spark.createDataFrame([(5, -1), (10**6, -2)], "k long, v long")
    parts = kept.merge(incoming, store.replaced)
    assert 1 <= len(parts) <= 2 and {f for f in before if not any(f"__part={p}/" in f for p in parts)} == {f for f in files() if not any(f"__part={p}/" in f for p in parts)}
    rows = {r.k: r.v for r in kept.rows().collect()}
    assert len(rows) == 1001 and rows[5] == -1 and rows[10**6] == -2 and rows[6] == 6
    kept.merge(spark.createDataFrame([(5, 99), (7, None), (10**7, 3)], "k long, v long"), store.kept)
    rows = {r.k: r.v for r in kept.rows().collect()}
    assert rows[5] == -1 and rows[7] == 7 and rows[10**7] == 3 and kept.merge(incoming.limit(0), store.kept) == []


def test_tries_wait_longer_each_time_and_drift_apart(spark, tmp_path):
    assert [stages.waited(n, chance=0.0) for n in (1, 2, 3, 4, 5, 9)] == [5.0, 10.0, 20.0, 40.0, 60.0, 60.0] and stages.waited(9, chance=1.0) == 75.0
    assert all(5.0 <= stages.waited(1) <= 6.25 for _ in range(50)) and len({stages.waited(5) for _ in range(50)}) > 1

    class Busy(Exception):
        code = 503

    def client(prompt):
        if prompt != "well":
            raise Busy if prompt == "busy" else ValueError
        return prompt

    def pause(seconds):
        with open(tmp_path / "waits", "a") as out:
            print(seconds, file=out)

    units = spark.createDataFrame([(1, "busy"), (2, "well")], "n int, prompt string").coalesce(1)
    got = {r.n: (r.answer, r.tries) for r in stages.called(units, ["n"], "prompt", client, tries=3, pause=pause).collect()}
    waits = [float(x) for x in (tmp_path / "waits").read_text().split()]
    assert got == {1: (None, 3), 2: ("well", 1)} and len(waits) == 2 and 5 <= waits[0] <= 6.25 and 10 <= waits[1] <= 12.5
