import itertools
import json
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstage.functions import automaton, images, text
from quillstage.operators import editing, intervals, quality, reading, search, stages, structure
from quillstage.operators.lines import lines_of
from quillstage.plans import structures
from quillstage.sources import remote, texts
from tests.conftest import same_rows


def test_junction_replies(spark):
    good = f"{editing.LEFT}\nabcde\n{editing.LEFT_END}x{editing.RIGHT}fghij{editing.RIGHT_END}"
    rows = spark.createDataFrame([(good,), ("no",), (good.replace("abcde", "a"),)], "r string")
    out = [tuple(r.k) for r in rows.select(editing.junction_kept(F.col("r"), F.lit("ABCDE"), F.lit("FGHIJ"), quality.junction_findings).alias("k")).collect()]
    assert out == [("abcde", "fghij"), ("ABCDE", "FGHIJ"), ("ABCDE", "FGHIJ")]


def test_annotations(spark):
    known, unknown = editing.annotations(spark.createDataFrame([("d", "1|note\n 2 | titre_acte \n3|what\nnone")], "doc string, r string"), "doc", "r")
    assert {(r.line_no, r.role) for r in known.collect()} == {(1, "note"), (2, "titre_acte")} and [r.role for r in unknown.collect()] == ["what"]
    lines = lines_of(spark.createDataFrame([("d", "a\n\nb\nc")], "doc string, t string"), "doc", "t")
    assert editing.annotation_prompt(lines, "doc", 3).first().prompt == "0|a\n2|b"


def test_override_takes_the_first_line(spark):
    typed = spark.createDataFrame([("d", i, 0, "x", "x", "texte") for i in range(2)], "doc string, line_no int, part int, raw string, text string, type string")
    out = structure.override(typed, spark.createDataFrame([("d", "x", "note")], "doc string, raw string, role string"), "doc")
    assert [r.type for r in out.orderBy("line_no").collect()] == ["note", "texte"]


def test_asides_go_back(spark):
    row = spark.range(1).select(
        editing.asides_marked(
            F.lit("un deux"),
            F.array(F.struct(F.lit(1).alias("before_word"), F.lit("bas").alias("text")), F.struct(F.lit(2).alias("before_word"), F.lit("sort").alias("text")))
        ).alias("t")
    ).first()
    assert row.t == "un *bas* deux *sort*"


def test_asides_of_a_long_text_go_back_in_time(spark):
    n = 4_000
    rows = spark.range(40).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("t"))
    words = F.size(text.tokens(F.col("t")))
    aside = lambda at, t: F.struct(at.cast("int").alias("before_word"), F.lit(t).alias("text"))
    notes = F.array(aside(words, "z"), aside(F.lit(1), "a"), aside(F.lit(1), "b"), aside(F.lit(0), "c"), aside(words + 1, "no"), aside(F.lit(-1), "no"), aside(F.lit(2), None))
    began = time.monotonic()
    out = [r.m for r in rows.repartition(4).select(editing.asides_marked(F.col("t"), notes).alias("m")).collect()]
    assert time.monotonic() - began < 30
    assert set(out) == {" ".join(["*c*", "w1", "*a*", "*b*", *(f"w{i}" for i in range(2, n + 1)), "*z*"])} and len(out) == 40


def test_edited_from_paragraphs(spark):
    rows = [
        ("d", 0, "ACTE I, SCÈNE 2", 1.0, 0.0), ("d", 1, "JAN", 1.0, 0.0), ("d", 2, "Un.", 0.0, 0.0), ("d", 3, "Deux.", 0.0, 0.1),
        ("d", 4, "Il sort.", 0.0, 1.0), ("d", 5, " ", 0.0, 0.0)
    ]
    out = editing.edited_from_paragraphs(spark.createDataFrame(rows, "doc string, paragraph int, text string, bold_share double, italic_share double"), "doc")
    assert [r.line for r in out.orderBy("position").collect()] == ["**SCÈNE 2**", "**JAN**", "Un.\nDeux.", "*Il sort.*"]
    assert [r.front for r in editing.front_split(out, "doc").orderBy("position").collect()] == [False] * 4


def test_tracked_cuts(spark):
    runs = spark.createDataFrame([("d", 0, "abcdef"), ("d", 6, "gh")], "doc string, start int, text string")
    pieces = editing.cut_runs(runs, spark.createDataFrame([("d", 2, 4, 1), ("d", 5, 7, 2)], "doc string, start int, stop int, category int"), "doc")
    assert [(r.text, r.category) for r in pieces.orderBy("start").collect()] == [("ab", None), ("cd", 1), ("e", None), ("f", 2), ("g", 2), ("h", None)]
    xml = "".join(r.xml for r in editing.with_tracked_cuts(pieces, "doc", {1: "A", 2: "B"}, "2026-01-01T00:00:00Z").orderBy("n").collect())
    assert xml.count("<w:del ") == 3 and 'w:author="A"' in xml and "<w:delText" in xml


def test_reports(spark):
    labels = spark.createDataFrame(
        [("d", "ACTE I", "titre_acte", "certaine", "lexique acte", 1, 0)],
        "doc string, label string, type string, confidence string, reason string, occurrences long, speech_after long"
    )
    assert editing.classification_report(labels, "doc").first().report.endswith("1 labels, 0 uncertain")
    numbered = structure.numbering(
        spark.createDataFrame(
            [("d", x, 1, i) for i, x in enumerate(("I", "II", "I. bis", "1"))][:3] + [("e", x, 1, i) for i, x in enumerate(("I", "II", "III"))],
            "doc string, label string, occurrences long, first_line int"
        ),
        "doc"
    )
    assert [r.doc for r in editing.restarted_numbering(numbered, "doc").collect()] == ["d"]
    findings = spark.createDataFrame([("b", "LACUNE", 2, "x"), ("b", "AJOUT", 1, "y")], "book string, category string, block int, detail string")
    assert quality.report(findings, "book").first().report == "[AJOUT] bloc 1 : y\n[LACUNE] bloc 2 : x"
    assert {r.piece: r.report for r in quality.report(findings, "book", 2).collect()} == {0: "[AJOUT] bloc 1 : y", 1: "[LACUNE] bloc 2 : x"}


def test_pages_of_speeches_without_text_and_with_many_lines(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "\n".join(f"line {i}" for i in range(30_000)))]
    out = reading.speech_pages(spark.createDataFrame(rows, "id int, text string"), ["id"], "text", 80).collect()
    pages = {i: [r.text for r in sorted(out, key=lambda r: r.page) if r.id == i] for i, _ in rows}
    assert pages[1] == [] and pages[2] == [""] and pages[3] == ["\n\n"]
    assert len(pages[4]) > 2000 and "\n".join(pages[4]) == rows[3][1]


def test_reading(spark):
    elements = spark.createDataFrame(
        [
            ("p", 0, "A", "1", False, 0, "replique", "x", ["JAN"]), ("p", 0, "A", "1", False, 1, "didascalie", "y", None),
            ("p", 1, "A", "1", True, 0, "replique", "z", ["*"])
        ],
        "piece string, unit_pos int, act string, scene string, implicit boolean, elem_pos int, type string, text string, people array<string>"
    )
    flat = reading.flattened(elements)
    assert [r.kind for r in flat.orderBy("position").collect()] == ["scene", "replique", "didascalie", "replique"]
    assert {r.scene for r in reading.with_scene(flat).collect()} == {"A - 1"}
    assert [r.target for r in reading.off_scene(flat).orderBy("position").collect()] == [1, 1, 2, 3]
    assert reading.off_scene(flat, False).orderBy("position").first().target is None
    pages = reading.speech_pages(spark.createDataFrame([(1, "\n".join(["x" * 30] * 5))], "id int, text string"), ["id"], "text", 80)
    assert [r.text.count("\n") + 1 for r in pages.orderBy("page").collect()] == [2, 2, 1]
    groups = reading.page_groups(spark.createDataFrame([("d", i, x) for i, x in enumerate("aabba")], "doc string, place int, id string"), "doc", "place", "id")
    assert sorted((r.first_place, r.last_place) for r in groups.collect()) == [(0, 1), (2, 3), (4, 4)]
    people = spark.createDataFrame([("JAN",), ("MARTHA",)], "name string")
    slots = spark.createDataFrame([("JAN", 1)], "name string, slot int")
    assert [r.name for r in reading.unassigned(people, slots, "name").collect()] == ["MARTHA"] and reading.roles_by_slot(slots, "name", "slot").first().roles == ["JAN"]
    assert [r.hue for r in reading.hues(people, "name").collect()] == [0.0, 180.0]
    assert spark.range(1).select(
        reading.reader_label(F.lit("JAN"), F.lit("Ann")).alias("l"), reading.piece_slug(F.lit("Le Malentendu")).alias("s")
    ).first()[:] == ("Jan (Ann)", "le-malentendu")
    assert reading.latest(spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "channel string, at int, text string"), "channel", "at").first().text == "b"


def test_sessions_and_settings(spark):
    rows = [("s", 1, "mode", "trous"), ("s", 2, "reveal", "r1"), ("s", 3, "reveal", "r2"), ("s", 4, "hide", "r1"), ("s", 5, "draw", None), ("s", 6, "go", "u2")]
    r = reading.session_state(spark.createDataFrame(rows, "id string, n int, action string, argument string"), "id", "n").first()
    assert (r.mode, r.revealed, r.draws, r.place) == ("trous", ["r2"], 1, "u2")
    rows = [
        ("s", 1, "reveal", "a"), ("s", 2, "reveal", "b"), ("s", 3, "reveal", "a"), ("s", 4, "hide", "b"), ("s", 5, "reveal", "c"),
        ("s", 6, "reveal", "b"), ("t", 1, "reveal", "a"), ("t", 2, "mask_all", None), ("u", 1, "draw", None)
    ]
    got = {r.id: r.revealed for r in reading.session_state(spark.createDataFrame(rows, "id string, n int, action string, argument string"), "id", "n").collect()}
    assert got == {"s": ["a", "c", "b"], "t": [], "u": []}
    s = spark.createDataFrame([('{"a": 3, "b": "x"}',), (None,)], "t string").select(reading.settings(F.col("t"), {"a": 1, "b": 2}).alias("s")).collect()
    assert [tuple(x.s) for x in s] == [(3, 2), (1, 2)]
    changed = spark.range(1).select(
        reading.roles_changed(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B"), F.lit("C")), F.array(F.lit("A"), F.lit("B"))).alias("r")
    ).first().r
    assert changed == ["B", "C"]


def test_remote_folder(spark):
    def fetch(url):
        if "alt=media" in url:
            return (200, '{"schema":"repetition/2"}') if "/1?" in url else (403, "")
        more = "pageToken" not in url
        return 200, json.dumps(
            {"files": [{"id": "1" if more else "2", "name": "a_REPET.json"}, {"id": "x", "name": "REPET.txt"}]} | ({"nextPageToken": "t"} if more else {})
        )

    files = remote.list_plays(spark, "http://store", "f", fetch)
    assert [r.id for r in files.orderBy("id").collect()] == ["1", "2"]
    assert {r.id: r.code for r in remote.download(files, "http://store", fetch).collect()} == {"1": 200, "2": 403}


def test_ink(spark):
    rows = spark.createDataFrame([(b"\xff" * 999 + b"\x00",), (None,)], "g binary").select(images.ink_share("g").alias("i")).collect()
    assert [r.i for r in rows] == [0.001, 1.0]
    image, tried = images.rendered(lambda dpi: b"x" * (dpi * 100_000), 300)
    assert tried == [300, 225, 168] and len(image) <= images.MOST_BYTES


def spans_of(rng, n, size, wide):
    out = []
    for _ in range(n):
        a = rng.randrange(size)
        out.append((a, a + rng.randint(0, wide), rng.randint(1, 4)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_intervals_equal_brute_force(spark, seed):
    rng, docs = random.Random(seed), {}
    for d in range(6):
        docs[d] = spans_of(rng, rng.randint(0, 25), 60, rng.choice([3, 20, 60]))
    spans = spark.createDataFrame([(d, *s) for d, x in docs.items() for s in x], "doc int, start long, stop long, category int")
    # overlay: at every place the highest category that covers it, equal neighbours together
    got = {(r.doc, r.start, r.stop, r.category) for r in intervals.overlaid(spans.withColumn("priority", F.col("category")), "doc").collect()}
    expected = set()
    for d, own in docs.items():
        tops = [max((c for a, b, c in own if a <= i < b), default=None) for i in range(140)]
        for c, run in itertools.groupby(range(140), lambda i: tops[i]):
            run = list(run)
            if c is not None:
                expected.add((d, run[0], run[-1] + 1, c))
    assert got == expected
    # points, and rows from one place to another, by the first span that holds them
    points = [(d, i) for d in docs for i in range(0, 130, 3)]
    held = {(r.doc, r.at): r.category for r in intervals.category_at(spark.createDataFrame(points + points[:5], "doc int, at long"), spans, "doc", "at").collect()}
    assert held == {(d, i): min(((a, b, c) for a, b, c in docs[d] if a <= i < b), default=(0, 0, 0))[2] for d, i in points}
    ranges = [(d, a, a + rng.randint(1, 9), "x") for d in docs for a in range(0, 100, 7)]
    rows = intervals.first_holder(spark.createDataFrame(ranges, "doc int, low int, high int, own string"), spans, "doc", "low", "high")
    assert rows.columns == ["doc", "low", "high", "own", "category"]
    assert {(r.doc, r.low, r.high): r.category for r in rows.collect()} == {(d, x, y): min(((a, b, c) for a, b, c in docs[d] if a <= x and y <= b), default=(0, 0, None))[2] for d, x, y, _ in ranges}
    # runs cut at all borders
    runs = [(d, a, "".join(rng.choices("aé𝄞 ", k=n)), f"k{a}") for d in docs for a, n in ((0, 17), (17, 0), (17, 30), (50, 40))]
    pieces = editing.cut_runs(spark.createDataFrame(runs, "doc int, start int, text string, own string"), spans, "doc", ("own",)).collect()
    expected = set()
    for d, a, text, own in runs:
        ends = sorted({a, a + len(text), *(x for s in docs[d] for x in s[:2] if a < x < a + len(text))})
        for x, y in itertools.pairwise(ends):
            expected.add((d, x, text[x - a : y - a], min(((s, e, c) for s, e, c in docs[d] if s <= x and y <= e), default=(0, 0, None))[2], own))
    assert {tuple(r) for r in pieces} == expected and len(pieces) == len(expected)


def test_a_document_of_very_many_spans(spark):
    n = 200_000
    spans = spark.range(n).select(F.lit("d").alias("doc"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 8).alias("stop"), (F.col("id") % 3).alias("category"))
    over = intervals.overlaid(spans.withColumn("priority", F.col("category")), "doc").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars")).first()
    assert over.chars == 5 * n + 3 and n <= over.n <= 2 * n
    points = spark.range(n).select(F.lit("d").alias("doc"), (F.col("id") * 5 + 1).alias("at"))
    at = intervals.category_at(points, spans, "doc", "at")
    # three before its end a span still holds the place, and it is the first
    assert at.filter(F.col("category") != F.when(F.col("at") == 1, 0).otherwise(((F.col("at") - 1) / 5 - 1) % 3)).count() == 0
    text = spark.createDataFrame([("d", 0, "abcde" * n)], "doc string, start int, text string")
    pieces = editing.cut_runs(text, spans, "doc")
    assert pieces.count() == 2 * n - 1 and pieces.agg(F.sum(F.length("text"))).first()[0] == 5 * n
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_runs_without_a_document_are_those_of_one(spark):
    runs = spark.createDataFrame([(None, 0, "abcdef"), ("d", 0, "xyz")], "doc string, start int, text string")
    spans = spark.createDataFrame([(None, 2, 4, 1), ("d", 0, 9, 2)], "doc string, start int, stop int, category int")
    got = {(r.doc, r.start, r.text, r.category) for r in editing.cut_runs(runs, spans, "doc").collect()}
    assert got == {(None, 0, "ab", None), (None, 2, "cd", 1), (None, 4, "ef", None), ("d", 0, "xyz", 2)}


def test_runs_are_cut_without_python(spark):
    rng = random.Random(4)
    docs = [(d, "".join(rng.choices("aé\n\u2028𝄞\r", k=n))) for d, n in enumerate([1, 255, 256, 257, 2000])]
    spans = [(d, *sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))), k) for d, t in docs for k in range(40)]
    runs = spark.createDataFrame(docs, "doc int, text string").select("doc", F.lit(7).alias("start"), "text")
    cut = editing.cut_runs(runs, spark.createDataFrame([(d, a + 7, b + 7, k) for d, a, b, k in spans], "doc int, start int, stop int, category int"), "doc")
    # batches of whole texts in Python workers are what memory grew with
    assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc, r.start - 7, r.text) for r in cut.collect())
    borders = {d: sorted({0, len(t), *(x for e, a, b, _ in spans if e == d for x in (a, b))}) for d, t in docs}
    assert got == sorted((d, a, t[a:b]) for d, t in docs for a, b in itertools.pairwise(borders[d]))


def test_categories_without_end_are_an_error(spark):
    rows = [("d", i, i + 2, i, i) for i in range(100)]
    spans = spark.createDataFrame(rows, "doc string, start int, stop int, category int, priority int")
    assert intervals.overlaid(spans, "doc", sums=2).count() == 100
    with pytest.raises(Exception, match="more than 62 categories"):
        intervals.overlaid(spans, "doc").count()


def brute_anchor(text, begin, end):
    def places(a):
        return [i for i in range(len(text)) if a and text.startswith(a, i)]

    for name, a in (("begin", begin),) if end is None else (("begin", begin), ("end", end)):
        if len(places(a)) != 1:
            return None, None, f"{name} not {'found' if not places(a) else 'unique'}"
    at, last = places(begin)[0], places(begin if end is None else end)[0] + len(begin if end is None else end)
    return (None, None, "ends before it begins") if last <= at else (at, last, None)


def test_many_anchors_in_one_pass(spark):
    rng, docs, anchors = random.Random(3), [], []
    for d in range(4):
        text = "".join(rng.choices("abcé ", k=400 * d))
        docs.append((d, text))
        for k in range(300):
            cut = lambda: text[(i := rng.randint(0, max(0, len(text) - 1))) : i + rng.randint(0, 7)]
            anchors.append((d, k, cut() or "zz", rng.choice([None, cut(), "é a"])))
    docs.append((9, None))
    anchors += [(9, 0, "a", None), (77, 0, "a", None)]
    found = intervals.located(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(anchors, "doc int, number int, begin string, end string"), "doc")
    got = {(r.doc, r.number): (r.start, r.stop, r.fault) for r in found.collect()}
    by = dict(docs)
    assert got == {(d, k): brute_anchor(by[d] or "", b, e) for d, k, b, e in anchors if d in by}
    faults = {f.split()[-1] if f else None for _, _, f in got.values()}
    assert {None, "unique", "found", "begins"} <= faults


def test_anchors_of_odd_texts_equal_the_sql(spark, tmp_path):
    texts = [None, "", " ", "abcd" * 9, "aaaaaa bbbbbb", "é𝄞\x00\n" * 5 + "z", "e\u0301 e\u0301 e\u0301", *("abcdefghijklmnop"[:n] for n in range(1, 16)), "ab" * 3 + "x" * 20 + "ababab"]
    ids = [*range(len(texts)), 3, 3, None, None]  # rows without an id or with that of another text are rows like others
    rows = [(i, t) for i, t in zip(ids, texts + ["another text of the same id", texts[3], "a text without id", None], strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(structures.anchors(spark, str(tmp_path)), duck, structures.ANCHORS)


def test_an_anchor_by_columns_equals_brute_force(spark):
    rng, rows = random.Random(5), []
    for k in range(400):
        text = "".join(rng.choices("abé𝄞", k=rng.randint(0, 40)))
        rows.append((k, text, *("".join(rng.choices("abé𝄞", k=rng.randint(1, 4))) for _ in range(2))))
    t, b, e = F.col("t"), F.col("b"), F.col("e")
    got = spark.createDataFrame(rows, "k int, t string, b string, e string").select("k", intervals.anchored(t, b, e).alias("two"), intervals.anchored(t, b).alias("one"))
    assert {r.k: (tuple(r.two), tuple(r.one)) for r in got.collect()} == {k: (brute_anchor(t, b, e), brute_anchor(t, b, None)) for k, t, b, e in rows}


def test_few_anchors_need_no_automaton(monkeypatch):
    rng = random.Random(9)
    for most in (0, 500):
        monkeypatch.setattr(intervals, "MOST_ALONE", most)
        for _ in range(100):
            text = "".join(rng.choices("ab", k=rng.randint(0, 30)))
            wanted = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(9)})
            places = {x: [i for i in range(len(text)) if text.startswith(x, i)] for x in wanted}
            assert intervals._ends(text, wanted) == [(places[x][0] + len(x) if len(places[x]) == 1 else None) if places[x] else 0 for x in wanted]
    monkeypatch.setattr(intervals, "Automaton", None)
    assert intervals._faults("aba", [{"number": 1, "begin": "b", "end": None}]) == [(1, 1, 2, None)]


def test_an_automaton_finds_every_place():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choices("ab", k=rng.randint(0, 40)))
        patterns = list({"".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(8)})
        got = sorted((patterns[k], end) for k, end in automaton.Automaton(patterns).places(text))
        assert got == sorted((p, i + len(p)) for p in patterns if p for i in range(len(text)) if text.startswith(p, i))


def test_a_long_book_is_folded_in_little_memory():
    import tracemalloc

    def frames():
        for k in range(400):
            yield pd.DataFrame({"book": ["b"] * 4, "n": range(4 * k, 4 * k + 4), "text": [f"first {i}\n" + "x" * 50_000 + f"\nlast {i}" for i in range(4 * k, 4 * k + 4)]})

    tracemalloc.start()
    n = size = 0
    for frame in stages.folded_rows(frames(), "book", "text", lambda a, b: (a + "!", "?" + b), 1):
        for t, i in zip(frame["text"], frame["n"], strict=True):
            assert t.startswith(f"?first {i}" if i else "first 0") and t.endswith(f"last {i}!" if i < 1599 else "last 1599")
            n, size = n + 1, size + len(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1600 and size > 80_000_000 and peak < 4_000_000


def test_folds_over_ends_of_batches_and_books(spark):
    rows = [(b, n, f"{b}{n}\nx") for b in ("a", "b", None) for n in range(5)] + [("c", 0, None)]
    blocks = spark.createDataFrame(rows, "book string, n int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    results = []
    for size in (1, 2, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        folded = stages.junctions_folded(blocks, "book", "n", "text", lambda a, b: (a + "!", "?" + b), 1)
        results.append(sorted((r.book or "", r.n, r.text) for r in folded.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert results[0] == results[1] == results[2]
    assert results[2][0] == ("", 0, "None0\nx!") and ("b", 4, "?b4\nx") in results[2] and ("c", 0, "") in results[2] and ("a", 2, "?a2\nx!") in results[2]


def test_documents_are_streamed_into_their_archives():
    import tracemalloc

    def frames():
        for k in range(300):
            yield pd.DataFrame({"doc": ["d" if k < 299 else "e"] * 100, "text": [f"line {k} {i} " + "word " * 200 for i in range(100)]})

    tracemalloc.start()
    made = pd.concat(texts.package_rows(frames(), "doc", lambda f: [texts.word_line("texte", t, texts.STYLES) for t in f["text"]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made["doc"].tolist() == ["d", "e"] and peak < 6_000_000
    back = texts.paragraphs_of(made["content"].iloc[0])
    assert len(list(back)) == 29_900


def test_search_equals_a_scan(spark):
    rng = random.Random(8)
    words = ["été", "Ete", "mer", "la", "l'homme", "—", "à", "Où", "est", "x", "YZ", "𝄞"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(300)] + [(300, None), (301, "mer " * 400 + "fin rare")]
    said = spark.createDataFrame(rows, "id int, text string").repartition(3)
    index = search.indexed(said, ["id"])
    needles = ["la", "la mer", "ETE", "a", "", "est x", "où est yz", "𝄞", "𝄞 la", "l'homme est", "fin rare", "not there", "mer  la", "x!"]
    asked = spark.createDataFrame([(n,) for n in [*needles, "la"]], "needle string")
    got = sorted((r.needle, r.id) for r in search.found(index, asked).collect())
    plain = {r.id: r.t or "" for r in said.select("id", search.searchable(F.col("text")).alias("t")).collect()}
    key = {r.needle: r.n for r in asked.select("needle", search.searchable(F.col("needle")).alias("n")).collect()}
    assert got == sorted((n, k) for n in needles if len(key[n]) >= 2 for k, t in plain.items() if key[n] in t)
    assert ("fin rare", 301) in got and index.lists.filter("size(texts) > 1 and texts <> array_sort(texts)").count() == 0


def test_many_needles_take_one_scan(spark, monkeypatch):
    rng = random.Random(5)
    words = ["été", "Ete", "mer", "la", "l'homme", "—", "à", "Où", "est", "x", "YZ", "𝄞"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(200)] + [(200, None), (201, "mer " * 300 + "fin rare"), (202, "a" * 600)]
    said = spark.createDataFrame(rows, "id int, text string").repartition(3)
    plain = {r.id: r.t or "" for r in said.select("id", search.searchable(F.col("text")).alias("t")).collect()}
    cuts = {t[i : i + n] for t in plain.values() if t for n in (1, 2, 3, 5, 12, 40, 300) for i in [rng.randint(0, len(t))]} | {"", "not there", "a" * 7, "mer  mer", "x!"}
    asked = spark.createDataFrame([(n,) for n in [*cuts, "la"]], "needle string")
    key = {r.needle: r.n for r in asked.select("needle", search.searchable(F.col("needle")).alias("n")).collect()}
    expected = sorted((n, k) for n in cuts | {"la"} if len(key[n]) >= 2 for k, t in plain.items() if key[n] in t)
    index = search.indexed(said, ["id"])
    assert sorted((r.needle, r.id) for r in search.found(index, asked).collect()) == expected
    # the needles times the lists of texts are not made: no list is written at all
    assert "lists" not in vars(index)
    monkeypatch.setattr(search, "MOST_SCANNED", 10)
    assert sorted((r.needle, r.id) for r in search.found(index, asked).collect()) == expected
