"""Structure and dialogue of a small edited play, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from quillstage.operators import dialogue, intervals, lines, quality, reading, stages, structure
from quillstage.plans import plays
from quillstage.sources import play, play_source, texts
from tests.conftest import SF

PLAY = """**LE PUITS**

**PERSONNAGES**

Jan, voyageur
Martha, sa sœur


**ACTE I**

*Une auberge.*

**JAN (bas)**

Bonsoir. *Il s'assied.* Il fait froid.
Très froid.

**MARTHA**

*Elle rit.*

Vous trouvez ?

***

**TOUS.**

Ah !

**SCÈNE 2**

**JAN, à part.** Bonsoir. Il fait froid.

Rien."""


@pytest.fixture(scope="module")
def typed(spark):
    rows = lines.lines_of(spark.createDataFrame([("p", PLAY)], "piece string, text string"), "piece", "text").cache()
    labels = structure.classify_labels(rows, "piece").cache()
    cast = structure.cast_of(rows, "piece").cache()
    return rows, labels, cast, structure.classify_lines(rows, labels, "piece", cast).cache()


def test_label_rules(typed):
    kinds = {r.label: (r.type, r.confidence) for r in typed[1].collect()}
    assert kinds["ACTE I"] == ("titre_acte", "certaine") and kinds["SCENE 2"] == ("titre_scene", "certaine")
    assert kinds["PERSONNAGES"] == ("distribution", "certaine") and kinds["LE PUITS"] == ("titre_oeuvre", "deduite")
    assert kinds["MARTHA"] == ("personnage", "certaine") and kinds["TOUS"] == ("personnage", "probable")


def test_cast_list(typed):
    assert {r.name for r in typed[2].collect()} == {"JAN", "MARTHA"}


def test_lines_are_conserved(typed):
    rows, _, _, out = typed
    assert out.select("line_no").distinct().count() == rows.count()


def test_front_matter(typed):
    rows, labels = typed[:2]
    assert structure.front_matter_end(rows, labels, "piece").first().front_end == PLAY.split("\n").index("**ACTE I**")


def test_elements(typed):
    found = dialogue.elements(typed[3], "piece").orderBy("position").collect()
    said = [(tuple(r.people), r.text, r.verse) for r in found if r.type == "replique"]
    assert said == [
        (("JAN",), "Bonsoir. Il fait froid.\nTrès froid.", True), (("MARTHA",), "Vous trouvez ?", False), (("*",), "Ah !", False),
        (("JAN",), "Bonsoir. Il fait froid.\nRien.", True)
    ]
    first = next(r for r in found if r.type == "replique")
    assert [(a.before_word, a.text) for a in first.asides] == [(0, "bas"), (1, "Il s'assied.")]
    assert [r.text for r in found if r.type == "didascalie"] == ["Elle rit.", "à part."]
    assert [r.type for r in found] == ["lieu", "replique", "didascalie", "replique", "replique", "didascalie", "replique"]
    ids = [r.id for r in found if r.type == "replique"]
    assert len(set(ids)) == len(ids)
    assert [r.type for r in found][0] == "lieu"
    assert {r.unit_id for r in found} == {"u001", "u002", "u003"}


def test_document_round_trip(spark, typed, tmp_path):
    docs = dialogue.document(dialogue.elements(typed[3], "piece"), "piece")
    play.write_plays(docs.unionByName(docs.withColumn("piece", F.lit("q"))).coalesce(1), str(tmp_path / "out"), "2026-01-01T00:00:00")
    both = play.read_plays(spark, str(tmp_path / "out"), lines=True)
    assert sorted(r.piece for r in both.collect()) == ["p", "q"]
    again = both.filter("piece = 'p'")
    assert play.structure_counts(again).first().units == 3
    assert play.manifest(again).first().unites == 3
    assert quality.first_violation(again).count() == 0
    assert play.spoken_by(again).filter("role = '*'").count() == 1


def test_numbered_titles(spark):
    text = "\n\n".join(f"**{n}**\n\nDit {n}." for n in ("I", "II", "III"))
    rows = lines.lines_of(spark.createDataFrame([("p", text), ("q", text.replace("II", "V", 1))], "piece string, text string"), "piece", "text")
    found = {(r.piece, r.label): r.type for r in structure.classify_labels(rows, "piece").collect()}
    assert {found["p", x] for x in ("I", "II", "III")} == {"titre_acte"}
    assert found["q", "V"] == "personnage"  # not in order: no division


def test_version_gate(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "repetition/2", "piece": "x"}, indent=2))
    assert [r.piece for r in play.read_plays(spark, str(tmp_path)).collect()] == ["x"]
    (tmp_path / "a.json").write_text(json.dumps({"schema": "repetition/1", "piece": "x"}))
    with pytest.raises(Exception, match="unexpected schema"):
        play.read_plays(spark, str(tmp_path)).collect()
    good, bad = play.ingest(
        spark.createDataFrame(
            [('{"schema":"repetition/2","piece":"x","unites":[{"id":"u001","elements":[]}]}',), ('{"schema":"repetition/3","piece":"x"}',), ("no",), (None,)],
            "text string"
        )
    )
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["not a document", "not a document", "reader_outdated"]


def test_first_violation(spark):
    doc = {
        "schema": "repetition/2", "piece": "x",
        "unites": [{"id": "u001", "elements": [{"type": "replique", "texte": "a", "id": "r", "personnages": ["A"]}, {"type": "what", "texte": "b"}]}]
    }
    docs = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.from_json("t", play.DOCUMENT).alias("d")).select("d.*")
    assert quality.first_violation(docs).first().message == "unknown element"


def test_lifted(spark):
    docs = spark.createDataFrame(
        [('{"schema":"repetition/1","piece":"x","unites":[{"id":"u","elements":[{"type":"replique","personnage":"A"}]}]}',)], "t string"
    ).select(F.from_json("t", play.DOCUMENT).alias("d")).select("d.*")
    assert play.lifted(docs).first().unites[0].elements[0].personnages == ["A"]


def test_text_files_and_ignore_list(spark, tmp_path):
    (tmp_path / "B.txt").write_bytes("﻿un\r\ndeux\r".encode())
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / ".hidden.txt").write_text("x")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in texts.read_texts(spark, str(tmp_path / "[Ba].txt")).collect()}
    assert got == {"B.txt": "un\ndeux\n", "a.txt": "x"}
    listed = texts.listing(spark, str(tmp_path), "*.txt")
    assert [r.name for r in listed.collect()] == ["a.txt", "B.txt"]
    ignored = texts.ignored_names(spark.createDataFrame([("A.txt  # old",), ("# no",), ("",)], "value string"))
    assert [r.name for r in texts.not_ignored(listed, ignored).collect()] == ["B.txt"]


def test_word_documents(spark, typed, tmp_path):
    made = texts.as_word(typed[3], "piece").first()
    (tmp_path / "p.docx").write_bytes(made.content)
    runs = texts.read_word(spark, str(tmp_path))
    shown = [r.text for r in texts.paragraphs(runs).orderBy("paragraph").collect()]
    assert "JAN" in " ".join(shown) and "Vous trouvez ?" in shown
    bold = {r.text for r in texts.paragraphs(runs).filter("bold_share > 0.6").collect()}
    assert {"ACTE I", "MARTHA"} <= bold


def test_propagated_cuts(spark):
    rows = [("d", 0, "JAN", True), ("d", 4, "Un.", False), ("d", 8, "Deux.", False), ("d", 14, "MARTHA", True), ("d", 21, "Trois.", False)]
    paragraphs = spark.createDataFrame(rows, "doc string, start int, text string, bold boolean")
    spans = spark.createDataFrame([("d", 4, 13, 2), ("d", 21, 23, 1)], "doc string, start int, stop int, category int")
    got = intervals.propagated(paragraphs, spans, "doc").collect()
    assert [(r.start, r.stop, r.category) for r in got] == [(0, 3, 2)]


def test_model_calls_and_junctions(spark):
    class Refused(Exception):
        code = 404

    def client(prompt):
        if "bad" in prompt:
            raise Refused
        return prompt.upper()

    units = spark.createDataFrame([(1, "a"), (2, "bad")], "n int, prompt string")
    got = {r.n: (r.answer, r.tries) for r in stages.called(units, ["n"], "prompt", client).collect()}
    assert got == {1: ("A", 1), 2: (None, 1)}
    blocks = spark.createDataFrame([("b", 1, "x\ny"), ("b", 2, "z"), ("b", 3, "w")], "book string, n int, text string")
    folded = stages.junctions_folded(blocks, "book", "n", "text", lambda a, b: (a + "!", "?" + b), 1)
    assert [r.text for r in folded.orderBy("n").collect()] == ["x\ny!", "?z!", "?w"]
    assert stages.run_stages([("a", lambda: True), ("b", lambda: False), ("c", lambda: True)]) == {"a": True, "b": False}


def test_unit_states(spark):
    rows = spark.createDataFrame([("termine", 0), ("suspect", 1), ("suspect", 2), ("echec", 5), (None, None)], "s string, r int")
    assert [r.d for r in rows.select(stages.to_do(F.col("s"), F.col("r")).alias("d")).collect()] == [False, True, False, True, True]


def a_play(piece, said="Bonjour", schema="repetition/2"):
    return {"schema": schema, "piece": piece, "unites": [{"id": "u001", "elements": [{"type": "replique", "texte": said, "id": "r", "personnages": ["JAN"]}]}]}


def test_plays_as_a_format(spark, tmp_path):
    play_source.registered(spark)
    for k in range(5):
        (tmp_path / f"p{k}_REPET.json").write_text(json.dumps(a_play(f"p{k}", "é" * k), indent=2), encoding="utf-8")
    (tmp_path / "more.json").write_text("\n".join(json.dumps(a_play(f"m{k}")) for k in range(3)))
    (tmp_path / "_hidden.json").write_text("{}")
    docs = spark.read.format("plays").load(str(tmp_path))
    assert sorted(r.piece for r in docs.collect()) == ["m0", "m1", "m2", "p0", "p1", "p2", "p3", "p4"]
    by_json = play.read_plays(spark, [str(tmp_path / f"p{k}_REPET.json") for k in range(5)])
    same = lambda df: sorted((r.piece, r.unit, r.text, tuple(r.people)) for r in play.speeches(df).collect())
    assert same(docs.filter("piece like 'p%'")) == same(by_json)
    one = docs.filter("piece = 'p3'")
    assert [r.piece for r in one.collect()] == ["p3"]
    (tmp_path / "old.json").write_text(json.dumps(a_play("old", schema="repetition/1")))
    with pytest.raises(Exception, match="unexpected schema repetition/1"):
        spark.read.format("plays").load(str(tmp_path)).collect()
    assert spark.read.format("plays").option("strict", "false").load(str(tmp_path)).filter("piece = 'old'").count() == 1


def test_a_job_that_fails_leaves_no_play(spark, tmp_path):
    play_source.registered(spark)
    docs = spark.createDataFrame([(json.dumps(a_play(f"p {k}/x")),) for k in range(6)], "t string").repartition(3).select(F.from_json("t", play.DOCUMENT).alias("d")).select("d.*")
    folder = tmp_path / "out"
    docs.write.format("plays").mode("append").save(str(folder))
    assert len(list(folder.iterdir())) == 6 and {r.piece for r in spark.read.format("plays").load(str(folder)).collect()} == {f"p {k}/x" for k in range(6)}
    broken = docs.withColumn("piece", F.when(F.col("piece") == "p 4/x", F.raise_error(F.lit("broken on the way"))).otherwise(F.col("piece")))
    before = sorted(p.name for p in folder.iterdir())
    with pytest.raises(Exception, match="broken on the way"):
        broken.write.format("plays").mode("append").save(str(folder))
    assert sorted(p.name for p in folder.iterdir()) == before
    docs.limit(2).write.format("plays").mode("overwrite").save(str(folder))
    assert len(list(folder.iterdir())) == 2 and spark.read.format("plays").load(str(folder)).count() == 2


def test_partitions_follow_sizes():
    groups = play_source.dealt([("a", 9), ("b", 5), ("c", 4), ("d", 30), ("e", 1)], 10)
    assert sorted(map(sorted, groups)) == [["a", "e"], ["b", "c"], ["d"]]


def reads(df):
    """How many leaves of a plan read a table."""
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")


def test_texts_are_ingested_by_one_pass(spark):
    # three times for the documents (labels, cast lists, lines), once as texts that are none
    assert reads(plays.QUERIES["ingested"](spark, SF)) == 4
    raw = spark.createDataFrame([("a", json.dumps(a_play("x"))), ("b", json.dumps(a_play("y", schema="repetition/1"))), ("c", "no"), ("d", None)], "piece string, text string")
    found = play.judged(raw)
    assert [(r.piece, r.reason, r.doc.piece if r.reason is None else None) for r in found.orderBy("piece").collect()] == [("a", None, "x"), ("b", "file_outdated", None), ("c", "not a document", None), ("d", "not a document", None)]
    good, bad = play.ingest(raw)
    assert [r.piece for r in good.collect()] == ["x"] and sorted(r.piece for r in bad.collect()) == ["b", "c", "d"]


def test_plays_are_flattened_by_one_pass(spark):
    assert reads(plays.QUERIES["flattened"](spark, SF)) == 3
    rows = [("p", u, f"u{u}", "I", scene, implicit, e, kind, f"{u}.{e}", ["A"]) for u, scene, implicit in ((0, "1", False), (1, None, True), (2, None, False)) for e, kind in ((0, "lieu"), (1, "replique"))]
    elements = spark.createDataFrame(rows, "piece string, unit_pos int, unit string, act string, scene string, implicit boolean, elem_pos int, type string, text string, people array<string>")
    flat = reading.flattened(elements.unionByName(elements.withColumn("piece", F.lit("q")))).filter("piece = 'p'").orderBy("position").collect()
    assert [(r.position, r.kind, r.text) for r in flat] == list(zip(range(8), ["scene", "lieu", "replique", "lieu", "replique", "scene", "lieu", "replique"], ["I - 1", "0.0", "0.1", "1.0", "1.1", "I", "2.0", "2.1"]))


def test_documents_are_made_by_one_pass(spark):
    assert reads(plays._documents(spark, SF)) == 3


def test_a_task_that_ends_after_its_job_was_given_up_leaves_no_folder(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815
        taskAttemptId = staticmethod(lambda: 1)  # noqa: N815

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))
    batch = lambda: iter([pa.RecordBatch.from_pylist([a_play("x"), a_play("y") | {"piece": None}])])
    writer = play_source.PlayWriter(str(tmp_path / "out"), False)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(batch())
    assert list((tmp_path / "out").iterdir()) == []
    writer = play_source.PlayWriter(str(tmp_path / "out"), False)
    writer.commit([writer.write(batch()), None])
    assert sorted(json.loads(p.read_text()).get("piece", "") for p in (tmp_path / "out").iterdir()) == ["", "x"]


def test_many_files_are_dealt_whole():
    sizes = [(f"f{k}", 1 + k % 7) for k in range(20_000)]
    groups = play_source.dealt(sizes, 1000)
    size = dict(sizes)
    assert sorted(n for g in groups for n in g) == sorted(size) and max(sum(size[n] for n in g) for g in groups) <= 1000
    assert len(groups) <= 2 * sum(size.values()) / 1000
