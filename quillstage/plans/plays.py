"""Plays as files and documents: conversations become edited plays, which are typed, written, read back and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import align
from quillstage.functions import text as X
from quillstage.operators import dialogue as D
from quillstage.operators import editing as E
from quillstage.operators import intervals as I
from quillstage.operators import lines as L
from quillstage.operators import reading as R
from quillstage.operators import structure as T
from quillstage.plans import sql as S
from quillstage.sources import play, play_source, texts
from quillstage.sources.folder import shared_folder, write_files
from quillstage.sources.tables import table

_NL = "chr(10)"


def edited_plays(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, line_no, line): conversations as edited plays, a turn under its bold name; every fourth turn opens a scene."""
    said = table(spark, sf, "conversations")
    head = F.when(F.col("turn") == 0, "**ACTE I**\n\n*Une rue.*\n\n").when(F.col("turn") % 4 == 0, "***\n\n").otherwise("")
    body = F.concat(head, F.lit("**"), F.upper("role"), F.lit("**\n\n"), F.regexp_replace("text", "[*]", ""), F.lit("\n"))
    per = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda s: s["b"]), "\n").alias("text"))
    return L.lines_of(per, "conv_id", "text")


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    lines = edited_plays(spark, sf)
    return T.classify_lines(lines, T.classify_labels(lines, "conv_id"), "conv_id")


_BODY = "CASE WHEN turn = 0 THEN '**ACTE I**' || chr(10) || chr(10) || '*Une rue.*' || chr(10) || chr(10) WHEN turn % 4 = 0 THEN '***' || chr(10) || chr(10) ELSE '' END || '**' || upper(role) || '**' || chr(10) || chr(10) || replace(text, '*', '') || chr(10)"
_LINES = f"""pl AS (SELECT conv_id, string_split(string_agg({_BODY}, chr(10) ORDER BY turn), chr(10)) AS l FROM conversations GROUP BY conv_id),
ln AS (SELECT conv_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM pl),
ty AS (SELECT *, {S.strip("line")} AS s, {S.bold("line")} AS b, {S.italic("line")} AS i FROM ln),
tl AS (SELECT conv_id, line_no, line, coalesce(b, i, s) AS text, CASE WHEN s = '' THEN 'vide' WHEN {S.separator("line")} THEN 'separateur' WHEN regexp_matches(s, {S.q(T.PAGE_NUMBER)}) THEN 'vide' WHEN b = 'ACTE I' THEN 'titre_acte' WHEN b IS NOT NULL THEN 'personnage' WHEN i IS NOT NULL THEN 'lieu' ELSE 'texte' END AS type FROM ty)"""


def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select(
        "conv_id", F.col("line_no").cast("long").alias("line_no"), F.col("part").cast("long").alias("part"), "type",
        F.md5("text").alias("text")
    )


TYPED = f"WITH {_LINES} SELECT conv_id, line_no, CAST(0 AS BIGINT) AS part, type, md5(text) AS text FROM tl"


def play_elements(spark: SparkSession, sf: str) -> DataFrame:
    found = D.elements(_typed(spark, sf), "conv_id")
    return found.select(
        "conv_id", "unit_id", F.col("position").cast("long").alias("position"), "act", "scene", "implicit", "type",
        F.md5("text").alias("text"), F.array_join("people", "|").alias("people"), "verse", F.size("asides").cast("long").alias("asides"),
        "id"
    )


_SPOKEN = S.strip("regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')")
_ELEMENTS = f"""sp AS (SELECT conv_id, turn, upper(role) AS who, list_filter(list_transform(string_split(replace(text, '*', ''), chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '' AND NOT regexp_matches(x, {S.q(T.PAGE_NUMBER)})) AS ls FROM conversations),
el AS (SELECT conv_id, 2 * turn AS o, turn // 4 AS g, 'lieu' AS type, 'Une rue.' AS text, NULL AS who, CAST(NULL AS BOOLEAN) AS verse FROM sp WHERE turn = 0
UNION ALL SELECT conv_id, 2 * turn + 1, turn // 4, 'replique', {_SPOKEN}, who, len(ls) > 1 FROM sp WHERE len(ls) > 0),
nu AS (SELECT *, 'u' || lpad(CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY g) AS VARCHAR), 3, '0') AS unit_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS position, {S.speech_key("text")} AS k FROM el),
oc AS (SELECT *, row_number() OVER (PARTITION BY conv_id, type, who, k ORDER BY o) - 1 AS nth FROM nu),
ee AS (SELECT conv_id, unit_id, position, 'ACTE I' AS act, CAST(NULL AS VARCHAR) AS scene, g > 0 AS implicit, type, text, who, verse, CASE WHEN type = 'replique' THEN 'r_' || left(sha1(who || '|' || k || CASE WHEN nth > 0 THEN '|' || nth ELSE '' END), 12) END AS id FROM oc)"""
ELEMENTS = f"WITH {_ELEMENTS} SELECT conv_id, unit_id, position, act, scene, implicit, type, md5(text) AS text, who AS people, verse, CASE WHEN type = 'replique' THEN CAST(0 AS BIGINT) END AS asides, id FROM ee"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.document(D.elements(_typed(spark, sf), "conv_id"), "conv_id").withColumn("piece", F.col("piece").cast("string"))


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """The plays, written as files in the shared folder by one commit and read again."""
    folder = shared_folder(spark, "plays")
    docs = _documents(spark, sf).withColumn("genere_le", F.lit("2026-01-01T00:00:00"))
    play_source.registered(spark)
    docs.write.format("plays").mode("append").save(folder)
    return spark.read.format("plays").load(folder)


def plays_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = play.speeches(_written(spark, sf))
    return rows.select(
        "piece", "unit", F.col("elem_pos").cast("long").alias("place"), "act", "scene", "implicit",
        F.array_join("unit_people", "|").alias("unit_people"), F.array_join("people", "|").alias("people"), F.md5("text").alias("text"),
        "verse", "id"
    )


READ = f"""WITH {_ELEMENTS}, pp AS (SELECT *, row_number() OVER (PARTITION BY conv_id, unit_id ORDER BY position) - 1 AS place, min(position) OVER (PARTITION BY conv_id, unit_id, who) AS f FROM ee),
up AS (SELECT conv_id, unit_id, string_agg(who, '|' ORDER BY f) AS unit_people FROM (SELECT DISTINCT conv_id, unit_id, who, f FROM pp WHERE who IS NOT NULL) GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS piece, unit_id AS unit, place, act, scene, implicit, unit_people, who AS people, md5(text) AS text, verse, id FROM pp JOIN up USING (conv_id, unit_id) WHERE type = 'replique'"""


def play_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the folder of plays holds, with the counts of its documents."""
    docs = _written(spark, sf)
    counts = play.structure_counts(docs)
    listed = play.manifest(docs).select("piece", "unites", "repliques", "personnages", F.col("fichier").endswith(".json").alias("is_json"))
    out = listed.join(counts, "piece")
    return out.select(
        "piece", "is_json",
        *(F.col(c).cast("long").alias(c) for c in ("unites", "repliques", "personnages", "units", "implicit_units", "speeches", "directions", "unattributed", "characters", "warnings"))
    )


MANIFEST = f"""WITH {_ELEMENTS}, c AS (SELECT CAST(conv_id AS VARCHAR) AS piece, count(DISTINCT unit_id) AS u, count(DISTINCT unit_id) FILTER (implicit) AS iu, count(*) FILTER (type = 'replique') AS s, count(DISTINCT who) AS p FROM ee GROUP BY 1)
SELECT piece, true AS is_json, u AS unites, s AS repliques, p AS personnages, u AS units, iu AS implicit_units, s AS speeches, CAST(0 AS BIGINT) AS directions, CAST(0 AS BIGINT) AS unattributed, p AS characters, CAST(0 AS BIGINT) AS warnings FROM c"""


def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = play.structure_counts(_written(spark, sf))
    return counts.agg(F.count("*").alias("plays"), *(F.sum(c).cast("long").alias(c) for c in ("units", "implicit_units", "speeches", "characters")))


COUNTS = f"""WITH {_ELEMENTS}, c AS (SELECT conv_id, count(DISTINCT unit_id) AS u, count(DISTINCT unit_id) FILTER (implicit) AS iu, count(*) FILTER (type = 'replique') AS s, count(DISTINCT who) AS p FROM ee GROUP BY 1)
SELECT count(*) AS plays, CAST(sum(u) AS BIGINT) AS units, CAST(sum(iu) AS BIGINT) AS implicit_units, CAST(sum(s) AS BIGINT) AS speeches, CAST(sum(p) AS BIGINT) AS characters FROM c"""


def flattened(spark: SparkSession, sf: str) -> DataFrame:
    """Plays as one sequence of rows, a scene row before every unit that has a title."""
    rows = R.flattened(play.elements(_documents(spark, sf)))
    return rows.select("piece", F.col("position").cast("long").alias("position"), "kind", F.md5("text").alias("text"), F.array_join("people", "|").alias("people"))


FLAT = f"""WITH {_ELEMENTS}, f AS (SELECT conv_id, 2 * position + 1 AS o, type AS kind, text, who FROM ee UNION ALL SELECT conv_id, 2 * min(position), 'scene', 'ACTE I', NULL FROM ee WHERE NOT implicit GROUP BY conv_id, unit_id)
SELECT CAST(conv_id AS VARCHAR) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS position, kind, md5(text) AS text, who AS people FROM f"""


def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Plays of several schemas, and texts that are none, sorted into valid and rejected."""
    schema = F.when(F.col("piece").cast("long") % 4 == 2, "repetition/1").when(F.col("piece").cast("long") % 4 == 3, "other/1").otherwise("repetition/2")
    docs = _documents(spark, sf).withColumn("schema", schema)
    raw = docs.select("piece", F.to_json(F.struct(*docs.columns)).alias("text")).unionByName(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("piece"), "text"))
    good = F.col("reason").isNull()
    return play.judged(raw).select(
        F.when(good, F.col("doc.piece")).otherwise(F.col("piece")).alias("piece"), "reason", F.when(good, F.size("doc.unites").cast("long")).alias("units")
    )


INGESTED = f"""WITH {_ELEMENTS}, c AS (SELECT conv_id, count(DISTINCT unit_id) AS u FROM ee GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS piece, CASE conv_id % 4 WHEN 2 THEN 'file_outdated' WHEN 3 THEN 'foreign_file' END AS reason, CASE WHEN conv_id % 4 < 2 THEN u END AS units FROM c
UNION ALL SELECT conv_id || '-' || turn, 'not a document', NULL FROM conversations"""


def lifted(spark: SparkSession, sf: str) -> DataFrame:
    """Plays of the first version, where an element has one speaker; every third has the list of the second."""
    who = F.when(F.col("turn") % 3 != 0, F.col("role")).alias("personnage"), F.when(F.col("turn") % 3 == 0, F.array("role", F.lit("B"))).alias("personnages")
    element = F.struct(F.lit("replique").alias("type"), F.col("text").alias("texte"), *who)
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", element.alias("e")))), lambda s: s["e"]).alias("elements"))
    raw = per.select(
        F.to_json(
            F.struct(
                F.lit("repetition/1").alias("schema"), F.col("conv_id").cast("string").alias("piece"),
                F.array(F.struct(F.lit("u001").alias("id"), "elements")).alias("unites")
            )
        ).alias("t")
    )
    rows = play.elements(play.lifted(raw.select(F.from_json("t", play.DOCUMENT).alias("d")).select("d.*")))
    return rows.select("piece", F.col("elem_pos").cast("long").alias("place"), F.array_join("people", "|").alias("people"), F.md5("text").alias("text"))


LIFTED = "SELECT CAST(conv_id AS VARCHAR) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role || CASE WHEN turn % 3 = 0 THEN '|B' ELSE '' END AS people, md5(text) AS text FROM conversations"


def speech_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What is said, on pages of a quota of characters."""
    pages = R.speech_pages(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", 300)
    return pages.select("conv_id", "turn", F.col("page").cast("long").alias("page"), F.md5("text").alias("text"))


SPEECH_PAGES = """WITH RECURSIVE s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
f AS (SELECT conv_id, turn, CAST(1 AS BIGINT) AS i, length(l[1]) + 1 AS size, CAST(1 AS BIGINT) AS page FROM s UNION ALL
SELECT f.conv_id, f.turn, i + 1, CASE WHEN f.size >= 180 OR f.size + length(l[i + 1]) + 1 > 420 THEN length(l[i + 1]) + 1 ELSE f.size + length(l[i + 1]) + 1 END, page + CASE WHEN f.size >= 180 OR f.size + length(l[i + 1]) + 1 > 420 THEN 1 ELSE 0 END
FROM f JOIN s USING (conv_id, turn) WHERE i < len(l))
SELECT conv_id, turn, page, md5(string_agg(l[i], chr(10) ORDER BY i)) AS text FROM f JOIN s USING (conv_id, turn) GROUP BY conv_id, turn, page"""


def asides_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Asides put back before the first and the third word, and behind the last."""
    words = F.size(X.tokens(F.col("text")))
    aside = lambda at, t: F.struct(at.cast("int").alias("before_word"), F.lit(t).alias("text"))
    asides = F.array(aside(F.lit(0), "bas"), aside(F.lit(2), "à part"), aside(words, "il sort"), aside(words + 1, "nowhere"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(E.asides_marked(F.col("text"), asides)).alias("marked"))


ASIDES = f"""WITH t AS (SELECT conv_id, turn, {S.tokens("text")} AS t FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_concat(['*bas*'], t[1:2], CASE WHEN len(t) >= 2 THEN ['*à part*'] ELSE [] END, t[3:], ['*il sort*']), ' ')) AS marked FROM t"""


def _fronted(spark: SparkSession, sf: str) -> DataFrame:
    """Plays with front matter of different length, of which some have a cast list and some a label at the end that says nothing."""
    k = F.col("conv_id") % 4
    notes = F.array_join(F.transform(F.sequence(F.lit(1), F.col("conv_id") % 5 + 1), lambda i: F.concat(F.lit("*Note "), i.cast("string"), F.lit("*"))), "\n")
    cast = F.when(k % 2 == 0, "**PERSONNAGES**\n\nUser, voyageur\n**Assistant** (sa sœur)\nun\n\n\n").otherwise("")
    end = F.when(k < 2, "\n**FIN**").otherwise("")
    per = edited_plays(spark, sf).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("t"))
    return L.lines_of(per.withColumn("t", F.concat(F.lit("**LE PUITS**\n\n"), notes, F.lit("\n\n"), cast, "t", end)), "conv_id", "t")


#: Lines before the first title: a title and a blank one, notes and a blank one, and the seven of a cast list.
_FRONT = "2 + conv_id % 5 + 1 + 1 + CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 0 END"


def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    lines = _fronted(spark, sf)
    return T.front_matter_end(lines, T.classify_labels(lines, "conv_id"), "conv_id").withColumn("front_end", F.col("front_end").cast("long"))


FRONT = f"SELECT DISTINCT conv_id, {_FRONT} AS front_end FROM conversations"


def cast_lists(spark: SparkSession, sf: str) -> DataFrame:
    return T.cast_of(_fronted(spark, sf), "conv_id").withColumn("line_no", F.col("line_no").cast("long"))


CAST = "WITH c AS (SELECT DISTINCT conv_id, 4 + conv_id % 5 AS head FROM conversations WHERE conv_id % 2 = 0) SELECT conv_id, head + unnest([2, 3, 4]) AS line_no, unnest(['USER', 'ASSISTANT', NULL]) AS name FROM c"


def play_warnings(spark: SparkSession, sf: str) -> DataFrame:
    lines = _fronted(spark, sf)
    return T.warnings_of(T.classify_labels(lines, "conv_id"), T.cast_of(lines, "conv_id"), lines.select("conv_id").distinct(), "conv_id")


WARNINGS = "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, 'classement incertain : FIN' AS warning FROM c WHERE conv_id % 4 < 2 UNION ALL SELECT conv_id, 'aucune distribution détectée' FROM c WHERE conv_id % 2 = 1"


def overridden_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Types of lines after the first line of the user's name was said to be a note."""
    typed = _typed(spark, sf)
    roles = typed.select("conv_id").distinct().select("conv_id", F.lit("**USER**").alias("raw"), F.lit("note").alias("role"))
    return T.override(typed, roles, "conv_id").select("conv_id", F.col("line_no").cast("long").alias("line_no"), "type")


OVERRIDDEN = f"WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, line ORDER BY line_no) AS n FROM tl) SELECT conv_id, line_no, CASE WHEN line = '**USER**' AND n = 1 THEN 'note' ELSE type END AS type FROM n"


def label_reports(spark: SparkSession, sf: str) -> DataFrame:
    return E.classification_report(T.classify_labels(edited_plays(spark, sf), "conv_id"), "conv_id").select("conv_id", F.md5("report").alias("report"))


REPORTS = f"""WITH l AS (SELECT conv_id, 'personnage' AS type, upper(role) AS label, 'probable' AS conf, count(*) AS n, count(*) FILTER (regexp_matches(replace(text, '*', ''), '[^{X.WS}]')) AS s, 'suivi d''une réplique' AS reason FROM conversations GROUP BY conv_id, role
UNION ALL SELECT DISTINCT conv_id, 'titre_acte', 'ACTE I', 'certaine', 1, 0, 'lexique acte' FROM conversations),
r AS (SELECT conv_id, type, label, printf('%-20s %-12s %-10s %3d %3d  %s', type, label, conf, n, s, reason) AS line FROM l)
SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY type, label) || chr(10) || count(*) || ' labels, 0 uncertain') AS report FROM r GROUP BY conv_id"""


def numbered_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as titles of a day's plays of a user: which are numbers, whether they rise, whether numbering starts anew."""
    n = F.col("event_id") % 9
    label = F.concat(
        F.get(F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), n.cast("int")),
        F.when(F.col("event_id") % 2 == 0, ". LA NUIT").otherwise("")
    )
    doc = F.concat_ws("/", "user_id", F.weekofyear("ts").cast("string"))
    e = table(spark, sf, "events").select(doc.alias("doc"), label.alias("label"), "event_id")
    labels = e.groupBy("doc", "label").agg(F.count("*").alias("occurrences"), F.min("event_id").alias("first_line"))
    found = T.numbering(labels, "doc")
    again = E.restarted_numbering(found, "doc").withColumn("restarted", F.lit(True))
    return found.join(again, "doc", "left").select(
        "doc", "label", "style", F.col("value").cast("long").alias("value"), "in_order",
        F.coalesce("restarted", F.lit(False)).alias("restarted")
    )


NUMBERED = """WITH e AS (SELECT user_id || '/' || weekofyear(ts) AS doc, event_id, event_id % 9 + 1 AS v, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][event_id % 9 + 1] || CASE WHEN event_id % 2 = 0 THEN '. LA NUIT' ELSE '' END AS label FROM events),
l AS (SELECT doc, label, v, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL), w AS (SELECT *, n <> 1 OR coalesce(v < lag(v) OVER (PARTITION BY doc ORDER BY f), false) AS falls FROM l),
d AS (SELECT doc, NOT bool_or(falls) AS in_order, count(*) >= 3 AND count(DISTINCT v) < count(*) AS restarted FROM w GROUP BY doc) SELECT doc, label, 'romain' AS style, v AS value, in_order, restarted FROM w JOIN d USING (doc)"""


def _folder_of(spark: SparkSession, files: DataFrame, name: str) -> str:
    folder = shared_folder(spark, name)
    write_files(files, folder)
    return folder


def word_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Plays as Word documents in the shared folder, read back: paragraphs with how much of them is bold or italic."""
    made = texts.as_word(_typed(spark, sf), "conv_id")
    files = made.select(F.concat(F.col("conv_id").cast("string"), F.lit(".docx")).alias("name"), "content", F.lit(None).cast("string").alias("sidecar"))
    back = texts.paragraphs(texts.read_word(spark, _folder_of(spark, files, "word")))
    return back.select(
        F.regexp_extract("file", r"(\d+)\.docx$", 1).cast("long").alias("conv_id"), F.col("paragraph").cast("long").alias("paragraph"),
        F.col("start").cast("long").alias("start"), F.md5("text").alias("text"), F.round("bold_share", 6).alias("bold"),
        F.round("italic_share", 6).alias("italic")
    )


WORD = f"""WITH {_LINES}, o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY line_no) - length(text) - 1 AS start FROM tl)
SELECT conv_id, line_no AS paragraph, CAST(start AS BIGINT) AS start, md5(text) AS text, CASE WHEN type IN ('titre_acte', 'personnage') THEN 1e0 ELSE 0e0 END AS bold, CASE WHEN type = 'lieu' THEN 1e0 ELSE 0e0 END AS italic FROM o WHERE trim(text) <> ''"""


def edited_again(spark: SparkSession, sf: str) -> DataFrame:
    """Edited text from the paragraphs of Word documents: speech paragraphs in a row are one."""
    typed = _typed(spark, sf).filter("type <> 'vide'")
    style = lambda kinds: F.when(F.col("type").isin(*kinds), 1.0).otherwise(0.0)
    paragraphs = typed.select(
        "conv_id", F.col("line_no").alias("paragraph"), "text", style(["titre_acte", "personnage"]).alias("bold_share"),
        style(["lieu"]).alias("italic_share")
    )
    lines = E.front_split(E.edited_from_paragraphs(paragraphs, "conv_id"), "conv_id")
    return lines.select("conv_id", F.col("position").cast("long").alias("position"), F.md5("line").alias("line"), "front")


AGAIN = f"""WITH {_LINES}, k AS (SELECT conv_id, line_no, text, CASE WHEN type IN ('titre_acte', 'personnage') THEN 'b' WHEN type = 'lieu' THEN 'i' ELSE 's' END AS k FROM tl WHERE type <> 'vide'),
n AS (SELECT *, CASE WHEN k = 's' AND lag(k) OVER (PARTITION BY conv_id ORDER BY line_no) = 's' THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY line_no) AS r FROM n)
SELECT conv_id, CAST(r AS BIGINT) AS position, md5(CASE k WHEN 'b' THEN '**' || string_agg(text, chr(10) ORDER BY line_no) || '**' WHEN 'i' THEN '*' || string_agg(text, chr(10) ORDER BY line_no) || '*' ELSE string_agg(text, chr(10) ORDER BY line_no) END) AS line, false AS front FROM r GROUP BY conv_id, r, k"""


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, text): what is said in a conversation, as one text."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))


_FLAT = "fl AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


def reviewed_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """The second quarter of a text cut as a tracked change in a Word document, which is read back: runs with what is deleted."""
    flat = _flat(spark, sf)
    n = F.length("text")
    spans = flat.select("conv_id", (n / 4).cast("int").alias("start"), (n / 2).cast("int").alias("stop"), F.lit(1).alias("category")).filter("start < stop")
    marked = E.with_tracked_cuts(E.cut_runs(flat.select("conv_id", F.lit(0).alias("start"), "text"), spans, "conv_id"), "conv_id", {1: 'A & "B"'}, "2026-01-01T00:00:00Z")
    files = texts.packaged(marked, "conv_id").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".docx")).alias("name"), "content", F.lit(None).cast("string").alias("sidecar")
    )
    back = texts.reviewed(texts.read_word(spark, _folder_of(spark, files, "cuts")))
    runs = back.select(F.regexp_extract("file", r"(\d+)\.docx$", 1).cast("long").alias("conv_id"), F.explode("runs").alias("r"))
    return runs.select("conv_id", F.col("r.start").cast("long").alias("start"), F.md5("r.text").alias("text"), "r.deleted")


REVIEWED = f"""WITH {_FLAT}, p AS (SELECT conv_id, t, unnest([0, length(t) // 4, length(t) // 2]) AS a, unnest([length(t) // 4, length(t) // 2, length(t)]) AS b, unnest([false, true, false]) AS d FROM fl)
SELECT conv_id, a AS start, md5(substr(t, a + 1, b - a)) AS text, d AS deleted FROM p WHERE a < b"""


def carried_masks(spark: SparkSession, sf: str) -> DataFrame:
    """A cut of a reviewed turn, whose first line was changed, carried to the turn as it was."""
    n = F.length("text")
    cut = F.array(F.struct((n / 4).cast("int") + 4, (n / 2).cast("int") + 4).cast("struct<start:int,stop:int>"))
    spans = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(align.carry("text", F.concat(F.lit("Ah! "), "text"), cut)).alias("s"))
    return spans.select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"))


CARRIED = """WITH c AS (SELECT conv_id, turn, length(text) // 4 AS a, length(text) // 2 AS b, length(string_split(text, chr(10))[1]) AS f, contains(text, chr(10)) AS m FROM conversations),
s AS (SELECT conv_id, turn, a AS start, least(b, f) AS stop FROM c UNION ALL SELECT conv_id, turn, greatest(a, f + 1), b FROM c WHERE m) SELECT * FROM s WHERE start < stop"""


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, start, text, bold, italic, turn): names and what they say as paragraphs of a flat text; of every fourth turn the name is of two, of every seventh of all."""
    name = F.when(F.col("turn") % 7 == 6, "TOUS").when(F.col("turn") % 4 == 3, F.concat(F.upper("role"), F.lit(" et CHŒUR"))).otherwise(F.upper("role"))
    title = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("SCÈNE "), (F.col("turn") / 5).cast("int").cast("string")))
    parts = F.array_compact(
        F.array(
            F.when(title.isNotNull(), F.struct(title.alias("text"), F.lit(True).alias("bold"))),
            F.struct(name.alias("text"), F.lit(True).alias("bold")), F.struct(F.col("text"), F.lit(False).alias("bold"))
        )
    )
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", parts.alias("p")))), lambda s: F.transform(s["p"], lambda p: F.struct(s["turn"].alias("turn"), p["text"].alias("text"), p["bold"].alias("bold"))))).alias("p"))
    rows = per.select("conv_id", F.posexplode("p").alias("k", "p"))
    upto = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("p.text") + 1).over(upto), F.lit(0)).cast("int")
    return rows.select("conv_id", start.alias("start"), "p.text", "p.bold", F.lit(False).alias("italic"), "p.turn")


_PARAGRAPHS = """pr AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS k, unnest([CASE WHEN turn % 5 = 0 THEN 'SCÈNE ' || turn // 5 END, CASE WHEN turn % 7 = 6 THEN 'TOUS' WHEN turn % 4 = 3 THEN upper(role) || ' et CHŒUR' ELSE upper(role) END, text]) AS text FROM conversations),
pa AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, k) - length(text) - 1 AS BIGINT) AS s, max(turn // 5) OVER (PARTITION BY conv_id ORDER BY turn, k) AS sc FROM pr WHERE text IS NOT NULL)"""


def words_left(spark: SparkSession, sf: str) -> DataFrame:
    """Words by scene and speaker outside a cut of 100 to 900 characters of each conversation."""
    paragraphs = _paragraphs(spark, sf)
    spans = paragraphs.select("conv_id").distinct().select("conv_id", F.lit(100).alias("start"), F.lit(900).alias("stop"), F.lit(1).alias("category"))
    return E.words_left(paragraphs, spans, "conv_id", F.col("text").startswith("SCÈNE"))


LEFT = f"""WITH {_PARAGRAPHS}, c AS (SELECT conv_id, sc, turn, len(regexp_extract_all(substr(text, 1, least(greatest(100 - s, 0), length(text))), '\\S+')) + len(regexp_extract_all(substr(text, least(greatest(900 - s, 0), length(text)) + 1), '\\S+')) AS w,
s >= 100 AND s + length(text) <= 900 AS gone FROM pa WHERE k = 2 AND length(text) > 0),
r AS (SELECT c.conv_id, 'SCÈNE ' || sc AS scene, unnest(CASE WHEN turn % 7 = 6 THEN [] WHEN turn % 4 = 3 THEN [upper(role), 'CHŒUR'] ELSE [upper(role)] END) AS role, w FROM c JOIN conversations USING (conv_id, turn) WHERE NOT gone)
SELECT conv_id, scene, role, CAST(sum(w) AS BIGINT) AS words FROM r GROUP BY ALL"""


def propagated_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose whole speech is cut, as that of every third turn is."""
    rows = _paragraphs(spark, sf).filter(~F.col("text").startswith("SCÈNE"))
    spans = rows.filter("not bold and turn % 3 = 1").select(
        "conv_id", "start", (F.col("start") + F.length("text")).alias("stop"), (F.col("turn") % 2 + 1).alias("category")
    )
    found = I.propagated(rows.select("conv_id", "start", "text", "bold"), spans, "conv_id")
    return found.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("start", "stop", "category")))


PROPAGATED = f"WITH {_PARAGRAPHS} SELECT n.conv_id, n.s AS start, n.s + length(n.text) AS stop, n.turn % 2 + 1 AS category FROM pa n JOIN pa t ON n.conv_id = t.conv_id AND n.turn = t.turn AND n.k = 1 AND t.k = 2 AND n.turn % 3 = 1 AND trim(t.text) <> ''"

QUERIES = {
    "typed_lines": typed_lines, "play_elements": play_elements, "plays_read": plays_read, "play_manifest": play_manifest,
    "structure_counts": structure_counts, "flattened": flattened, "ingested": ingested, "lifted": lifted, "speech_pages": speech_pages,
    "asides_marked": asides_marked, "front_matter": front_matter, "cast_lists": cast_lists, "play_warnings": play_warnings,
    "overridden_roles": overridden_roles, "label_reports": label_reports, "numbered_titles": numbered_titles,
    "word_paragraphs": word_paragraphs, "edited_again": edited_again, "reviewed_cuts": reviewed_cuts, "carried_masks": carried_masks,
    "words_left": words_left, "propagated_cuts": propagated_cuts
}
SQL = {
    "typed_lines": TYPED, "play_elements": ELEMENTS, "plays_read": READ, "play_manifest": MANIFEST, "structure_counts": COUNTS,
    "flattened": FLAT, "ingested": INGESTED, "lifted": LIFTED, "speech_pages": SPEECH_PAGES, "asides_marked": ASIDES, "front_matter": FRONT,
    "cast_lists": CAST, "play_warnings": WARNINGS, "overridden_roles": OVERRIDDEN, "label_reports": REPORTS, "numbered_titles": NUMBERED,
    "word_paragraphs": WORD, "edited_again": AGAIN, "reviewed_cuts": REVIEWED, "carried_masks": CARRIED, "words_left": LEFT,
    "propagated_cuts": PROPAGATED
}
