"""Group reading, replies, cuts, validation and listings over the flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.operators import dialogue as D
from quillstage.operators import editing as E
from quillstage.operators import quality as Q
from quillstage.operators import reading as R
from quillstage.plans import sql as S
from quillstage.sources import texts
from quillstage.sources.play import DOCUMENT
from quillstage.sources.tables import table
from quillstage.streaming.recitations import windowed


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 1, "scene").otherwise("replique")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("piece"), F.col("turn").alias("position"), kind.alias("kind"), "text", "role")


_FLAT = "f AS (SELECT conv_id AS piece, turn AS position, CASE WHEN turn % 3 = 1 THEN 'scene' ELSE 'replique' END AS kind, text, role FROM conversations)"


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    forward = R.off_scene(R.with_scene(_flat(spark, sf))).withColumnRenamed("target", "next_place")
    return R.off_scene(forward, False).select("piece", "position", "scene", "next_place", F.col("target").alias("last_place"))


SCENES = f"""WITH {_FLAT} SELECT piece, position, last_value(CASE WHEN kind = 'scene' THEN text END IGNORE NULLS) OVER b AS scene,
first_value(CASE WHEN kind <> 'scene' THEN position END IGNORE NULLS) OVER a AS next_place, last_value(CASE WHEN kind <> 'scene' THEN position END IGNORE NULLS) OVER b AS last_place FROM f
WINDOW b AS (PARTITION BY piece ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY piece ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def kind_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.page_groups(_flat(spark, sf), "piece", "position", "kind").select("piece", "kind", "first_place", "last_place")


RUNS = f"""WITH {_FLAT}, n AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY piece ORDER BY position)),
r AS (SELECT *, sum(new) OVER (PARTITION BY piece ORDER BY position) AS run FROM n) SELECT piece, kind, min(position) AS first_place, max(position) AS last_place FROM r GROUP BY piece, run, kind"""


def source_hues(spark: SparkSession, sf: str) -> DataFrame:
    return R.hues(table(spark, sf, "documents").select("source").distinct(), "source")


HUES = "SELECT source, round(360.0 * (row_number() OVER (ORDER BY source) - 1) / count(*) OVER (), 6) AS hue FROM (SELECT DISTINCT source FROM documents)"


def slots(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return R.roles_by_slot(docs, "source", "lang").select("lang", F.array_join("roles", ",").alias("roles"))


SLOTS = "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS roles FROM documents GROUP BY lang"


def unassigned(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of source and language as characters; those of labelled documents have a slot."""
    people = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("name"))
    return R.unassigned(people, people.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("name").distinct(), "name")


UNASSIGNED = "WITH p AS (SELECT doc_id, concat_ws('-', source, lang) AS name FROM documents) SELECT DISTINCT name FROM p WHERE name NOT IN (SELECT name FROM p WHERE doc_id IN (SELECT doc_id FROM labels))"


def latest_messages(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(
        table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn"
    ).withColumn("label", R.reader_label(F.col("role"), F.when(F.col("turn") % 2 == 0, F.lit("Ann"))))


LATEST = "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, upper(arg_max(role, turn)[1]) || arg_max(role, turn)[2:] || CASE WHEN max(turn) % 2 = 0 THEN ' (Ann)' ELSE '' END AS label FROM conversations GROUP BY conv_id"


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 7
    action = F.when(k == 0, "mode").when(k == 1, "draw").when(k == 2, "go").when(k == 3, "hide").otherwise("reveal")
    events = table(spark, sf, "events").select(
        "user_id", "event_id", action.alias("action"), F.concat(F.lit("r"), (F.col("event_id") % 11).cast("string")).alias("argument")
    )
    return R.session_state(events, "user_id", "event_id").select(
        "user_id", "mode", F.col("draws").cast("long").alias("draws"), "place",
        F.array_join(F.array_sort("revealed"), ",").alias("revealed")
    )


SESSIONS = """WITH e AS (SELECT user_id, event_id, event_id % 7 AS k, 'r' || event_id % 11 AS x FROM events), m AS (SELECT user_id, coalesce(max(event_id) FILTER (k = 0), -1) AS m FROM e GROUP BY user_id),
v AS (SELECT user_id, x, arg_max(k, event_id) AS k FROM e JOIN m USING (user_id) WHERE event_id > m AND k >= 3 GROUP BY ALL),
r AS (SELECT user_id, string_agg(x, ',' ORDER BY x) AS revealed FROM v WHERE k > 3 GROUP BY user_id)
SELECT e.user_id, coalesce(arg_max(x, event_id) FILTER (k = 0), 'lecture') AS mode, count(*) FILTER (k = 1) AS draws, arg_max(x, event_id) FILTER (k = 2) AS place, coalesce(any_value(revealed), '') AS revealed FROM e LEFT JOIN r USING (user_id) GROUP BY e.user_id"""


def junction_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies that say the halves of whole texts again, some with one side cut short, some not to be read."""
    n = F.length("text")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.substr("text", F.lit(1), F.ceil(n / 2).cast("int")).alias("a"),
        F.substr("text", F.ceil(n / 2).cast("int") + 1).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("no")).otherwise(F.concat(F.lit(E.LEFT), F.when(F.col("doc_id") % 3 == 1, a).otherwise("x"), F.lit(E.LEFT_END + "\n" + E.RIGHT), F.upper(b), F.lit(E.RIGHT_END)))
    kept = E.junction_kept(reply, a, b, Q.junction_findings)
    return docs.select("doc_id", kept.alias("k")).select("doc_id", F.md5("k.left").alias("left_side"), F.md5("k.right").alias("right_side"))


_REPLY = S.q(f"(?s){E.LEFT}(.*?){E.LEFT_END}.*?{E.RIGHT}(.*?){E.RIGHT_END}")
_FAIR = lambda x, y: f"({S.strip(y)} <> '' AND (length({S.strip(x)}) = 0 OR length({S.strip(y)}) / length({S.strip(x)}) BETWEEN 0.9 AND 1.1))"
JUNCTIONS = f"""WITH h AS (SELECT doc_id, substr(text, 1, CAST(ceil(length(text) / 2) AS BIGINT)) AS a, substr(text, CAST(ceil(length(text) / 2) AS BIGINT) + 1) AS b FROM documents),
r AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE '{E.LEFT}' || CASE WHEN doc_id % 3 = 1 THEN a ELSE 'x' END || '{E.LEFT_END}' || chr(10) || '{E.RIGHT}' || replace(upper(b), 'ẞ', 'SS') || '{E.RIGHT_END}' END AS r FROM h),
s AS (SELECT *, regexp_matches(r, {_REPLY}) AS read, {S.strip(f"regexp_extract(r, {_REPLY}, 1)")} AS x, {S.strip(f"regexp_extract(r, {_REPLY}, 2)")} AS y FROM r),
k AS (SELECT *, read AND {_FAIR("a", "x")} AND {_FAIR("b", "y")} AS k FROM s) SELECT doc_id, md5(CASE WHEN k THEN x ELSE a END) AS left_side, md5(CASE WHEN k THEN y ELSE b END) AS right_side FROM k"""


def annotated_roles(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(
        (F.col("doc_id") % 9).cast("string"), F.lit("|note\n 12 | "), F.when(F.col("doc_id") % 2 == 0, "titre_acte").otherwise("unheard"),
        F.lit("\nnothing")
    )
    known, unknown = E.annotations(table(spark, sf, "documents").withColumn("r", reply), "doc_id", "r")
    return known.withColumn("line_no", F.col("line_no").cast("long")).unionByName(unknown.select("doc_id", F.lit(None).cast("long").alias("line_no"), "role"))


ANNOTATED = "SELECT doc_id, doc_id % 9 AS line_no, 'note' AS role FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 12 END, CASE WHEN doc_id % 2 = 0 THEN 'titre_acte' ELSE 'unheard' END FROM documents"


def cut_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from quillstage.plans.structures import _spans

    runs = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("start"), "text")
    spans = _spans(spark, sf).withColumns({"start": F.col("start").cast("int"), "stop": F.col("stop").cast("int")})
    return E.cut_runs(runs, spans, "doc_id").select(
        "doc_id", F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("chars"),
        F.col("category").cast("long").alias("category")
    )


PIECES = """WITH s AS (SELECT doc_id, unnest([1, 3, 8]) * length(text) // 10 AS a, unnest([4, 6, 9]) * length(text) // 10 AS b, unnest([1, 2, 3]) AS c FROM documents), v AS (SELECT * FROM s WHERE a < b),
e AS (SELECT DISTINCT doc_id, unnest([0, length(text)]) AS p FROM documents UNION SELECT doc_id, a FROM v UNION SELECT doc_id, b FROM v), l AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM e)
SELECT l.doc_id, p AS start, q - p AS chars, CAST(arg_min(c, (a, b, c)) AS BIGINT) AS category FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND a <= p AND b >= q WHERE q IS NOT NULL GROUP BY l.doc_id, p, q"""


def first_violations(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    element = F.struct(
        "turn", F.when((c % 7 == 2) & (t == 0), "what").otherwise("replique").alias("type"), F.col("text").alias("texte"),
        F.when(~((c % 5 == 1) & (t == 1)), F.concat_ws("-", c, F.when(c % 11 == 3, F.lit(0)).otherwise(t))).alias("id"),
        F.array("role").alias("personnages")
    )
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(element)), lambda e: e.dropFields("turn")).alias("elements"))
    docs = per.select(
        F.to_json(
            F.struct(
                F.when(c % 13 == 4, "repetition/1").otherwise("repetition/2").alias("schema"), c.cast("string").alias("piece"),
                F.array(F.struct(F.lit("u001").alias("id"), "elements")).alias("unites")
            )
        ).alias("j")
    )
    return Q.first_violation(docs.select(F.from_json("j", DOCUMENT).alias("d")).select("d.*"))


VIOLATIONS = """WITH m AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
v AS (SELECT DISTINCT conv_id, -1 AS p, 'schema' AS message FROM m WHERE conv_id % 13 = 4 UNION ALL SELECT conv_id, turn, CASE WHEN conv_id % 7 = 2 AND turn = 0 THEN 'unknown element' ELSE 'speech without id' END FROM m WHERE (conv_id % 7 = 2 AND turn = 0) OR (conv_id % 5 = 1 AND turn = 1)
UNION ALL SELECT conv_id, turn, 'id not unique' FROM m WHERE conv_id % 11 = 3 AND NOT (conv_id % 7 = 2 AND turn = 0) AND NOT (conv_id % 5 = 1 AND turn = 1) AND n - CASE WHEN conv_id % 7 = 2 THEN 1 ELSE 0 END - CASE WHEN conv_id % 5 = 1 THEN 1 ELSE 0 END > 1)
SELECT CAST(conv_id AS VARCHAR) AS piece, arg_min(message, (p, message)) AS message FROM v GROUP BY conv_id"""


def unit_heads(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    units = table(spark, sf, "conversations").select("conv_id").distinct().select(
        (c / 20).cast("int").cast("string").alias("piece"), F.format_string("u%03d", c).alias("unit_id"),
        F.when(c % 20 >= 3, F.concat(F.lit("ACTE "), (c % 20 / 7).cast("int").cast("string"))).alias("act"),
        F.when(c % 4 != 0, F.concat(F.lit("Scène "), (c % 20 / 3).cast("int").cast("string"))).alias("scene"),
        (c % 5 == 0).alias("implicit")
    )
    return D.titled(units, "piece").groupBy("piece", "type").agg(F.count("*").alias("titles"))


HEADS = """WITH u AS (SELECT conv_id // 20 AS piece, conv_id, CASE WHEN conv_id % 20 >= 3 THEN 'ACTE ' || (conv_id % 20) // 7 END AS act, CASE WHEN conv_id % 4 <> 0 THEN 'Scène ' || (conv_id % 20) // 3 END AS scene, conv_id % 5 = 0 AS implicit FROM (SELECT DISTINCT conv_id FROM conversations)),
l AS (SELECT *, (act IS NOT NULL AND act IS DISTINCT FROM lag(act) OVER w) AS an, lag(scene) OVER w AS ls FROM u WINDOW w AS (PARTITION BY piece ORDER BY conv_id)), n AS (SELECT *, (scene IS NOT NULL AND (an OR scene IS DISTINCT FROM ls)) AS sn FROM l)
SELECT CAST(piece AS VARCHAR) AS piece, type, count(*) AS titles FROM (SELECT piece, 'titre_acte' AS type FROM n WHERE an UNION ALL SELECT piece, 'titre_scene' FROM n WHERE sn UNION ALL SELECT piece, 'separateur' FROM n WHERE implicit AND NOT an AND NOT sn) GROUP BY ALL"""


def books_to_read(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(F.concat(F.upper("source"), F.lit(".PDF")).alias("name")).distinct()
    ignored = texts.ignored_names(spark.createDataFrame([("src1.pdf  # done",), ("# none",), ("SRC3",)], "value string"))
    return texts.not_ignored(files, ignored)


BOOKS = "SELECT DISTINCT upper(source) || '.PDF' AS name FROM documents WHERE source NOT IN ('src1', 'src3')"


def findings_report(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").filter("quality = 0")
    rows = found.select("source", F.when(F.col("toxic") == 1, "TOXIC").otherwise("LOW").alias("category"), F.col("doc_id").alias("block"), F.lit("x").alias("detail"))
    return Q.report(rows, "source").select("source", "piece", F.md5("report").alias("report"), "findings")


REPORTS = "WITH r AS (SELECT source, doc_id, CAST(doc_id // 500 AS BIGINT) AS piece, '[' || CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'LOW' END || '] bloc ' || doc_id || ' : x' AS line FROM labels JOIN documents USING (doc_id) WHERE quality = 0) SELECT source, piece, md5(string_agg(line, chr(10) ORDER BY doc_id, line)) AS report, count(*) AS findings FROM r GROUP BY source, piece"


def stored_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn(
        "t",
        F.concat(F.lit('{"size": '), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 3 == 0, ', "pace": "fast"').otherwise(', "pace": 2'), F.lit("}"))
    )
    return e.select("event_id", R.settings(F.col("t"), {"size": 9, "pace": 7, "gone": 4}).alias("s")).select(
        "event_id", *(F.col(f"s.{k}").cast("long").alias(k) for k in ("size", "pace", "gone"))
    )


SETTINGS = "SELECT event_id, event_id % 5 AS size, CAST(CASE WHEN event_id % 3 = 0 THEN 7 ELSE 2 END AS BIGINT) AS pace, CAST(4 AS BIGINT) AS gone FROM events"


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the stream over a table at rest."""
    hours = windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp")), "1 hour")
    return hours.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.col("mean").cast("double").alias("mean"))


HOURLY = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, CAST(round(sum(CAST(value AS DECIMAL(18, 6))) / count(*), 6) AS DOUBLE) AS mean FROM events GROUP BY date_trunc('hour', ts), event_type"

QUERIES = {
    "scenes": scenes, "kind_runs": kind_runs, "source_hues": source_hues, "slots": slots, "unassigned": unassigned,
    "latest_messages": latest_messages, "sessions": sessions, "junction_replies": junction_replies, "annotated_roles": annotated_roles,
    "cut_pieces": cut_pieces, "first_violations": first_violations, "unit_heads": unit_heads, "books_to_read": books_to_read,
    "findings_report": findings_report, "stored_settings": stored_settings, "hourly_events": hourly_events
}
SQL = {
    "scenes": SCENES, "kind_runs": RUNS, "source_hues": HUES, "slots": SLOTS, "unassigned": UNASSIGNED, "latest_messages": LATEST,
    "sessions": SESSIONS, "junction_replies": JUNCTIONS, "annotated_roles": ANNOTATED, "cut_pieces": PIECES, "first_violations": VIOLATIONS,
    "unit_heads": HEADS, "books_to_read": BOOKS, "findings_report": REPORTS, "stored_settings": SETTINGS, "hourly_events": HOURLY
}
