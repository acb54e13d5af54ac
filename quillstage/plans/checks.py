"""Quality checks over documents, and work units, journals and manifests over the flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.operators import quality as Q
from quillstage.operators import stages as G
from quillstage.plans import sql as S
from quillstage.sources.tables import table


def text_layers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("r", Q.text_layer_refusals(F.col("text")))
    return d.select("doc_id", F.array_join("r", ",").alias("refusals"), Q.layer_used(F.col("r")).alias("used"))


_LAYERS = f"""b AS (SELECT doc_id, {S.strip("coalesce(text, '')")} AS b FROM documents),
n AS (SELECT *, len(regexp_extract_all(b, '[^{X.WS}]')) AS f, len(regexp_extract_all(b, '\\p{{L}}')) AS l, len(regexp_extract_all(b, '[{Q.ACCENTED}]')) AS a, len(regexp_extract_all(b, '[\\x{{fffd}}\\x00-\\x07\\x0b\\x0c]')) AS o FROM b),
r AS (SELECT doc_id, CASE WHEN b = '' THEN 'no text layer' WHEN length(b) < 200 THEN 'too short' ELSE concat_ws(',', CASE WHEN l / f < 0.6 THEN 'few letters' END, CASE WHEN o / length(b) > 0.02 THEN 'odd characters' END, CASE WHEN l > 0 AND a / l < 0.005 THEN 'no accents' END) END AS refusals FROM n)"""
LAYERS = f"WITH {_LAYERS} SELECT doc_id, refusals, refusals = '' AS used FROM r"


def _before_and_after(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as sources t and outputs o: of some the source says all twice, of others the output has marks of its own."""
    source = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    output = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\n[PAGE 4]\n*"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", source.alias("t"), output.alias("o"))


def output_checks(spark: SparkSession, sf: str) -> DataFrame:
    t, o = F.col("t"), F.col("o")
    found = {"output": Q.output_findings(t, o), "junction": Q.junction_findings(t, o), "volume": Q.volume_findings(t, o), "transcript": Q.transcript_findings(o)}
    return _before_and_after(spark, sf).select("doc_id", *(F.array_join(c, ",").alias(k) for k, c in found.items()))


def mechanical_checks(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of an edited book against its transcript, which has two labels more."""
    t = F.concat("t", F.lit("\nSCÈNE II.\nACTE I"))
    return _before_and_after(spark, sf).select("doc_id", F.array_join(Q.mechanical_findings(t, F.col("o")), ",").alias("findings"))


def _stars(x: str) -> str:
    return f"list_sum(list_transform(string_split({x}, chr(10)), lambda y: CASE WHEN {S.separator('y')} THEN 0 ELSE length(y) - length(replace(y, '*', '')) END))"


def _forbidden(x: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({x}, {S.q(p)}) THEN 'forbidden: {name}' END" for name, p in Q.FORBIDDEN.items())


def _comparison(x: str) -> str:
    return S.squeeze(f"replace({S.for_counting(x)}, '*', '')")


_FILLED = lambda x: f"len(list_filter(string_split({x}, chr(10)), lambda y: {S.strip('y')} <> ''))"
_BEFORE = "d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || text ELSE text END AS t, CASE doc_id % 4 WHEN 1 THEN text || chr(10) || '[PAGE 4]' || chr(10) || '*' ELSE text END AS o FROM documents)"
OUTPUT = f"""WITH {_BEFORE},
n AS (SELECT *, length({S.for_counting("t")}) AS a, length({S.for_counting("o")}) AS b, length({S.strip("t")}) AS sa, length({S.strip("o")}) AS sb, length({_comparison("t")}) AS ca, length({_comparison("o")}) AS cb FROM d)
SELECT doc_id, CASE WHEN sb = 0 THEN 'empty output' ELSE concat_ws(',', CASE WHEN a > 0 AND b / a < 0.8 THEN 'too short' END, {_forbidden("o")}, CASE WHEN {_stars("o")} % 2 <> 0 THEN 'odd number of stars' END) END AS output,
CASE WHEN sb = 0 THEN 'empty' ELSE concat_ws(',', CASE WHEN sa > 0 AND sb / sa < 0.9 THEN 'shortened' END, CASE WHEN sa > 0 AND sb / sa > 1.1 THEN 'lengthened' END) END AS junction,
concat_ws(',', CASE WHEN ca > 0 AND cb / ca < 0.8 THEN 'volume' END, CASE WHEN {_FILLED("t")} > 0 AND {_FILLED("o")} / {_FILLED("t")} < 0.8 THEN 'lines' END) AS volume,
concat_ws(',', {_forbidden("o")}, CASE WHEN regexp_matches(o, '(?m)\\*\\*[^*\\n]+\\*\\*|^\\*[^*\\n]+\\*$') THEN 'emphasis added' END) AS transcript FROM n"""
_CL = lambda x: f"""list_sort(list_distinct(list_transform(list_filter(string_split({x}, chr(10)), lambda x: NOT contains(x, '<<<') AND NOT regexp_matches({S.strip("x")}, {S.q(X.PAGE_MARK)}) AND length({S.strip("x")}) <= 40 AND length({S.letters("x")}) >= 3 AND regexp_matches({S.letters("x")}, '^\\p{{Lu}}+$')), lambda x: {S.label("x")})))"""
MECHANICAL = f"""WITH {_BEFORE}, e AS (SELECT doc_id, t || chr(10) || 'SCÈNE II.' || chr(10) || 'ACTE I' AS t, o FROM d),
n AS (SELECT *, length({_comparison("t")}) AS ca, length({_comparison("o")}) AS cb, {_FILLED("t")} AS la, {_FILLED("o")} AS lb, {_CL("t")} AS ta, {_CL("o")} AS tb FROM e)
SELECT doc_id, concat_ws(',', CASE WHEN ca > 0 AND cb / ca < 0.8 THEN 'volume' END, CASE WHEN la > 0 AND lb / la < 0.8 THEN 'lines' END,
CASE WHEN len(list_filter(ta, lambda x: NOT list_contains(tb, x))) > 0 THEN array_to_string(list_transform(list_filter(ta, lambda x: NOT list_contains(tb, x)), lambda x: 'label lost: ' || x), ',') END,
CASE WHEN {_stars("o")} % 2 <> 0 THEN 'odd number of stars' END, {_forbidden("o")}) AS findings FROM n"""


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """What texts declare, some of which have a declaration added."""
    said = F.when(F.col("doc_id") % 4 == 0, "\nPage vide.").when(
        F.col("doc_id") % 4 == 1, "\nJe ne peux pas transcrire cette page"
    ).when(F.col("doc_id") % 4 == 2, "\n[RAS] ok\n[LACUNE] x\n[AJOUT] y").otherwise("")
    d = table(spark, sf, "documents").withColumn("t", F.concat("text", said))
    return d.select(
        "doc_id", Q.says_blank(F.col("t")).alias("blank"), Q.says_failed(F.col("t")).alias("failed"), Q.is_sound(F.col("t")).alias("sound"),
        Q.counted_findings(F.col("t")).cast("long").alias("findings")
    )


DECLARATIONS = f"""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Page vide.' WHEN 1 THEN chr(10) || 'Je ne peux pas transcrire cette page' WHEN 2 THEN chr(10) || '[RAS] ok' || chr(10) || '[LACUNE] x' || chr(10) || '[AJOUT] y' ELSE '' END AS t FROM documents)
SELECT doc_id, ({S.strip("t")} <> '' AND length({S.strip("t")}) <= 200 AND regexp_matches(t, {S.q(Q.BLANK_SAID)})) AS blank, ({S.strip("t")} <> '' AND length({S.strip("t")}) <= 300 AND regexp_matches(t, {S.q(Q.FAILED_SAID)})) AS failed,
contains(upper(t), '[RAS]') AS sound, CAST(len(regexp_extract_all(t, '(?m)^\\[[A-Z ]+\\]')) AS BIGINT) AS findings FROM d"""


def lost_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in capitals of whole texts, put in capitals, and those that are gone from an edition that has but one."""
    a = F.concat(F.upper("text"), F.lit("\nSCÈNE II.\nACTE I"))
    d = table(spark, sf, "documents").select("doc_id", Q.capital_labels(a).alias("l"))
    return d.select("doc_id", F.array_join("l", "|").alias("labels"), F.array_join(F.array_except("l", F.array(F.lit("ACTE I"))), "|").alias("lost"))


LOST = f"""WITH d AS (SELECT doc_id, replace(upper(text), 'ẞ', 'SS') || chr(10) || 'SCÈNE II.' || chr(10) || 'ACTE I' AS a FROM documents), l AS (SELECT doc_id, {_CL("a")} AS l FROM d)
SELECT doc_id, array_to_string(l, '|') AS labels, array_to_string(list_filter(l, lambda x: x <> 'ACTE I'), '|') AS lost FROM l"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    schema = F.concat(F.when(F.col("doc_id") % 7 == 0, "other/").otherwise("repetition/"), (F.col("doc_id") % 4).cast("string"))
    return table(spark, sf, "documents").select("doc_id", Q.version_remedy(schema).alias("remedy"))


VERSIONS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'foreign_file' WHEN doc_id % 4 > 2 THEN 'reader_outdated' WHEN doc_id % 4 < 2 THEN 'file_outdated' END AS remedy FROM documents"


def _sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as work units: source is the book, every tenth failed, every seventh doubtful."""
    status = F.when(F.col("doc_id") % 10 == 0, "echec").when(F.col("doc_id") % 7 == 0, "suspect").otherwise("termine")
    return table(spark, sf, "documents").select(
        F.col("source").alias("book"), F.col("doc_id").alias("number"), status.alias("status"),
        (F.col("doc_id") % 4).cast("int").alias("retries")
    )


_SIDE = "s AS (SELECT source AS book, doc_id AS number, CASE WHEN doc_id % 10 = 0 THEN 'echec' WHEN doc_id % 7 = 0 THEN 'suspect' ELSE 'termine' END AS status, doc_id % 4 AS retries FROM documents)"


def pending_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units whose sidecar is not finished, or is missing, as for documents without a label."""
    units = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("number"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("number")).distinct()
    return G.pending(units, _sidecars(spark, sf).join(labelled, "number", "left_semi"), ["book", "number"])


PENDING = f"WITH {_SIDE} SELECT book, number FROM s WHERE number NOT IN (SELECT doc_id FROM labels) OR NOT (status = 'termine' OR (status = 'suspect' AND retries >= 2))"


def unit_counters(spark: SparkSession, sf: str) -> DataFrame:
    return G.counters(_sidecars(spark, sf), "book")


COUNTERS = f"""WITH {_SIDE} SELECT book, count(*) FILTER (status = 'termine') AS finished, count(*) FILTER (status = 'suspect') AS doubtful, count(*) FILTER (status = 'echec') AS failed,
min(number) FILTER (status = 'echec') AS first_failed, max(number) FILTER (status = 'echec') AS last_failed, grouping(book) = 1 AS is_total, count(*) FILTER (status <> 'termine') = 0 AS complete FROM s GROUP BY ROLLUP (book)"""


def junctions_left(spark: SparkSession, sf: str) -> DataFrame:
    side = _sidecars(spark, sf)
    return G.invalidated(side, side.filter("number % 50 = 0").select("book", "number"), "book", "number").select("book", "number")


JUNCTIONS = f"WITH {_SIDE}, c AS (SELECT book, unnest([number - 1, number]) AS number FROM s WHERE number % 50 = 0) SELECT book, number FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book = s.book AND c.number = s.number)"


def assembled_books(spark: SparkSession, sf: str) -> DataFrame:
    """Whole books, by pieces of consecutive units; pages without a text, as are some that the spine has besides, are marked."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("number"), "text")
    spine = docs.select("book", "number").unionByName(docs.filter("number % 50 = 0").select("book", (-F.col("number") - 1).alias("number")))
    return G.assembled(spine, docs, "book", "number", "text", "[PAGE %d — ÉCHEC OCR]", 200).select(
        "book", "piece", F.md5("content").alias("content"), F.length("content").cast("long").alias("chars")
    )


ASSEMBLED = """WITH s AS (SELECT source AS book, doc_id AS n, text FROM documents UNION ALL SELECT source, -doc_id - 1, NULL FROM documents WHERE doc_id % 50 = 0),
t AS (SELECT book, n, CAST(floor(n / 200.0) AS BIGINT) AS piece, CASE WHEN trim(coalesce(text, '')) <> '' THEN trim(text) ELSE '[PAGE ' || n || ' — ÉCHEC OCR]' END AS t FROM s), a AS (SELECT book, piece, string_agg(t, chr(10) || chr(10) ORDER BY n) AS c FROM t GROUP BY book, piece)
SELECT book, piece, md5(c) AS content, length(c) AS chars FROM a"""


def journal(spark: SparkSession, sf: str) -> DataFrame:
    return G.newest_calls(table(spark, sf, "events"), "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("calls"), F.min("event_id").alias("first_call"))


JOURNAL = "SELECT event_type, count(*) AS calls, min(event_id) AS first_call FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000) GROUP BY event_type"


def journal_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """An entry for every document, which its label replaces."""
    old = table(spark, sf, "documents").select("doc_id", F.lit(-1).cast("long").alias("quality"))
    return G.upserted(old, table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), ["doc_id"])


UPSERT = "SELECT doc_id, CAST(-1 AS BIGINT) AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, CAST(quality AS BIGINT) FROM labels"


def not_imported(spark: SparkSession, sf: str) -> DataFrame:
    return G.not_imported(table(spark, sf, "documents").select("doc_id", F.md5(X.slug(F.col("text"))).alias("slug")), table(spark, sf, "labels"), "doc_id")


NOT_IMPORTED = "SELECT doc_id, md5(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def routes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    route = G.transcript_route(F.coalesce("done", F.lit(False)), F.size(Q.text_layer_refusals(F.col("text"))) == 0, X.strip(F.col("text")) == "")
    return d.groupBy(F.col("source").alias("book"), route.alias("route")).agg(F.count("*").alias("pages"))


ROUTES = f"WITH {_LAYERS} SELECT source AS book, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' WHEN refusals = '' THEN 'text_layer' WHEN refusals = 'no text layer' THEN 'blank' ELSE 'model' END AS route, count(*) AS pages FROM r JOIN documents USING (doc_id) GROUP BY ALL"

QUERIES = {
    "text_layers": text_layers, "output_checks": output_checks, "mechanical_checks": mechanical_checks, "declarations": declarations,
    "lost_labels": lost_labels, "versions": versions, "pending_units": pending_units, "unit_counters": unit_counters,
    "junctions_left": junctions_left, "assembled_books": assembled_books, "journal": journal, "journal_upsert": journal_upsert,
    "not_imported": not_imported, "routes": routes
}
SQL = {
    "text_layers": LAYERS, "output_checks": OUTPUT, "mechanical_checks": MECHANICAL, "declarations": DECLARATIONS, "lost_labels": LOST,
    "versions": VERSIONS, "pending_units": PENDING, "unit_counters": COUNTERS, "junctions_left": JUNCTIONS, "assembled_books": ASSEMBLED,
    "journal": JOURNAL, "journal_upsert": UPSERT, "not_imported": NOT_IMPORTED, "routes": ROUTES
}
