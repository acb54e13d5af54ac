"""Pages, blocks, labels and typed lines of documents; intervals over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.operators import intervals as I
from quillstage.operators import lines as L
from quillstage.operators import structure as T
from quillstage.plans import sql as S
from quillstage.plans.plays import edited_plays
from quillstage.sources.tables import table

_NL = "chr(10)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.when(
        F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\n", "\n\n<<<PAGE_BREAK>>>\n\n")
    ).otherwise(F.concat(F.lit("[PAGE 1]\n"), F.regexp_replace("text", "\n", "\n[PAGE 2]\n")))
    return L.pages_of(table(spark, sf, "documents").withColumn("t", marked), "doc_id", "t")


_PAGES = f"""l AS (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents),
g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN len(l) = 1 THEN [{S.strip("l[1]")}] ELSE list_filter(list_transform(l, lambda x: {S.strip("x")}), lambda x: x <> '') END
ELSE list_transform(range(1, len(l) + 1), lambda i: {S.strip(f"CASE WHEN i = 1 THEN '[PAGE 1]' ELSE '[PAGE 2]' END || {_NL} || l[i]")}) END AS g FROM l),
p AS (SELECT doc_id, generate_subscripts(g, 1) AS page_no, unnest(g) AS page FROM g)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.md5("page").alias("page"))


PAGES = f"WITH {_PAGES} SELECT doc_id, page_no, md5(page) AS page FROM p"


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return L.blocks_of(_pages(spark, sf), "doc_id", 8).select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in ("block", "first_page", "last_page")), F.md5("content").alias("content")
    )


BLOCKS = f"""WITH {_PAGES} SELECT doc_id, (page_no - 1) // 8 + 1 AS block, min(page_no) AS first_page, max(page_no) AS last_page,
md5(string_agg(page, {_NL} || {_NL} || '<<<PAGE_BREAK>>>' || {_NL} || {_NL} ORDER BY page_no)) AS content FROM p GROUP BY doc_id, (page_no - 1) // 8"""


def play_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = T.classify_labels(edited_plays(spark, sf), "conv_id")
    return found.select("conv_id", "label", "shown", "type", "confidence", "occurrences", "speech_after")


LABELS = f"""WITH r AS (SELECT conv_id, role, count(*) AS n, count(*) FILTER (regexp_matches(regexp_replace(text, '[*]', '', 'g'), '[^{X.WS}]')) AS s FROM conversations GROUP BY ALL)
SELECT conv_id, upper(role) AS label, upper(role) AS shown, 'personnage' AS type, 'probable' AS confidence, n AS occurrences, s AS speech_after FROM r
UNION ALL SELECT DISTINCT conv_id, 'ACTE I', 'ACTE I', 'titre_acte', 'certaine', 1, 0 FROM conversations WHERE turn = 0"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping spans a document, of categories 1 to 3 by its length."""
    n = F.length("text")
    at = lambda a, b: (n * a / b).cast("long")
    bits = F.array(
        F.struct(at(1, 10).alias("start"), at(4, 10).alias("stop"), F.lit(1).alias("category")),
        F.struct(at(3, 10).alias("start"), at(6, 10).alias("stop"), F.lit(2).alias("category")),
        F.struct(at(8, 10).alias("start"), at(9, 10).alias("stop"), F.lit(3).alias("category"))
    )
    return table(spark, sf, "documents").select("doc_id", F.explode(bits).alias("s")).select("doc_id", "s.*").filter("start < stop")


_SPANS = "s AS (SELECT doc_id, unnest([1, 3, 8]) * length(text) // 10 AS start, unnest([4, 6, 9]) * length(text) // 10 AS stop, unnest([1, 2, 3]) AS category FROM documents), v AS (SELECT * FROM s WHERE start < stop)"


def united_spans(spark: SparkSession, sf: str) -> DataFrame:
    return I.united(_spans(spark, sf), "doc_id")


UNITED = f"""WITH {_SPANS}, m AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, i"""


def overlaid_spans(spark: SparkSession, sf: str) -> DataFrame:
    return I.overlaid(_spans(spark, sf).withColumn("priority", F.col("category")), "doc_id").withColumn("category", F.col("category").cast("long"))


OVERLAID = f"""WITH {_SPANS}, p AS (SELECT doc_id, max(start) FILTER (category = 1) AS a1, max(stop) FILTER (category = 1) AS b1, max(start) FILTER (category = 2) AS a2, max(stop) FILTER (category = 2) AS b2, max(start) FILTER (category = 3) AS a3, max(stop) FILTER (category = 3) AS b3 FROM v GROUP BY doc_id),
u AS (SELECT doc_id, a1 AS start, coalesce(least(b1, a2), b1) AS stop, 1 AS category FROM p UNION ALL SELECT doc_id, a2, b2, 2 FROM p UNION ALL SELECT doc_id, a3, b3, 3 FROM p) SELECT doc_id, CAST(category AS BIGINT) AS category, start, stop FROM u WHERE start < stop"""


def overlapping_spans(spark: SparkSession, sf: str) -> DataFrame:
    return I.overlapping(_spans(spark, sf), "doc_id").select("doc_id", "start", "stop", F.col("category").cast("long").alias("category"))


OVERLAPPING = f"WITH {_SPANS}, m AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v) SELECT doc_id, start, stop, CAST(category AS BIGINT) AS category FROM m WHERE start < m"


def category_at(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "documents").select(
        "doc_id",
        F.explode(F.array(F.lit(0).cast("long"), (F.length("text") * 35 / 100).cast("long"), (F.length("text") * 85 / 100).cast("long"))).alias("place")
    ).distinct()
    return I.category_at(points, _spans(spark, sf), "doc_id", "place").select("doc_id", "place", F.col("category").cast("long").alias("category"))


CATEGORY_AT = f"""WITH {_SPANS}, p AS (SELECT DISTINCT doc_id, unnest([0, length(text) * 35 // 100, length(text) * 85 // 100]) AS place FROM documents)
SELECT p.doc_id, place, CAST(coalesce(arg_min(category, (start, stop, category)), 0) AS BIGINT) AS category FROM p LEFT JOIN v ON p.doc_id = v.doc_id AND place >= start AND place < stop GROUP BY ALL"""


def words_cut(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _spans(spark, sf).join(docs, "doc_id").groupBy("category").agg(
        F.sum(I.words_inside(F.col("text"), F.col("start").cast("int"), F.col("stop").cast("int"), X.NONSPACE)).cast("long").alias("words"),
        F.sum(F.col("stop") - F.col("start")).cast("long").alias("chars")
    ).withColumn("category", F.col("category").cast("long"))


CUT = f"WITH {_SPANS} SELECT CAST(category AS BIGINT) AS category, CAST(sum(len(regexp_extract_all(substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), {S.q(X.NONSPACE)}))) AS BIGINT) AS words, CAST(sum(stop - start) AS BIGINT) AS chars FROM v JOIN documents USING (doc_id) GROUP BY category"


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Where a text's first twelve and last six characters stand, if they stand there alone."""
    t = F.col("text")
    found = lambda ends: I.anchored(ends["t"], ends["begin"], ends["end"])
    ends = F.struct(t.alias("t"), F.substring(t, F.lit(1), F.lit(12)).alias("begin"), F.substring(t, F.length(t) - 5, F.lit(6)).alias("end"))
    return table(spark, sf, "documents").select("doc_id", X.let(ends, found).alias("a")).select("doc_id", *(F.col(f"a.{c}").cast("long").alias(c) for c in ("start", "stop")), "a.fault")


ANCHORS = """WITH a AS (SELECT doc_id, text, substr(text, 1, 12) AS b, substr(text, length(text) - 5, 6) AS e FROM documents),
f AS (SELECT *, CASE WHEN instr(substr(text, instr(text, b) + 1), b) > 0 THEN 'begin not unique' WHEN instr(substr(text, instr(text, e) + 1), e) > 0 THEN 'end not unique' WHEN instr(text, e) - 1 + length(e) <= instr(text, b) - 1 THEN 'ends before it begins' END AS fault FROM a)
SELECT doc_id, CASE WHEN fault IS NULL THEN instr(text, b) - 1 END AS start, CASE WHEN fault IS NULL THEN instr(text, e) - 1 + length(e) END AS stop, fault FROM f"""


def line_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document as an anchor: where it stands, or that it stands more than once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("number", "begin")).filter("begin <> ''").withColumn("end", F.lit(None).cast("string"))
    return I.located(docs, lines, "doc_id")


LINE_ANCHORS = f"""WITH {S.LINES}, a AS (SELECT doc_id, line_no AS number, line, text, instr(text, line) AS p FROM lines JOIN documents USING (doc_id) WHERE line <> ''),
f AS (SELECT *, instr(substr(text, p + 1), line) > 0 AS twice FROM a)
SELECT doc_id, number, CASE WHEN NOT twice THEN p - 1 END AS start, CASE WHEN NOT twice THEN p - 1 + length(line) END AS stop, CASE WHEN twice THEN 'begin not unique' END AS fault FROM f"""


QUERIES = {
    "pages": pages, "page_blocks": page_blocks, "play_labels": play_labels, "united_spans": united_spans, "overlaid_spans": overlaid_spans,
    "overlapping_spans": overlapping_spans, "category_at": category_at, "words_cut": words_cut, "anchors": anchors, "line_anchors": line_anchors
}
SQL = {
    "pages": PAGES, "page_blocks": BLOCKS, "play_labels": LABELS, "united_spans": UNITED, "overlaid_spans": OVERLAID,
    "overlapping_spans": OVERLAPPING, "category_at": CATEGORY_AT, "words_cut": CUT, "anchors": ANCHORS, "line_anchors": LINE_ANCHORS
}
