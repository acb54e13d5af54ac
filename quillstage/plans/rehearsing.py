"""Cues over conversations; recitation history over events: a user is a speech, a value a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import speech as P
from quillstage.functions import text as X
from quillstage.operators import rehearsal as R
from quillstage.plans import sql as S
from quillstage.plans.text import FRENCH
from quillstage.sources import store
from quillstage.sources.tables import table
from quillstage.streaming import recitations as stream

#: The clock of the queries, in milliseconds.
NOW = 1_735_689_600_000
_H = "h AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, least(100.0, value) AS score, event_id FROM events)"
_R = f"{_H}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms DESC, event_id DESC) AS rank FROM h) WHERE rank <= 10)"
_P = f"""{_R}, p AS (SELECT user_id, count(*) AS attempts, coalesce(min(rank) FILTER (score < 90) - 1, count(*)) AS streak, count(*) FILTER (score >= 90) AS successes, max(at_ms) AS last_at, max(score) FILTER (rank = 1) AS last_score FROM r GROUP BY user_id),
q AS (SELECT *, CASE WHEN streak >= 3 THEN last_at + CAST([7, 16, 35][least(streak - 3, 2) + 1] AS BIGINT) * 86400000 END AS due_at FROM p),
g AS (SELECT *, CASE WHEN streak >= 3 THEN CASE WHEN {NOW} <= due_at THEN 'maitrisee' ELSE 'a_reviser' END WHEN successes >= 3 THEN 'a_reviser' ELSE 'en_cours' END AS status FROM q)"""
_D = f"0.7 * least(1.0, greatest(0.0, (100 - last_score) / 100.0)) + 0.3 * least(1.0, greatest(0.0, ({NOW} - last_at) / 86400000.0) / 30.0)"


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("role") == "system", "didascalie").when(F.col("turn") % 7 == 6, "lieu").otherwise("replique").alias("type"), "text"
    )


def cues(spark: SparkSession, sf: str) -> DataFrame:
    mine = R.is_mine(F.when(F.col("turn") % 5 == 4, F.array(F.lit("*"))).otherwise(F.array("role")), ["assistant"])
    return R.cues(_elements(spark, sf), ["conv_id"], "turn", mine).select("conv_id", "turn", "cue_type", X.last_words(F.col("cue_text"), 5).alias("cue"), "cue_reason")


CUES = f"""WITH e AS (SELECT *, CASE WHEN role = 'system' THEN 'didascalie' WHEN turn % 7 = 6 THEN 'lieu' ELSE 'replique' END AS type, (turn % 5 = 4 OR role = 'assistant') AS mine FROM conversations),
c AS (SELECT *, last_value(CASE WHEN type = 'replique' THEN mine END IGNORE NULLS) OVER w AS lm, last_value(CASE WHEN type <> 'lieu' THEN type END IGNORE NULLS) OVER w AS ct, last_value(CASE WHEN type <> 'lieu' THEN text END IGNORE NULLS) OVER w AS cx
FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, (coalesce(lm, false) OR ct IS NULL) AS none, {S.tokens("cx")} AS t FROM c WHERE type = 'replique' AND mine)
SELECT conv_id, turn, CASE WHEN none THEN 'aucun' ELSE ct END AS cue_type, CASE WHEN NOT none THEN array_to_string(t[greatest(1, len(t) - 4):], ' ') END AS cue,
CASE WHEN coalesce(lm, false) THEN 'enchainement' WHEN ct IS NULL THEN 'debut_unite' END AS cue_reason FROM d"""


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    mine = _elements(spark, sf).filter("role = 'assistant'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return R.neighbours(mine, ["conv_id"], "turn", "id").select("conv_id", "turn", "previous_id", "next_id")


NEIGHBOURS = "SELECT conv_id, turn, lag(conv_id || '-' || turn) OVER w AS previous_id, lead(conv_id || '-' || turn) OVER w AS next_id FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def _history_of(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at_ms"),
        F.least(F.lit(100.0), F.col("value")).alias("score"), "event_id"
    )


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return _history_of(table(spark, sf, "events"))


def newest_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.newest(_history(spark, sf), ["user_id"], "at_ms", "event_id").select(
        "user_id", F.col("rank").cast("long").alias("rank"), "at_ms", "score", (F.col("rank") == 1).alias("may_be_corrected")
    )


NEWEST = f"WITH {_R} SELECT user_id, rank, at_ms, score, rank = 1 AS may_be_corrected FROM r"


def _progress_of(history: DataFrame) -> DataFrame:
    return R.progress(R.newest(history, ["user_id"], "at_ms", "event_id"), ["user_id"], "at_ms", "score", F.lit(NOW))


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    return _progress_of(_history(spark, sf))


PROGRESS = f"WITH {_P} SELECT user_id, attempts, streak, successes, last_at, last_score, due_at, status FROM g"


def lapsed_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every speech when a stream of its recitations has been read: mastered ones lapse by timers as the watermark passes."""
    at_rest = table(spark, sf, "events")
    source = spark.readStream.schema(at_rest.schema)
    if at_rest.inputFiles()[0].endswith("/events.parquet"):  # a single file: a stream's source is a folder
        events = source.option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        events = source.parquet(f"{sf.rstrip('/')}/events.parquet")
    return stream.settled(spark, events).select("user_id", "status", *(F.col(c).cast("long").alias(c) for c in ("streak", "successes", "attempts", "due_at")))


LAPSED = f"""WITH {_P}, n AS (SELECT max(at_ms) - 86400000 AS now FROM h)
SELECT user_id, CASE WHEN streak >= 3 THEN CASE WHEN greatest(now, last_at) <= due_at THEN 'maitrisee' ELSE 'a_reviser' END WHEN successes >= 3 THEN 'a_reviser' ELSE 'en_cours' END AS status, streak, successes, attempts, due_at FROM q, n"""


def revision_queue(spark: SparkSession, sf: str) -> DataFrame:
    hard = _progress(spark, sf).withColumn("difficulty", F.round(R.difficulty(F.col("last_score"), F.col("last_at"), F.lit(NOW)), 9))
    days = F.floor((F.lit(NOW) - F.col("last_at")) / float(R.DAY)).cast("long")
    why = F.concat(
        F.floor(F.col("last_score") + 0.5).cast("string"), F.lit(" % · "),
        F.when(days <= 0, "aujourd'hui").when(days == 1, "hier").otherwise(F.concat(F.lit("il y a "), days.cast("string"), F.lit(" j")))
    )
    return hard.orderBy(F.desc("difficulty"), "user_id").limit(R.QUEUE).select("user_id", "difficulty", "status", why.alias("why"))


QUEUE = f"""WITH {_P}, d AS (SELECT *, round({_D}, 9) AS difficulty, CAST(floor(({NOW} - last_at) / 86400000.0) AS BIGINT) AS days FROM g)
SELECT user_id, difficulty, status, CAST(floor(last_score + 0.5) AS BIGINT) || ' % · ' || CASE WHEN days <= 0 THEN 'aujourd''hui' WHEN days = 1 THEN 'hier' ELSE 'il y a ' || days || ' j' END AS why FROM d ORDER BY difficulty DESC, user_id LIMIT 12"""


def spot_check(spark: SparkSession, sf: str) -> DataFrame:
    per = _progress(spark, sf).withColumns({"weight": F.round(R.spot_weight(F.col("last_at"), F.lit(NOW)), 6), "part": F.col("user_id") % 4})
    return R.drawn(per, ["part"], "user_id", "weight", F.lit(0.37)).select("part", "user_id", "weight")


SPOT = f"""WITH {_P}, w AS (SELECT user_id % 4 AS part, user_id, round(greatest(1.0, greatest(0, {NOW} - last_at) / 86400000.0), 6) AS weight FROM g),
s AS (SELECT *, sum(weight) OVER (PARTITION BY part ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY part) AS a FROM w)
SELECT part, user_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY user_id) AS n FROM s WHERE s > 0.37 * a) WHERE n = 1"""


def status_report(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.explode(F.array("user_id", F.col("user_id") + 1000)).alias("user_id")).distinct()
    status = users.join(_progress(spark, sf), "user_id", "left").withColumn("status", F.coalesce("status", F.lit("a_apprendre")))
    return status.groupBy("status").agg(F.count("*").alias("speeches")).withColumn("total", F.sum("speeches").over(W.partitionBy()).cast("long"))


REPORT = f"WITH {_P}, u AS (SELECT DISTINCT unnest([user_id, user_id + 1000]) AS user_id FROM events), s AS (SELECT coalesce(status, 'a_apprendre') AS status, count(*) AS speeches FROM u LEFT JOIN g USING (user_id) GROUP BY 1) SELECT *, CAST(sum(speeches) OVER () AS BIGINT) AS total FROM s"


def unit_status(spark: SparkSession, sf: str) -> DataFrame:
    per = _progress(spark, sf).withColumn("unit", F.col("user_id") % 20)
    return R.worst_status(per.withColumn("status", F.when(F.col("user_id") % 37 == 0, "unknown").otherwise(F.col("status"))), "unit")


_ORDER = "['a_apprendre', 'en_cours', 'a_reviser', 'maitrisee']"
UNIT_STATUS = f"WITH {_P} SELECT user_id % 20 AS unit, {_ORDER}[min(CASE WHEN user_id % 37 = 0 THEN 1 ELSE list_position({_ORDER}, status) END)] AS status FROM g GROUP BY 1"


def merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf).withColumn("at_ms", (F.col("at_ms") / 3_600_000).cast("long"))
    return R.merged_scores(
        h.filter("event_id % 2 = 0"), h.filter("event_id % 2 = 1"), ["user_id"], "at_ms", "score"
    ).select("user_id", F.col("rank").cast("long").alias("rank"), "at_ms", "score")


MERGED = f"""WITH {_H}, b AS (SELECT user_id, at_ms // 3600000 AS at_ms, score, event_id % 2 AS side FROM h), o AS (SELECT user_id, at_ms, arg_max(score, (side, score)) AS score FROM b GROUP BY ALL)
SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_ms DESC, score DESC) AS rank, at_ms, score FROM o) WHERE rank <= 10"""


def merged_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress by clicks and views merged with that by all other events."""
    events, looks = table(spark, sf, "events"), F.col("event_type").isin("click", "view")
    local, imported = (_progress_of(_history_of(events.filter(side))).select("user_id", "status", F.col("last_at").alias("checked_at")) for side in (looks, ~looks))
    return R.merged_progress(local, imported, ["user_id"])


def stored_progress(spark: SparkSession, sf: str) -> DataFrame:
    """A store of progress by clicks and views into which that by all other events is merged."""
    events, looks = table(spark, sf, "events"), F.col("event_type").isin("click", "view")
    local, imported = (_progress_of(_history_of(events.filter(side))).select("user_id", "status", F.col("last_at").alias("checked_at")) for side in (looks, ~looks))
    kept = store.stored(local, ["user_id"])
    kept.merge(imported, R.merged_progress)
    return kept.rows()


def _side(of: str) -> str:
    return f"""(WITH {_P.replace("FROM events", f"FROM events WHERE {of}")} SELECT user_id, status, last_at AS c FROM g)"""


MERGED_PROGRESS = f"""WITH a AS {_side("event_type IN ('click', 'view')")}, b AS {_side("event_type NOT IN ('click', 'view')")}
SELECT coalesce(a.user_id, b.user_id) AS user_id, {_ORDER}[greatest(coalesce(list_position({_ORDER}, a.status), 1), coalesce(list_position({_ORDER}, b.status), 1))] AS status, greatest(a.c, b.c) AS checked_at FROM a FULL JOIN b ON a.user_id = b.user_id"""


#: Words as a recitation is judged by them, from a text: no accents, case or points, numbers and abbreviations in full.
_POINTS = "[.,;:!?…«»\"“”()\\[\\]{}—–\\-*]"
_SHORT = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SHORT.items()) + " ELSE w END"
_IN_FULL = f"CASE WHEN regexp_matches(w, '^[0-9]+$') AND try_cast(w AS BIGINT) < 1000 THEN {FRENCH}[try_cast(w AS BIGINT) + 1] ELSE {_SHORT} END"


def _normal(x: str) -> str:
    bare = f"regexp_replace(lower(strip_accents(regexp_replace({x}, '[’‘‛`]', '''', 'g'))), {S.q(_POINTS)}, ' ', 'g')"
    return f"flatten(list_transform({S.tokens(bare)}, lambda w: string_split({_IN_FULL}, ' ')))"


def recitations(spark: SparkSession, sf: str) -> DataFrame:
    """What is said, recited without the words that begin with w and with another word for those that begin with v."""
    said = table(spark, sf, "conversations")
    left = F.filter(X.tokens(F.col("text")), lambda w: ~F.lower(w).startswith("w"))
    heard = F.array_join(F.transform(left, lambda w: F.when(F.lower(w).startswith("v"), "zzz").otherwise(w)), " ")
    rows = said.select("conv_id", "turn", P.compare("text", heard).alias("r")).select("conv_id", "turn", "r.*")
    return rows.select(
        "conv_id", "turn", *(F.col(c).cast("long").alias(c) for c in ("score", "expected", "correct", "added", "judged")),
        P.band(F.col("score")).alias("band")
    )


RECITATIONS = f"""WITH t AS (SELECT conv_id, turn, unnest({S.tokens("text")}) AS t, generate_subscripts({S.tokens("text")}, 1) AS i FROM conversations),
n AS (SELECT conv_id, turn, i, len({_normal("t")}) AS n, CASE WHEN starts_with(lower(t), 'w') THEN 0 WHEN starts_with(lower(t), 'v') THEN 1 ELSE 2 END AS k FROM t),
g AS (SELECT *, sum(CASE WHEN k = 2 THEN n ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM n),
m AS (SELECT conv_id, turn, sum(n) AS e, sum(n) FILTER (k = 2) AS c, greatest(count(*) FILTER (k = 1) - 1, 0) AS a FROM g GROUP BY conv_id, turn, g),
s AS (SELECT conv_id, turn, CAST(sum(e) AS BIGINT) AS expected, CAST(coalesce(sum(c), 0) AS BIGINT) AS correct, CAST(sum(a) AS BIGINT) AS added FROM m GROUP BY conv_id, turn),
p AS (SELECT *, expected + added AS judged, CASE WHEN expected = 0 THEN 0 ELSE CAST(floor(100 * correct / (expected + added) + 0.5) AS BIGINT) END AS score FROM s)
SELECT conv_id, turn, score, expected, correct, added, judged, CASE WHEN score >= 90 THEN 'haut' WHEN score >= 60 THEN 'moyen' ELSE 'bas' END AS band FROM p"""


def hidden_words(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").withColumn("n", F.size(X.word_places(F.col("text"))))
    key = F.concat(F.lit("r_"), F.col("conv_id").cast("string"), F.lit("|45|0"))
    return said.select(
        "conv_id", "turn", F.col("n").cast("long").alias("n"),
        F.array_join(F.transform(P.holes("n", F.lit(45), key), lambda i: i.cast("string")), ",").alias("holes")
    )


_MUL = lambda x, y: f"CAST(CAST({x} AS HUGEINT) * CAST({y} AS HUGEINT) % 4294967296 AS BIGINT)"
HIDDEN = f"""WITH RECURSIVE s AS (SELECT conv_id, turn, CAST(len(list_filter({S.tokens("text")}, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS n,
CAST(list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split('r_' || conv_id || '|45|0', ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT) AS seed FROM conversations),
w AS (SELECT *, CASE WHEN n > 0 THEN greatest(1, CAST(floor(n * 45 / 100 + 0.5) AS BIGINT)) ELSE 0 END AS m FROM s),
f AS (SELECT conv_id, turn, n, m, CAST(0 AS BIGINT) AS i, range(n) AS p, seed AS st FROM w UNION ALL
SELECT conv_id, turn, n, m, i + 1, list_transform(p, lambda x, k: CASE WHEN k = i + 1 THEN p[j + 1] WHEN k = j + 1 THEN p[i + 1] ELSE x END), st
FROM (SELECT *, i + CAST(floor(CAST(xor(y, y >> 14) AS DOUBLE) / CAST(4294967296 AS DOUBLE) * (n - i)) AS BIGINT) AS j
FROM (SELECT *, xor(x, (x + {_MUL("xor(x, x >> 7)", "(x | 61)")}) % 4294967296) AS y
FROM (SELECT *, {_MUL("xor(st, st >> 15)", "(st | 1)")} AS x FROM (SELECT conv_id, turn, n, m, i, p, (st + 1831565813) % 4294967296 AS st FROM f WHERE i < m)))))
SELECT conv_id, turn, n, array_to_string(list_sort(p[1:m]), ',') AS holes FROM f WHERE i = m"""


def phonetic_keys(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations")
    return said.select(
        "conv_id", "turn", F.array_join(P.sounds("text"), " ").alias("sounds"),
        F.array_join(F.transform(P.normalised("text"), P.sound_column), " ").alias("by_columns")
    )


#: Sounds of words w in steps; what ends in ai, ei or es before no letter is hidden while the others are replaced.
_STEPS = [
    "regexp_replace(replace(k, '''', ''), 'eaux?', 'o', 'g')", "replace(replace(replace(k, 'au', 'o'), 'ph', 'f'), 'qu', 'k')", "replace(regexp_replace(k, 'c([ei])', 's\\1', 'g'), 'c', 'k')",
    *(f"regexp_replace(k, '{x}([^a-z\\x01-\\x03]|$)', chr({i}) || '\\1', 'g')" for i, x in enumerate(("ai", "ei", "es"), 1)), "regexp_replace(k, '(ai|ei|es)', 'e', 'g')",
    "replace(replace(replace(k, chr(1), 'ai'), chr(2), 'ei'), chr(3), 'es')", "replace(k, 'h', '')", "array_to_string(list_filter(string_split(k, ''), lambda c, i: i = 1 OR c <> string_split(k, '')[i - 1]), '')",
    "regexp_replace(k, '^(.+?)[stdxzpg]+$', '\\1')", "regexp_replace(k, '^(..+)e$', '\\1')",
]
_SOUNDED = "SELECT *, w AS k FROM w"
for _step in _STEPS:
    _SOUNDED = f"SELECT * REPLACE ({_step} AS k) FROM ({_SOUNDED})"
PHONETIC = f"""WITH l AS (SELECT conv_id, turn, {_normal("text")} AS l FROM conversations), w AS (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l),
s AS (SELECT conv_id, turn, string_agg(CASE WHEN k = '' THEN w ELSE k END, ' ' ORDER BY i) AS s FROM ({_SOUNDED}) GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(s, '') AS sounds, coalesce(s, '') AS by_columns FROM conversations LEFT JOIN s USING (conv_id, turn)"""


QUERIES = {
    "cues": cues, "neighbours": neighbours, "newest_scores": newest_scores, "progress": _progress, "revision_queue": revision_queue,
    "lapsed_status": lapsed_status, "spot_check": spot_check, "status_report": status_report, "unit_status": unit_status, "merged_scores": merged_scores,
    "merged_progress": merged_progress, "stored_progress": stored_progress, "recitations": recitations, "hidden_words": hidden_words, "phonetic_keys": phonetic_keys
}
SQL = {
    "cues": CUES, "neighbours": NEIGHBOURS, "newest_scores": NEWEST, "progress": PROGRESS, "revision_queue": QUEUE, "spot_check": SPOT, "lapsed_status": LAPSED,
    "status_report": REPORT, "unit_status": UNIT_STATUS, "merged_scores": MERGED, "merged_progress": MERGED_PROGRESS, "stored_progress": MERGED_PROGRESS,
    "recitations": RECITATIONS, "hidden_words": HIDDEN, "phonetic_keys": PHONETIC
}
