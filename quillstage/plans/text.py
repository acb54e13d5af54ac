"""Scalar functions over lines, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import numbers as N
from quillstage.functions import text as X
from quillstage.operators import lines as L
from quillstage.operators import reading as R
from quillstage.operators import search as Q
from quillstage.plans import sql as S
from quillstage.sources.tables import table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines_of(table(spark, sf, "documents"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))


def line_shapes(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, sf).select(
        "doc_id", "line_no", X.is_separator(line).alias("separator"), X.bold(line).alias("bold"), X.italic(line).alias("italic"),
        X.is_speech(line).alias("speech"), X.without_markers(line).alias("bare"), X.is_structure_label(line).alias("structure")
    )


LINE_SHAPES = f"""WITH {S.LINES} SELECT doc_id, line_no, {S.separator("line")} AS separator, {S.bold("line")} AS bold, {S.italic("line")} AS italic,
{S.speech("line")} AS speech, coalesce({S.bold("line")}, {S.italic("line")}, {S.strip("line")}) AS bare,
(NOT contains(line, '<<<') AND NOT regexp_matches({S.strip("line")}, {S.q(X.PAGE_MARK)}) AND length({S.strip("line")}) <= 40 AND length({S.letters("line")}) >= 3
 AND regexp_matches({S.letters("line")}, '^\\p{{Lu}}+$')) AS structure FROM lines"""


def name_predicates(spark: SparkSession, sf: str) -> DataFrame:
    word = F.get(F.split("line", " "), F.lit(0))
    return _lines(spark, sf).withColumn("w", word).select(
        "doc_id", "line_no", "w", X.is_name(F.col("w")).alias("is_name"), X.may_be_name(F.col("w")).alias("may_be_name"),
        X.starts_small(F.col("w")).alias("starts_small"), X.has_word_of(F.upper("line"), ["THE", "LA", "DER"]).alias("in_lexicon")
    )


NAMES = f"""WITH {S.LINES}, w AS (SELECT doc_id, line_no, line, string_split(line, ' ')[1] AS w FROM lines)
SELECT doc_id, line_no, w, {S.is_name("w")} AS is_name,
(length({S.letters("w")}) >= 2 AND length(w) <= 40 AND regexp_matches(w[1], '^\\p{{Lu}}')) AS may_be_name,
regexp_matches(regexp_extract(w, '[\\p{{L}}\\p{{Nd}}]', 0), '\\p{{Ll}}') AS starts_small,
list_has_any(string_split(upper(line), ' '), ['THE', 'LA', 'DER']) AS in_lexicon FROM w"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(
        "doc_id", "line_no", X.label(F.col("line")).alias("label"), X.slug(F.col("line")).alias("slug"),
        R.piece_slug(F.col("line")).alias("piece_slug"), X.canonical_role(F.col("line")).alias("role")
    )


LABELS = f"""WITH {S.LINES} SELECT doc_id, line_no, {S.label("line")} AS label,
regexp_replace(regexp_replace(lower(strip_accents(line)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(strip_accents(lower(line)), ' ', '-') AS piece_slug,
replace(upper(replace({S.strip(f"regexp_replace({S.strip(f'regexp_split_to_array(line, {S.q(f"[{X.WS}]*[\\[(]")})[1]')}, {S.q(X.TRAILING_POINTS)}, '')")}, '’', '''')), 'ẞ', 'SS') AS role FROM lines"""


def counted_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    odd = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("[PAGE 3]\n"), "text", F.lit(" \n<<<PAGE_BREAK>>>\n *x*")))
    return odd.select(
        "doc_id", F.md5(X.for_counting(t)).alias("counting"), F.md5(X.for_comparison(t)).alias("comparison"),
        F.md5(X.speech_key(t)).alias("speech_key"), X.stars_outside_separators(t).cast("long").alias("stars")
    )


COUNTED = f"""WITH d AS (SELECT doc_id, '[PAGE 3]' || chr(10) || text || ' ' || chr(10) || '<<<PAGE_BREAK>>>' || chr(10) || ' *x*' AS text FROM documents)
SELECT doc_id, md5({S.for_counting("text")}) AS counting, md5({S.squeeze(f"replace({S.for_counting('text')}, '*', '')")}) AS comparison, md5({S.speech_key("text")}) AS speech_key,
CAST(list_sum(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {S.separator("x")} THEN 0 ELSE length(x) - length(replace(x, '*', '')) END)) AS BIGINT) AS stars FROM d"""


def speech_ids(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").withColumn("k", X.speech_key(F.col("text")))
    nth = F.row_number().over(W.partitionBy("role", "k").orderBy("conv_id", "turn")) - 1
    return said.withColumn("occurrence", nth.cast("long")).select(
        "conv_id", "turn", "occurrence", X.speech_id(F.array("role"), F.col("text"), F.col("occurrence")).alias("id")
    )


SPEECH_IDS = f"""WITH s AS (SELECT *, {S.speech_key("text")} AS k FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY role, k ORDER BY conv_id, turn) - 1 AS occurrence FROM s)
SELECT conv_id, turn, occurrence, 'r_' || left(sha1(role || '|' || k || CASE WHEN occurrence > 0 THEN '|' || occurrence ELSE '' END), 12) AS id FROM o"""


def speakers(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations")
    raw = F.when(F.col("turn") % 7 == 3, "Tous.").when(
        F.col("turn") % 3 == 1, F.concat("role", F.lit(" (aside) et L’"), F.upper("role"), F.lit(" : "))
    ).otherwise(F.concat("role", F.lit(" [low] / Bob!")))
    named = said.withColumn("raw", raw)
    return named.select(
        "conv_id", "turn", "raw", X.speaker(F.col("raw")).alias("speaker"), F.array_join(X.speakers(F.col("raw")), "|").alias("speakers"),
        F.array_join(X.asides_of(F.col("raw")), "|").alias("asides"), X.speakers_label(X.speakers(F.col("raw"))).alias("label")
    )


def _speaker_sql(x: str) -> str:
    bare = S.squeeze(f"regexp_replace({x}, '[\\[(][^\\])]*[\\])]', ' ', 'g')")
    return S.strip(f"replace(regexp_replace({bare}, {S.q(X.TRAILING_POINTS)}, ''), '’', '''')")


_ET = S.q(f"(?i)[{X.WS}]*/[{X.WS}]*|[{X.WS}]+et[{X.WS}]+")
SPEAKERS = f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'Tous.' WHEN turn % 3 = 1 THEN role || ' (aside) et L’' || upper(role) || ' : ' ELSE role || ' [low] / Bob!' END AS raw FROM conversations),
s AS (SELECT *, {_speaker_sql("raw")} AS speaker FROM r),
p AS (SELECT *, CASE WHEN upper(speaker) = 'TOUS' THEN ['*'] ELSE list_transform(regexp_split_to_array(raw, {_ET}), lambda x: {_speaker_sql("x")}) END AS people FROM s)
SELECT conv_id, turn, raw, speaker, array_to_string(people, '|') AS speakers, array_to_string(list_transform(regexp_extract_all(raw, '[\\[(]([^\\])]*)[\\])]', 1), lambda x: {S.strip("x")}), '|') AS asides,
CASE WHEN list_contains(people, '*') THEN 'TOUS' ELSE array_to_string(people, ' / ') END AS label FROM p"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    t, w = F.col("text"), F.col("w")
    docs = table(spark, sf, "documents").select("doc_id", "text", X.tokens(t).alias("w"))
    counts = {
        "balance_words": X.balance_words(t), "tokens": F.size(w), "stretches": X.stretches(t), "real_words": F.size(X.real_places(w)),
        "lines": F.size(F.split(t, "\n", -1)),
    }
    return docs.select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()))


WORDS = f"""SELECT doc_id, CAST(len(regexp_extract_all(text, {S.q(X.BALANCE_WORD)})) AS BIGINT) AS balance_words, CAST(len({S.tokens("text")}) AS BIGINT) AS tokens,
CAST(len(regexp_extract_all(text, {S.q(X.NONSPACE)})) AS BIGINT) AS stretches, CAST(len(list_filter({S.tokens("text")}, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS real_words,
CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents"""


def openings(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.opening(t, 3).alias("opening"), X.opening_is_all(t, 3).alias("is_all"), X.last_words(t, 5).alias("cue"),
        F.md5(X.initials(t)).alias("initials"), X.excerpt(t).alias("excerpt")
    )


OPENINGS = f"""WITH t AS (SELECT conv_id, turn, text, {S.tokens("text")} AS t FROM conversations),
p AS (SELECT *, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN regexp_matches(t[i], '[\\p{{L}}\\p{{N}}]') THEN i END), lambda i: i IS NOT NULL) AS p FROM t)
SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(t[1:p[least(3, len(p))]], ' ') END AS opening, len(p) <= 3 AS is_all,
array_to_string(t[greatest(1, len(t) - 4):], ' ') AS cue, md5(regexp_replace(text, '(\\p{{L}}\\p{{M}}*)[\\p{{L}}\\p{{M}}]*', '\\1', 'g')) AS initials,
CASE WHEN length({S.squeeze("text")}) > 60 THEN left({S.squeeze("text")}, 59) || '…' ELSE {S.squeeze("text")} END AS excerpt FROM p"""


def unit_titles(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id").distinct()
    act = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("ACTE "), (F.col("conv_id") % 5).cast("string")))
    scene = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Scène "), (F.col("conv_id") % 4).cast("string")))
    unit = F.format_string("u%03d", F.col("conv_id"))
    return said.select("conv_id", X.unit_label(act, scene, unit).alias("label"), X.unit_title(act, scene, F.col("conv_id") % 6 == 3).alias("title"))


TITLES = """WITH u AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN 'ACTE ' || conv_id % 5 END AS a, CASE WHEN conv_id % 2 = 0 THEN 'Scène ' || conv_id % 4 END AS s FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, coalesce(nullif(concat_ws(' - ', a, s), ''), 'Unité sans titre') || ' [' || printf('u%03d', conv_id) || ']' AS label, CASE WHEN conv_id % 6 <> 3 THEN coalesce(s, a) END AS title FROM u"""


def numerals(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("event_id") % 1000).cast("int")
    roman = F.concat(F.repeat(F.lit("X"), (n / 10).cast("int") % 4), F.get(F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), n % 10))
    written = F.get(F.array(*map(F.lit, ["UN", "DEUX", "TROISIEME", "SEIZE", "VINGT"])), n % 5)
    label = F.when(n % 4 == 0, roman).when(n % 4 == 1, F.concat(n.cast("string"), F.lit(" - Titre"))).when(n % 4 == 2, written).otherwise(F.concat(F.lit("SIR "), roman))
    e = table(spark, sf, "events").withColumn("label", label)
    return e.select(
        "event_id", "label", N.numeral_style(F.col("label")).alias("style"), N.numeral_value(F.col("label")).cast("long").alias("value"),
        N.in_words(n).alias("in_words")
    )


FRENCH = "[" + ", ".join(S.q(N.french(i)) for i in range(1000)) + "]"
NUMERALS = f"""WITH e AS (SELECT event_id, event_id % 1000 AS n, repeat('X', CAST((event_id % 1000) // 10 % 4 AS BIGINT)) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][event_id % 1000 % 10 + 1] AS r FROM events),
l AS (SELECT event_id, n, CASE n % 4 WHEN 0 THEN r WHEN 1 THEN n || ' - Titre' WHEN 2 THEN ['UN', 'DEUX', 'TROISIEME', 'SEIZE', 'VINGT'][n % 5 + 1] ELSE 'SIR ' || r END AS label, r FROM e)
SELECT event_id, label, CASE WHEN n % 4 = 2 THEN 'ecrit' WHEN n % 4 = 1 THEN 'arabe' WHEN n % 4 = 0 AND r <> '' THEN 'romain' END AS style,
CASE WHEN n % 4 = 2 THEN [1, 2, 3, 16, 20][n % 5 + 1] WHEN n % 4 = 1 THEN n WHEN n % 4 = 0 AND r <> '' THEN n // 10 % 4 * 10 + n % 10 END AS value, {FRENCH}[n + 1] AS in_words FROM l"""


def formats(spark: SparkSession, sf: str) -> DataFrame:
    n, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        "event_id", N.half_up(v).cast("long").alias("rounded"), N.per_cent(v).cast("long").alias("per_cent"),
        N.back_off((n % 6 + 1).cast("int")).alias("wait"), N.thousands(n).alias("grouped"), N.duration(n * 7).alias("lasted"),
        N.lower_dpi((n % 300 + 100).cast("int")).cast("long").alias("dpi")
    )


FORMATS = """SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS rounded, CAST(greatest(0, least(100, floor(value + 0.5))) AS BIGINT) AS per_cent,
least(60.0, 5.0 * pow(2.0, event_id % 6)) AS wait, replace(format('{:,}', event_id), ',', ' ') AS grouped,
CASE WHEN s >= 3600 THEN s // 3600 || ' h ' || printf('%02d', s % 3600 // 60) || ' min' WHEN s >= 60 THEN s // 60 || ' min ' || printf('%02d', s % 60) || ' s' ELSE s || ' s' END AS lasted,
CAST(greatest(110, floor((event_id % 300 + 100) * 0.75)) AS BIGINT) AS dpi FROM (SELECT *, event_id * 7 AS s FROM events)"""


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("<<<SOURCE>>>\n"), "text", F.lit("\n<<<FIN_SOURCE>>>"))
    ).otherwise(F.concat(F.lit("ﬁn  \n\n\n\n"), "text"))
    w = table(spark, sf, "documents").withColumn("w", wrapped)
    return w.select(
        "doc_id", F.md5(X.without_envelope(F.col("w"))).alias("reply"), F.md5(X.text_layer(F.col("w"))).alias("layer"),
        F.md5(X.straight(F.col("w"))).alias("straight")
    )


_LIG = "w"
for _a, _b in X.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"
ENVELOPES = f"""WITH w AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '```text' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '<<<SOURCE>>>' || chr(10) || text || chr(10) || '<<<FIN_SOURCE>>>' ELSE 'ﬁn  ' || repeat(chr(10), 4) || text END AS w FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN {S.strip("w")} ELSE {S.strip("text")} END) AS reply,
md5({S.strip(f"regexp_replace(regexp_replace({_LIG}, '[ \\t\\r\\f\\x0b\\x{{a0}}]+(' || chr(10) || '|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS layer,
md5(translate(w, '’‘  ' || chr(13), '''''   ')) AS straight FROM w"""


def windows_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    (a, b), (c, d) = L.tail_window(t, 3), L.head_window(t, 2)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(a).alias("before_tail"), F.md5(b).alias("tail"), F.md5(c).alias("head"), F.md5(d).alias("after_head"),
        F.md5(L.assembled(F.split(t, "\n", -1))).alias("assembled"), F.md5(L.rejoined(a, b)).alias("rejoined")
    )


_NL = "chr(10)"
WINDOWS = f"""WITH l AS (SELECT doc_id, text, string_split(text, {_NL}) AS l FROM documents),
w AS (SELECT *, CASE WHEN len(l) <= 3 THEN '' ELSE array_to_string(l[1:len(l) - 3], {_NL}) END AS a, CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(l[len(l) - 2:], {_NL}) END AS b,
CASE WHEN len(l) <= 2 THEN text ELSE array_to_string(l[1:2], {_NL}) END AS c, CASE WHEN len(l) <= 2 THEN '' ELSE array_to_string(l[3:], {_NL}) END AS d,
list_filter(list_transform(l, lambda x: {S.strip("x")}), lambda x: x <> '') AS k FROM l)
SELECT doc_id, md5(a) AS before_tail, md5(b) AS tail, md5(c) AS head, md5(d) AS after_head, md5(CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(k, {_NL} || {_NL}) || {_NL} END) AS assembled,
md5({S.strip(f"array_to_string(list_filter([{S.strip('a')}, {S.strip('b')}], lambda x: x <> ''), {_NL})")} || {_NL}) AS rejoined FROM w"""


def inline_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of what is said, put behind a name."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "l"))
    line = F.concat(
        F.lit("**"), F.upper("role"), F.when(F.col("turn") % 3 == 0, ", low.").when(F.col("turn") % 3 == 1, "").otherwise("."),
        F.lit("** "), F.when(F.col("turn") % 2 == 0, "— ").otherwise(""), F.lower("l")
    )
    return said.select(
        "conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), L.split_inline(line).alias("s")
    ).select("conv_id", "turn", "line_no", "s.name", "s.aside", F.md5("s.speech").alias("speech"))


INLINE = f"""WITH l AS (SELECT conv_id, turn, role, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS l FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)), s AS (SELECT *, {S.strip("lower(l)")} AS t FROM l),
f AS (SELECT *, t <> '' AND (turn % 3 <> 1 OR NOT regexp_matches(regexp_extract(t, '[\\p{{L}}\\p{{Nd}}]', 0), '\\p{{Ll}}')) AS fits FROM s)
SELECT conv_id, turn, line_no, CASE WHEN fits THEN upper(role) || CASE WHEN turn % 3 = 2 THEN '.' ELSE '' END END AS name, CASE WHEN fits AND turn % 3 = 0 THEN 'low.' END AS aside, CASE WHEN fits THEN md5(t) END AS speech FROM f"""


def emphasis(spark: SparkSession, sf: str) -> DataFrame:
    runs = _lines(spark, sf).select("doc_id", "line_no", F.explode(L.emphasis_runs(F.col("line"))).alias("r"))
    return runs.groupBy("doc_id", "line_no").agg(
        F.count("*").alias("runs"), F.count_if("r.bold").alias("bold_runs"), F.count_if("r.italic").alias("italic_runs"),
        F.sum(F.length("r.text")).cast("long").alias("chars")
    )


EMPHASIS = f"""WITH {S.LINES}, r AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|[^*]+|\\*')) AS t FROM lines),
k AS (SELECT *, regexp_matches(t, '^\\*\\*[^*]+\\*\\*$') AS b, regexp_matches(t, '^\\*[^*]+\\*$') AS i FROM r)
SELECT doc_id, line_no, count(*) AS runs, count(*) FILTER (b) AS bold_runs, count(*) FILTER (i) AS italic_runs, CAST(sum(length(t) - CASE WHEN b THEN 4 WHEN i THEN 2 ELSE 0 END) AS BIGINT) AS chars FROM k GROUP BY ALL"""


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """The first 30 turns that hold a fragment, in order, with an excerpt."""
    index = Q.indexed(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    hits = Q.found(index, spark.range(1).select(F.lit("the th").alias("needle")))
    return hits.orderBy("conv_id", "turn").limit(30).select("conv_id", "turn", X.excerpt(F.col("text"), 90).alias("excerpt"))


_KEY = S.squeeze("regexp_replace(lower(strip_accents(text)), '[.,;:!?…«»\"“”()\\[\\]{}—–*-]', ' ', 'g')")
SEARCHED = f"""SELECT conv_id, turn, CASE WHEN length({S.squeeze("text")}) > 90 THEN left({S.squeeze("text")}, 89) || '…' ELSE {S.squeeze("text")} END AS excerpt
FROM conversations WHERE contains({_KEY}, 'the th') ORDER BY conv_id, turn LIMIT 30"""


def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """What each conversation opens with, looked for in all turns of all conversations: how many hold it, and the first."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    needles = said.filter("turn = 0").select(F.substring(Q.searchable(F.col("text")), 1, 12).alias("needle"))
    hits = Q.found(Q.indexed(said, ["conv_id", "turn"]), needles)
    return hits.groupBy("needle").agg(F.count("*").alias("hits"), F.min(F.struct("conv_id", "turn")).alias("f")).select("needle", "hits", "f.conv_id", "f.turn")


SEARCH_HITS = f"""WITH k AS (SELECT conv_id, turn, {_KEY} AS k FROM conversations), n AS (SELECT DISTINCT substr(k, 1, 12) AS needle FROM k WHERE turn = 0 AND length({S.squeeze("substr(k, 1, 12)")}) >= 2)
SELECT needle, count(*) AS hits, min((conv_id, turn))[1] AS conv_id, min((conv_id, turn))[2] AS turn FROM n JOIN k ON contains(k, {S.squeeze("needle")}) GROUP BY needle"""

QUERIES = {
    "line_shapes": line_shapes, "name_predicates": name_predicates, "labels": labels, "counted_texts": counted_texts,
    "speech_ids": speech_ids, "speakers": speakers, "words": words, "openings": openings, "unit_titles": unit_titles, "numerals": numerals,
    "formats": formats, "envelopes": envelopes, "windows_of_lines": windows_of_lines, "inline_speech": inline_speech, "emphasis": emphasis,
    "searched": searched, "search_hits": search_hits
}
SQL = {
    "line_shapes": LINE_SHAPES, "name_predicates": NAMES, "labels": LABELS, "counted_texts": COUNTED, "speech_ids": SPEECH_IDS,
    "speakers": SPEAKERS, "words": WORDS, "openings": OPENINGS, "unit_titles": TITLES, "numerals": NUMERALS, "formats": FORMATS,
    "envelopes": ENVELOPES, "windows_of_lines": WINDOWS, "inline_speech": INLINE, "emphasis": EMPHASIS, "searched": SEARCHED, "search_hits": SEARCH_HITS
}
