"""Files and their sidecars, a remote folder, calls of a model, stored entries, roles and pages over the flat tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.functions import images
from quillstage.functions import text as X
from quillstage.operators import lines as L
from quillstage.operators import model as M
from quillstage.operators import quality as Q
from quillstage.operators import reading as R
from quillstage.operators import rehearsal as H
from quillstage.operators import stages as G
from quillstage.plans import sql as S
from quillstage.plans.rehearsing import _P, NOW, _history
from quillstage.sources import remote, texts
from quillstage.sources.folder import shared_folder, write_files
from quillstage.sources.tables import table


def _conversation_files(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """A folder with a file for each conversation: its texts behind a mark, with line ends of another system; of every third a sidecar, which for every sixth is damaged. And what lies there besides."""
    c = F.col("conv_id")
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("t"),
        F.count("*").alias("n")
    )
    name = F.concat(F.when(c % 2 == 0, "Book").otherwise("book"), F.lpad(c.cast("string"), 6, "0"), F.lit(".txt"))
    sidecar = F.when(c % 6 == 0, "{no").when(
        c % 3 == 0,
        F.to_json(F.struct(F.lit("termine").alias("statut"), F.col("n").cast("int").alias("reprises"), F.lit("bloc").alias("unite")))
    )
    files = per.select(name.alias("name"), F.concat(F.lit(texts.UTF8_MARK), F.replace("t", F.lit("\n"), F.lit("\r\n"))).alias("content"), sidecar.alias("sidecar"))
    odd = [
        (".hidden.txt", "x", None), ("~$lock.txt", "x", None), ("half.txt.tmp", "x", None), ("prompt_ocr.md", "Read {page}.", None),
        ("prompt_edition.md", "Edit\r\nit.", None)
    ]
    folder = shared_folder(spark, "files")
    write_files(files.unionByName(spark.createDataFrame(odd, files.schema)), folder)
    return table(spark, sf, "conversations").select("conv_id").distinct(), folder


def files_read(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of a folder, in order of names whatever their case, but those of every fifth book, which a list names."""
    books, folder = _conversation_files(spark, sf)
    listed = texts.listing(spark, folder, "*.txt")
    ignored = texts.ignored_names(
        books.filter("conv_id % 5 = 0").select(F.concat(F.lit("BOOK"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(".TXT  # done")).alias("value"))
    )
    kept = texts.not_ignored(listed, ignored)
    read = texts.read_texts(spark, f"{folder}/*.txt").select(F.regexp_extract("file", "([^/]+)$", 1).alias("name"), "text")
    return kept.join(read, "name").select("name", F.col("bytes").cast("long").alias("bytes"), F.md5("text").alias("text"))


_FILES = "f AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Book' ELSE 'book' END || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '.txt' AS name, string_agg(text, chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id)"
FILES = f"WITH {_FILES} SELECT name, CAST(3 + strlen(replace(t, chr(10), chr(13) || chr(10))) AS BIGINT) AS bytes, md5(t) AS text FROM f WHERE conv_id % 5 <> 0"


def sidecars_read(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars of files, with nulls where there is none or a damaged one."""
    _, folder = _conversation_files(spark, sf)
    names = texts.listing(spark, folder, "*.txt").select("name")
    found = texts.sidecars(texts.read_texts(spark, f"{folder}/*.txt.json")).select(
        F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("name"), "statut", F.col("reprises").cast("long").alias("reprises"), "unite"
    )
    return names.join(found, "name", "left")


SIDECARS = f"WITH {_FILES} SELECT name, CASE WHEN conv_id % 6 = 3 THEN 'termine' END AS statut, CASE WHEN conv_id % 6 = 3 THEN n END AS reprises, CASE WHEN conv_id % 6 = 3 THEN 'bloc' END AS unite FROM f"


def prompts_read(spark: SparkSession, sf: str) -> DataFrame:
    _, folder = _conversation_files(spark, sf)
    return texts.prompts(texts.read_texts(spark, f"{folder}/*.md"))


PROMPTS = "SELECT 'ocr' AS name, 'Read {page}.' AS prompt UNION ALL SELECT 'edition', 'Edit' || chr(10) || 'it.'"


def remote_plays(spark: SparkSession, sf: str) -> DataFrame:
    """Plays of a remote folder, which lists nations by seven and refuses every fourth file."""
    nations = {str(r[0]): r[1] for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect()}  # as many as there are nations

    def fetch(url: str) -> tuple[int, str]:
        if "alt=media" in url:
            file = url.split("/files/")[1].split("?")[0]
            return (403, "") if int(file) % 4 == 0 else (200, json.dumps({"schema": "repetition/2", "piece": nations[file]}))
        first = int(url.split("pageToken=")[1].split("&")[0]) if "pageToken=" in url else 0
        keys = sorted(nations, key=int)
        files = [{"id": k, "name": f"{nations[k]}_REPET.json"} for k in keys[first : first + 7]] + [{"id": "0", "name": "_REPET.json.txt"}]
        return 200, json.dumps({"files": files} | ({"nextPageToken": str(first + 7)} if first + 7 < len(keys) else {}))

    got = remote.download(remote.list_plays(spark, "http://store", "f", fetch), "http://store", fetch)
    return got.select(F.col("id").cast("long").alias("id"), "name", F.get_json_object("text", "$.piece").alias("piece"), F.col("code").cast("long").alias("code"))


REMOTE = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name || '_REPET.json' AS name, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS piece, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 403 ELSE 200 END AS BIGINT) AS code FROM nation"


class Refused(RuntimeError):
    """What a client of these queries raises."""

    def __init__(self, code: int) -> None:
        super().__init__(f"refused with {code}")
        self.code = code


def _client(prompt: str) -> str:
    """A stand-in for a model: refuses for good or for now, says nothing, or says the text in capitals."""
    n = len(prompt) % 11
    if n == 3:
        raise Refused(404)
    if n == 5:
        raise Refused(503)
    return " " if n == 7 else prompt.upper()


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.called(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", _client, first=0.0)
    return rows.select("conv_id", "turn", F.md5("answer").alias("answer"), F.col("tries").cast("long").alias("tries"), "error")


_UPPER = lambda x: f"replace(upper({x}), 'ẞ', 'SS')"
CALLS = f"""SELECT conv_id, turn, md5(CASE length(text) % 11 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN ' ' ELSE {_UPPER("text")} END) AS answer, CAST(CASE WHEN length(text) % 11 = 5 THEN 4 ELSE 1 END AS BIGINT) AS tries,
CASE length(text) % 11 WHEN 3 THEN 'Refused: refused with 404' WHEN 5 THEN 'Refused: refused with 503' END AS error FROM conversations"""


def edited_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks edited by a model: a text stands as it is where replies stay blank."""
    rows = M.edited(
        table(spark, sf, "conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 3 == 0, "\n*").otherwise(""))),
        ["conv_id", "turn"], "text", _client, first=0.0
    )
    return rows.select(
        "conv_id", "turn", F.md5("output").alias("output"), F.array_join("findings", ",").alias("findings"), "status",
        F.col("tries").cast("long").alias("tries")
    )


EDITED = f"""WITH c AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN chr(10) || '*' ELSE '' END AS t FROM conversations), o AS (SELECT *, length(t) % 11 AS k, CASE length(t) % 11 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN t ELSE {_UPPER("t")} END AS o FROM c),
f AS (SELECT *, CASE WHEN o IS NULL THEN 'no answer' WHEN {S.strip("o")} = '' THEN 'empty output' WHEN turn % 3 = 0 THEN 'odd number of stars' ELSE '' END AS f FROM o)
SELECT conv_id, turn, md5(o) AS output, f AS findings, CASE WHEN o IS NULL THEN 'echec' WHEN f = '' THEN 'termine' ELSE 'suspect' END AS status, CAST(CASE k WHEN 5 THEN 4 WHEN 7 THEN 2 ELSE 1 END AS BIGINT) AS tries FROM f"""


def _judge(prompt: str) -> str:
    """A stand-in for a model that compares: refuses, finds nothing, or names what it finds."""
    n = len(prompt) % 7
    if n == 2:
        raise Refused(400)
    return "[RAS] rien" if n < 4 else "Constats :\n" + "\n".join(f"[LACUNE] {i}" for i in range(n - 3))


def compared_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose edition a model compares with the transcript."""
    said = table(spark, sf, "conversations").withColumn("edition", F.upper("text"))
    rows = M.compared(said, ["conv_id", "turn"], "text", "edition", _judge, first=0.0)
    return rows.select("conv_id", "turn", "sound", "findings", "status", F.col("tries").cast("long").alias("tries"))


COMPARED = f"""WITH c AS (SELECT conv_id, turn, (13 + length(text) + 18 + length({_UPPER("text")})) % 7 AS n FROM conversations)
SELECT conv_id, turn, n < 4 AND n <> 2 AS sound, CAST(CASE WHEN n = 2 THEN 0 WHEN n < 4 THEN 1 ELSE n - 3 END AS BIGINT) AS findings, CASE WHEN n = 2 THEN 'echec' WHEN n < 4 THEN 'termine' ELSE 'suspect' END AS status, CAST(1 AS BIGINT) AS tries FROM c"""


def _annotator(prompt: str) -> str:
    """A stand-in for a model that gives roles to numbered lines: the first a title, the last a sound."""
    numbers = [line.split("|")[0] for line in prompt.split("\n")]
    return f"{numbers[0]}|titre_oeuvre\n{numbers[-1]} | sound\nno role"


def annotated_books(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter that a model annotates, one call per document."""
    known, unknown = M.annotated(L.lines_of(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", 5, _annotator, first=0.0)
    return known.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "role"
    ).unionByName(unknown.select("doc_id", F.lit(None).cast("long").alias("line_no"), "role"))


ANNOTATED = f"""WITH {S.LINES}, n AS (SELECT doc_id, min(line_no) AS f FROM lines WHERE line_no < 5 AND {S.strip("line")} <> '' GROUP BY doc_id)
SELECT doc_id, f AS line_no, 'titre_oeuvre' AS role FROM n UNION ALL SELECT doc_id, NULL, 'sound' FROM n"""


def stored_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A key-value table of conversations into which one of labels and conversations is taken, and of that the entries of a family."""
    said = table(spark, sf, "conversations")
    entries = lambda mark: said.select(F.concat_ws("/", "role", "conv_id", "turn").alias("key"), F.concat(F.lit(mark), F.length("text").cast("string")).alias("value"))
    more = table(spark, sf, "labels").select(F.concat(F.lit("user/label/"), F.col("doc_id").cast("string")).alias("key"), F.col("quality").cast("string").alias("value"))
    return G.prefixed(G.imported(entries("own "), entries("other ").unionByName(more)), "user/")


ENTRIES = "SELECT concat_ws('/', role, conv_id, turn) AS key, 'own ' || length(text) AS value FROM conversations WHERE role = 'user' UNION ALL SELECT 'user/label/' || doc_id, CAST(quality AS VARCHAR) FROM labels"


def first_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Which stage a book lacks first; its languages stand for the stages it has behind it."""
    made = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", (F.col("doc_id") / 100).cast("int").cast("string")).alias("book"), F.col("lang").alias("stage")
    )
    return G.first_missing(made, "book", "stage", ["en", "fr", "de", "es"])


MISSING = """WITH h AS (SELECT source || '/' || doc_id // 100 AS book, list(DISTINCT lang) AS l FROM documents GROUP BY 1)
SELECT book, CAST(CASE WHEN NOT list_contains(l, 'en') THEN 0 WHEN NOT list_contains(l, 'fr') THEN 1 WHEN NOT list_contains(l, 'de') THEN 2 WHEN NOT list_contains(l, 'es') THEN 3 ELSE 4 END AS BIGINT) AS ready,
CASE WHEN NOT list_contains(l, 'en') THEN 'en' WHEN NOT list_contains(l, 'fr') THEN 'fr' WHEN NOT list_contains(l, 'de') THEN 'de' WHEN NOT list_contains(l, 'es') THEN 'es' END AS missing FROM h"""


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """Stages run one after the other up to the first that fails: whether tables have rows, and whether all documents are labelled."""
    count = lambda name: table(spark, sf, name).count()
    ran = G.run_stages(
        [
            ("documents", lambda: count("documents") > 0), ("labels", lambda: count("labels") > 0),
            ("all labelled", lambda: count("labels") >= count("documents")), ("events", lambda: count("events") > 0)
        ]
    )
    return spark.createDataFrame(list(ran.items()), "stage string, done boolean")


STAGED = """WITH c AS (SELECT (SELECT count(*) FROM documents) > 0 AS a, (SELECT count(*) FROM labels) > 0 AS b, (SELECT count(*) FROM labels) >= (SELECT count(*) FROM documents) AS c, (SELECT count(*) FROM events) > 0 AS d)
SELECT 'documents' AS stage, a AS done FROM c UNION ALL SELECT 'labels', b FROM c WHERE a UNION ALL SELECT 'all labelled', c FROM c WHERE a AND b UNION ALL SELECT 'events', d FROM c WHERE a AND b AND c"""


def restored_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Stored roles of a conversation that its cast still has."""
    cast = table(spark, sf, "conversations").select("conv_id", "role")
    stored = cast.select("conv_id").distinct().select(
        "conv_id",
        F.explode(F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("ghost"))).otherwise(F.array(F.lit("system"), F.lit("ghost"), F.lit("user")))).alias("role")
    )
    return R.restored_roles(stored, cast, "conv_id", "role").select("conv_id", F.array_join("roles", ",").alias("roles"))


RESTORED = "SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN string_agg(DISTINCT role, ',' ORDER BY role) FILTER (role IN ('system', 'user')) END AS roles FROM conversations GROUP BY conv_id"


def changed_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Active roles when mine change, those that are none of mine, and lists of names between bars."""
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("mine"))
    array = lambda *names: F.array(*map(F.lit, names))
    new = F.when(F.col("conv_id") % 2 == 0, array("user", "guest", "assistant")).otherwise(array("guest"))
    active = array("user", "system")
    changed = R.roles_changed(F.col("mine"), new, active)
    return per.select(
        "conv_id", F.array_join(changed, ",").alias("active"), F.array_join(R.outsiders(active, F.col("mine")), ",").alias("outsiders"),
        X.role_key(new).alias("key"), X.listed(changed).alias("listed"),
        F.array_join(X.unlisted(X.listed(F.col("mine"))), ",").alias("unlisted")
    )


CHANGED = """WITH m AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS m, CASE WHEN conv_id % 2 = 0 THEN ['user', 'guest', 'assistant'] ELSE ['guest'] END AS n FROM conversations GROUP BY conv_id),
c AS (SELECT *, list_concat(list_filter(['user', 'system'], lambda x: list_contains(n, x)), list_filter(n, lambda x: NOT list_contains(m, x))) AS c FROM m), d AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS d FROM c)
SELECT conv_id, array_to_string(d, ',') AS active, array_to_string(list_filter(['user', 'system'], lambda x: NOT list_contains(m, x)), ',') AS outsiders, array_to_string(list_sort(n), '+') AS key,
CASE WHEN len(d) > 0 THEN '|' || array_to_string(d, '|') || '|' ELSE '' END AS listed, array_to_string(m, ',') AS unlisted FROM d"""


def first_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first two pages of every document that are not blank."""
    pages = L.pages_of(table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n<<<PAGE_BREAK>>>\n"))), "doc_id", "text")
    return L.first_pages(pages, 2).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.md5("page").alias("page"))


FIRST_PAGES = f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, generate_subscripts(l[1:2], 1) AS page_no, md5(unnest(l[1:2])) AS page FROM l"""


def ink(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of texts as grey images: the share of dark ones, and whether a page is blank."""
    share = images.ink_share(F.encode(F.col("text"), "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", share.alias("s")).select(
        "doc_id", F.round("s", 9).alias("ink"), (F.col("s") <= images.BLANK_SHARE).alias("blank")
    )


INK = "WITH s AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE (strlen(text) - len(regexp_extract_all(text, '[\\x{200}-\\x{10FFFF}]'))) / strlen(text) END AS s FROM documents) SELECT doc_id, round(s, 9) AS ink, s <= 0.001 AS blank FROM s"


def corrected_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of speeches whose newest recitation was corrected by its reader."""
    ranked = H.newest_corrected(H.newest(_history(spark, sf), ["user_id"], "at_ms", "event_id"))
    return H.progress(ranked, ["user_id"], "at_ms", "score", F.lit(NOW), "corrected")


CORRECTED = "WITH " + _P.replace("FILTER (score < 90)", "FILTER (score < 90 AND rank > 1)").replace("FILTER (score >= 90)", "FILTER (score >= 90 OR rank = 1)") + " SELECT user_id, attempts, streak, successes, last_at, last_score, due_at, status FROM g"


def folded_junctions(spark: SparkSession, sf: str) -> DataFrame:
    """Seams of a conversation's turns corrected one after the other: what a seam changes takes part in the next."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    folded = G.junctions_folded(said, "conv_id", "turn", "text", lambda a, b: (f"{a}!{len(a) % 10}", f"?{b}"), 1)
    return folded.select("conv_id", "turn", F.md5("text").alias("text"))


JUNCTIONS = """WITH p AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l, lag(turn) OVER w IS NOT NULL AS b, lead(turn) OVER w IS NOT NULL AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, CASE WHEN b THEN list_concat(['?' || l[1]], l[2:]) ELSE l END AS h FROM p)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN a THEN list_concat(h[1:len(h) - 1], [h[len(h)] || '!' || length(h[len(h)]) % 10]) ELSE h END, chr(10))) AS text FROM h"""


def report_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether reports are sound and how much they find: of every document one that says nothing was found, and one of its words in capitals."""
    words = F.transform(X.tokens(F.col("text")), lambda w: F.concat(F.lit("["), F.upper(w), F.lit("] x")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[ras]\n"), "text")).otherwise(F.array_join(words, "\n"))
    d = table(spark, sf, "documents").select("doc_id", said.alias("r"))
    return d.select("doc_id", Q.is_sound(F.col("r")).alias("sound"), Q.counted_findings(F.col("r")).cast("long").alias("findings"))


CHECKS = f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[ras]' || chr(10) || text ELSE array_to_string(list_transform({S.tokens("text")}, lambda w: '[' || {_UPPER("w")} || '] x'), chr(10)) END AS r FROM documents)
SELECT doc_id, contains(upper(r), '[RAS]') AS sound, CAST(len(regexp_extract_all(r, '(?m)^\\[[A-Z ]+\\]')) AS BIGINT) AS findings FROM r"""

QUERIES = {
    "files_read": files_read, "sidecars_read": sidecars_read, "prompts_read": prompts_read, "remote_plays": remote_plays,
    "model_calls": model_calls, "edited_blocks": edited_blocks, "compared_blocks": compared_blocks, "annotated_books": annotated_books,
    "stored_entries": stored_entries, "first_missing": first_missing, "staged": staged, "restored_roles": restored_roles,
    "changed_roles": changed_roles, "first_pages": first_pages, "ink": ink, "corrected_progress": corrected_progress,
    "folded_junctions": folded_junctions, "report_checks": report_checks
}
SQL = {
    "files_read": FILES, "sidecars_read": SIDECARS, "prompts_read": PROMPTS, "remote_plays": REMOTE, "model_calls": CALLS,
    "edited_blocks": EDITED, "compared_blocks": COMPARED, "annotated_books": ANNOTATED, "stored_entries": ENTRIES, "first_missing": MISSING,
    "staged": STAGED, "restored_roles": RESTORED, "changed_roles": CHANGED, "first_pages": FIRST_PAGES, "ink": INK,
    "corrected_progress": CORRECTED, "folded_junctions": JUNCTIONS, "report_checks": CHECKS
}
