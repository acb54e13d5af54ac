"""Balance of roles and actors, presence, casting; conversations stand for plays: a conversation is a unit, a role a character."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.operators import balance as B
from quillstage.operators import dialogue as D
from quillstage.plans import sql as S
from quillstage.sources.tables import table

#: The cast: an actor, a role, its place in the map.
CAST = [("Ann", "user", 0), ("Ann", "system", 1), ("Ben", "assistant", 2), ("Cy", "nobody", 3)]
_CAST = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{r}', {p})" for a, r, p in CAST) + ") t(actor, role, place))"
_W = f"len(regexp_extract_all(text, {S.q(X.BALANCE_WORD)}))"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _cast(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAST, "actor string, role string, place int")


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return B.role_weights(_said(spark, sf), "conv_id", "role", X.balance_words(F.col("text")))


WEIGHTS = f"""p AS (SELECT role, CAST(sum({_W}) AS BIGINT) AS words, count(*) AS speeches, count(DISTINCT conv_id) AS units FROM conversations WHERE role <> '*' GROUP BY role),
s AS (SELECT *, 100.0 * words / sum(words) OVER () AS share, (SELECT count(DISTINCT conv_id) FROM conversations) AS n FROM p), w AS (SELECT *, avg(share) OVER () AS mean FROM s)"""
ROLE_WEIGHTS = f"""WITH {WEIGHTS} SELECT role, words, round(share, 6) AS word_share, speeches, units, round(100.0 * units / n, 6) AS unit_share,
CASE WHEN share < 0.25 * mean AND share < 3 THEN 'hollow' WHEN share > 2.5 * mean AND share > 15 THEN 'swollen' ELSE '' END AS flag FROM w"""


def presence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return B.presence(_said(spark, sf), "conv_id", "role", ["system", "user", "assistant"])


PRESENCE = "SELECT conv_id, " + ", ".join(f"CASE WHEN bool_or(role = '{r}') THEN 'X' ELSE '' END AS {r}" for r in ("system", "user", "assistant")) + " FROM conversations GROUP BY conv_id"


def unit_words(spark: SparkSession, sf: str) -> DataFrame:
    return B.unit_words(_said(spark, sf), "conv_id", "role", X.balance_words(F.col("text")))


UNIT_WORDS = f"SELECT conv_id, CAST(sum({_W}) AS BIGINT) AS words, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles, false AS collective FROM conversations GROUP BY conv_id"


def actor_balance(spark: SparkSession, sf: str) -> DataFrame:
    return B.actor_balance(_weights(spark, sf).filter("role <> 'assistant' or words > 0"), _cast(spark))


ACTORS = f"""WITH {_CAST}, {WEIGHTS}, m AS (SELECT coalesce(c.actor, '[unmapped] ' || w.role) AS actor, words FROM w LEFT JOIN c USING (role)),
a AS (SELECT actor, CAST(sum(words) AS BIGINT) AS words FROM m GROUP BY actor), t AS (SELECT *, 100.0 * words / sum(words) OVER () AS share, 100.0 / (SELECT count(DISTINCT actor) FROM c) AS equal FROM a)
SELECT actor, words, round(share, 6) AS share, round(share - equal, 6) AS distance, CASE WHEN share > 1.3 * equal THEN 'cut first' WHEN share < 0.6 * equal THEN 'hollow' ELSE '' END AS advice FROM t"""


def cut_candidates(spark: SparkSession, sf: str) -> DataFrame:
    units = unit_words(spark, sf)
    total = _said(spark, sf).agg(F.sum(X.balance_words(F.col("text"))).alias("total"))
    return B.cut_candidates(units.crossJoin(F.broadcast(total)), "conv_id", F.col("total"))


CUTS = f"""WITH u AS ({UNIT_WORDS}) SELECT conv_id, words, round(100.0 * words / (SELECT sum(words) FROM u), 6) AS share, roles FROM u ORDER BY words DESC, conv_id LIMIT 15"""


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    people = F.when(F.col("turn") % 5 == 0, F.array(F.lit("*"))).when(F.col("turn") % 5 == 1, F.array("role", F.lit("CHOIR"))).otherwise(F.array("role"))
    return D.distribution(_said(spark, sf).select(F.lit("p").alias("piece"), F.lit("replique").alias("type"), people.alias("people"), "text"), "piece").drop("piece")


DISTRIBUTION = f"""WITH e AS (SELECT unnest(CASE turn % 5 WHEN 0 THEN ['*'] WHEN 1 THEN [role, 'CHOIR'] ELSE [role] END) AS name, len({S.tokens("text")}) AS w FROM conversations)
SELECT name, count(*) AS speeches, CAST(sum(w) AS BIGINT) AS words FROM e WHERE name <> '*' GROUP BY name"""


def spellings(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("turn") % 3 == 0, F.initcap("role")).when(F.col("turn") % 3 == 1, F.concat("role", F.lit("."))).otherwise("user")
    return D.spellings(
        _said(spark, sf).select("conv_id", raw.alias("raw")), "conv_id", "raw"
    ).select("conv_id", "name", F.array_join("spellings", " / ").alias("spellings"))


SPELLINGS = f"""WITH r AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN upper(role[1]) || role[2:] WHEN 1 THEN role || '.' ELSE 'user' END AS raw FROM conversations),
l AS (SELECT conv_id, {S.label("raw")} AS name, list_sort(list_distinct(list(raw))) AS s FROM r GROUP BY ALL) SELECT conv_id, name, array_to_string(s, ' / ') AS spellings FROM l WHERE len(s) > 1"""


def _present(spark: SparkSession, sf: str) -> DataFrame:
    scene = F.concat(F.lit("ACTE "), (F.col("conv_id") / 10).cast("int").cast("string"), F.lit(" Scène "), F.col("conv_id").cast("string"))
    return _said(spark, sf).select(
        "conv_id", scene.alias("scene"),
        F.when((F.col("conv_id") % 2 == 0) & (F.col("role") == "user"), "system").otherwise(F.col("role")).alias("role")
    ).distinct()


_PRESENT = "p AS (SELECT DISTINCT conv_id, 'ACTE ' || conv_id // 10 || ' Scène ' || conv_id AS scene, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 'system' ELSE role END AS role FROM conversations)"


def casting_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return B.conflicts(_said(spark, sf).select("conv_id", "role").distinct(), _cast(spark), "conv_id")


CONFLICTS = f"WITH {_CAST} SELECT conv_id, actor, string_agg(DISTINCT role, ' + ' ORDER BY role) AS roles FROM conversations JOIN c USING (role) GROUP BY conv_id, actor HAVING count(DISTINCT role) > 1"


def costume_changes(spark: SparkSession, sf: str) -> DataFrame:
    return B.costume_changes(_present(spark, sf), _cast(spark), "conv_id", "scene")


COSTUMES = f"""WITH {_CAST}, {_PRESENT}, s AS (SELECT actor, conv_id, scene, list_sort(list(DISTINCT role)) AS r FROM p JOIN c USING (role) WHERE actor IN (SELECT actor FROM c GROUP BY actor HAVING count(*) > 1) GROUP BY ALL),
n AS (SELECT *, lead(conv_id) OVER w AS nx, lead(scene) OVER w AS ns, lead(r) OVER w AS nr FROM s WINDOW w AS (PARTITION BY actor ORDER BY conv_id))
SELECT actor, conv_id AS place, array_to_string(r, '/') AS roles, array_to_string(nr, '/') AS next_roles, (string_split(scene, ' ')[1:2] = string_split(ns, ' ')[1:2]) AS quick FROM n WHERE nx = conv_id + 1 AND NOT list_has_any(r, nr)"""


def _played(spark: SparkSession, sf: str) -> DataFrame:
    """Words by scene and role, of even conversations the user's as the system's."""
    scene = F.concat(F.lit("ACTE "), (F.col("conv_id") / 10).cast("int").cast("string"), F.lit(" Scène "), F.col("conv_id").cast("string"))
    role = F.when((F.col("conv_id") % 2 == 0) & (F.col("role") == "user"), "system").otherwise(F.col("role"))
    return _said(spark, sf).select("conv_id", scene.alias("scene"), role.alias("role"), X.balance_words(F.col("text")).alias("words"))


def presence_heat(spark: SparkSession, sf: str) -> DataFrame:
    return B.heat(_played(spark, sf), _cast(spark), "conv_id", "scene")


HEAT = f"""WITH {_CAST}, p AS (SELECT conv_id, 'ACTE ' || conv_id // 10 AS act, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 'system' ELSE role END AS role, {_W} AS words FROM conversations),
r AS (SELECT conv_id, act, role, CAST(sum(words) AS BIGINT) AS words FROM p GROUP BY ALL),
a AS (SELECT actor, conv_id, act, CAST(sum(words) AS BIGINT) AS words, list(role) AS l, string_agg(upper(role[1]) || role[2:] || ' ' || words, ' · ' ORDER BY words DESC, role) AS roles FROM r JOIN c USING (role) GROUP BY ALL),
t AS (SELECT *, words / (SELECT max(words) FROM a) AS t FROM a)
SELECT t.actor, t.conv_id AS place, t.words, t.roles, round(t, 6) AS heat, 'rgb(' || CAST(trunc(255 + t * (30 - 255)) AS INTEGER) || ',' || CAST(trunc(255 + t * (125 - 255)) AS INTEGER) || ',' || CAST(trunc(255 + t * (60 - 255)) AS INTEGER) || ')' AS background,
CASE WHEN t > 0.55 THEN '#fff' ELSE '#222' END AS colour, n.actor IS NOT NULL AND NOT list_has_any(t.l, n.l) AND t.act = n.act AS quick FROM t LEFT JOIN a n ON n.actor = t.actor AND n.conv_id = t.conv_id + 1"""


def presence_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of CSV: of every conversation, labelled by how its first turn begins, who speaks in it; one role's name has a comma."""
    said = _said(spark, sf).withColumn("role", F.when(F.col("role") == "assistant", "ALL, \"IN CHORUS\"").otherwise(F.col("role")))
    label = F.concat(F.col("conv_id").cast("string"), F.lit(" "), F.when(F.col("turn") == 0, F.substring("text", 1, 20)))
    return B.presence_csv(said, "conv_id", label, "role", ["system", "user", "ALL, \"IN CHORUS\""])


_FIELD = lambda x: f"CASE WHEN regexp_matches({x}, '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END"
PRESENCE_CSV = f"""WITH u AS (SELECT conv_id, min(CASE WHEN turn = 0 THEN conv_id || ' ' || substr(text, 1, 20) END) AS label, bool_or(role = 'system') AS s, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT NULL AS conv_id, 'Unite,system,user,"ALL, ""IN CHORUS""' || chr(34) AS line UNION ALL
SELECT conv_id, {_FIELD("label")} || ',' || CASE WHEN s THEN 'X' ELSE '' END || ',' || CASE WHEN u THEN 'X' ELSE '' END || ',' || CASE WHEN a THEN 'X' ELSE '' END FROM u"""

QUERIES = {
    "role_weights": _weights, "presence_matrix": presence_matrix, "unit_words": unit_words, "actor_balance": actor_balance,
    "cut_candidates": cut_candidates, "distribution": distribution, "spellings": spellings, "casting_conflicts": casting_conflicts,
    "costume_changes": costume_changes, "presence_heat": presence_heat, "presence_csv": presence_csv
}
SQL = {
    "role_weights": ROLE_WEIGHTS, "presence_matrix": PRESENCE, "unit_words": UNIT_WORDS, "actor_balance": ACTORS, "cut_candidates": CUTS,
    "distribution": DISTRIBUTION, "spellings": SPELLINGS, "casting_conflicts": CONFLICTS, "costume_changes": COSTUMES, "presence_heat": HEAT, "presence_csv": PRESENCE_CSV
}
