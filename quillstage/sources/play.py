"""Nested documents of plays: schema, reader with version gate, flat views, cast maps, ingestion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "repetition/2"
_ELEMENT = "struct<type:string,texte:string,id:string,personnages:array<string>,personnage:string,vers:boolean,didascalies_internes:array<struct<avant_mot:int,texte:string>>>"
DOCUMENT = (
    "schema string, piece string, outil string, genere_le string, avertissements array<string>, liminaires array<struct<type:string,texte:string>>, "
    "personnages array<struct<nom:string,repliques:int,mots:int>>, "
    f"unites array<struct<id:string,acte:string,scene:string,implicite:boolean,personnages:array<string>,elements:array<{_ELEMENT}>>>"
)


def read_plays(spark: SparkSession, path: str | list[str], strict: bool = True, lines: bool = False) -> DataFrame:
    """Documents under ``path``, one a file, or with ``lines`` one a line, as ``write_plays`` leaves them; with ``strict`` any other schema version fails the read."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path).withColumn("file", F.input_file_name())
    if not strict:
        return docs
    wrong = F.concat(F.lit("unexpected schema "), F.coalesce("schema", F.lit("null")), F.lit(" in "), F.col("file"))
    return docs.filter(F.when(F.col("schema").eqNullSafe(F.lit(SCHEMA_VERSION)), True).otherwise(F.raise_error(wrong).cast("boolean")))


def judged(raw: DataFrame, text: str = "text") -> DataFrame:
    """Adds doc, the document that a JSON text holds, and reason, why it is rejected, null for the valid ones. Nothing fails the job."""
    from quillstage.operators.quality import version_remedy

    parsed = raw.withColumn("doc", F.from_json(text, DOCUMENT, {"mode": "PERMISSIVE"}))
    reason = F.when(
        F.col("doc").isNull() | F.coalesce(F.col("doc.schema"), F.col("doc.piece")).isNull(), "not a document"
    ).otherwise(F.coalesce(version_remedy(F.col("doc.schema")), F.when(F.coalesce(F.size("doc.unites"), F.lit(0)) <= 0, "no units")))
    return parsed.withColumn("reason", reason)


def ingest(raw: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The valid documents and the rejected texts with a reason, for two uses; who wants both at once takes ``judged``, which reads once."""
    marked = judged(raw, text)
    return marked.filter("reason is null").select("doc.*"), marked.filter("reason is not null").drop("doc")


def lifted(docs: DataFrame) -> DataFrame:
    """Documents of the first version too: a single speaker becomes a list."""
    element = lambda e: e.withField("personnages", F.coalesce(e["personnages"], F.when(e["personnage"].isNotNull(), F.array(e["personnage"]))))
    return docs.withColumn("unites", F.transform("unites", lambda u: u.withField("elements", F.transform(u["elements"], element))))


def elements(docs: DataFrame) -> DataFrame:
    """A row per element in play order: (piece, unit_pos, unit, act, scene, implicit, unit_people, elem_pos, type, text, id, people, verse, asides)."""
    units = docs.select("piece", F.posexplode("unites").alias("unit_pos", "u"))
    rows = units.select(
        "piece", "unit_pos", F.col("u.id").alias("unit"), F.col("u.acte").alias("act"), F.col("u.scene").alias("scene"),
        F.col("u.implicite").alias("implicit"), F.col("u.personnages").alias("unit_people"),
        F.posexplode("u.elements").alias("elem_pos", "e")
    )
    return rows.select(
        *rows.columns[:-1], F.col("e.type").alias("type"), F.col("e.texte").alias("text"), F.col("e.id").alias("id"),
        F.col("e.personnages").alias("people"), F.col("e.vers").alias("verse"), F.col("e.didascalies_internes").alias("asides")
    )


def speeches(docs: DataFrame) -> DataFrame:
    return elements(docs).filter("type = 'replique'")


def spoken_by(docs: DataFrame) -> DataFrame:
    """A row per speech and speaker."""
    return speeches(docs).withColumn("role", F.explode("people"))


def structure_counts(docs: DataFrame) -> DataFrame:
    """Per play: units, implicit units, speeches, stage directions, unattributed text, characters, warnings."""
    flat = F.flatten(F.transform("unites", lambda u: u["elements"]))
    of = lambda kind: F.size(F.filter(flat, lambda e: e["type"] == kind))
    return docs.select(
        "piece", F.size("unites").alias("units"), F.size(F.filter("unites", lambda u: u["implicite"])).alias("implicit_units"),
        of("replique").alias("speeches"), of("didascalie").alias("directions"), of("texte_sans_personnage").alias("unattributed"),
        F.size("personnages").alias("characters"), F.size(F.coalesce("avertissements", F.array().cast("array<string>"))).alias("warnings")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """What a folder of plays holds: file, piece, numbers of units, speeches and characters."""
    counts = structure_counts(docs).select("piece", F.col("units").alias("unites"), F.col("speeches").alias("repliques"), F.col("characters").alias("personnages"))
    return docs.select(F.regexp_extract("file", "([^/]+)$", 1).alias("fichier"), "piece").join(counts, "piece")


def cast_map(spark: SparkSession, text: str) -> DataFrame:
    """(actor, role, place) of a JSON map from actors to their roles; small by nature."""
    rows = [(actor, role, i) for i, (actor, roles) in enumerate(json.loads(text).items()) for role in roles]
    return spark.createDataFrame(rows, "actor string, role string, place int")


def write_plays(docs: DataFrame, path: str, stamp: str | None = None) -> None:
    """Documents as JSON, one a line, stamped with the time of writing."""
    (docs.withColumn("genere_le", F.lit(stamp)) if stamp else docs).write.mode("overwrite").json(path)
