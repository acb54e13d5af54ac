"""Units, speeches and the nested document of a play from its typed lines.

Sessions by running counts: an opening line begins a unit, a name begins a speech, text feeds it, and every line but an
aside or a place between a name and its first text ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X

FRONT = ["titre_oeuvre", "titre_secondaire", "epigraphe", "attribution", "note", "prologue"]
SILENT = ["vide", "distribution", "entree_distribution"]
OPENING = ["titre_acte", "titre_scene", "separateur"]
SIMPLE = {"didascalie": "didascalie", "didascalie_longue": "didascalie", "lieu": "lieu"}


def sessions(typed: DataFrame, doc: str) -> DataFrame:
    """Adds unit_no and speech_no (0 before any), act, scene and implicit to the lines that leave a trace."""
    order = W.partitionBy(doc).orderBy("line_no", "part")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    t = F.col("type")
    rows = typed.filter(~t.isin(SILENT))
    rows = rows.withColumn("__unit", F.sum(F.when(t.isin(OPENING), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("act", F.last(F.when(t == "titre_acte", F.col("text")), ignorenulls=True).over(upto))
    scene = F.when(t == "titre_scene", F.struct(F.col("text").alias("s"))).when(t == "titre_acte", F.struct(F.lit(None).cast("string").alias("s")))
    rows = rows.withColumn("scene", F.last(scene, ignorenulls=True).over(upto)["s"])
    opener = F.last(F.when(t.isin(OPENING), t), ignorenulls=True).over(upto)
    rows = rows.withColumn("implicit", F.coalesce(opener == "separateur", F.lit(True)))
    rows = rows.withColumn("__name", F.sum(F.when(t == "personnage", 1).otherwise(0)).over(upto))
    # what has happened since the last name is told by places, so that one order serves all steps
    at = F.struct("line_no", "part")
    rows = rows.withColumn("__name_at", F.last(F.when(t == "personnage", at), ignorenulls=True).over(upto))
    text_at = F.last(F.when(t == "texte", at), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__fed", F.coalesce(text_at > F.col("__name_at"), F.lit(False)))
    ends = ~t.isin("texte", "personnage") & ~(t.isin(list(SIMPLE)) & ~F.col("__fed"))
    rows = rows.withColumn("__ended_at", F.last(F.when(ends, at), ignorenulls=True).over(upto))
    ended = F.coalesce(F.col("__ended_at") > F.col("__name_at"), F.lit(False))
    speaks = (F.col("__name") > 0) & ~ended & t.isin("personnage", "texte")
    rows = rows.withColumn("speech_no", F.when(speaks, F.col("__name")).otherwise(0)).withColumnRenamed("__unit", "unit_no")
    return rows.drop("__name", "__name_at", "__fed", "__ended_at")


def elements(typed: DataFrame, doc: str) -> DataFrame:
    """The elements of a play in order: speeches with speakers, text, verse flag and inner asides, and what stands between.

    Lines are grouped once, those of a speech together and every other alone, and a group gives its elements: no line is read twice.
    """
    t, place = F.col("type"), F.struct("line_no", "part")
    rows = sessions(typed, doc).filter(~t.isin(FRONT + OPENING))
    groups = rows.groupBy(doc, "unit_no", "act", "scene", "implicit", "speech_no", F.when(F.col("speech_no") == 0, place).alias("__alone")).agg(
        F.max(F.when(t == "personnage", F.col("text"))).alias("name"),
        F.transform(F.array_sort(F.collect_list(F.when(t == "texte", F.struct("line_no", "part", "text")))), lambda s: s["text"]).alias("lines"),
        # what stands between a name and its first text comes before the speech
        F.coalesce(F.min(F.when(t == "texte", place)), F.max(place)).alias("at"),
        F.collect_list(F.when((F.col("speech_no") == 0) & (t != "personnage"), F.struct("type", "text"))).alias("__others")
    )
    said = groups.withColumn("__said", F.array_join("lines", "\n"))
    no_people, no_verse = F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")
    no_asides = F.lit(None).cast("array<struct<before_word:int,text:string>>")

    def element(kind: Column, text: Column, people: Column = no_people, verse: Column = no_verse, asides: Column = no_asides) -> Column:
        return F.struct(kind.alias("type"), text.alias("text"), people.alias("people"), verse.alias("verse"), asides.alias("asides"))

    joined = F.col("__said")
    starred = F.contains(joined, F.lit("*"))
    bare = F.when(starred, F.regexp_replace(joined, r"(?<!\*)\*(?!\*)([^*]+)\*", "")).otherwise(joined)
    # only what is no single blank, or has blanks at its side, is replaced
    spoken = X.strip(F.regexp_replace(F.regexp_replace(bare, r"\t[ \t]*| [ \t]+", " "), r" \n ?|\n ", "\n"))
    before = lambda i: F.size(X.tokens(F.regexp_replace(F.array_join(F.slice(F.split(joined, r"\*[^*]+\*", -1), F.lit(1), i + 1), " "), r"\*", "")))
    inner = F.transform(
        F.when(starred, F.regexp_extract_all(joined, F.lit(r"(?<!\*)\*([^*]+)\*"), F.lit(1))).otherwise(F.array().cast("array<string>")), lambda a,
        i: F.struct(before(i).alias("before_word"), X.strip(a).alias("text"))
    )
    named = F.transform(X.asides_of(F.col("name")), lambda a: F.struct(F.lit(0).alias("before_word"), a.alias("text")))
    said = said.withColumns({"people": X.speakers(F.col("name")), "spoken": spoken, "asides": F.concat(named, inner)})
    speech = element(F.lit("replique"), F.col("spoken"), F.col("people"), F.size("lines") > 1, F.col("asides"))
    silent = F.transform("asides", lambda a: element(F.lit("didascalie"), a["text"]))
    kind = lambda t: F.when(t == "texte", "texte_sans_personnage").when(t == "lieu", "lieu").otherwise("didascalie")
    others = F.transform("__others", lambda o: element(kind(o["type"]), o["text"]))
    found = F.when(F.col("speech_no") == 0, others).otherwise(F.when(F.col("spoken") != "", F.array(speech)).otherwise(silent))
    return identified(said.select(doc, "unit_no", "act", "scene", "implicit", "at", F.explode(found).alias("e")).select(doc, "unit_no", "act", "scene", "implicit", "at", "e.*"), doc)


def identified(rows: DataFrame, doc: str) -> DataFrame:
    """Adds unit_id (numbered over units that are not empty), position and the ids of speeches."""
    # places grow with units, so one order serves both
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy(doc).orderBy("unit_no", "at")) - 1)
    rows = rows.withColumn("unit_id", F.format_string("u%03d", F.dense_rank().over(W.partitionBy(doc).orderBy("unit_no"))))
    key = [doc, "type", "people", "__key"]
    rows = rows.withColumn("__key", X.speech_key(F.col("text")))
    nth = F.row_number().over(W.partitionBy(*key).orderBy("at")) - 1
    return rows.withColumn("id", F.when(F.col("type") == "replique", X.speech_id(F.col("people"), F.col("text"), nth))).drop("__key", "at", "unit_no")


def credited(people: str) -> Column:
    """Speakers by name, without everyone at once."""
    return F.filter(people, lambda n: n != "*")


def distribution(speeches: DataFrame, doc: str) -> DataFrame:
    """(doc, name, speeches, words): every speaker is fully credited, everyone at once nobody."""
    return speeches.filter("type = 'replique'").select(
        doc, F.explode(credited("people")).alias("name"), F.size(X.tokens(F.col("text"))).alias("w")
    ).groupBy(doc, "name").agg(F.count("*").alias("speeches"), F.sum("w").alias("words"))


def spellings(names: DataFrame, doc: str, raw: str) -> DataFrame:
    """Canonical names with more than one spelling, and these."""
    return names.groupBy(doc, X.label(F.col(raw)).alias("name")).agg(F.array_sort(F.collect_set(raw)).alias("spellings")).filter(F.size("spellings") > 1)


def document(rows: DataFrame, doc: str) -> DataFrame:
    """The nested document of each play: units with their people and elements.

    Elements and what their speakers are credited with go through the same groups, so elements are made once.
    """
    element = F.struct(
        "position", "type", F.col("text").alias("texte"), "id", F.col("people").alias("personnages"), F.col("verse").alias("vers"),
        F.transform("asides", lambda a: F.struct(a["before_word"].alias("avant_mot"), a["text"].alias("texte"))).alias("didascalies_internes")
    )
    unit = F.struct(F.col("unit_id").alias("id"), F.col("act").alias("acte"), "scene", F.col("implicit").alias("implicite"))
    row = lambda unit, name, words, e: F.struct(unit.alias("unit"), name.alias("name"), words.alias("words"), e.alias("e"))
    absent = lambda c: F.when(F.lit(False), c)
    counted = rows.withColumn("__words", F.when(F.col("type") == "replique", F.size(X.tokens(F.col("text")))))
    names = F.coalesce(F.when(F.col("type") == "replique", credited("people")), F.array().cast("array<string>"))
    credits = F.transform(names, lambda n: row(absent(unit), n, F.col("__words"), absent(element)))
    shown = row(unit, absent(F.lit("")), absent(F.col("__words")), element)
    each = counted.select(doc, F.explode(F.concat(F.array(shown), credits)).alias("r")).select(doc, "r.*")
    per = each.groupBy(doc, "unit", "name").agg(F.sort_array(F.collect_list("e")).alias("es"), F.count("*").alias("speeches"), F.sum("words").alias("words"))
    people = F.array_distinct(F.flatten(F.transform("es", lambda e: F.coalesce(e["personnages"], F.array().cast("array<string>")))))
    of_unit = F.struct("unit.*", people.alias("personnages"), F.transform("es", lambda e: e.dropFields("position")).alias("elements"))
    of_name = F.struct((-F.col("words")).alias("k"), F.col("name").alias("nom"), F.col("speeches").alias("repliques"), F.col("words").alias("mots"))
    whole = per.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.when(F.col("unit").isNotNull(), of_unit))).alias("unites"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), of_name))), lambda s: s.dropFields("k")).alias("cast")
    )
    return whole.select(F.lit("repetition/2").alias("schema"), F.col(doc).alias("piece"), F.when(F.size("cast") > 0, F.col("cast")).alias("personnages"), "unites")


def titled(units: DataFrame, doc: str) -> DataFrame:
    """Title rows to write before a unit: its act where that changes, its scene where act or scene changes, a separator for an implicit one."""
    w = W.partitionBy(doc).orderBy("unit_id")
    act_new = F.col("act").isNotNull() & ~F.col("act").eqNullSafe(F.lag("act").over(w))
    scene_new = F.col("scene").isNotNull() & (act_new | ~F.col("scene").eqNullSafe(F.lag("scene").over(w)))
    row = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    titles = F.array_compact(
        F.array(
            F.when(act_new, row("titre_acte", F.col("act"))), F.when(scene_new, row("titre_scene", F.col("scene"))),
            F.when(F.col("implicit") & ~F.coalesce(act_new, F.lit(False)) & ~F.coalesce(scene_new, F.lit(False)), row("separateur", F.lit("***")))
        )
    )
    return units.withColumn("t", titles).select(doc, "unit_id", F.posexplode("t").alias("part", "t")).select(doc, "unit_id", "part", "t.type", "t.text")
