"""What the lines of an edited play are: observations of its labels, then rules over them.

A label's type depends on the whole document, so labels are aggregated first and joined back to the lines. All steps are
partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import numbers as N
from quillstage.functions import text as X
from quillstage.operators.lines import next_line_is_speech, split_inline

# Words of act and scene titles, and headings of cast lists.
ACT_WORDS = ["ACTE", "PARTIE", "PROLOGUE", "EPILOGUE", "MOUVEMENT", "JOURNEE", "INTERMEDE"]
SCENE_WORDS = ["SCENE", "TABLEAU", "SEQUENCE", "FRAGMENT"]
CAST_HEADINGS = ["PERSONNAGE", "PERSONNAGES", "DISTRIBUTION", "LES PERSONNAGES"]
RECURRENT, CAST_LINES, TITLE_LINE, FRONT_LINES, LONG_ASIDE = 2, 60, 12, 120, 180
# A line that is a page number alone, and the reasons that are given for a label's type.
PAGE_NUMBER = r"^[\t-\r \-–—_=«»<>|.·•*]*\d{1,4}[\t-\r \-–—_=«»<>|.·•*]*$"
REASONS = {
    "forced": "surcharge manuelle",
    "heading": "en-tête de distribution",
    "act": "lexique acte",
    "scene": "lexique scène",
    "under": "numéroté, sous des actes lexicaux",
    "upper": "numéroté, niveau supérieur du document",
    "cast": "distribution",
    "followed": "suivi d'une réplique",
    "nothing": "aucun signal : ni lexique, ni numéro, ni réplique, ni récurrence",
    "title": "premier intitulé du document : titre de l'œuvre",
    "two levels": ("numérotation ", ", deux niveaux détectés"),
    "recurrent": ("récurrent (", " occurrences)"),
}
WARNINGS = {"unsure": "classement incertain : ", "no cast": "aucune distribution détectée", "nobody": "aucun personnage détecté"}
OPENERS = ["titre_acte", "titre_scene", "separateur"]
_FIRST = {h[0] for h in CAST_HEADINGS}
#: How every line begins whose label is a heading of a cast list; most lines do not, and need no label.
_MAY_HEAD = f"^[{X.WS}*\\p{{Mn}}]*[{''.join(sorted(_FIRST | {c.lower() for c in _FIRST}) + [a for a, b in zip(X.ACCENTED, X.BARE, strict=True) if b.upper() in _FIRST])}]"


def labels_of(lines: DataFrame, doc: str) -> DataFrame:
    """Per document and label: occurrences, speech_after, first_line, and the spelling that prevails."""
    line = F.col("line")
    # no text is sorted: what is seen of the lines that are not blank is enough
    facts = lines.filter(X.strip(line) != "").select(
        doc, "line_no", X.bold(line).alias("__bold"), split_inline(line)["name"].alias("__inline"), X.is_speech(line).alias("__speech")
    )
    speech_next = F.coalesce(F.lead("__speech").over(W.partitionBy(doc).orderBy("line_no")), F.lit(False))
    seen = facts.select(doc, "line_no", F.coalesce("__bold", "__inline").alias("shown"), (F.col("__inline").isNotNull() | speech_next).alias("after"))
    seen = seen.filter(F.col("shown").isNotNull()).withColumn("label", X.label(F.col("shown"))).filter(F.col("label") != "")
    forms = seen.groupBy(doc, "label", "shown").agg(F.count("*").alias("n"), F.count_if("after").alias("speech_after"), F.min("line_no").alias("first_line"))
    best = F.min_by("shown", F.struct(-F.col("n"), F.col("shown")))
    return forms.groupBy(doc, "label").agg(
        F.sum("n").alias("occurrences"), F.sum("speech_after").alias("speech_after"), F.min("first_line").alias("first_line"),
        best.alias("shown")
    )


def cast_of(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, line_no, name): lines of the cast list below the first cast heading; name is null where a line names no one.

    The list ends at two blank lines, a separator, speech on a name's line, a title, or a name that is followed by speech.
    """
    line = F.col("line")
    whole = W.partitionBy(doc)
    order = W.partitionBy(doc).orderBy("line_no")
    head = F.when(line.rlike(_MAY_HEAD), X.label(line)).isin(CAST_HEADINGS)
    marked = lines.withColumn("__head", F.min(F.when(head, F.col("line_no"))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # what follows a line is looked for below headings alone
    body = next_line_is_speech(marked.filter(F.col("line_no") > F.col("__head")), doc).filter(F.col("line_no") <= F.col("__head") + CAST_LINES)
    blank = X.strip(line) == ""
    own = X.label(X.bold(line))
    ends = (blank & F.coalesce(F.lag(blank).over(order), F.lit(False))) | X.is_separator(line) | split_inline(line).isNotNull()
    ends = ends | (X.bold(line).isNotNull() & (X.has_word_of(own, ACT_WORDS) | X.has_word_of(own, SCENE_WORDS) | F.col("speech_next")))
    body = body.withColumn("__stop", F.min(F.when(F.coalesce(ends, F.lit(False)), F.col("line_no"))).over(whole))
    listed = body.filter(~blank & (F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))))
    part = X.strip(F.get(F.split(F.regexp_replace(X.strip(line), r"^\*+|\*+$", ""), "[,:(–—-]", 2), F.lit(0)))
    return listed.select(doc, "line_no", F.when(X.may_be_name(part), X.label(part)).alias("name"))


def numbering(labels: DataFrame, doc: str) -> DataFrame:
    """Adds numbered (a pure or titled number), style, value, and in_order: numbers occur once each and grow in reading order."""
    with_value = labels.withColumns({"style": N.numeral_style(F.col("label")), "value": N.numeral_value(F.col("label"))}).withColumn("numbered", F.col("style").isNotNull())
    order = W.partitionBy(doc, "numbered").orderBy("first_line")
    falls = F.col("numbered") & ((F.col("value") < F.lag("value").over(order)) | (F.col("occurrences") != 1))
    return with_value.withColumn("__falls", F.coalesce(falls, F.lit(False))).withColumn("in_order", ~F.max("__falls").over(W.partitionBy(doc))).drop("__falls")


def classify_labels(lines: DataFrame, doc: str, forced: dict[str, list[str]] | None = None, recurrent: int = RECURRENT) -> DataFrame:
    """Type, confidence and reason of every label of every document. ``forced`` maps a type to labels that have it."""
    labels = numbering(labels_of(lines, doc), doc)
    cast = cast_of(lines, doc).filter(F.col("name").isNotNull()).select(doc, F.col("name").alias("label"), F.lit(True).alias("in_cast")).distinct()
    known = labels.join(cast, [doc, "label"], "left").withColumn("in_cast", F.coalesce("in_cast", F.lit(False)))
    label, whole = F.col("label"), W.partitionBy(doc)
    act, scene = X.has_word_of(label, ACT_WORDS), X.has_word_of(label, SCENE_WORDS)

    def verdict(kind: str, trust: str, why: str | Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(trust).alias("confidence"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))

    never = F.lit(False)
    rule = F.when(never, verdict("", "", ""))
    for kind in ("personnage", "titre_acte", "titre_scene"):
        rule = rule.when(label.isin((forced or {}).get(kind, [])), verdict(kind, "certaine", REASONS["forced"]))
    rule = rule.when(
        label.isin(CAST_HEADINGS), verdict("distribution", "certaine", REASONS["heading"])
    ).when(act, verdict("titre_acte", "certaine", REASONS["act"])).when(scene, verdict("titre_scene", "certaine", REASONS["scene"]))
    known = known.withColumns({"__early": rule, "__deferred": F.col("in_order") & F.col("numbered")})
    known = known.withColumn("__deferred", F.col("__deferred") & F.col("__early").isNull())
    known = known.withColumns(
        {"__acts": F.max(F.col("__early.type") == "titre_acte").over(whole), "__styles": F.size(F.collect_set(F.when(F.col("__deferred"), F.col("style"))).over(whole))}
    )
    upper = F.col("style").isin("romain", "ecrit")
    level = F.when(F.coalesce("__acts", never), verdict("titre_scene", "deduite", REASONS["under"]))
    two = F.concat(F.lit(REASONS["two levels"][0]), F.col("style"), F.lit(REASONS["two levels"][1]))
    level = level.when((F.col("__styles") >= 2) & upper, verdict("titre_acte", "deduite", two)).when(F.col("__styles") >= 2, verdict("titre_scene", "deduite", two))
    level = level.otherwise(verdict("titre_acte", "deduite", REASONS["upper"]))
    late = F.when(F.col("in_cast"), verdict("personnage", "certaine", REASONS["cast"])).when(
        F.col("speech_after") >= 1, verdict("personnage", "probable", REASONS["followed"])
    )
    late = late.when(
        F.col("occurrences") >= recurrent,
        verdict("personnage", "probable", F.concat(F.lit(REASONS["recurrent"][0]), F.col("occurrences").cast("string"), F.lit(REASONS["recurrent"][1])))
    )
    late = late.otherwise(verdict("personnage", "incertaine", REASONS["nothing"]))
    known = known.withColumn("__found", F.coalesce("__early", F.when(F.col("__deferred"), level), late))
    first = F.row_number().over(W.partitionBy(doc).orderBy("first_line")) == 1
    title = first & (F.col("__found.confidence") == "incertaine") & (F.col("first_line") <= TITLE_LINE)
    known = known.withColumn("__title", title)
    found = F.when(F.col("__title"), verdict("titre_oeuvre", "deduite", REASONS["title"])).otherwise(F.col("__found"))
    return known.withColumn("__found", found).select(
        doc, "label", "shown", "__found.type", "__found.confidence", "__found.reason", "occurrences", "speech_after", "first_line"
    )


def warnings_of(labels: DataFrame, cast: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, warning): uncertain labels, no cast list, no character."""
    uncertain = labels.filter("confidence = 'incertaine'").select(doc, F.concat(F.lit(WARNINGS["unsure"]), F.col("shown")).alias("warning"))
    named = cast.filter(F.col("name").isNotNull())
    no_cast = docs.select(doc).join(named, doc, "left_anti").withColumn("warning", F.lit(WARNINGS["no cast"]))
    nobody = docs.select(doc).join(labels.filter("type = 'personnage'"), doc, "left_anti").withColumn("warning", F.lit(WARNINGS["nobody"]))
    return uncertain.unionByName(no_cast).unionByName(nobody)


def classify_lines(lines: DataFrame, labels: DataFrame, doc: str, cast: DataFrame | None = None) -> DataFrame:
    """Typed lines (doc, line_no, part, raw, text, type); a name with speech on its line gives up to three rows."""
    line = F.col("line")
    parts = lines.withColumn("__inline", split_inline(line))
    one = lambda kind, t, label: F.struct(F.lit(kind).alias("type"), t.alias("text"), label.alias("label"))
    no = F.lit(None).cast("string")
    inline = F.array_compact(
        F.array(
            one("personnage", F.col("__inline.name"), X.label(F.col("__inline.name"))),
            F.when(F.col("__inline.aside").isNotNull(), one("didascalie", F.col("__inline.aside"), no)),
            one("texte", F.col("__inline.speech"), no)
        )
    )
    s, bold, italic = X.strip(line), X.bold(line), X.italic(line)
    kind = F.when(s == "", "vide").when(X.is_separator(line), "separateur").when(s.rlike(PAGE_NUMBER), "vide").when(bold.isNotNull(), "?").when(
        italic.isNotNull(), F.when(F.length(italic) > LONG_ASIDE, "didascalie_longue").otherwise("didascalie")
    ).otherwise("texte")
    plain = F.array(F.struct(kind.alias("type"), X.without_markers(line).alias("text"), F.when(bold.isNotNull(), X.label(bold)).alias("label")))
    rows = parts.select(
        doc, "line_no", line.alias("raw"), F.posexplode(F.when(F.col("__inline").isNotNull(), inline).otherwise(plain)).alias("part", "p")
    ).select(doc, "line_no", "part", "raw", "p.*")
    rows = rows.join(labels.select(doc, "label", F.col("type").alias("__type")), [doc, "label"], "left")
    rows = rows.withColumn("type", F.when(F.col("type") == "?", F.coalesce("__type", F.lit("personnage"))).otherwise(F.col("type"))).drop("__type", "label")
    if cast is not None:
        listed = cast.select(doc, "line_no", F.lit(True).alias("__listed")).distinct()
        rows = rows.join(listed, [doc, "line_no"], "left").withColumn(
            "type", F.when(F.col("__listed") & (F.col("type") != "vide"), "entree_distribution").otherwise(F.col("type"))
        ).drop("__listed")
    before = W.partitionBy(doc).orderBy("line_no", "part").rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("type") != "vide", F.col("type")), ignorenulls=True).over(before)
    return rows.withColumn("type", F.when((F.col("type") == "didascalie") & previous.isin(OPENERS), "lieu").otherwise(F.col("type")))


def front_matter_end(lines: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """(doc, front_end): the first line that surely opens the play, at most FRONT_LINES."""
    line = F.col("line")
    bold = X.bold(line)
    shown = F.coalesce(bold, split_inline(line)["name"])
    filled = lines.filter(X.strip(line) != "").select(doc, "line_no", bold.isNotNull().alias("__bold"), X.label(shown).alias("label"))
    known = filled.join(labels.select(doc, "label", "type", "confidence"), [doc, "label"], "left")
    unclear = F.col("__bold") & ~F.coalesce(F.col("type").isin("titre_acte", "titre_scene"), F.lit(False))
    known = known.withColumn("__after", F.coalesce(F.lag(unclear).over(W.partitionBy(doc).orderBy("line_no")), F.lit(False)))
    opens = F.col("type").isin("titre_acte", "personnage") & F.col("confidence").isin("certaine", "probable") & ~F.col("__after")
    ends = known.groupBy(doc).agg(F.min(F.when(opens, F.col("line_no"))).alias("first"))
    sizes = lines.groupBy(doc).agg(F.count("*").alias("n"))
    return sizes.join(ends, doc, "left").select(doc, F.least(F.coalesce("first", "n"), F.lit(FRONT_LINES)).alias("front_end"))


def override(typed: DataFrame, roles: DataFrame, doc: str) -> DataFrame:
    """Types from ``roles`` (doc, raw, role), for the first row with that raw line in the front matter only."""
    nth = F.row_number().over(W.partitionBy(doc, "raw").orderBy("line_no", "part"))
    return typed.withColumn("__n", nth).join(roles, [doc, "raw"], "left").withColumn(
        "type", F.when((F.col("__n") == 1) & F.col("role").isNotNull(), F.col("role")).otherwise(F.col("type"))
    ).drop("__n", "role")
