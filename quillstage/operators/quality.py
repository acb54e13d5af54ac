"""Checks of transcripts, edited text and documents; every check gives an array of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X

LEAST_CHARS, LEAST_LETTERS, LEAST_ACCENTS, MOST_ODD = 200, 0.60, 0.005, 0.02
LEAST_LENGTH, JUNCTION = 0.80, (0.90, 1.10)
# Accented letters of French.
ACCENTED = "àâäéèêëîïôöùûüÿçÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÇ"
# What must not stand in edited text or in a transcript, and declarations of a blank page or a failure.
FORBIDDEN = {"page break": r"<<<PAGE_BREAK>>>", "page mark": r"(?m)^[\t-\r ]*\[PAGE[\t-\r ]+\d+\][\t-\r ]*$", "code fence": "(?m)^```"}
BLANK_SAID = r"(?i)page (est )?(vide|blanche)|aucun texte|sans texte|blank page"
FAILED_SAID = r"(?i)(cette|la|l')\s*(page|image)\s+(est\s+)?(illisible|corrompue|inexploitable)|(lire|transcrire|déchiffrer)\s+(cette|la|l')\s*(page|image)"
ILLEGIBLE = "*[texte illisible]*"


def _share(pattern: str, text: Column, of: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), of)


def text_layer_refusals(text: Column) -> Column:
    """Why a page's text layer is refused; empty where it may be used. The first two reasons end the check."""

    def rest(bare: Column, letters: Column) -> Column:
        odd = _share("[\\x{fffd}\\x00-\\x07\\x0b\\x0c]", bare, F.length(bare))
        return F.array_compact(F.array(
            F.when(letters / F.regexp_count(bare, F.lit(f"[^{X.WS}]")) < LEAST_LETTERS, "few letters"), F.when(odd > MOST_ODD, "odd characters"),
            F.when((letters > 0) & (_share(f"[{ACCENTED}]", bare, letters) < LEAST_ACCENTS), "no accents"),
        ))

    def reasons(bare: Column) -> Column:
        return F.when(bare == "", F.array(F.lit("no text layer"))).when(F.length(bare) < LEAST_CHARS, F.array(F.lit("too short"))).otherwise(X.let(F.regexp_count(bare, F.lit(r"\p{L}")), lambda n: rest(bare, n)))

    return X.let(X.strip(F.coalesce(text, F.lit(""))), reasons)


def layer_used(refusals: Column, strategy: str = "auto") -> Column:
    return {"auto": F.size(refusals) == 0, "never": F.lit(False), "always": F.lit(True)}[strategy]


def says_blank(text: Column) -> Column:
    bare = X.strip(text)
    return (bare != "") & (F.length(bare) <= 200) & bare.rlike(BLANK_SAID)


def says_failed(text: Column) -> Column:
    bare = X.strip(text)
    return (bare != "") & (F.length(bare) <= 300) & bare.rlike(FAILED_SAID)


def is_sound(report: Column) -> Column:
    """Whether a report says that nothing was found."""
    return F.contains(F.upper(report), F.lit("[RAS]"))


def counted_findings(report: Column) -> Column:
    """Lines of a report that begin with a category."""
    return F.regexp_count(report, F.lit(r"(?m)^\[[A-Z ]+\]"))


#: Signs without which a pattern of FORBIDDEN cannot stand.
_SIGNS = {"page break": "<<<", "page mark": "[PAGE", "code fence": "```"}


def forbidden(text: Column) -> list[Column]:
    return [F.when(F.contains(text, F.lit(_SIGNS[name])) & text.rlike(p), f"forbidden: {name}") for name, p in FORBIDDEN.items()]


def transcript_findings(text: Column) -> Column:
    unmarked = F.replace(text, F.lit(ILLEGIBLE), F.lit(""))
    emphasis = F.contains(text, F.lit("*")) & unmarked.rlike(r"(?m)\*\*[^*\n]+\*\*|^\*[^*\n]+\*$")
    return F.array_compact(F.array(*forbidden(text), F.when(emphasis, "emphasis added")))


def _ratio(a: Column, b: Column) -> Column:
    """As a plain expression, so that the optimiser computes sizes that several checks need once."""
    return F.try_divide(b.cast("double"), a)


def output_findings(source: Column, output: Column) -> Column:
    short = F.when(_ratio(F.length(X.for_counting(source)), F.length(X.for_counting(output))) < LEAST_LENGTH, "too short")
    found = F.array_compact(F.array(short, *forbidden(output), F.when(X.stars_outside_separators(output) % 2 != 0, "odd number of stars")))
    return F.when(X.strip(output) == "", F.array(F.lit("empty output"))).otherwise(found)


def junction_findings(before: Column, after: Column) -> Column:
    ratio = _ratio(F.length(X.strip(before)), F.length(X.strip(after)))
    found = F.array_compact(F.array(F.when(ratio < JUNCTION[0], "shortened"), F.when(ratio > JUNCTION[1], "lengthened")))
    return F.when(X.strip(after) == "", F.array(F.lit("empty"))).otherwise(found)


def volume_findings(transcript: Column, edited: Column) -> Column:
    lines = lambda t: F.size(F.filter(F.split(t, "\n", -1), lambda x: X.strip(x) != ""))
    volume = F.when(_ratio(F.length(X.for_comparison(transcript)), F.length(X.for_comparison(edited))) < LEAST_LENGTH, "volume")
    return F.array_compact(F.array(volume, F.when(_ratio(lines(transcript), lines(edited)) < LEAST_LENGTH, "lines")))


def mechanical_findings(transcript: Column, edited: Column) -> Column:
    """All checks of an edited book against its transcript, in order."""
    labels = F.array_except(capital_labels(transcript), capital_labels(edited))
    lost = F.transform(labels, lambda x: F.concat(F.lit("label lost: "), x))
    return F.concat(
        volume_findings(transcript, edited), lost,
        F.array_compact(F.array(F.when(X.stars_outside_separators(edited) % 2 != 0, "odd number of stars"), *forbidden(edited)))
    )


def capital_labels(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), X.is_structure_label), X.label)))


def version_remedy(schema: Column, reader: int = 2) -> Column:
    """Null where the schema is the reader's; else what is out of date."""
    n = F.regexp_extract(schema, r"^repetition/(\d+)$", 1).try_cast("int")
    return F.when(n == reader, None).when(n > reader, "reader_outdated").when(n < reader, "file_outdated").otherwise("foreign_file")


def violations(documents: DataFrame) -> DataFrame:
    """(piece, place, message): every breach of the structure of nested documents, in the order in which a reader meets them."""
    u = documents.select("piece", F.posexplode_outer("unites").alias("u", "unit"))
    e = u.select("piece", "u", F.posexplode_outer("unit.elements").alias("e", "element"))
    place = lambda *parts: F.array(*[F.coalesce(p, F.lit(-1)) for p in parts])
    none = F.lit(None).cast("int")
    found = [
        documents.filter(version_remedy(F.col("schema")).isNotNull() | F.col("schema").isNull()).select(
            "piece", place(none, none).alias("place"), F.lit("schema").alias("message")
        )
    ]
    found.append(documents.filter("unites is null or size(unites) = 0").select("piece", place(none, none).alias("place"), F.lit("no units").alias("message")))
    found.append(u.filter("unit is not null and unit.id is null").select("piece", place(F.col("u"), none).alias("place"), F.lit("unit without id").alias("message")))
    bad = F.when(
        ~F.coalesce(F.col("element.type").isin("replique", "didascalie", "lieu", "texte_sans_personnage"), F.lit(False)), "unknown element"
    ).when(F.col("element.texte").isNull(), "element without text").when((F.col("element.type") == "replique") & F.col("element.id").isNull(), "speech without id").when((F.col("element.type") == "replique") & (F.coalesce(F.size("element.personnages"), F.lit(0)) <= 0), "speech without speaker")
    found.append(
        e.filter("element is not null").withColumn("message", bad).filter("message is not null").select("piece", place(F.col("u"), F.col("e")).alias("place"), "message")
    )
    ids = e.filter("element.type = 'replique'").withColumn("n", F.count("*").over(W.partitionBy("piece", "element.id")))
    found.append(ids.filter("n > 1").select("piece", place(F.col("u"), F.col("e")).alias("place"), F.lit("id not unique").alias("message")))
    spoken = e.groupBy("piece").agg(F.count_if(F.coalesce(F.col("element.type") == "replique", F.lit(False))).alias("n")).filter("n = 0")
    found.append(spoken.select("piece", place(none, none).alias("place"), F.lit("no speech").alias("message")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def first_violation(documents: DataFrame) -> DataFrame:
    return violations(documents).groupBy("piece").agg(F.min_by("message", F.struct("place", "message")).alias("message"))


def report(findings: DataFrame, book: str, size: int = 500) -> DataFrame:
    """(book, piece, report, findings): the findings of each book, a line each by block, healthy blocks left out.

    A piece holds those of ``size`` consecutive blocks, so that no book is one row.
    """
    line = F.format_string("[%s] bloc %d : %s", F.col("category"), F.col("block"), F.col("detail"))
    rows = findings.withColumn("line", line)
    piece = F.floor(F.col("block") / size).cast("long").alias("piece")
    return rows.groupBy(book, piece).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda s: s["line"]), "\n").alias("report"),
        F.count("*").alias("findings")
    )
