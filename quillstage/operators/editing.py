"""Replies of models, asides within speech, edited text from Word paragraphs, tracked cuts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.operators.intervals import first_holder
from quillstage.operators.structure import ACT_WORDS, SCENE_WORDS

# Delimiters of a junction reply, and the roles that front matter may have.
LEFT, LEFT_END, RIGHT, RIGHT_END = "<<<BLOC_GAUCHE>>>", "<<<FIN_BLOC_GAUCHE>>>", "<<<BLOC_DROIT>>>", "<<<FIN_BLOC_DROIT>>>"
FRONT_ROLES = [
    "titre_oeuvre", "titre_secondaire", "epigraphe", "attribution", "note", "distribution", "entree_distribution", "titre_acte",
    "titre_scene", "personnage", "didascalie", "prologue", "texte"
]
BOLD_SHARE = 0.6


def junction_reply(reply: Column) -> Column:
    """struct(left, right) of a reply between its delimiters, null where they are missing."""
    pattern = f"(?s){LEFT}(.*?){LEFT_END}.*?{RIGHT}(.*?){RIGHT_END}"
    return F.when(reply.rlike(pattern), F.struct(X.strip(F.regexp_extract(reply, pattern, 1)).alias("left"), X.strip(F.regexp_extract(reply, pattern, 2)).alias("right")))


def junction_kept(reply: Column, left: Column, right: Column, findings: Callable[[Column, Column], Column]) -> Column:
    """The corrected sides where the reply can be read and nothing is found against it, else the old ones."""
    old = F.struct(left.alias("left"), right.alias("right"))
    return X.let(
        junction_reply(reply),
        lambda r: F.when(r.isNotNull() & (F.size(findings(left, r["left"])) == 0) & (F.size(findings(right, r["right"])) == 0), r).otherwise(old)
    )


def annotations(replies: DataFrame, doc: str, reply: str) -> tuple[DataFrame, DataFrame]:
    """(doc, line_no, role) of replies in lines ``number|role``, and the unknown roles of each document."""
    rows = replies.select(doc, F.explode(F.regexp_extract_all(reply, F.lit(r"(?m)^[ \t]*(\d+[ \t]*\|[ \t]*[a-z_]+)[ \t]*$"), F.lit(1))).alias("a"))
    cut = rows.select(doc, F.regexp_extract("a", r"^(\d+)", 1).cast("int").alias("line_no"), F.regexp_extract("a", r"([a-z_]+)$", 1).alias("role"))
    known = F.col("role").isin(FRONT_ROLES)
    return cut.filter(known).dropDuplicates([doc, "line_no"]), cut.filter(~known).select(doc, "role").distinct()


def annotation_prompt(lines: DataFrame, doc: str, end: int) -> DataFrame:
    """(doc, prompt): the numbered lines before ``end`` that are not blank."""
    kept = lines.filter((F.col("line_no") < end) & (X.strip(F.col("line")) != ""))
    one = F.concat(F.col("line_no").cast("string"), F.lit("|"), X.strip(F.col("line")))
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", one.alias("l")))), lambda s: s["l"]), "\n").alias("prompt"))


def asides_marked(text: Column, asides: Column) -> Column:
    """The text with its asides put back in stars before their words; ``asides`` has before_word and text.

    Words and asides are sorted together by place, so neither list is searched for each element of the other.
    """
    piece = lambda at, kind, i, t: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), i.alias("i"), t.alias("t"))

    def sorted_in(words: Column) -> Column:
        notes = F.transform(asides, lambda a, i: piece(a["before_word"], 0, i, F.concat(F.lit("*"), a["text"], F.lit("*"))))
        fits = X.let(F.size(words), lambda n: F.filter(notes, lambda p: p["at"].between(0, n)))
        placed = F.array_sort(F.concat(fits, F.transform(words, lambda w, i: piece(i, 1, F.lit(0), w))))
        return F.array_join(F.transform(placed, lambda p: p["t"]), " ")

    return X.let(X.tokens(text), sorted_in)


def edited_from_paragraphs(paragraphs: DataFrame, doc: str) -> DataFrame:
    """(doc, position, line) of edited text from (doc, paragraph, text, bold_share, italic_share).

    What is mostly bold is a title or name, mostly italic a direction; speech paragraphs in a row are one speech. Scene
    titles lose the act they repeat.
    """
    t = X.strip(F.col("text"))
    bold, italic = F.col("bold_share") >= BOLD_SHARE, F.col("italic_share") >= BOLD_SHARE
    bare = F.regexp_replace(t, r"(?i)^ACTE[ \t]+[IVXLC\d]+[ \t,.–—-]+(?=SC[EÈ]NE)", "")
    kind = F.when(bold, "bold").when(italic, "italic").otherwise("speech")
    rows = paragraphs.filter(t != "").withColumns({"__kind": kind, "__t": F.when(bold, bare).otherwise(t)})
    w = W.partitionBy(doc).orderBy("paragraph")
    rows = rows.withColumn("__new", (~((F.col("__kind") == "speech") & F.coalesce(F.lag("__kind").over(w) == "speech", F.lit(False)))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = rows.groupBy(doc, "__run", "__kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "__t"))), lambda s: s["__t"]), "\n").alias("__t"))
    line = F.when(
        F.col("__kind") == "bold", F.concat(F.lit("**"), F.col("__t"), F.lit("**"))
    ).when(F.col("__kind") == "italic", F.concat(F.lit("*"), F.col("__t"), F.lit("*"))).otherwise(F.col("__t"))
    return joined.select(doc, F.col("__run").cast("int").alias("position"), line.alias("line"))


def front_split(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """Adds front: whether a line stands before the first title of an act or scene."""
    words = X.label(F.coalesce(X.bold(F.col(line)), F.lit("")))
    opens = X.has_word_of(words, ACT_WORDS) | X.has_word_of(words, SCENE_WORDS)
    first = F.min(F.when(opens, F.col("position"))).over(W.partitionBy(doc))
    return lines.withColumn("front", F.col("position") < F.coalesce(first, F.lit(0)))


#: Characters of the blocks that a text is cut into, so that no slice is found by walking up to it from the text's beginning.
_BLOCK = 256


def _sliced(text: Column, bits: Column, start: Column) -> Column:
    """``bits`` (at, to) of a text that begins at ``start``, as strings: a slice reads the blocks it touches alone."""
    def cut(blocks: Column, at: Column, to: Column) -> Column:
        first, last = F.floor(at / _BLOCK).cast("int"), F.floor((to - 1) / _BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), at % _BLOCK + 1, to - at)

    place = lambda end: (end - start).cast("int")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return X.let(blocks, lambda c: F.transform(bits, lambda b: cut(c, place(b["at"]), place(b["to"]))))


def cut_runs(runs: DataFrame, spans: DataFrame, doc: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs split at the borders of spans: (doc, start, text, category) and what is to be carried, category null where kept.

    The runs of a document do not overlap. All borders of a document are swept once in order; of spans that overlap the
    first counts. A text is sliced in one pass over its own pieces.
    """
    r = runs.withColumns({"start": F.col("start").cast("long"), "stop": F.col("start") + F.length("text")}).filter("start < stop")
    s = spans.select(doc, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "category")
    ends = lambda of, run: of.select(doc, F.inline(F.array(F.struct(F.col("start").alias("at"), run.alias("run")), F.struct(F.col("stop").alias("at"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("run")))))
    borders = ends(r, F.struct(F.col("start").alias("a"), F.col("stop").alias("b"))).unionAll(ends(s, F.lit(None).cast("struct<a:bigint,b:bigint>")))
    w = W.partitionBy(doc).orderBy("at")
    marked = borders.groupBy(doc, "at").agg(F.max("run").alias("run"))
    open_ = marked.withColumns({"to": F.lead("at").over(w), "run": F.last("run", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))})
    bits = open_.filter(F.col("at") < F.col("run.b")).select(doc, F.col("run.a").alias("start"), F.col("run.b").alias("stop"), "at", "to")
    listed = first_holder(bits, s, doc, "at", "to").groupBy(doc, "start", "stop").agg(F.array_sort(F.collect_list(F.struct("at", "to", "category"))).alias("bits"))
    listed = listed.select(F.col(doc).alias("__doc"), F.col("start").alias("__start"), "bits")
    own = r.join(listed, r[doc].eqNullSafe(listed["__doc"]) & (r["start"] == listed["__start"]))
    cut = own.withColumn("__texts", _sliced(F.col("text"), F.col("bits"), F.col("start")))
    each = cut.select(doc, *carry, F.inline(F.arrays_zip("bits", F.col("__texts").alias("piece"))))
    return each.select(doc, F.col("bits.at").alias("start"), F.col("piece").alias("text"), F.col("bits.category").alias("category"), *carry)


def words_left(paragraphs: DataFrame, spans: DataFrame, doc: str, is_scene: Column) -> DataFrame:
    """(doc, scene, role, words): words outside the spans, by scene and speaker.

    ``paragraphs`` has (doc, start, text, bold, italic). Bold ones are names, or titles where ``is_scene`` says so; what
    follows a name is its speech. Every speaker of a name is credited, everyone at once nobody; italic paragraphs count not.
    """
    upto = W.partitionBy(doc).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    scene = F.last(F.when(F.col("bold") & is_scene, F.col("text")), ignorenulls=True).over(upto)
    name = F.last(F.when(F.col("bold") & ~is_scene, F.col("text")), ignorenulls=True).over(upto)
    said = paragraphs.withColumns({"scene": scene, "name": name}).filter(~F.col("bold") & ~F.col("italic"))
    pieces = cut_runs(said.select(doc, "start", "text", "scene", "name"), spans, doc, ("scene", "name")).filter("category is null")
    each = pieces.select(doc, "scene", F.explode(X.speakers(F.col("name"))).alias("role"), F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    return each.filter("role <> '*'").groupBy(doc, "scene", "role").agg(F.sum("w").cast("long").alias("words"))


def with_tracked_cuts(pieces: DataFrame, doc: str, authors: dict[int, str], date: str) -> DataFrame:
    """(doc, n, xml): markup of each run, numbered within its document; cut pieces are deletions of their category's author."""
    def escaped(text: Column) -> Column:
        plain = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            plain = F.replace(plain, F.lit(sign), F.lit(name))
        return plain

    number = (F.row_number().over(W.partitionBy(doc).orderBy("start")) - 1).cast("string")
    who = F.try_element_at(F.create_map(*[x for k, v in authors.items() for x in (F.lit(k), escaped(F.lit(v)))]), F.col("category").cast("int"))
    who = F.coalesce(who, F.raise_error(F.concat(F.lit("no author for category "), F.col("category").cast("string"))))
    kept = F.concat(F.lit('<w:r><w:t xml:space="preserve">'), escaped(F.col("text")), F.lit("</w:t></w:r>"))
    cut = F.concat(
        F.lit('<w:del w:id="'), number, F.lit('" w:author="'), who, F.lit(f'" w:date="{date}"><w:r><w:delText xml:space="preserve">'), escaped(F.col("text")),
        F.lit("</w:delText></w:r></w:del>")
    )
    return pieces.select(doc, number.cast("long").alias("n"), F.when(F.col("category").isNull(), kept).otherwise(cut).alias("xml"))


def classification_report(labels: DataFrame, doc: str) -> DataFrame:
    """(doc, report): a line per label by type, with totals."""
    line = F.format_string(
        "%-20s %-12s %-10s %3d %3d  %s", F.col("type"), F.col("label"), F.col("confidence"), F.col("occurrences"), F.col("speech_after"),
        F.col("reason")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "label", line.alias("l")))), lambda s: s["l"]), "\n")
    return labels.groupBy(doc).agg(body.alias("body"), F.count("*").alias("n"), F.count_if(F.col("confidence") == "incertaine").alias("unsure")).select(
        doc, F.concat("body", F.format_string("\n%d labels, %d uncertain", F.col("n"), F.col("unsure"))).alias("report")
    )


def restarted_numbering(labels: DataFrame, doc: str) -> DataFrame:
    """Documents of one level of at least three numbered titles whose values repeat. ``labels`` come from ``numbering``."""
    numbered = labels.filter("numbered")
    return numbered.groupBy(doc).agg(
        F.count("value").alias("n"), F.countDistinct("value").alias("d"), F.countDistinct("style").alias("s")
    ).filter("s < 2 and n >= 3 and d < n").select(doc)
