"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is lower-cased, runs of ASCII white space become one space, and every 8 characters (UTF-16 units) in a row have a 64-bit
hash, of which 38 bits stay. Of every 8 neighbouring hashes the smallest is chosen, the rightmost of equal ones, and its position
is kept. Any passage of 15 characters that two texts share therefore leaves a common entry in both fingerprints, in any script
and with or without spaces. A text of fewer than 8 characters is one gram, and one of fewer than 8 grams is one window.
Grams of 5 words, of which a passage needs 12, are there for callers whose texts are long and have spaces.

A hash stands in the high bits of a long and the position, counted down, in its low 26 bits: the least of some longs is
then the smallest hash and, among equals, the rightmost. Windows are minima of minima over 1, 2 and 4 places. Where an edited
text begins as the text itself does, which is compared, the minima of that part are taken over and not computed again.

Neighbours in document order come from one exchange: documents are dealt by ranges of their ids, and the first document
of each range is sent once more to the range before it. Ranges are quantiles of a bounded sample of ids and hashes of texts,
so they are even however the ids lie, and documents of one id, or of none, are many ranges where they are many. The sample
decides only where ranges begin. Rows equal in id and text lie in one range.

Defined results: null and blank texts have the empty fingerprint, two empty fingerprints are alike (1.0), an empty and
another are not (0.0); equal ids are ordered by a hash of their texts; positions count modulo 2**26; a single
document is its own next one; an empty table gives an empty result; ids are integers, others are an error; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.llm.common import gram_hashes, read, words_of

GRAM, CHARACTERS, WINDOW = 5, 8, 8
POSITION_BITS = 26
_NOT_ONE_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
_LAST = (1 << POSITION_BITS) - 1
#: Bytes of a gram of characters in UTF-16.
_WIDE = 2 * CHARACTERS
_NONE = "array<bigint>"


def _packed(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LAST)).bitwiseOR(F.bitwise_not(i).bitwiseAND(F.lit(_LAST)))


def word_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the packed hash of every GRAM words in a row."""
    words, grams = f"{out}_words", f"{out}_grams"
    df = df.withColumn(words, F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))
    df = gram_hashes(df, words, grams)
    whole = F.when(F.size(words) == 0, F.array().cast(_NONE)).otherwise(F.array(F.xxhash64(words)))
    df = df.withColumn(grams, F.when(F.size(words) < GRAM, whole).otherwise(F.col(grams)))
    return df.withColumn(out, F.transform(grams, _packed)).drop(words, grams)


def wide(text: Column) -> Column:
    """The text of which grams of characters are taken, in UTF-16, where any of them is found at once."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.encode(F.regexp_replace(trimmed, _NOT_ONE_SPACE, " "), "UTF-16BE")


def grams_from(units: Column, first: Column) -> Column:
    """The packed hash of every CHARACTERS units in a row of a ``wide`` text, from the gram numbered ``first`` on."""

    def grams(u: Column) -> Column:
        n, at = F.length(u), first * 2 + 1
        starts = F.when(n < at, F.array().cast("array<int>")).otherwise(F.sequence(at, F.greatest(n - (_WIDE - 1), at), F.lit(2)))
        return F.transform(starts, lambda s, i: _packed(F.xxhash64(F.substring(u, s, F.lit(_WIDE))), i + first))

    # as a variable, for a binary column is copied whole wherever it is named
    return F.transform(F.array(units), grams)[0]


def character_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the packed hash of every CHARACTERS characters in a row."""
    return df.withColumn(out, grams_from(wide(F.col(text)), F.lit(0)))


Grams = Callable[[DataFrame, str, str], DataFrame]


def with_minima(df: DataFrame, packed: str, out: str) -> DataFrame:
    """Adds ``out``: the least of every WINDOW neighbours in the array ``packed``, one after the other."""
    minima = packed
    for width, name in ((1, f"{out}_two"), (2, f"{out}_four"), (4, out)):
        rest = F.greatest(F.size(packed) - (2 * width - 1), F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(minima, 1, rest), F.slice(minima, 1 + width, rest), lambda a, b: F.least(a, b)))
        minima = name
    return df.drop(f"{out}_two", f"{out}_four")


def chosen(packed: str, minima: Column) -> Column:
    """The fingerprint: the minima of the windows, of fewer grams than a window has the least."""
    n = F.size(packed)
    single = F.when(n == 0, F.array().cast(_NONE)).otherwise(F.array(F.array_min(packed)))
    return F.when(n < WINDOW, single).otherwise(F.array_distinct(minima))


def with_fingerprint(df: DataFrame, text: str, out: str, grams: Grams = word_grams) -> DataFrame:
    """Adds ``out``, an array of longs: the chosen hashes with their positions, in the order of the text."""
    packed, minima = f"__{out}_packed", f"__{out}_minima"
    df = with_minima(grams(df, text, packed), packed, minima)
    return df.withColumn(out, chosen(packed, F.col(minima))).drop(packed, minima)


def with_both(df: DataFrame, text: str, edited: str, kept: Column) -> DataFrame:
    """Adds ``fp`` and ``edited_fp`` by grams of characters. At most ``kept`` first characters of both texts are equal."""
    df = df.withColumns({"__w": wide(F.col(text)), "__e": wide(F.col(edited))})
    units = (F.length("__w") / 2).cast("int")
    # white space that was taken out may have stood in front
    likely = F.greatest(kept - F.greatest(F.length(F.coalesce(text, F.lit(""))) - units, F.lit(0)) - 1, F.lit(0))
    df = df.withColumn("__likely", F.least(likely, units))
    same = F.substring("__w", F.lit(1), 2 * F.col("__likely")) == F.substring("__e", F.lit(1), 2 * F.col("__likely"))
    # windows of both that lie in the common part
    df = df.withColumn("__from", F.when(same, F.greatest(F.col("__likely") - (CHARACTERS + WINDOW - 2), F.lit(0))).otherwise(0))
    df = df.withColumns({"__packed": grams_from(F.col("__w"), F.lit(0)), "__rest": grams_from(F.col("__e"), F.col("__from"))}).drop("__w", "__e", "__likely")
    df = with_minima(with_minima(df, "__packed", "__minima"), "__rest", "__later")
    both = F.concat(F.slice("__minima", F.lit(1), F.col("__from")), "__later")
    # with a common window there are at least WINDOW grams
    later = F.when(F.col("__from") > 0, F.array_distinct(both)).otherwise(chosen("__rest", F.col("__later")))
    return df.withColumns({"fp": chosen("__packed", F.col("__minima")), "edited_fp": later}).drop("__packed", "__rest", "__minima", "__later", "__from")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, POSITION_BITS)))


def as_text(fingerprint: Column) -> Column:
    """The chosen longs joined by spaces: a hash times 2**26 and the position's distance from 2**26 - 1."""
    return F.array_join(fingerprint.cast("array<string>"), " ")


#: Bits of a position that are written: those of neighbours differ by a window at most, so they tell the whole of it.
SHORT_BITS = 6


def compact(fingerprint: Column) -> Column:
    """The same in less than half of the characters: 11 hexadecimal digits for each long, its hash and the lowest bits of the position, all of them as base64.

    The lowest bits lie over the highest ones, which are 0 up to a position of 2**20 and change once in 2**20 positions beyond it.
    """
    short = lambda v: F.shiftrightunsigned(v, POSITION_BITS - SHORT_BITS).bitwiseXOR(v.bitwiseAND(F.lit((1 << SHORT_BITS) - 1)))
    return F.base64(F.unhex(F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(short(v)), 11, "0")), "")))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of the hash sets in the columns ``a`` and ``b``, null ones being empty."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


#: Documents that a range of ids should hold, the most ranges, and how many sampled rows draw the border of each.
RANGE_ROWS, MOST_RANGES, SAMPLED = 2048, 1 << 16, 16


def _place(order: str, text: str) -> Column:
    """Where a row stands by descending ids: rows without an id come last, equal ids by a hash of their texts."""
    i = F.bitwise_not(F.col(order).cast("long"))
    return F.struct(i.isNull().cast("long").alias("without"), F.coalesce(i, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("tie"))


def _heads(df: DataFrame, order: str, text: str) -> list[tuple[int, int, int]]:
    """The places at which ranges of about as many rows begin, in order, the first row's at the front: at most MOST_RANGES, quantiles of a sample."""
    n, first = df.select(_place(order, text).alias("p")).agg(F.count("*"), F.min("p")).first()
    if not n:
        return []
    ranges = min(MOST_RANGES, n // RANGE_ROWS)
    if ranges < 2:
        return [tuple(first)]
    drawn = df.sample(min(1.0, SAMPLED * ranges / n), 7).select(_place(order, text).alias("p"))
    drawn = drawn.agg(F.sort_array(F.collect_list("p")).alias("all"), F.count("*").alias("m"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("all", (k * F.col("m") / ranges).cast("int")))
    return sorted({tuple(first), *(tuple(h) for h in drawn.select(at).first()[0] if h)})


def _range_of(place: Column, heads: list[tuple[int, int, int]]) -> tuple[Column, Callable[[Column], Column]]:
    """The number of the range that a place lies in, found by halving, and a function from numbers to the ranges' heads."""
    bits = max(len(heads) - 1, 0).bit_length()
    padded = heads + [(2, 0, 0)] * ((1 << bits) - len(heads))  # behind all rows
    # one constant for all heads of a kind
    parts = [F.split(F.lit(",".join(str(h[k]) for h in padded)), ",").cast("array<bigint>") for k in range(3)]

    def head(number: Column) -> Column:
        return F.struct(*(F.get(a, number).alias(name) for a, name in zip(parts, ("without", "id", "tie"), strict=True)))

    def halved(state: Column, step: Column) -> Column:
        there = state["at"] + step
        return F.struct(F.when(state["place"] >= head(there), there).otherwise(state["at"]).alias("at"), state["place"].alias("place"))

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(bits)))).cast("array<int>")
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), place.alias("place")), halved, lambda s: s["at"]), head


def with_next(df: DataFrame, order: str, text: str) -> tuple[DataFrame, W]:
    """Rows of ``order`` and ``text`` with ``next_text``, that of the next row by descending ``order``, the first's after the last; and the window in which they lie. The last row of each range, ``__guest`` = 1, is the first of the next."""
    df = df.select(order, text)
    heads = _heads(df, order, text)
    number, head = _range_of(_place(order, text), heads)
    own = df.select(number.alias("__range"), F.lit(0).alias("__guest"), order, text)
    # a head is the place of a row, so the first row of each range is known without a search
    firsts = own.filter(_place(order, text) == head(F.col("__range"))).groupBy("__range", order).agg(F.min(text).alias(text))
    before = F.when(F.col("__range") == 0, len(heads) - 1).otherwise(F.col("__range") - 1)
    guests = firsts.select(before.alias("__range"), F.lit(1).alias("__guest"), order, text)
    rows = own.unionByName(guests).repartition("__range").withColumn("__tie", F.xxhash64(text))
    w = W.partitionBy("__range").orderBy("__guest", F.col(order).desc_nulls_last(), "__tie")
    return rows.withColumn("next_text", F.lead(text).over(w)), w


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", grams: Grams = word_grams, form: Callable[[Column], Column] = as_text) -> DataFrame:
    """Fingerprint of every text, of the text edited by its neighbour's beginning, both written in a ``form``, and the likenesses."""
    rows, w = with_next(df, doc, text)
    whole, after = F.coalesce(F.col(text), F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.length(whole) - F.floor(F.length(whole) / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(whole, F.lit(1), half), F.substring(after, F.lit(1), F.length(whole) - half)))
    if grams is character_grams:
        rows = with_both(rows, text, "edited", half)
    else:
        rows = with_fingerprint(with_fingerprint(rows, text, "fp", grams), "edited", "edited_fp", grams)
    own = ["__range", "__guest", "__tie", doc, "fp", "edited_fp", F.length(whole).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    rows = rows.select(*own).withColumns({"h": hashes(F.col("fp")), "h_edited": hashes(F.col("edited_fp"))})
    rows = rows.withColumn("near_edited", likeness("h", "h_edited")).drop("h_edited")
    rows = rows.withColumn("h_next", F.lead("h").over(w)).filter("__guest = 0")
    rows = rows.withColumn("h_next", F.coalesce("h_next", F.array().cast(_NONE)))
    return rows.select(
        doc, "n_chars", "edited_sha256", form(F.col("fp")).alias("fingerprint"), form(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", likeness("h", "h_next").alias("near_next")
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"), grams=character_grams, form=compact)


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
SQL: dict[str, str] = {}
