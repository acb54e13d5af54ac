"""Search of fragments in texts by an inverted index of their two and three characters in a row, of many fragments by one scan.

Texts are compared without accents, case and marks. ``indexed`` writes the texts with a number each; the index itself is written
when it is first asked: for each gram sorted lists of the numbers of the texts that have it, of which one holds the numbers of a block
of 65,536. So the list of a gram that stands everywhere is many rows of bounded size. ``found`` looks up the rarest grams of
each needle, intersects their lists block by block, and reads only the texts that are left, to see whether they hold the needle.
Lists grow with the texts, so many needles would take needles times texts: these are met by their beginnings in one pass over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X
from quillstage.sources.folder import shared_folder

#: Characters of a needle at least, of the pieces that grams are taken from and that are scanned, and lists that are intersected for a needle.
LEAST, PIECE, SCAN_PIECE, LISTS = 2, 256, 64, 4
BLOCK_BITS = 16
#: Rows of needles' grams that are broadcast.
MOST_BROADCAST = 100_000
#: Needles that are looked up in the index, more are scanned for; how many characters of a needle's beginning are joined with those
#: of texts, the largest that it has; needles of a scan that are broadcast, and their characters.
MOST_LOOKED_UP, BEGINNINGS, MOST_SCANNED, MOST_CHARS = 64, (2, 3, 4, 6, 8, 12, 16, 24, 32), 1_000_000, 32_000_000
# Marks that count as spaces.
MARKS = r"[.,;:!?…«»\"“”()\[\]{}—–*-]"


def searchable(text: Column) -> Column:
    """The form in which texts and needles are compared."""
    return X.squeeze(F.regexp_replace(F.lower(X.strip_accents(text)), MARKS, " "))


def grams(text: Column, size: int) -> Column:
    """Every ``size`` characters in a row of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _pieces(texts: DataFrame, size: int, more: int) -> DataFrame:
    """(number, p): the searchable texts in pieces of ``size`` characters and ``more`` of the next.

    A character far inside a long text is found by walking up to it, so grams are taken from short pieces.
    """
    plain = texts.select("number", searchable(F.col("text")).alias("t"))
    n = F.length("t")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))
    return plain.filter(n >= LEAST).select("number", F.explode(F.transform(starts, lambda i: F.substring("t", i, F.lit(size + more)))).alias("p"))


@dataclass
class Index:
    """``texts`` has the numbered texts with their keys, ``lists`` (gram, block, texts): sorted numbers."""

    texts: DataFrame
    keys: list[str]

    @cached_property
    def lists(self) -> DataFrame:
        """Written when they are first asked for, sorted by gram, so that a look-up reads few of them."""
        pieces = _pieces(self.texts, PIECE, 2)
        each = pieces.select("number", F.explode(F.array_distinct(F.concat(grams(F.col("p"), 2), grams(F.col("p"), 3)))).alias("gram")).filter(F.length("gram") >= LEAST)
        block = F.shiftright("number", BLOCK_BITS)
        lists = each.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_set("number")).alias("texts"))
        return _stored(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), "lists")


def indexed(texts: DataFrame, keys: list[str], text: str = "text") -> Index:
    """The index of all texts, in the shared folder."""
    return Index(_stored(texts.select(*keys, F.col(text).alias("text"), F.monotonically_increasing_id().alias("number")), "texts"), keys)


def _scanned(index: Index, asked: DataFrame, needle: str, sizes: list[int], longest: int, few: bool) -> DataFrame:
    """(needle, number) of the texts that hold a needle: every place of a text is joined by its next characters with the beginnings of needles."""
    begins = F.coalesce(*(F.when(F.length("__n") >= k, F.substring("__n", 1, k)) for k in sorted(sizes, reverse=True)))
    wanted = asked.withColumn("__begin", begins)
    # a piece holds whole what begins in it; rows are made one by one in compiled code, arrays of beginnings would be interpreted
    size = max(SCAN_PIECE, longest)
    pieces = _pieces(index.texts, size, longest - 1)
    places = pieces.select("number", "p", F.explode(F.sequence(F.lit(1), F.least(F.length("p"), F.lit(size)))).alias("i"))
    begun = [F.substring("p", F.col("i"), F.lit(k)) for k in sizes]
    places = places.withColumn("b", begun[0] if len(begun) == 1 else F.explode(F.array(*begun)))
    met = places.join(F.broadcast(wanted) if few else wanted, F.col("b") == F.col("__begin"))
    return met.filter(F.substring("p", F.col("i"), F.length("__n")) == F.col("__n")).select(needle, "number").distinct()


def found(index: Index, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, the index's keys, text) of every text that holds a needle of LEAST characters and more, in the searchable form of both."""
    asked = needles.select(needle).distinct().withColumn("__n", searchable(F.col(needle))).filter(F.length("__n") >= LEAST)
    size = F.coalesce(*(F.when(F.length("__n") >= k, F.lit(k)) for k in reversed(BEGINNINGS)))
    many = asked.agg(F.count("*").alias("n"), F.sum(F.length("__n")).alias("chars"), F.max(F.length("__n")).alias("longest"), F.collect_set(size).alias("sizes")).first()
    if many.n > MOST_LOOKED_UP:
        scanned = _scanned(index, asked, needle, sorted(many.sizes), many.longest, many.n <= MOST_SCANNED and many.chars <= MOST_CHARS)
        return index.texts.join(scanned, "number").select(needle, *index.keys, "text")
    # of a needle of two characters the only gram is the needle itself
    wanted = asked.select(needle, "__n", F.explode(F.array_distinct(F.when(F.length("__n") > 2, grams(F.col("__n"), 3)).otherwise(F.array("__n")))).alias("gram"))
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    bound = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    sizes = index.lists.join(bound(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum(F.size("texts")).alias("size"))
    rarest = W.partitionBy(needle).orderBy(F.col("size").asc_nulls_first(), "gram")
    chosen = wanted.join(sizes, "gram", "left").withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= LISTS)
    chosen = chosen.withColumn("lists", F.count("*").over(W.partitionBy(needle))).select(needle, "__n", "gram", "lists")
    met = index.lists.join(bound(chosen), "gram").groupBy(needle, "__n", "lists", "block").agg(F.collect_list("texts").alias("all"))
    # a gram that stands nowhere in a block leaves nothing of it
    common = met.filter(F.size("all") == F.col("lists")).withColumn("number", F.explode(F.reduce("all", F.get("all", F.lit(0)), F.array_intersect)))
    hits = index.texts.join(common.select(needle, "__n", "number"), "number")
    return hits.filter(F.contains(searchable(F.col("text")), F.col("__n"))).select(needle, *index.keys, "text")
