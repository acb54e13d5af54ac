"""Ordered lines, pages and blocks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X

PAGES_PER_BLOCK = 8
_PAGE_LINE = r"(?im)(?=^[\t-\r ]*\[PAGE[\t-\r ]+\d+\][\t-\r ]*$)"


def lines_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no from 0, line); a null text has no line."""
    return df.select(doc, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def pages_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, page_no from 1, page): cut at separators, else before page marks; blank pages are dropped."""
    cut = F.when(F.col(text).rlike(X.PAGE_BREAK), F.split(text, X.PAGE_BREAK, -1)).otherwise(F.split(text, _PAGE_LINE, -1))
    kept = F.filter(F.transform(cut, X.strip), lambda p: p != "")
    return df.select(doc, F.posexplode(kept).alias("page_no", "page")).withColumn("page_no", F.col("page_no") + 1)


def first_pages(pages: DataFrame, n: int | None = None) -> DataFrame:
    """The first n pages of each document, all without a limit."""
    if n is not None and n < 1:
        raise ValueError("at least one page is read")
    return pages if n is None else pages.filter(F.col("page_no") <= n)


def blocks_of(pages: DataFrame, doc: str, size: int = PAGES_PER_BLOCK, separator: str = "\n\n<<<PAGE_BREAK>>>\n\n") -> DataFrame:
    """Consecutive pages by ``size``: block, first_page, last_page, content."""
    if size < 1:
        raise ValueError("a block has at least one page")
    block = (F.floor((F.col("page_no") - 1) / size) + 1).cast("int").alias("block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda s: s["page"]), separator)
    return pages.groupBy(doc, block).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), joined.alias("content"))


def tail_window(text: Column, n: int) -> tuple[Column, Column]:
    """What precedes the last n lines, and these."""
    lines = F.split(text, "\n", -1)
    few = F.size(lines) <= n
    return F.when(few, "").otherwise(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - n, F.lit(0))), "\n")), F.when(few, text).otherwise(F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n"))


def head_window(text: Column, n: int) -> tuple[Column, Column]:
    """The first n lines, and what follows."""
    lines = F.split(text, "\n", -1)
    few = F.size(lines) <= n
    return F.when(few, text).otherwise(F.array_join(F.slice(lines, F.lit(1), F.lit(n)), "\n")), F.when(few, "").otherwise(F.array_join(F.slice(lines, F.lit(n + 1), F.greatest(F.size(lines) - n, F.lit(0))), "\n"))


def assembled(parts: Column) -> Column:
    """Parts stripped, blanks dropped, joined by an empty line, with a final line feed; empty where nothing is left."""
    kept = F.filter(F.transform(parts, X.strip), lambda p: (p != "") & p.isNotNull())
    return F.when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, "\n\n"), F.lit("\n")))


def rejoined(left: Column, right: Column) -> Column:
    parts = F.filter(F.array(X.strip(left), X.strip(right)), lambda p: p != "")
    return F.concat(X.strip(F.array_join(parts, "\n")), F.lit("\n"))


def next_line_is_speech(lines: DataFrame, doc: str) -> DataFrame:
    """Adds speech_next: whether the next line that is not blank is speech; false at the end."""
    # backwards, as frames that begin unbounded are kept up from row to row
    ahead = W.partitionBy(doc).orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    kind = F.when(X.strip(F.col("line")) != "", X.is_speech(F.col("line")))
    return lines.withColumn("speech_next", F.coalesce(F.last(kind, ignorenulls=True).over(ahead), F.lit(False)))


def split_inline(line: Column) -> Column:
    """``**NAME[, aside].** speech`` as struct(name, aside, speech), else null.

    Emphasis inside a sentence is told by a label without final point whose continuation begins small.
    """
    pattern = r"^\*\*([^*\n]+)\*\*[\t-\r ]+(\S.*)$"

    def judged(raw: Column, said: Column, before: Column, after: Column, with_aside: Column) -> Column:
        name = F.when(with_aside, before).otherwise(raw)
        fits = X.is_name(name) & (said != "") & (name.endswith(".") | with_aside | ~X.starts_small(said))
        return F.when(fits, F.struct(name.alias("name"), F.when(with_aside, after).alias("aside"), said.alias("speech")))

    def parts(p: Column) -> Column:
        return judged(p["raw"], p["said"], p["before"], p["after"], p["comma"] & X.is_name(p["before"]) & (p["after"] != ""))

    def cut(raw: Column, said: Column) -> Column:
        return F.struct(
            raw.alias("raw"), said.alias("said"), X.strip(F.regexp_extract(raw, r"^([^,]*),", 1)).alias("before"),
            X.strip(F.regexp_extract(raw, r"^[^,]*,(.*)$", 1)).alias("after"), (F.instr(raw, ",") > 0).alias("comma")
        )

    def fitting(s: Column) -> Column:
        raw, rest = X.strip(F.regexp_extract(s, pattern, 1)), X.strip(F.regexp_extract(s, pattern, 2))
        return X.let(raw, lambda r: X.let(cut(r, F.regexp_replace(rest, r"^[–—−-][\t-\r ]*", "")), parts))

    return X.let(X.strip(line), lambda s: F.when(s.startswith("**") & s.rlike(pattern), fitting(s)))


def emphasis_runs(line: Column) -> Column:
    """Runs of a line: array of struct(text, bold, italic); a stray star is text."""
    bits = F.regexp_extract_all(line, F.lit(r"\*\*[^*]+\*\*|\*[^*]+\*|[^*]+|\*"), F.lit(0))
    run = lambda t, b, i: F.struct(t.alias("text"), F.lit(b).alias("bold"), F.lit(i).alias("italic"))
    return F.transform(
        bits,
        lambda t: F.when(
            t.rlike(r"^\*\*[^*]+\*\*$"), run(F.regexp_replace(t, r"^\*\*|\*\*$", ""), True, False)
        ).when(t.rlike(r"^\*[^*]+\*$"), run(F.regexp_replace(t, r"^\*|\*$", ""), False, True)).otherwise(run(t, False, False))
    )
