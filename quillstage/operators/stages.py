"""Work units, journals and stages: what is to be done, what became of it, and calls of an injected model."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RETRIES, MOST_CALLS = 2, 5000
#: Statuses of HTTP that no second try mends.
FINAL_CODES = frozenset([400, 401, 403, 404, 422])


def to_do(status: Column, retries: Column) -> Column:
    """Whether a unit is to be done (again): unless finished, or doubtful and tried often enough."""
    return ~F.coalesce((status == "termine") | ((status == "suspect") & (retries >= MOST_RETRIES)), F.lit(False))


def status_of(findings: Column) -> Column:
    return F.when(F.size(findings) == 0, "termine").otherwise("suspect")


def pending(units: DataFrame, sidecars: DataFrame, key: list[str], bounds: tuple[str, ...] = ()) -> DataFrame:
    """Units without a finished sidecar of the same bounds."""
    done = sidecars.filter(~to_do(F.col("status"), F.col("retries"))).select(*key, *bounds).distinct()
    return units.join(done, [*key, *bounds], "left_anti")


def invalidated(sidecars: DataFrame, changed: DataFrame, book: str, number: str) -> DataFrame:
    """Sidecars of junctions without those beside a changed block: n-1 and n."""
    beside = changed.select(book, F.explode(F.array(F.col(number) - 1, F.col(number))).alias(number)).distinct()
    return sidecars.join(beside, [book, number], "left_anti")


def counters(sidecars: DataFrame, book: str) -> DataFrame:
    """Per book: units by status, the first and last failed one, whether all is complete; the last row is the total."""
    s = F.col("status")
    per = sidecars.rollup(book).agg(
        F.count_if(s == "termine").alias("finished"), F.count_if(s == "suspect").alias("doubtful"),
        F.count_if(s == "echec").alias("failed"), F.min(F.when(s == "echec", F.col("number"))).alias("first_failed"),
        F.max(F.when(s == "echec", F.col("number"))).alias("last_failed"), F.grouping(book).cast("boolean").alias("is_total")
    )
    return per.withColumn("complete", (F.col("doubtful") == 0) & (F.col("failed") == 0))


def assembled(spine: DataFrame, parts: DataFrame, book: str, number: str, text: str, missing: str, size: int = 200) -> DataFrame:
    """(book, piece, content): books from their parts in order; ``missing`` (with %d) stands for a part that is absent or blank.

    A piece holds the parts of ``size`` consecutive numbers, so that no book is one row; pieces joined in order are the book.
    """
    rows = spine.join(parts.select(book, number, text), [book, number], "left")
    filled = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.trim(text)).otherwise(F.format_string(missing, F.col(number)))
    rows = rows.withColumn("__t", filled)
    piece = F.floor(F.col(number) / size).cast("long").alias("piece")
    return rows.groupBy(book, piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "__t"))), lambda s: s["__t"]), "\n\n").alias("content"))


def newest_calls(calls: DataFrame, at: str, tie: str, most: int = MOST_CALLS) -> DataFrame:
    """The newest calls of a journal: a distributed top-k."""
    return calls.orderBy(F.desc(at), F.desc(tie)).limit(most)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it does not replace."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def not_imported(manifest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return manifest.join(stored.select(key), key, "left_anti")


def transcript_route(sidecar_done: Column, layer_ok: Column, blank: Column) -> Column:
    """Where a page's text comes from, the cheapest source first."""
    return F.when(sidecar_done, "done").when(layer_ok, "text_layer").when(blank, "blank").otherwise("model")


def retriable(code: int | None) -> bool:
    return code not in FINAL_CODES


#: Seconds before a second try and at most, and the part of them that chance adds, so that tries of many tasks drift apart.
FIRST_WAIT, MOST_WAIT, JITTER = 5.0, 60.0, 0.25


def waited(attempt: int, first: float = FIRST_WAIT, chance: float | None = None) -> float:
    """Seconds to wait after the failed try number ``attempt``; ``chance`` is a number from 0 to 1, drawn where none is given."""
    seconds = min(MOST_WAIT, first * 2 ** (attempt - 1))
    return round(seconds * (1 + JITTER * (random.random() if chance is None else chance)), 2)


def called(
    units: DataFrame, key: list[str], prompt: str, client: Callable[[str], str], tries: int = 4, blanks: int = 1, first: float = FIRST_WAIT,
    pause: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Answers of a model to the prompts of units: key, answer, tries, error. ``client`` is injected and may raise.

    An error with an attribute ``code`` that no second try mends ends the tries at once, and so do ``blanks`` blank answers. Before
    every further try the task waits, from ``first`` seconds on, each time twice as long.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for text in frame[prompt].tolist():
                answer, error, blank = None, None, 0
                for n in range(1, tries + 1):
                    try:
                        answer, error = client(text), None
                        blank += not answer.strip()
                        if answer.strip() or blank >= blanks:
                            break
                    except Exception as fault:
                        answer, error = None, f"{type(fault).__name__}: {fault}"
                        if not retriable(getattr(fault, "code", None)):
                            break
                    if n < tries:
                        pause(waited(n, first))
                answers.append((answer, n, error))
            yield pd.concat([frame[key].reset_index(drop=True), pd.DataFrame(answers, columns=["answer", "tries", "error"])], axis=1)

    schema = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in key) + ", answer string, tries int, error string"
    return units.select(*dict.fromkeys([*key, prompt])).mapInPandas(run, schema)


def folded_rows(frames: Iterator[pd.DataFrame], book: str, text: str, client: Callable[[str, str], tuple[str, str]], lines: int) -> Iterator[pd.DataFrame]:
    """Blocks in order with their seams corrected. Only the last block waits for the next one, over the ends of frames and of books."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if frame.empty:
            continue
        books, texts = frame[book].tolist(), frame[text].tolist()
        # of the block that was held the seam before it is done
        for i in range(len(texts) - 1):
            if books[i] == books[i + 1] or (books[i] != books[i] and books[i + 1] != books[i + 1]):
                left, right = texts[i].split("\n"), texts[i + 1].split("\n")
                a, b = client("\n".join(left[-lines:]), "\n".join(right[:lines]))
                texts[i], texts[i + 1] = "\n".join([*left[:-lines], a]), "\n".join([b, *right[lines:]])
        frame = frame.assign(**{text: texts})
        held = frame.iloc[-1:]
        yield frame.iloc[:-1]
    if held is not None:
        yield held


def junctions_folded(blocks: DataFrame, book: str, number: str, text: str, client: Callable[[str, str], tuple[str, str]], lines: int = 50) -> DataFrame:
    """Corrects the seams of each book's blocks one after the other: the corrected head of a block takes part in its next seam.

    Sequential by nature within a book. Blocks are sorted within the partition of their book, which spills, and streamed: a task holds
    one batch of blocks and the one that waits for its next seam, however large a book is. Books run beside each other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    rows = blocks.select(book, number, F.coalesce(text, F.lit("")).alias(text)).repartition(book).sortWithinPartitions(book, number, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return folded_rows(frames, book, text, client, lines)

    return rows.mapInPandas(run, f"`{book}` {kinds[book]}, `{number}` {kinds[number]}, `{text}` string")


def first_missing(made: DataFrame, book: str, stage: str, stages: list[str]) -> DataFrame:
    """(book, ready, missing): how many of the stages in their order a book has behind it, and the first that it lacks, null with all."""
    has = made.groupBy(book).agg(F.collect_set(stage).alias("__has"))
    lacks = F.filter(F.array(*map(F.lit, stages)), lambda s: ~F.array_contains("__has", s))
    ready = F.coalesce(F.array_position(F.array(*map(F.lit, stages)), F.get(lacks, F.lit(0))) - 1, F.lit(len(stages)))
    return has.select(book, ready.cast("long").alias("ready"), F.get(lacks, F.lit(0)).alias("missing"))


def prefixed(store: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """The entries of a key-value table whose keys begin so."""
    return store.filter(F.col(key).startswith(prefix))


def imported(store: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """A key-value table with what it lacked; an entry that it has is not replaced."""
    return store.unionByName(incoming.join(store.select(key), key, "left_anti"))


def run_stages(stages: Iterable[tuple[str, Callable[[], bool]]], stop_at_failure: bool = True) -> dict[str, bool]:
    """Results of stages by name; stops at the first that fails."""
    results: dict[str, bool] = {}
    for name, stage in stages:
        results[name] = bool(stage())
        if stop_at_failure and not results[name]:
            break
    return results
