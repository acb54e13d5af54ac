"""Best-fit packing of token sequences by linear grouping.

How many pieces there are of each length is at most 4096 numbers, whatever the corpus; the whole plan is made from them
on the driver. Large lengths are sorted and cut into groups of equal cardinality, every length of a group counts as the
group's largest, and the few sizes that result are packed by a linear programme over configurations (columns come from
a knapsack). Configurations are taken a whole number of times, actual lengths take the places of their group's size, and
what is left of large lengths and all small ones go, from the largest, where they fit best.

The plan is a list of runs: so many pieces of a length, from a rank on, go to so many consecutive sequences. Pieces learn
their rank among those of equal length from counts by (length, bucket), so no length meets in one task, and look their
place up in the plan. A length has as many buckets as its pieces take, and a piece's bucket is drawn by the number that it got
when it was cut, so neither a frequent length nor equal rows meet in one task. The plan's size depends on the capacity only.

Defined results: null text is empty text, which is the end token alone; equal rows are packed separately; pieces of equal
length are interchangeable; ids may be of any type, null and repeated ones included; an empty table gives an empty result; columns that the caller does not name are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.llm.common import make_room, read, written
from quillstage.llm.tokens import encoder, vocabulary_path

CAPACITY, END_ID = 4096, 1
#: Numbers of groups and the parts of the capacity up to which a length is small; the plan of fewest sequences is used.
GROUPINGS = ((24, 2), (24, 3), (96, 4), (48, 8))
#: Pieces of one length that are ranked together.
BUCKET_ROWS = 1000


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how often each size goes into one sequence."""
    most = capacity // min(sizes)
    best, choice = np.zeros(capacity + 1), []
    for _ in range(most):
        grown, chosen = best.copy(), np.full(capacity + 1, -1)
        for k, (s, v) in enumerate(zip(sizes, values, strict=True)):
            if v > 0:
                with_k = best[: capacity + 1 - s] + v
                better = with_k > grown[s:] + 1e-12
                grown[s:][better] = with_k[better]
                chosen[s:][better] = k
        choice.append(chosen)
        best = grown
    room, counts = capacity, np.zeros(len(sizes))
    for chosen in reversed(choice):
        if (k := chosen[room]) >= 0:
            counts[k] += 1
            room -= sizes[k]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Columns of an optimal basis of the fractional packing with how often each is taken, rounded down."""
    if not sizes:
        return []
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        used, enters = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(enters > 1e-9, np.maximum(used, 0) / np.where(enters > 1e-9, enters, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    used = np.linalg.solve(basis, need)
    return [(basis[:, k].round().astype(int), int(u + 1e-9)) for k, u in enumerate(used) if u >= 1 - 1e-9]


class Plan:
    """Places for counts of lengths. ``runs``: (length, first rank, pieces, pieces a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = 24, part: int = 3) -> None:
        self.capacity, self.groups, self.runs, self.sequences = capacity, groups, [], 0
        self.taken: dict[int, int] = dict.fromkeys(counts, 0)
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self._group({k: n for k, n in counts.items() if k > capacity // part})
        for length in sorted(counts, reverse=True):
            self._best_fit(length, counts[length] - self.taken[length])
        order = sorted(self.runs)
        self.keys = np.array([self._key(r[0], r[1]) for r in order], np.int64)
        self.table = np.array(order, np.int64).reshape(-1, 6)

    @staticmethod
    def _key(length, rank):
        return (length << 48) | rank

    def _put(self, length: int, pieces: int, each: int, first: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], pieces, each, first, offset))
        self.taken[length] += pieces

    def _leave(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.open:
                insort(self.gaps, gap)
            self.open.setdefault(gap, []).append((first, n))

    def _group(self, counts: dict[int, int]) -> None:
        total = sum(counts.values())
        if not total:
            return
        groups: list[list[list[int]]] = []
        left = 0
        for length in sorted(counts, reverse=True):
            n = counts[length]
            while n:
                if not left:
                    groups.append([])
                    left = -(-total // self.groups)
                part = min(n, left)
                groups[-1].append([length, part])
                n, left = n - part, left - part
        # groups of one largest length are one size
        merged: dict[int, list[list[int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        stock = {s: list(reversed(merged[s])) for s in sizes}
        for column, times in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], self.capacity):
            self._fill([s for s, k in zip(sizes, column, strict=True) for _ in range(k)], times, stock)

    def _fill(self, slots: list[int], times: int, stock: dict[int, list[list[int]]]) -> None:
        """Actual lengths into ``times`` sequences of one configuration."""
        done = 0
        taken: list[list[list[int]]] = []
        for s in slots:
            need, parts = times, []
            while need:
                length, n = stock[s][-1]
                part = min(n, need)
                parts.append([length, part])
                need -= part
                stock[s][-1][1] -= part
                if not stock[s][-1][1]:
                    stock[s].pop()
            taken.append(parts[::-1])
        while done < times:
            n = min(parts[-1][1] for parts in taken)
            offset = 0
            for parts in taken:
                self._put(parts[-1][0], n, 1, self.sequences, offset)
                offset += parts[-1][0]
                parts[-1][1] -= n
                if not parts[-1][1]:
                    parts.pop()
            self._leave(self.capacity - offset, self.sequences, n)
            self.sequences += n
            done += n

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.gaps, length)
            if at == len(self.gaps):
                new = -(-n // (self.capacity // length))
                self._leave(self.capacity, self.sequences, new)
                self.sequences += new
                continue
            gap = self.gaps[at]
            first, bins = self.open[gap].pop()
            if not self.open[gap]:
                del self.open[gap], self.gaps[at]
            each = gap // length
            full = min(bins, n // each)
            if full:
                self._put(length, full * each, each, first, self.capacity - gap)
                self._leave(gap - each * length, first, full)
                n -= full * each
            if full < bins:
                rest = n if n < each else 0
                if rest:
                    self._put(length, rest, rest, first + full, self.capacity - gap)
                    self._leave(gap - rest * length, first + full, 1)
                    n = 0
                self._leave(gap, first + full + bool(rest), bins - full - bool(rest))

    @classmethod
    def best(cls, counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
        """The plan of fewest sequences over GROUPINGS."""
        return min((cls(counts, capacity, *g) for g in GROUPINGS), key=lambda plan: plan.sequences)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these ranks (from 0) among those of their lengths."""
        if not len(length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        run = self.table[np.searchsorted(self.keys, self._key(length.astype(np.int64), rank.astype(np.int64)), "right") - 1]
        nth = rank - run[:, 1]
        return run[:, 4] + nth // run[:, 3], run[:, 5] + nth % run[:, 3] * length


def cut(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row per piece of a document: piece, start, length and CRC-32 of its ids, and ``row``, a number no other piece has; only longer documents are cut."""
    path = tokenizer or vocabulary_path()

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room("quillstage.llm.tokens")
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        for frame in frames:
            docs = frame["d"]
            for first, ids, begins in encoder(path).batches(frame["t"].tolist()):
                rows = []
                for i in range(len(begins) - 1):
                    whole = np.append(ids[begins[i] : begins[i + 1]], np.uint32(END_ID)).astype("<u4")
                    rows += [(first + i, k, s, len(part := whole[s : s + capacity]), zlib.crc32(part.tobytes())) for k, s in enumerate(range(0, len(whole), capacity))]
                out = pd.DataFrame(rows, columns=["at", "piece", "start", "length", "ids_crc32"])
                out.insert(0, doc, docs.iloc[out.pop("at").to_numpy()].to_numpy())
                out["row"] = number + np.arange(len(out))
                number += len(out)
                yield out

    # ids travel as text: pandas would make floats of them where one is null
    found = df.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(
        pieces, f"`{doc}` string, piece int, start long, length long, ids_crc32 long, row long"
    )
    return found.withColumn(doc, F.col(doc).cast(df.schema[doc].dataType))


def pack(pieces: DataFrame, row: str = "row", length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. ``pieces`` is read twice, so it must be a table; its numbers ``row`` differ."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}  # capacity rows at most
    plan = pieces.sparkSession.sparkContext.broadcast(Plan.best(counts, capacity))
    buckets = F.get(F.lit([1 + counts.get(k, 0) // BUCKET_ROWS for k in range(capacity + 1)]), F.col(length).cast("int"))
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(row), buckets).cast("int"))
    before = keyed.groupBy(length, "__bucket").agg(F.count("*").alias("__n"))
    before = before.select(length, "__bucket", (F.sum("__n").over(W.partitionBy(length).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    ranked = keyed.withColumn("__rank", F.row_number().over(W.partitionBy(length, "__bucket").orderBy(row)) - 1)
    ranked = ranked.join(before, [length, "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__bucket", "__before")
    names = [c for c in ranked.columns if c != "__rank"]
    kinds = {c: ranked.schema[c].dataType for c in names}
    whole = (length, "piece", "start", "ids_crc32", row)
    # other columns travel as text: pandas would make floats of numbers where one is null
    as_text = ranked.select(*(F.col(c) if c in whole else F.col(c).cast("string").alias(c) for c in names), F.col(length).cast("long").alias("__length"), "__rank")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = plan.value.find(frame["__length"].to_numpy(), frame["__rank"].to_numpy())
            yield frame[names].assign(sequence_id=sequence, offset=offset)

    schema = as_text.select(names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    placed = as_text.mapInPandas(place, schema)
    return placed.select(*(F.col(c).cast(kinds[c]).alias(c) for c in names), "sequence_id", "offset")


def pack_documents(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut into pieces, packed."""
    packed = pack(written(cut(df, doc, text), "pieces"))
    return packed.select(doc, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}
