"""Near duplicates by SetSketch registers, with exact confirmation.

A document's set are its distinct shingles of five words. Register i of its sketch is an exponential minimum over the set on
a logarithmic scale, floor(1 - log_b x), truncated to 16 bits: registers of two sets are equal with nearly the chance of
their Jaccard similarity, and the registers of a union are the larger ones. 48 bands of 5 registers lead a pair of similarity
0.75 to a common bucket but for two pairs in a million.

Rows of equal sets are one class, which has a number of its own, so that ids need be neither present nor distinct; one row
stands for it. In every bucket each class is compared with the first; the links found make components, and then classes of a
bucket that are still apart are compared with each other, so no candidate of a bucket is left out while most pairs of a large
group are never made. A comparison first estimates the
similarity from how many registers are larger, smaller and equal and from both set sizes, by maximum likelihood; pairs whose
estimate is within reach of the threshold are confirmed on the full sets.

Sets are dealt to parts of bounded size; for its pairs a document's set is sent once to each part that holds other ends, and
streamed by them. Buckets are compared in blocks of bounded size. Nothing of all documents reaches the driver.

Defined results: a text of fewer than five words is one shingle; a text without words is empty and linked with nothing, so
``keep_one`` keeps it; texts make links and ids do not, so rows of equal ids and different texts are linked like others; a
component's id is the smallest that a row of it has, null where none has one; ``keep_one`` keeps a single row of each
component, that of the smallest id and text hash, of rows equal in both any one; an empty table gives an empty result; ids are
integers, others are an error; other columns are ignored, or kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import discard, make_room, read, written
from quillstage.llm.components import components

SHINGLE, BANDS, ROWS = 5, 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: The least similarity in per cent, and how far an estimate may be below it: over four standard deviations.
THRESHOLD, REACH = 75, 0.12
BATCH_BYTES, SET_PART = 500_000, 2048
#: Members of a bucket that meet each other at once, bytes of sets that a task holds, and ids that are broadcast.
BLOCK, PART_BYTES, MOST_BROADCAST = 1024, 4_000_000, 2_000_000
#: Rows, and pairs, that a task should compare, and the most tasks of a stage.
TASK_ROWS, TASK_PAIRS, MOST_TASKS = 4000, 2_000_000, 20_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _families() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240)
    return g.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1), g.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32), g.integers(0, 1 << 63, (BANDS, ROWS + 1), np.uint64) | _U(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text, in order."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        yield from _sets(texts.slice(first, last - first))
        first = last


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    import xxhash

    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    filled = pc.greater(pc.binary_length(trimmed), 0).to_pylist()
    lists = pc.ascii_split_whitespace(trimmed)
    begins = np.asarray(lists.offsets, np.int64)
    begins -= begins[0]
    words = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    flat = hashes[np.asarray(words.indices)] if len(hashes) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + flat[k : k + len(rolled)]
        rolled = _mix(rolled)
        for i, some in enumerate(filled):
            a, b = begins[i], begins[i + 1]
            if not some:
                yield np.empty(0, np.uint64)
            elif b - a < SHINGLE:
                short = _U(b - a)
                for h in flat[a:b]:
                    short = short * _U(0x9E3779B97F4A7C15) + h
                yield _mix(np.array([short], np.uint64))
            else:
                yield np.unique(rolled[a : b - SHINGLE + 1])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    a, b, _ = _families()
    low = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), SET_PART):
        np.minimum(least, (low[i : i + SET_PART, None] * a + b).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    m = _families()[2]
    with np.errstate(over="ignore"):
        return _mix((sketch.reshape(BANDS, ROWS).astype(np.uint64) * m[:, :ROWS]).sum(axis=1, dtype=np.uint64) + m[:, ROWS])


def _chance(x: np.ndarray) -> np.ndarray:
    """The chance that a register of one set is larger, given the part x of the union that the other lacks."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


#: Similarities among which the likeliest is sought, as parts of what the sizes allow, and the share of equal registers below which none is.
_GRID, LEAST_EQUAL = np.linspace(0.4, 1, 61), 0.48


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of a sketch with each of ``many``, given the sizes of the sets; 0 where few registers are equal."""
    equal = (many == one).sum(axis=1)
    out, some = np.zeros(len(many)), np.flatnonzero(equal >= LEAST_EQUAL * REGISTERS)
    if not len(some):
        return out
    equal, n_many = equal[some], n_many[some]
    larger = (many[some] < one).sum(axis=1)
    smaller = REGISTERS - equal - larger
    u = (n_one / (n_one + n_many))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    up, down = _chance(u - v * j), _chance(v - u * j)
    fit = larger[:, None] * np.log(up + 1e-12) + smaller[:, None] * np.log(down + 1e-12) + equal[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    out[some] = j[np.arange(len(j)), fit.argmax(axis=1)]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    few, most = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < THRESHOLD * len(most):
        return False
    at = np.searchsorted(most, few)
    common = int((most[np.minimum(at, len(most) - 1)] == few).sum())
    return 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def sketches(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(d, t, n, k1, k2, bands): of each row its id, a hash of its text, size and key of its set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            n, k1, k2, bands = [], [], [], [np.empty(0, np.int64)]
            for s in shingle_sets(batch.column("x")):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(np.bitwise_xor.reduce(_mix(s + _U(1))).astype(np.int64)) if len(s) else 0)
                if len(s):
                    bands.append(band_hashes(registers(s)).astype(np.int64))
            ends = np.r_[0, np.cumsum(np.array(n, np.int64) > 0) * BANDS].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("t"), *(pa.array(c, pa.int64()) for c in (n, k1, k2)), lists],
                ["d", "t", "n", "k1", "k2", "bands"]
            )

    rows = docs.select(F.col(doc).cast("long").alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    return rows.mapInArrow(run, "d long, t long, n long, k1 long, k2 long, bands array<bigint>")


def _same(a: DataFrame, b: DataFrame):
    """Whether rows have the same id, or none, and the same text."""
    return a["d"].eqNullSafe(b["d"]) & (a["t"] == b["t"])


def _sets_of(docs: DataFrame, classes: DataFrame, doc: str, text: str) -> DataFrame:
    """(c, shingles, sketch) of the classes (c, d, t) by the rows that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            shingles, sketch = [], []
            for s in shingle_sets(batch.column("x")):
                shingles.append(s.tobytes())
                sketch.append(registers(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(shingles, pa.binary()), pa.array(sketch, pa.binary())], ["c", "shingles", "sketch"])

    n = classes.count()
    texts = docs.select(F.col(doc).cast("long").alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    # beyond the bound both sides are shuffled
    texts = texts.join(F.broadcast(classes) if n <= MOST_BROADCAST else classes, _same(texts, classes)).select("c", "x")
    sets = written(texts.mapInArrow(run, "c long, shingles binary, sketch binary"), "sets")
    if sets.count() == n:
        return sets
    single = written(sets.dropDuplicates(["c"]), "sets")  # the very row that stands for a class was repeated
    discard(sets)
    return single


def _requests(pairs: DataFrame, parts: int) -> DataFrame:
    """(part, b, members): pairs (a, b) with the ends a gathered by their part, of which each holds a bounded part of the sets."""
    return pairs.groupBy(F.pmod("a", F.lit(parts)).cast("int").alias("part"), "b").agg(F.collect_set("a").alias("members"))


def _confirmed(requests: DataFrame, sets: DataFrame, parts: int, estimated: bool = False) -> DataFrame:
    """Those pairs of members and b that are alike. A task holds one part of the sets and streams the sets of the ends b by."""
    held = sets.select(
        F.pmod("c", F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "c", "shingles", "sketch",
        F.lit(None).cast("array<bigint>").alias("members")
    )
    asked = requests.join(sets.withColumnRenamed("c", "b"), "b").select("part", F.lit(1).alias("kind"), F.col("b").alias("c"), "shingles", "sketch", "members")
    rows = held.unionByName(asked).repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part", "kind")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room(__name__)
        here, known = None, {}
        for frame in frames:
            found = []
            for part, kind, c, raw, regs, members in zip(
                frame["part"].tolist(), frame["kind"].tolist(), frame["c"].tolist(), frame["shingles"].tolist(), frame["sketch"].tolist(),
                frame["members"].tolist(), strict=True
            ):
                if part != here:
                    here, known = part, {}
                s, r = np.frombuffer(raw, np.uint64), np.frombuffer(regs, np.uint16)
                if not kind:
                    known[c] = s, r
                    continue
                fit = [m for m in members if m in known]
                if fit and not estimated:
                    near = estimate(r, np.stack([known[m][1] for m in fit]), len(s), np.array([len(known[m][0]) for m in fit]))
                    fit = [m for m, j in zip(fit, near.tolist(), strict=True) if 100 * j >= THRESHOLD - 100 * REACH]
                found += [(m, c) for m in fit if alike(known[m][0], s)]
            yield pd.DataFrame(found, columns=["a", "b"])

    return rows.mapInPandas(compare, "a long, b long")


def _meeting(group: dict[str, np.ndarray], parts: int) -> list[tuple[int, int, list[int]]]:
    """(part, b, members) of the pairs of one block of a bucket that are in reach and were not met in an earlier band."""
    c, n, component, out, head, sketch = (group[k] for k in ("c", "n", "component", "out", "head", "sketch"))
    others, askers = np.flatnonzero(~group["asks"] & (c != head)), np.flatnonzero(group["asks"] & (c != head))
    if not len(others) or not len(askers):
        return []
    multipliers = _families()[2]
    with np.errstate(over="ignore"):
        bands = (sketch.reshape(-1, BANDS, ROWS).astype(np.uint64) * multipliers[None, :, :ROWS]).sum(axis=2, dtype=np.uint64)
        band = int((_mix(bands[0] + multipliers[:, ROWS]).astype(np.int64) == group["bucket"][0]).argmax())
    found = []
    for k in askers:
        fit = others[(component[others] != component[k]) & (~out[others] | (c[others] < c[k]))]
        fit = fit[100 * np.minimum(n[fit], n[k]) >= THRESHOLD * np.maximum(n[fit], n[k])]
        if band and len(fit):
            fit = fit[~(bands[fit, :band] == bands[k, :band]).any(axis=1)]  # met in an earlier band
        if len(fit):
            near = estimate(sketch[k], sketch[fit], int(n[k]), n[fit])
            reached = c[fit[100 * near >= THRESHOLD - 100 * REACH]]
            found += [(int(p), int(c[k]), reached[reached % parts == p].tolist()) for p in np.unique(reached % parts)]
    return found


def _apart(buckets: DataFrame, grouped: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Requests for the pairs of a bucket that lie in different components and whose estimate is within reach, each pair once.

    Members outside the component of the bucket's first one, the outsiders, are compared with all members. Members are dealt
    to blocks, and every block of outsiders meets every block of members. There are as many tasks as the pairs take.
    """
    known = buckets.join(grouped.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    heads = known.filter("c = head").select("bucket", F.col("component").alias("main"))
    sizes = known.join(heads, "bucket").withColumn("out", F.col("component") != F.col("main"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if("out").alias("o")).filter("o > 0")
    rows = written(sizes.join(split, "bucket").select("bucket", "head", "c", "component", "out", "m", "o"), "outsiders")
    n_rows, n_pairs = rows.agg(F.count("*"), F.sum(F.when(F.col("out"), F.col("m")).otherwise(0))).first()
    tasks = min(MOST_TASKS, 1 + n_rows // TASK_ROWS + (n_pairs or 0) // TASK_PAIRS)
    rows = rows.withColumns({"nb": F.ceil(F.col("m") / BLOCK).cast("int"), "no": F.ceil(F.col("o") / BLOCK).cast("int")})
    block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "head", "c", "component", "out"]
    members = rows.select(*columns, F.lit(False).alias("asks"), block("nb").alias("i"), each("no").alias("j"))
    outside = rows.filter("out").select(*columns, F.lit(True).alias("asks"), block("no").alias("j"), each("nb").alias("i"))
    dealt = members.unionByName(outside).join(sets.select("c", "sketch", (F.length("shingles") / 8).cast("long").alias("n")), "c")
    key = ["bucket", "i", "j"]

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] | None = None
        for frame in frames:
            now = {k: frame[k].to_numpy() for k in frame.columns if k != "sketch"}
            now["sketch"] = np.frombuffer(b"".join(frame["sketch"].tolist()), np.uint16).reshape(-1, REGISTERS)
            now = now if kept is None else {k: np.concatenate([kept[k], now[k]]) for k in now}
            new = np.flatnonzero(np.any([now[k][1:] != now[k][:-1] for k in key], axis=0)) + 1
            starts = [0, *new.tolist()]
            found = [r for a, b in zip(starts, starts[1:], strict=False) for r in _meeting({k: v[a:b] for k, v in now.items()}, parts)]
            kept = {k: v[starts[-1] :] for k, v in now.items()}  # the last block may go on
            yield pd.DataFrame(found, columns=["part", "b", "members"])
        if kept is not None:
            yield pd.DataFrame(_meeting(kept, parts), columns=["part", "b", "members"])

    return dealt.repartition(tasks, *key).sortWithinPartitions(*key).mapInPandas(meet, "part int, b long, members array<bigint>")


_KEYS = ["k1", "k2", "n"]


def _links(docs: DataFrame, classes: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, component): the components of classes that are linked."""
    banded = classes.select("c", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("c").alias("head"), F.count("*").alias("m")).filter("m > 1").drop("m")
    buckets = written(banded.join(shared, "bucket"), "buckets")
    standing = written(buckets.select("c").distinct().join(classes.select("c", "stands.d", "stands.t"), "c"), "standing")
    sets = _sets_of(docs, standing, doc, text)
    size = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    parts = max(size // PART_BYTES, buckets.count() // TASK_ROWS) + 1
    stars = buckets.filter("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b"))
    first = written(_confirmed(_requests(stars, parts), sets, parts), "first-links")
    grouped = components(first)
    apart = written(_apart(buckets, grouped, sets, parts), "apart")
    if apart.take(1):
        second = written(_confirmed(apart, sets, parts, estimated=True), "second-links")
        if second.take(1):
            discard(grouped)
            grouped = components(first.unionAll(second))
        discard(second)
    discard(buckets, standing, sets, first, apart)
    return grouped


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(d, t, n, m, component_id, kept) of every row: its id and text hash, the size of its set, how many rows have that set, the
    smallest id that links reach, and whether it is the row of its component that is kept, or equal to that."""
    drawn = written(sketches(docs, doc, text), "sketches")
    row = F.struct(F.col("d").isNull().alias("without"), "d", "t")
    classes = drawn.filter("n > 0").groupBy(*_KEYS).agg(F.min(row).alias("stands"), F.count("*").alias("m"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    links = _links(docs, classes, doc, text)
    grouped = links.unionAll(links.select("component", "component").distinct())  # with the first of each
    # classes of one row without links stand for themselves; the others are a table, so that a join with a large class can be split
    own = classes.drop("bands").join(grouped.withColumnRenamed("id", "c"), "c", "left").filter("m > 1 or component is not null")
    own = own.withColumn("component", F.coalesce("component", "c"))
    own = written(own, "linked")
    least = own.groupBy("component").agg(F.min("stands").alias("least"))
    few = own.count() <= MOST_BROADCAST  # else both sides are shuffled
    several = written(own.join(F.broadcast(least) if few else least, "component").select(*_KEYS, "m", "least"), "several")
    discard(own, links, classes)
    found = drawn.drop("bands").join(several, _KEYS, "left")
    kept = F.col("least").isNull() | (F.col("d").eqNullSafe(F.col("least.d")) & (F.col("t") == F.col("least.t")))
    return found.select("d", "t", "n", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("least.d", "d").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) for every row: the size of its set and the smallest id that links reach."""
    return _rows(docs, doc, text).select(F.col("d").alias(doc), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns."""
    found = written(_rows(docs, doc, text), "near-duplicates")
    gone = found.filter("not kept").select("d", "t").distinct()
    again = found.filter("kept and m > 1").groupBy("d", "t").count().filter("count > 1").select("d", "t")
    own = docs.select(F.col(doc).cast("long").alias("d"), F.xxhash64(text).alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    few = gone.count() <= MOST_BROADCAST  # else both sides are shuffled
    left = own.join(F.broadcast(gone) if few else gone, _same(own, gone), "left_anti")
    if again.take(1):
        single = left.join(again, _same(left, again), "left_semi").groupBy("d", "t").agg(F.first("row").alias("row"))
        left = left.join(again, _same(left, again), "left_anti").select("row").unionAll(single.select("row"))
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM k JOIN n USING (doc_id)"""
}
