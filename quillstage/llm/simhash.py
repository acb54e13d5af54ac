"""Near duplicates by SimHash: fingerprints within a few bits of each other, found in BK-trees.

A text's features are its shingles of four words with repeats; bit i of the fingerprint is set where it is set in over half
of the features' 64-bit hashes. Equal fingerprints are one node. Two fingerprints that differ in at most RADIUS bits agree,
of any cut of their 64 bits into more blocks than RADIUS, in all blocks but RADIUS: every choice of that many blocks and every
value of them is a shard, and each pair to be found lies in at least one. The more nodes there are, the more blocks are cut, so that
shards stay small; any cut finds the same pairs.

A shard's fingerprints form BK-trees, in which the children of a node are keyed by their integer Hamming distance to it. A
search follows only the edges whose key is within the radius of the distance between query and node: a child behind another edge
cannot hold a fingerprint within reach, by the triangle inequality. A tree holds at most TREE fingerprints; where a shard has more,
it has several trees, and every tree goes to each task that holds a block of the shard's queries. So the work of a large shard is
dealt to as many tasks as it has pairs of blocks. Trees are rows: where all of them are small together they are broadcast to the
queries, beyond that both are shuffled by shard. Trees and queries of a task are searched level by level in numpy.

Of the links that a task finds in one shard it hands on those of a spanning forest: a group of very many near fingerprints
has as many links as nodes, not as pairs, and the components are the same. Nothing of all documents reaches the driver.

Defined results: a text of fewer than four words is one shingle, a text without words has the fingerprint zero, which is linked
like any other; texts make links and ids do not; a component's id is the smallest that a row of it has, null where none has one;
repeated rows are rows of one component; an empty table gives an empty result; ids are integers, others are an error; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import LOWER, UPPER, discard, make_room, raw_bytes, read, slices_by_size, word_spans, written
from quillstage.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tree and of a block of queries, and how many a shard should hold on average.
TREE, SHARD = 4096, 4
#: Bytes of text that are hashed at once, hashes whose bits are summed at once, and queries that descend at once.
BATCH_BYTES, BITS_AT_ONCE, QUERIES_AT_ONCE = 2_000_000, 65_536, 65_536
#: Bytes of trees, and components, that are broadcast.
MOST_TREES, MOST_BROADCAST = 16_000_000, 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of some texts, and where each text's begin, with the end."""
    from xxhash import xxh64_intdigest

    data, begins = raw_bytes(texts)
    inside = ~_SPACE[data]
    first, end = word_spans(inside, begins)
    # of white space the first character behind a word stays, as a space: words of a text are then one space apart
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    place = np.cumsum(kept, dtype=np.int64) - 1
    line = np.where(inside, _LOWER[data], 32).astype(np.uint8)[kept].tobytes()
    lo, hi = place[first], place[end - 1] + 1
    word = np.searchsorted(first, begins)  # of each text the first word
    n = np.diff(word)
    shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.r_[0, np.cumsum(shingles)]
    start = np.arange(ends[-1]) + np.repeat(word[:-1] - ends[:-1], shingles)
    stop = start + np.repeat(np.minimum(n, SHINGLE), shingles) - 1
    view = memoryview(line)
    return np.fromiter((xxh64_intdigest(view[a:b], SEED) for a, b in zip(lo[start].tolist(), hi[stop].tolist(), strict=True)), np.uint64, len(start)), ends


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: the bits that are set in over half of it."""
    ones, n = np.zeros((len(ends) - 1, 64), np.int64), np.diff(ends)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i : i + BITS_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero((ends[:-1] < i + len(part)) & (ends[1:] > i) & (n > 0))
        ones[runs] += np.add.reduceat(bits, np.maximum(ends[runs] - i, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, fp): the id and the fingerprint, a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            found = [np.empty(0, np.uint64), *(majority(*shingle_hashes(part)) for _, part in slices_by_size(batch.column("x"), BATCH_BYTES))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.concatenate(found).view(np.int64), pa.int64())], ["d", "fp"])

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("x")).mapInArrow(run, "d long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a ^ b).view(np.uint16).reshape(-1, 4)
    return _ONES[x].sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over numbered points: ``children[i]`` is the child of node ``keys[i] // 65`` behind the edge ``keys[i] % 65``."""

    def __init__(self, points: np.ndarray, tree: np.ndarray) -> None:
        """``points`` in the order of their insertion, ``tree`` numbers the tree of each."""
        self.points = points
        _, self.roots, which = np.unique(tree, return_index=True, return_inverse=True)
        at, left = self.roots[which], np.arange(len(points))
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left = left[left != at]
        at = at[left]
        while len(left):
            key = at * 65 + distance(points[left], points[at])
            new, head, which = np.unique(key, return_index=True, return_inverse=True)
            # a node's edges are all filled from the same points at once, so a key is new whenever it appears
            keys.append(new)
            children.append(left[head])
            at = left[head][which]
            left, at = left[left != at], at[left != at]
        keys, children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the query, node) of all points within the radius, query k beginning at the node ``roots[k]``."""
        for i in range(0, len(queries), QUERIES_AT_ONCE):
            waiting = [(np.arange(i, min(len(queries), i + QUERIES_AT_ONCE)), roots[i : i + QUERIES_AT_ONCE])]
            while waiting:
                q, node = waiting.pop()
                if len(q) > 4 * QUERIES_AT_ONCE:  # later: a level of wide trees has many more visits than queries
                    half = len(q) // 2
                    waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = distance(queries[q], self.points[node])
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - lo
                ends = np.cumsum(n)
                if ends[-1]:
                    edge = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
                    waiting.append((np.repeat(q, n), self.children[edge]))


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) of the numbers below ``n`` that the links ``found`` put together, without the smallest."""
    least = np.arange(n)

    def settle() -> None:
        while True:
            up = least[least]
            if (up == least).all():
                return
            least[:] = up

    for a, b in found:
        while True:
            x, y = least[a], least[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            settle()
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


def cuts(nodes: int) -> list[list[tuple[int, int]]]:
    """The choices of blocks of bits, each (first bit, bits), that leave some SHARD of so many nodes in a shard."""
    for blocks in range(RADIUS + 1, 13):
        if nodes <= SHARD << (64 * (blocks - RADIUS) // blocks):
            break
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [[(edge[i], edge[i + 1] - edge[i]) for i in chosen] for chosen in combinations(range(blocks), blocks - RADIUS)]


def _key(chosen: list[tuple[int, int]]) -> Column:
    """The bits of the chosen blocks, in their places."""
    mask = sum(((1 << bits) - 1) << first for first, bits in chosen)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _blocks(rows: DataFrame) -> DataFrame:
    """(cut, key, block, points): the fingerprints of each block of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        rest: pa.Table | None = None

        def packed(table: pa.Table) -> pa.RecordBatch:
            cut, key, block, fp = (table.column(c).to_numpy() for c in ("cut", "key", "block", "fp"))
            new = np.flatnonzero(np.r_[True, (cut[1:] != cut[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            data = pa.py_buffer(np.ascontiguousarray(fp).tobytes())
            points = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer((np.r_[new, len(fp)] * 8).astype(np.int64)), data])
            return pa.RecordBatch.from_arrays([pa.array(cut[new]), pa.array(key[new]), pa.array(block[new]), points.cast(pa.binary())], ["cut", "key", "block", "points"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cut, key, block = (table.column(c).to_numpy() for c in ("cut", "key", "block"))
            if not len(cut):
                continue
            begun = np.flatnonzero((cut != cut[-1]) | (key != key[-1]) | (block != block[-1]))
            whole = int(begun[-1]) + 1 if len(begun) else 0  # the last block may go on
            rest = table.slice(whole).combine_chunks()
            if whole:
                yield packed(table.slice(0, whole))
        if rest is not None and len(rest):
            yield packed(rest)

    dealt = rows.repartition("cut", "key", "block").sortWithinPartitions("cut", "key", "block")
    return dealt.mapInArrow(run, "cut int, key long, block int, points binary")


def _searched(pairs: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of rows (tree, points, same): the points of a tree and those of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                trees, asked = ([np.frombuffer(x, np.int64) for x in part.column(c).to_pylist()] for c in ("tree", "points"))
                of, by = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (trees, asked))
                points, queries = np.concatenate(trees), np.concatenate(asked)
                forest = Forest(points, of)
                every, number = np.unique(np.concatenate([points, queries]), return_inverse=True)
                ours, theirs = number[: len(points)], number[len(points) :]
                found = ((theirs[q], ours[p]) for q, p in forest.search(queries, forest.roots[by]))
                a, b = spanning(len(every), found)
                out.append((every[a], every[b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return pairs.select("tree", "points").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of nodes, each there once, that have the components of all pairs within RADIUS bits."""
    chosen = cuts(nodes.count())
    keys = F.array(*[F.struct(F.lit(i).alias("cut"), _key(c).alias("key")) for i, c in enumerate(chosen)])
    sharded = nodes.select("fp", F.inline(keys))
    sizes = sharded.groupBy("cut", "key").agg(F.count("*").alias("m")).filter("m > 1")
    rows = sharded.join(sizes, ["cut", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("m") / TREE)).cast("int"))
    blocks = written(_blocks(rows.select("cut", "key", "block", "fp")), "trees")
    trees = blocks.select("cut", "key", F.col("block").alias("of"), F.col("points").alias("tree"))
    size = blocks.agg(F.sum(F.length("points"))).first()[0] or 0
    pairs = blocks.join(F.broadcast(trees) if size <= MOST_TREES else trees, ["cut", "key"]).filter("block <= of")
    heavy = F.col("of") + F.col("block") > 0
    salt = F.when(heavy, F.struct("cut", "key", "of", "block"))
    found = written(_searched(pairs.filter(heavy).repartition(salt)).unionAll(_searched(pairs.filter(~heavy))), "near")
    discard(blocks)
    return found


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp, component_id) for every row: its fingerprint as a signed long and the smallest id that links reach."""
    drawn = written(fingerprints(docs, doc, text), "fingerprints")
    nodes = written(drawn.groupBy("fp").agg(F.min("d").alias("least"), F.count("*").alias("m")), "nodes")
    found = links(nodes.select("fp"))
    grouped = components(found)
    own = nodes.join(grouped.unionAll(grouped.select("component", "component").distinct()).withColumnRenamed("id", "fp"), "fp", "left")
    own = written(own.filter("m > 1 or component is not null").withColumn("component", F.coalesce("component", "fp")), "own")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    several = written(own.join(least, "component").select("fp", "component_id", F.lit(True).alias("several")), "several")
    few = several.count() <= MOST_BROADCAST  # else both sides are shuffled
    discard(nodes, found, grouped, own)
    rows = drawn.join(F.broadcast(several) if few else several, "fp", "left")
    return rows.select(F.col("d").alias(doc), "fp", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("d")).alias("component_id"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash_near_dedup": op13_simhash_near_dedup}
SQL: dict[str, str] = {}
