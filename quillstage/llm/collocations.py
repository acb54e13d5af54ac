"""Collocations by hierarchical pair naming.

Texts are taken in blocks of bounded size and of one language. A block is a sequence of ids of words, broken at the ends of pieces.
Frequent words have global names, others break the sequence as well: a phrase that is frequent has no rare part. On every further
level two neighbouring names of k-1 words, which overlap in all but the outer ones, are a pair; each block counts its distinct pairs,
the counts are added up over all blocks, and frequent pairs are named, whereupon the sequence of the block is rewritten in the
new names. A name points to the two it was made of, its first and its last k-1 words. Along these pointers the counts
of all beginnings and ends of a phrase, its text and the highest count of the phrases around it are found by joins of names, and
no text is read again.

Names reach the blocks by a broadcast where they are few; beyond that, every block's pairs are joined with the names by a shuffle
and sorted to their block, which streams them by. Either way a block is rewritten alone, in memory for one block. Counts are added up
per block before any shuffle, so that a word that is a third of all is a row per block.

Defined results: null text is empty and has no words; null languages are ``und``, which is one language with rows so labelled;
white space other than space, tab and line ends belongs to words; documents do not join, repeated rows count as often as they
stand; an empty table gives an empty result; scores are exact where products pass 64 bits; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.llm.common import LOWER, UPPER, arrow_batches, discard, make_room, raw_bytes, read, slices_by_size, word_spans, written

LEAST, LONGEST, TOP, SCALE, COVER = 100, 5, 2000, 1000, 100
UNKNOWN = "und"
#: Bytes of text in a block, of blocks that a Python worker takes at once, and names that are broadcast.
BLOCK_BYTES, BATCH_BYTES, MOST_BROADCAST = 2_000_000, 4_000_000, 1_000_000
#: How blocks are compressed: their sequences are most of the disk that is used. And how many a task holds unpacked: one is up to ten times its text.
CODEC, GROUP = "zstd", 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
#: A block of words, and one of pairs of names. In a sequence 0 is a break and k the k-th item.
_WORDS = "block long, lang string, total long, seq binary, word array<string>, n array<long>"
_PAIRS = "block long, seq binary, first array<long>, last array<long>, n array<long>"


def word_sequence(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The sequence of some texts, their distinct words, and how often each stands."""
    data, begins = raw_bytes(texts)
    kind = _KIND[data]
    inside = kind == 0
    first, end = word_spans(inside, begins)
    if not len(first):
        return np.empty(0, np.int32), pa.array([], pa.large_string()), np.empty(0, np.int64)
    letters = np.ascontiguousarray(_LOWER[data[inside]])
    place = np.r_[0, np.cumsum(end - first)]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(place), pa.py_buffer(letters)).dictionary_encode()
    code = np.asarray(words.indices).astype(np.int32)
    # pieces end at marks and at the end of a text
    ended = np.searchsorted(np.flatnonzero(kind == 2), first) + np.searchsorted(begins, first, "right")
    return np.insert(code + 1, np.flatnonzero(np.diff(ended)) + 1, 0), words.dictionary, np.bincount(code, minlength=len(words.dictionary))


def rewritten(seq: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of pairs that follows from one of items and the names of these (0 where an item has none): with first and last names and counts of the distinct pairs."""
    s = np.r_[0, names][seq]
    # a single break between names is enough
    s = s[(s != 0) | np.r_[False, s[:-1] != 0][: len(s)]]
    known, s = np.unique(np.r_[0, s], return_inverse=True)
    s = s[1:]
    pair = (s[:-1] != 0) & (s[1:] != 0)
    key = s[:-1] * len(known) + s[1:]
    distinct, code, n = np.unique(key[pair], return_inverse=True, return_counts=True)
    out = np.zeros(len(pair), np.int32)
    out[pair] = code + 1
    return out, known[distinct // len(known)], known[distinct % len(known)], n


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values.cast(kind))


def word_blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The blocks of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room(__name__)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            for name in pc.unique(table.column("l")).to_pylist():
                texts = table.filter(pc.equal(table.column("l"), name)).column("x").combine_chunks()
                for _, part in slices_by_size(texts, 2 * BLOCK_BYTES):
                    seq, words, n = word_sequence(part)
                    own = [pa.array([number]), pa.array([name], pa.string()), pa.array([int(n.sum())]), pa.array([seq.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, _list(words, pa.string()), _list(n, pa.int64())], ["block", "lang", "total", "seq", "word", "n"])
                    number += 1

        for batch in batches:
            for first, texts in slices_by_size(batch.column("x"), BLOCK_BYTES):
                held.append(pa.RecordBatch.from_arrays([texts.cast(pa.large_string()), batch.column("l").slice(first, len(texts))], ["x", "l"]))
                size += texts.nbytes
                if size >= BLOCK_BYTES:
                    yield from blocks()
                    held, size = [], 0
        if held:
            yield from blocks()

    return docs.select(F.col(text).alias("x"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("l")).mapInArrow(run, _WORDS)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table with a column ``id``: 1, 2, 3, …, the same on every reading."""
    drawn = written(df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), name)
    sizes = drawn.groupBy("__part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.withColumn("__before", F.sum("n").over(W.orderBy("__part")) - F.col("n")).drop("n")
    id_ = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    out = written(drawn.join(F.broadcast(before), "__part").withColumn("id", id_).drop("__part", "__row", "__before"), name)
    discard(drawn)
    return out


def frequent(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    return counted.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def word_names(blocks: DataFrame, least: int) -> DataFrame:
    """(id, lang, phrase, tail, heads, tails, f) of the frequent words: ``heads`` and ``tails`` hold the counts of a phrase's beginnings and ends, by length."""
    found = frequent(blocks.select("lang", F.inline(F.arrays_zip("word", "n"))), ["lang", "word"], least)
    return numbered(found.select("lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.array("f").alias("heads"), F.array("f").alias("tails"), "f"), "words")


def pair_names(blocks: DataFrame, before: DataFrame, least: int) -> DataFrame:
    """The same of the frequent pairs of names, with ``first`` and ``last``, the names that they are made of."""
    found = frequent(blocks.select(F.inline(F.arrays_zip("first", "last", "n"))), ["first", "last"], least)
    head = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("p"), F.col("heads").alias("h"))
    tail = before.select(F.col("id").alias("last"), F.col("tail").alias("tail"), F.col("tails").alias("t"))
    made = found.join(head, "first").join(tail, "last")
    return numbered(made.select(
        "lang", F.concat_ws(" ", "p", "tail").alias("phrase"), "tail", F.concat("h", F.array("f")).alias("heads"), F.concat("t", F.array("f")).alias("tails"), "f", "first", "last"
    ), "pairs")


def _pairs(block: int, seq: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    out, first, last, n = rewritten(seq, names)
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()], pa.binary()), *(_list(x, pa.int64()) for x in (first, last, n))], ["block", "seq", "first", "last", "n"])


def _by_broadcast(blocks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The next blocks, with the names as a broadcast of at most MOST_BROADCAST rows."""
    words = len(keys) == 1
    if words:
        rows = names.select("lang", "phrase", "id").toArrow()
        by_lang = {lang: rows.filter(pc.equal(rows.column("lang"), lang)) for lang in pc.unique(rows.column("lang")).to_pylist()}
        table = {lang: (t.column("phrase").combine_chunks(), t.column("id").to_numpy()) for lang, t in by_lang.items()}
    else:
        rows = names.select("first", "last", "id").toArrow()
        first, last, ids = (rows.column(c).to_numpy() for c in ("first", "last", "id"))
        order = np.lexsort((last, first))
        table = first[order], last[order], ids[order]
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def of_words(batch: pa.RecordBatch, row: int) -> np.ndarray:
        items = batch.column("word")[row].values
        phrases, ids = shared.value.get(batch.column("lang")[row].as_py(), (pa.array([], pa.string()), np.empty(0, np.int64)))
        at = pc.fill_null(pc.index_in(items, phrases), -1).to_numpy()
        return np.where(at >= 0, np.r_[ids, 0][at], 0)

    def of_pairs(batch: pa.RecordBatch, row: int) -> np.ndarray:
        first, last, ids = shared.value
        a, b = (batch.column(c)[row].values.to_numpy() for c in ("first", "last"))
        if not len(ids):
            return np.zeros(len(a), np.int64)
        # both are sorted by first and last: places among the names in one number
        known, base = np.unique(first, return_index=True)
        k = np.minimum(np.searchsorted(known, a), len(known) - 1)
        span = int(max(last.max(), b.max(initial=0))) + 1  # ids are counted from 1: far below 2 ** 31 beside so few names
        at = np.searchsorted(np.repeat(np.arange(len(known)), np.diff(np.r_[base, len(first)])) * span + last, k * span + b)
        at = np.minimum(at, len(ids) - 1)
        return np.where((first[at] == a) & (last[at] == b), ids[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            for row in range(batch.num_rows):
                names = (of_words if words else of_pairs)(batch, row)
                yield _pairs(batch.column("block")[row].as_py(), np.frombuffer(batch.column("seq")[row].as_buffer(), np.int32), names)

    needed = ["block", "seq", "lang", "word"] if words else ["block", "seq", "first", "last"]
    return blocks.select(*needed).mapInArrow(run, _PAIRS)


def _by_join(blocks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The next blocks, with every block's items joined with the names and sorted to the block."""
    words = len(keys) == 1
    zipped = F.arrays_zip(*keys)
    items = blocks.select("block", *(["lang"] if words else []), F.posexplode(zipped).alias("code", "item"))
    items = items.select("block", "code", *(["lang"] if words else []), *(F.col(f"item.{k}").alias(k) for k in keys))
    named = names.withColumnRenamed("phrase", "word") if words else names
    on = ["lang", "word"] if words else keys
    found = items.join(named.select(*on, "id"), on).select("block", F.lit(0).alias("kind"), "code", "id", F.lit(None).cast("binary").alias("seq"))
    own = blocks.select("block", F.lit(1).alias("kind"), F.lit(0).alias("code"), F.lit(0).cast("long").alias("id"), "seq")
    dealt = found.unionByName(own).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        codes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            kind, code, id_ = (batch.column(c).to_numpy() for c in ("kind", "code", "id"))
            begun = 0
            for row in np.flatnonzero(kind).tolist():
                codes.append(code[begun:row])
                ids.append(id_[begun:row])
                begun = row + 1
                seq = np.frombuffer(batch.column("seq")[row].as_buffer(), np.int32)
                names = np.zeros(int(seq.max(initial=0)), np.int64)
                names[np.concatenate(codes)] = np.concatenate(ids)
                yield _pairs(batch.column("block")[row].as_py(), seq, names)
                codes, ids = [], []
            codes.append(code[begun:].copy())
            ids.append(id_[begun:].copy())

    return dealt.mapInArrow(run, _PAIRS)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """The named words, pairs, … of up to ``longest`` words, a table each, and (lang, total), the number of all words."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        blocks = written(word_blocks(docs, text, lang), "word-blocks", codec=CODEC, group=GROUP)
        totals = written(blocks.groupBy("lang").agg(F.sum("total").alias("total")), "totals")
        names, keys = [word_names(blocks, least)], ["word"]
        while len(names) < longest:
            some = names[-1].count()
            before, blocks = blocks, written((_by_broadcast if some <= MOST_BROADCAST else _by_join)(blocks, names[-1], keys), "pair-blocks", codec=CODEC, group=GROUP)
            discard(before)
            names.append(pair_names(blocks, names[-1], least))
            keys = ["first", "last"]
        discard(blocks)
    return names, totals


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(names: DataFrame, k: int, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of ``k`` words, by their lowest cut, of equal ones the first."""

    def cut(i: int) -> Column:
        left, right = F.element_at("heads", i), F.element_at("tails", k - i)
        value = F.call_function("div", F.lit(SCALE).cast("decimal(4,0)") * (_exact("f") * _exact("total")).cast("decimal(34,0)"), _exact(left) * _exact(right))
        return F.struct(value.alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.array(*[cut(i) for i in range(1, k)]))
    rows = names.join(totals, "lang").withColumn("x", lowest)
    return rows.select("lang", "phrase", F.col("f").alias("a"), "x.l", "x.r", F.col("total").alias("n"), "x.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Each language's ``top`` phrases by score that no longer phrase covers, with rank, counts and score."""
    names, totals = phrases(docs, text, lang, least, longest)
    found: DataFrame | None = None
    for k in range(2, longest + 1):
        own = names[k - 1]
        if k < longest:
            longer = names[k].select("f", F.explode(F.array("first", "last")).alias("id")).groupBy("id").agg(F.max("f").alias("around"))
            # what a longer phrase covers, one of a word more does too: it is as frequent at least
            own = own.join(longer, "id", "left").filter(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("f")))
        rows = scored(own, k, totals)
        found = rows if found is None else found.unionAll(rows)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # at most ``top`` rows of a language leave a task before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op11_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(read(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op11_phrase_collocation_mining": op11_phrase_collocation_mining}
SQL = {
    "op11_phrase_collocation_mining": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + j - 1], ' ') AS part FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM c, range(2, 5) t(j) WHERE j < k)),
o AS (SELECT lang, part, max(a) AS around FROM s GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN o ON o.lang = c.lang AND o.part = c.phrase WHERE around IS NULL OR 100 * around < 100 * a),
x AS (SELECT d.*, unnest(range(1, k)) AS cut FROM d),
y AS (SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, n.n, x.cut, CAST((1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
FROM x JOIN n ON n.lang = x.lang JOIN f l ON l.lang = x.lang AND l.g = array_to_string(x.w[:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.g = array_to_string(x.w[x.cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000"""
}
