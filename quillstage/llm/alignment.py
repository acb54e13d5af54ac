"""How two tokenizers cut the same texts: groups of tokens between common ends, and the links of overlapping tokens.

Both tokenizers read a space and the text. A byte-level one (A) and a piece model (B) both begin a token at a space between two
characters that are not white, so a text falls into stretches there, of which each distinct one is encoded and aligned once per
worker: its tokens' byte ranges, the groups between ends that both have, the pairs of overlapping tokens. The stretches of a batch
are then gathered by numpy. Whether the vocabulary of B allows for this is checked on loading; where it doesn't, texts are not cut.

How often a pair of ids is linked corpus-wide is found by a cogroup of postings. Documents are taken in chapters of bounded size;
of each chapter the sorted multiplicities of pairs by document leave as rows by B id, beside the chapter's sums by pair. The sums make
a list of counts per B id, of one entry for each A id at most. Postings and lists are dealt by B id, an id of very many
postings to several tasks, each of which gets the list, and sorted, which spills; a task holds the list of one id and
streams the postings by, adding up counts and the links whose count is the id's highest per document. These contributions
leave by chapter and are summed there. No task holds more than one list, a bounded number of sums and a chapter.

Defined results: a text that is null or empty, or whose joined token bytes differ from space and text for either tokenizer, has no
tokens, all zeros and the empty string for its groups; repeated rows count like others; ids need be neither present nor distinct; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import discard, make_room, raw_bytes, read, slices_by_size, written

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK = "▁"
#: Stretches that a worker remembers, bytes of the longest of them, bytes of text and links that are aligned at once.
REMEMBERED, LONGEST, BATCH_BYTES = 300_000, 256, 2_000_000
#: Documents and links of a chapter, postings of a B id that one task should stream, sums that it holds.
CHAPTER_DOCS, CHAPTER_LINKS, TASK_POSTINGS, MOST_SUMS = 60_000, 4_000_000, 8_000_000, 2_000_000
#: First bytes of UTF-8 characters that are surely not white: ASCII signs, and lead bytes of blocks without white space.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True
_ID_BITS = 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Aligner:
    """Aligned stretches: number k has the links ``a`` and ``b`` from ``starts[k]`` on, and its figures and groups."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        signs = {chr(256 + i): b for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}
        vocabulary = self.a.get_vocab()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(signs.get(c, ord(c) & 255) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        if max(len(bytes_a), len(bytes_b)) >= 1 << _ID_BITS:
            raise ValueError(f"ids of more than {_ID_BITS} bits")
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        #: Whether no piece holds a blank behind another sign, so that none crosses a cut.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.figures = np.empty((1024, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes are the text's
        self.starts, self.used = np.zeros(1025, np.int64), 0
        self.pairs = np.empty((1 << 14, 2), np.int32)

    def _add(self, new: list[str]) -> None:
        """Aligns new stretches and remembers them."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in new], num_threads=1)
        raw = [s.encode() for s in new]
        whole = np.array([
            b"".join([self.bytes_a[i] for i in x]) == s and b"".join([self.bytes_b[i] for i in y]) == s for x, y, s in zip(ids_a, ids_b, raw, strict=True)
        ])
        n_a, n_b = (np.where(whole, [len(x) for x in ids], 0) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for x, ok in zip(ids, whole.tolist(), strict=True) if ok for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        # tokens of A and B whose byte ranges overlap
        low = np.searchsorted(end_b, end_a - self.len_a[flat_a], "right")
        wide = np.searchsorted(end_b - self.len_b[flat_b], end_a, "left") - low
        last = np.cumsum(wide)
        links = np.stack([np.repeat(flat_a, wide), flat_b[np.arange(last[-1] if len(last) else 0) + np.repeat(low - last + wide, wide)]], axis=1).astype(np.int32)
        # groups end where both do
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        cut_a, cut_b = (np.r_[0, np.searchsorted(e, both, "right")].astype(np.int32) for e in (end_a, end_b))
        texts = [pc.binary_join(pa.ListArray.from_arrays(cut, pa.array(ids).cast(pa.string())), ",") for cut, ids in ((cut_a, flat_a), (cut_b, flat_b))]
        grouped = pc.binary_join_element_wise(*texts, "|")
        stretch = np.cumsum(np.where(whole, [len(s) for s in raw], 0))
        upto = np.r_[0, np.searchsorted(both, stretch, "right")].astype(np.int32)
        first, n = len(self.groups), len(new)
        self.groups += pc.binary_join(pa.ListArray.from_arrays(upto, grouped), ";").to_pylist()
        n_links = np.diff(np.r_[0, last][np.r_[0, np.cumsum(n_a)]])
        while first + n >= len(self.figures):
            self.figures, self.starts = np.r_[self.figures, np.empty_like(self.figures)], np.r_[self.starts, np.zeros(len(self.starts) - 1, np.int64)]
        self.figures[first : first + n] = np.stack([n_a, n_b, np.diff(upto), n_links, whole], axis=1)
        self.starts[first + 1 : first + n + 1] = self.used + np.cumsum(n_links)
        while self.used + len(links) > len(self.pairs):
            self.pairs = np.r_[self.pairs, np.empty_like(self.pairs)]
        self.pairs[self.used : self.used + len(links)] = links
        self.used += len(links)
        self.known.update(zip(new, range(first, first + n), strict=True))

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED or self.used > 16 * REMEMBERED:
            self._forget()
        new = [s for s in distinct if s not in self.known]
        for i in range(0, len(new), 4096):
            self._add(new[i : i + 4096])
        found = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        for s in new:
            if len(s) > LONGEST:  # unlikely to come again
                del self.known[s]
        return found

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every stretch of the texts, and where each text begins there, with the end; none of an empty text."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
        data, begins = raw_bytes(spaced)
        first = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data):
            space = data == 32
            first[1:-2] = space[1:-1] & ~space[:-2] & _SOLID[data[2:]]
        first[begins] = True
        at = np.flatnonzero(first)
        if len(at) < 2:
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        return self._numbers(parts.dictionary.to_pylist())[np.asarray(parts.indices)], np.searchsorted(at, begins)


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def forget() -> bool:
    """Drops the aligner of this process; whether there was one."""
    had = aligner.cache_info().currsize > 0
    aligner.cache_clear()
    return had


class Chapter:
    """Documents that are counted together, and the links of each."""

    def __init__(self) -> None:
        self.docs: list[pd.DataFrame] = []
        self.keys: list[np.ndarray] = []
        self.n_docs = self.n_links = 0

    def add(self, ids: pa.Array, texts: pa.Array, of: Aligner) -> None:
        numbers, begins = of.stretches(texts)
        figures = np.add.reduceat(np.r_[of.figures[numbers], np.zeros((1, 5), np.int64)], begins[:-1], axis=0) if len(texts) else np.empty((0, 5), np.int64)
        n = np.diff(begins)
        some = (n > 0) & (figures[:, 4] == n)
        figures[~some] = 0
        spelled = [of.groups[k] for k in numbers.tolist()]
        sha = [hashlib.sha256(";".join(spelled[x:y]).encode()).hexdigest() if ok else "" for ok, x, y in zip(some.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        doc = np.repeat(np.arange(len(texts)), n)
        numbers, doc = numbers[some[doc]], doc[some[doc]]
        wide = of.figures[numbers, 3]
        last = np.cumsum(wide)
        pairs = of.pairs[np.arange(last[-1] if len(last) else 0) + np.repeat(of.starts[numbers] - last + wide, wide)].astype(np.int64)
        self.keys.append((pairs[:, 1] << (2 * _ID_BITS)) | (pairs[:, 0] << _ID_BITS) | np.repeat(doc + self.n_docs, wide))
        self.docs.append(pd.DataFrame({"d": ids.to_pandas().astype("Int64"), "n_a": figures[:, 0], "n_b": figures[:, 1], "n_groups": figures[:, 2], "n_links": figures[:, 3], "sha": sha}))
        self.n_docs += len(texts)
        self.n_links += len(pairs)

    def rows(self, chapter: int) -> Iterator[pa.RecordBatch]:
        """One row of documents and sums by pair, and one of postings per B id."""
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        pair, doc = keys >> _ID_BITS, (keys & ((1 << _ID_BITS) - 1)).astype(np.uint16)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        pairs, n = pair[first], np.diff(np.r_[first, len(pair)])
        total = np.add.reduceat(times, first) if len(first) else np.empty(0, np.int64)
        b, a = (pairs >> _ID_BITS).astype(np.int32), (pairs & ((1 << _ID_BITS) - 1)).astype(np.int32)
        docs = pd.concat(self.docs)
        yield _batch(chapter=[chapter], **{c: [pa.array(docs[c])] for c in docs.columns}, pair_b=[b], pair_a=[a], pair_n=[total])
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
        ends = np.r_[head, len(b)]
        at = np.r_[first, len(pair)][ends]
        slices = {"a": (a, ends), "n": (n.astype(np.int32), ends), "doc": (doc, at), "times": (times.astype(np.uint32), at)}
        cut = {k: pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((e * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v).tobytes())]) for k, (v, e) in slices.items()}
        yield _batch(chapter=np.full(len(head), chapter), b=b[head], m=np.diff(at), **cut)


_DOC = {"d": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "sha": "string"}
_FIELDS = {"chapter": "long"} | {k: f"array<{v}>" for k, v in _DOC.items()} | {"pair_b": "array<int>", "pair_a": "array<int>", "pair_n": "array<long>"}
_FIELDS |= {"b": "int", "m": "long", "a": "binary", "n": "binary", "doc": "binary", "times": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]


def _batch(**columns) -> pa.RecordBatch:
    """A record batch of all _FIELDS, those not given being null."""
    size = len(columns["chapter"])
    arrays = []
    for name, kind in _FIELDS.items():
        given, kind = columns.get(name), _arrow(kind)
        if given is None:
            arrays.append(pa.nulls(size, kind))
        elif pa.types.is_list(kind):
            values = pa.concat_arrays([pa.array(x, kind.value_type) if not isinstance(x, pa.Array) else x.cast(kind.value_type) for x in given])
            arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in given])], pa.int32()), values))
        else:
            arrays.append(given if isinstance(given, pa.Array) else pa.array(given, kind))
    return pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def chapters(docs: DataFrame, doc: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """The rows of all chapters: those with documents and sums, and those with postings, which have a ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room(__name__)
        of, number, chapter = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, Chapter()
        for batch in batches:
            for first, texts in slices_by_size(batch.column("x"), BATCH_BYTES, CHAPTER_DOCS):
                if chapter.n_docs and chapter.n_docs + len(texts) > CHAPTER_DOCS:
                    yield from chapter.rows(number)
                    number, chapter = number + 1, Chapter()
                chapter.add(batch.column("d").slice(first, len(texts)), texts, of)
                if chapter.n_links >= CHAPTER_LINKS:
                    yield from chapter.rows(number)
                    number, chapter = number + 1, Chapter()
        if chapter.n_docs:
            yield from chapter.rows(number)

    rows = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("x"))
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


def contributions(told: DataFrame) -> DataFrame:
    """(chapter, doc, best, sums): what the postings of some B ids add to documents, in the numbers of their chapter."""
    sums = told.filter("b is null").select(F.inline(F.arrays_zip("pair_b", "pair_a", "pair_n")))
    totals = sums.groupBy(F.col("pair_b").alias("b"), F.col("pair_a").alias("a")).agg(F.sum("pair_n").alias("c"))
    # as many entries as A has ids at most
    lists = totals.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "c"))).alias("x")).select("b", F.col("x.a").alias("la"), F.col("x.c").alias("lc"))
    postings = told.filter("b is not null").select("chapter", "b", "a", "n", "doc", "times", "m")
    parts = postings.groupBy("b").agg(F.ceil(F.sum("m") / TASK_POSTINGS).cast("int").alias("parts"))  # a row per B id at most
    none = {k: F.lit(None).cast(v) for k, v in (("la", "array<int>"), ("lc", "array<long>"), ("chapter", "long"), *((k, "binary") for k in ("a", "n", "doc", "times")))}
    held = lists.join(parts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "la", "lc", *(none[k].alias(k) for k in ("chapter", "a", "n", "doc", "times")))
    streamed = postings.join(F.broadcast(parts), "b").select(
        "b", F.pmod(F.xxhash64("chapter"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), none["la"].alias("la"), none["lc"].alias("lc"), "chapter", "a", "n", "doc", "times"
    )
    dealt = held.unionByName(streamed).repartition("b", "part").sortWithinPartitions("b", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        ids, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        added: dict[int, np.ndarray] = {}
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for chapter, both in added.items():
                some = np.flatnonzero(both[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(1, chapter)), *(pa.array([x.tobytes()], pa.binary()) for x in (some.astype(np.uint16), *both[:, some]))], ["chapter", "doc", "best", "sums"])
            added.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "la", "lc", "chapter", "a", "n", "doc", "times")]
            for kind, la, lc, chapter, *raw in zip(*columns, strict=True):
                if not kind.as_py():
                    ids, counts = la.values.to_numpy(), lc.values.to_numpy()
                    highest = counts.max()
                    continue
                chapter = chapter.as_py()
                a, n, doc, times = (np.frombuffer(x.as_buffer(), k) for x, k in zip(raw, (np.int32, np.int32, np.uint16, np.uint32), strict=True))
                count = counts[np.searchsorted(ids, a)]
                both = added.get(chapter)
                if both is None or both.shape[1] <= doc.max():
                    wider = np.zeros((2, max(1024, 1 << int(doc.max()).bit_length())), np.int64)
                    if both is not None:
                        wider[:, : both.shape[1]] = both
                        held -= both.shape[1]
                    both = added[chapter] = wider
                    held += both.shape[1]
                times = times.astype(np.int64)
                # a document stands here once for each of its A ids
                np.add.at(both[1], doc, times * np.repeat(count, n))
                np.add.at(both[0], doc, times * np.repeat(count == highest, n))
                if held > MOST_SUMS:
                    yield from emptied()
                    held = 0
        yield from emptied()

    return dealt.mapInArrow(run, "chapter long, doc binary, best binary, sums binary")


def aligned(docs: DataFrame, doc: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Figures of both tokenizers over every text: tokens, groups, links, links of the highest count of their B id, counts summed over links, digest of the groups."""
    told = written(chapters(docs, doc, text, path_a or vocabulary_path(SIDE_A), path_b or vocabulary_path(SIDE_B)), "chapters")
    added = written(contributions(told), "contributions")
    pages = told.filter("b is null").select("chapter", F.lit(1).alias("kind"), *_DOC)
    rows = pages.unionByName(added.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("chapter").sortWithinPartitions("chapter", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        both = np.zeros((2, 1 << 16), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                if at["kind"].as_py() == 0:
                    number = np.frombuffer(at["doc"].as_buffer(), np.uint16)
                    both[0, number] += np.frombuffer(at["best"].as_buffer(), np.int64)
                    both[1, number] += np.frombuffer(at["sums"].as_buffer(), np.int64)
                    continue
                own = [at[c].values for c in _DOC]
                sums = [pa.array(x[: len(own[0])]) for x in both]
                yield pa.RecordBatch.from_arrays([*own, *sums], [*_DOC, "best", "sums"])
                both[:] = 0

    found = rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _DOC.items()) + ", best long, sums long")
    found = written(found, "aligned", keep=True)
    discard(told, added)
    return found.select(
        F.col("d").alias(doc), "n_a", "n_b", "n_groups", "n_links", F.col("best").alias("n_best"), F.col("sums").alias("count_sum"), F.col("sha").alias("groups_sha256")
    )


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents"))


QUERIES = {"op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment}
SQL: dict[str, str] = {}
