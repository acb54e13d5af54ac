import collections
import zlib
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillstage.llm import packing, tokens
from quillstage.llm.common import local_path, written
from tests.llm.conftest import PROSE
from tests.llm.test_mixing import brute as drawn
from tests.llm.test_near_duplicates import brute, brute_rows
from tests.llm.test_quality import figures

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        tables.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good, known, single, mixed, packed = tables
    for r in good.collect():
        n, _, _, _, again = figures(r.text)
        assert n >= 10 and 100 * again <= 20 * n
    assert known.count() >= 0.99 * good.count()
    before = brute([(r.doc_id, r.text) for r in known.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in before.items() if c == d}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies == drawn(single.select("doc_id", "source").collect())
    placed(packed.collect(), mixed)


def placed(rows, docs):
    """Asserts that the pieces are those of the documents, and lie in their sequences gapless and apart."""
    tokenizer, pieces = Tokenizer.from_file(tokens.vocabulary_path()), collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.update((r.doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_leaves_no_table_but_the_pieces(spark):
    shared = Path(local_path(spark.conf.get("spark.checkpoint.dir")))
    before = set(shared.iterdir())
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-", 2)[2] for p in set(shared.iterdir()) - before] == ["pieces"]
    assert packed.count() > 0


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(d, PROSE * 2 + f" It was the day {k} of the week." * 3, "en", "s", 1) for k in range(12) for d in (None, None, k % 5, k % 5, 7 + k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.near_dedup(spark, docs, SF)
    assert single.count() == len({r.text for r in single.collect()}) == len(brute_rows([(d, t) for d, t, *_ in rows])[1])


def test_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_odd_and_empty(spark, odd, clashing, nothing):
    for docs in (odd, clashing, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert "sequence_id" in docs.columns
