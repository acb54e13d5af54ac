import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstage.llm import alignment
from tests.conftest import SF

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.vocabulary_path(alignment.SIDE_A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.vocabulary_path(alignment.SIDE_B))


def byte_of_sign():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def brute(texts, models):
    """The contract on whole texts: every token of every text, every pair of overlapping ranges."""
    a, b = models
    signs, told, counts = byte_of_sign(), [], collections.Counter()
    for text in texts:
        if not text:
            told.append(None)
            continue
        whole = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(p) != whole for p in pieces):
            told.append(None)
            continue
        spans = []
        for p in pieces:
            at, out = 0, []
            for x in p:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, (s, e) in zip(ids[0], spans[0], strict=True):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ids[1]) and spans[1][k][0] < e:
                links.append((i, ids[1][k]))
                k += 1
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at = [], [0, 0]
        for high in both:
            sides = []
            for k in (0, 1):
                first = at[k]
                while at[k] < len(ids[k]) and spans[k][at[k]][1] <= high:
                    at[k] += 1
                sides.append(",".join(map(str, ids[k][first : at[k]])))
            groups.append("|".join(sides))
        counts.update(links)
        told.append((len(ids[0]), len(ids[1]), len(both), links, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for x in told:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = x
            rows.append((n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    return rows


def same(spark, texts, models):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(docs).collect()}
    expected = brute(texts, models)
    for i, t in enumerate(texts):
        assert got[i] == expected[i], repr(t)
    assert len(got) == len(texts)


def test_equals_brute_force(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect()}
    assert [got[r.doc_id] for r in docs.select("doc_id").collect()] == brute(texts, models)


ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n x", "x\n y", "a b c", "a  b", "a   b", "a 　b", "<|endoftext|> a", "a <|endoftext|>", "</s> <s> <unk>", "<0x41> b", "a▁b", "▁", " ▁ x",
    "été naïve", "日本語 のテキスト", "🙂 🙂🙂", "it's they'll 'tis", "a\x00b \x00", "a \x1cb", "a \x85b", "x" * 3000, "tab\tbed \t x", "ﬁne ①②", "á b", "  lead", "trail   ", "a  b   c    d", "e​f ​ g", "﻿bom ﻿"
]


def test_odd_texts(spark, models):
    same(spark, ODD, models)


def test_random_texts(spark, models):
    rng = random.Random(4)
    signs = ["a", "the", "ing", " ", " ", "  ", "\n", "\t", "é", "ß", "日", " ", " ", "'s", "'", "12", "3", "--", "▁" * (rng.random() < 0.1), "🙂", "<s>", "\x00", "\x1f"]
    same(spark, ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(600)], models)


def test_many_chapters_and_tasks_of_an_id(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "CHAPTER_DOCS", 7)
    monkeypatch.setattr(alignment, "TASK_POSTINGS", 3)
    monkeypatch.setattr(alignment, "MOST_SUMS", 2000)
    rng, words = random.Random(2), "the of and harbour boats fishermen storm nets quiet small".split()
    same(spark, [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)] + ["the the the"] * 40, models)


def test_an_aligner_forgets(models, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    import pyarrow as pa

    of = alignment.Aligner(alignment.vocabulary_path(alignment.SIDE_A), alignment.vocabulary_path(alignment.SIDE_B))
    assert of.cuts
    for k in range(12):
        texts = [f"word{k}x{i} and" for i in range(9)] + ["y" * 400]
        numbers, begins = of.stretches(pa.array(texts))
        for t, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
            assert ";".join(of.groups[n] for n in numbers[a:b].tolist()).count("|") == of.figures[numbers[a:b], 2].sum() == brute([t], models)[0][2]
    assert len(of.known) <= 20 + 27


def test_odd_rows(odd, nothing, models):
    rows = odd.select("doc_id", "text").collect()
    expected = collections.Counter(zip([r.doc_id for r in rows], brute([r.text for r in rows], models), strict=True))
    assert collections.Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in alignment.aligned(odd).collect()) == expected
    assert alignment.aligned(nothing).count() == 0
    empty = alignment.aligned(odd.filter(F.col("text").isNull() | (F.col("text") == ""))).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in empty] == [(0, 0, 0, 0, 0, 0, "")] * 2
