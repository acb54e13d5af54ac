import base64
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from quillstage.llm import winnow
from tests.conftest import SF

M = (1 << 64) - 1


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & M).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return []
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    if len(h) < 5:
        grams = [chained(*h)]
    else:
        two = [chained(a, b) for a, b in zip(h, h[1:], strict=False)]
        four = [chained(a, b) for a, b in zip(two, two[2:], strict=False)]
        grams = [chained(a, b) for a, b in zip(four, h[4:], strict=False)]
    short = [(g >> 26, i) for i, g in enumerate(grams)]
    out = []
    for i in range(max(1, len(short) - 7)):
        best = min(short[i : i + 8], key=lambda x: (x[0], -x[1]))
        if best not in out:
            out.append(best)
    return out


def check(rows):
    tie = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1] is not None, r[1] or ""))
    expected = {}
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = ({x for x, _ in brute(s)} for s in (t, edited, nxt))
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        write = lambda s: " ".join(str((x << 26) + (1 << 26) - 1 - i) for x, i in brute(s))
        expected.setdefault(d, set()).add((len(t), hashlib.sha256(edited.encode()).hexdigest(), write(t), write(edited), round(like(a, b), 9), round(like(a, c), 9)))
    return expected


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)))
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert collected(winnow.fingerprints(docs)) == check([(r.doc_id, r.text) for r in docs.collect()])


def test_ranges_and_wrap(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)
    rows = [(i * i * 7919, f"text number {i} of some words and more " * (i % 4)) for i in range(60)]
    assert collected(winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == check(rows)


def test_odd_rows(odd, nothing, spark):
    short = odd.filter("doc_id is null or doc_id <> 6")
    assert collected(winnow.fingerprints(short)) == check([(r.doc_id, r.text) for r in short.collect()])
    assert winnow.fingerprints(odd).count() == odd.count() and winnow.fingerprints(nothing).count() == 0
    single = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert collected(winnow.fingerprints(single)) == check([(1, "abcd")])


def test_rows_without_id_are_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)
    rows = [(None, f"text number {i} of some words" * (i % 3)) for i in range(90)] + [(i * 5, f"other text {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(without for without, _, _ in winnow._heads(docs, "doc_id", "text")) > 8
    assert collected(winnow.fingerprints(docs)) == check(rows)


def test_ranges_are_even_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 4)
    dense, far = list(range(100, 200)), [k * (1 << 62) // 100 * (-1) ** k for k in range(100)]
    for ids in (dense + far, [7] * 200, [None] * 90 + [-(1 << 63), (1 << 63) - 1] * 5 + dense):
        rows = [(i, f"text number {k} of some words" * (k % 3 + 1)) for k, i in enumerate(ids)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        heads = winnow._heads(docs, "doc_id", "text")
        number, _ = winnow._range_of(winnow._place("doc_id", "text"), heads)
        sizes = [r["count"] for r in docs.groupBy(number.alias("r")).count().collect()]
        assert len(sizes) == len(heads) > 40 and max(sizes) <= 8
        assert collected(winnow.fingerprints(docs)) == check(rows)


def test_rows_of_one_id_and_text_and_a_single_range(spark, monkeypatch):
    rows = [(7, "the same few words again")] * 40 + [(9, "another text"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert winnow.fingerprints(docs).count() == 43 and collected(winnow.fingerprints(docs)) == check(rows)
    monkeypatch.setattr(winnow, "RANGE_ROWS", 2)
    assert winnow.fingerprints(docs).count() == 43 and collected(winnow.fingerprints(docs)) == check(rows)


def test_shared_passage_is_found():
    words = [f"w{i}" for i in range(40)]
    a, b = brute(" ".join(["x"] * 9 + words[:12] + ["y"] * 9)), brute(" ".join(["u"] * 7 + words[:12] + ["v"] * 5))
    assert {x for x, _ in a} & {x for x, _ in b}


def brute_characters(text):
    text = re.sub(r"[ \t-\r]+", " ", (text or "").lower().strip(" \t\n\x0b\x0c\r"))
    units = text.encode("utf-16-be")
    n = len(units) // 2
    short = [(signed(xxhash.xxh64_intdigest(units[2 * i : 2 * i + 16], 42)) >> 26, i) for i in range(max(1, n - 7))] if text else []
    out = []
    for i in range(max(1, len(short) - 7) if short else 0):
        best = min(short[i : i + 8], key=lambda x: (x[0], -x[1]))
        if best not in out[-1:]:
            out.append(best)
    return out


#: Texts whose lower-cased first halves differ from the beginning of the whole, or that lose or gain characters.
ODD = [
    "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ", "İ" * 40 + "I", " \n " * 30 + "the words stand far behind the white space here",
    "a  b \n c  " * 12, "𝄞" * 33, "x" * 29, "x" * 30, "x" * 31, "0123456789abcdef", "0123456789abcde"
]


def test_character_grams_equal_brute_force(spark, odd, monkeypatch):
    monkeypatch.setitem(globals(), "brute", brute_characters)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text")
    docs = docs.unionByName(odd.filter("doc_id is null or doc_id <> 6").select((-F.col("doc_id")).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(9_000_001, "汉字" * 3 + "中文文本没有空格𝄞也要找到共同的段落"), (9_000_002, "a"), (9_000_003, "ab\n\n\tcd  efgh"), *[(9_000_010 + i, x) for i, x in enumerate(ODD)]], docs.schema))
    assert collected(winnow.fingerprints(docs, grams=winnow.character_grams)) == check([(r.doc_id, r.text) for r in docs.collect()])


def test_short_and_unsegmented_texts_keep_their_unchanged_half(spark, tmp_path):
    texts = ["The harbour was full of small boats.", "港口里停满了小船渔夫们在修补渔网没有人谈起夜里过去的那场暴风雨", "function(a,b){return(a+b)*(a-b)};var", "ท่าเรือเต็มไปด้วยเรือลำเล็กและชาวประมง"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert all(0 < r.near_edited < 1 for r in winnow.op6_document_fingerprints(spark, str(tmp_path)).collect())


def test_compact_fingerprints_hold_all_of_them(spark):
    def read(text):
        """(hash, position) of the entries of a compact fingerprint."""
        raw = base64.b64decode(text).hex()
        digits, out, at = raw[len(raw) % 11 :], [], -1
        for k in range(0, len(digits), 11):
            x = int(digits[k : k + 11], 16)
            at += 1 + (x % 64 - (at + 1)) % 64
            out.append(((x >> 6) - ((x >> 43) << 38), at))
        return out

    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ODD + [None, "", "a", "z" * 500]
    got = winnow.op6_document_fingerprints(spark, SF).collect()
    whole = {r.doc_id: r for r in winnow.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"), grams=winnow.character_grams).collect()}
    size = 0
    for r in got:
        for c in ("fingerprint", "edited_fingerprint"):
            entries = [(x >> 26, (1 << 26) - 1 - x % (1 << 26)) for x in map(int, whole[r.doc_id][c].split())]
            assert read(r[c]) == entries
            size += len(r[c]) - 0.4 * len(whole[r.doc_id][c])
    assert len(got) == len(whole) and size < 0
    df = spark.createDataFrame([(t,) for t in docs], "t string")
    for r in winnow.with_fingerprint(df, "t", "fp", winnow.character_grams).select("t", "fp", winnow.compact(F.col("fp")).alias("c")).collect():
        assert read(r.c) == [(x >> 26, (1 << 26) - 1 - x % (1 << 26)) for x in r.fp] == brute_characters(r.t)
