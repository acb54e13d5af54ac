import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quillstage.llm import language
from tests.conftest import SF
from tests.llm.conftest import PROSE


def test_held_out_accuracy(spark):
    got = language.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", F.length("text").alias("size"))
    rows = got.filter("held_out").join(docs, "doc_id").filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.985 * len(rows)
    for least, most, share in ((0, 50, 0.4), (50, 500, 0.97), (500, 10**9, 0.99)):
        part = [r for r in rows if least <= (r["size"] or 0) < most]
        assert sum(r.lang == r.lang_pred for r in part) >= share * len(part)
    assert got.filter("score < 0 or score > 1").count() == 0


def spaced(text):
    return " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")).split()


def brute(rows, held):
    """Predictions by compressing every text anew with every dictionary."""
    samples = {}
    order = lambda r: xxhash.xxh64_intdigest((r[1] or "").encode(), xxhash.xxh64_intdigest(str(r[0]).encode(), 42)) % (1 << 40)
    for d, text, lang in sorted((r for r in rows if r[2] is not None and not held(r[0])), key=order):
        words = spaced(text)
        first = next((i for i, c in enumerate(text or "") if c.isalpha()), None)
        if words:
            piece = text if len(text) <= language.SAMPLE_CHARS else text[first : first + language.SAMPLE_CHARS]
            parts = samples.setdefault(lang, [])
            if len(parts) < language.SAMPLE_DOCS and sum(map(len, parts)) < language.DICTIONARY_BYTES:
                parts.append(" ".join(spaced(piece)).encode())
    out = {}
    for d, text, _ in rows:
        raw, sizes = " ".join(spaced(text)).encode(), []
        for lang, parts in samples.items():
            joined = b" ".join(parts)[: language.DICTIONARY_BYTES]
            own = zstandard.ZstdCompressionParameters.from_level(
                language.LEVEL, dict_size=language.DICTIONARY_BYTES, source_size=language.BLOCK, write_content_size=False,
                write_checksum=False, write_dict_id=False
            )
            c = zstandard.ZstdCompressor(compression_params=own, dict_data=zstandard.ZstdCompressionDict(joined, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append((sum(len(c.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)), lang))
        (best, lang), (second, _) = sorted(sizes)[:2] if raw else ((0, "und"), (0, ""))
        share = (second - best) / second if raw else 0
        out[d] = (held(d), lang, round(share / (share + language.HALF_SCORE), 9), share < language.MARGIN)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**6 + i, t, "en") for i, t in enumerate([None, "", "½ ² ① Ⅻ 12", "a", "É", "12 le port tranquille ①", "x" * 5000])]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    got = {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in language.QUERIES["op5_language_id"](spark, str(tmp_path)).collect()}
    assert got == brute(rows, lambda d: zlib.crc32(str(d).encode()) % 5 == 0)


@pytest.mark.parametrize("text", ["½ ²", "①②", "Ⅻ", "12 _ ٣", "", None, "!?"])
def test_no_letter(text):
    assert language.letters(text) == b"" and language.classify(text, (("en", b"abc"), ("fr", b"xyz")))[0] == "und"


def test_rows_without_id_are_neither_held_out_nor_learned(spark, tmp_path):
    rows = [(None, "zzz yyy xxx", "zz"), *[(i, PROSE, "en") for i in range(9)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = language.QUERIES["op5_language_id"](spark, str(tmp_path)).collect()
    assert len(out) == 10 and {r.lang_pred for r in out} == {"en"} and [r.held_out for r in out if r.doc_id is None] == [False]


def test_many_languages_are_all_learned(spark, monkeypatch):
    rows = [(i, PROSE + f" {chr(97 + i % 7) * 3} x" * i, f"l{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(model) == 300 and model[0][0] == "l000" and model[-1][0] == "l299"
    some = docs.filter("doc_id % 90 = 0")
    single = {r.doc_id: r.l for r in some.select("doc_id", language.identified("text", model[:40], spark).alias("l")).collect()}
    monkeypatch.setattr(language, "AT_ONCE", 7)
    assert single == {r.doc_id: r.l for r in some.select("doc_id", language.identified("text", model[:40], spark).alias("l")).collect()}
    assert {r.doc_id: r.l for r in some.select("doc_id", language.identified(F.lit(None).cast("string"), model[:40], spark).alias("l")).collect()}[0].lang_pred == "und"


FRENCH = "Le port tranquille était plein de petits bateaux, et les pêcheurs réparaient leurs filets. "


@pytest.mark.parametrize("ids", ["CAST(NULL AS BIGINT)", "CAST(7 AS BIGINT)", "id", "id div 100", "id * 4000037"])
def test_any_ids_are_learned_from_a_bounded_sample(spark, monkeypatch, ids):
    docs = spark.range(10_000).selectExpr(f"{ids} AS doc_id", f"concat(if(id % 2 = 0, '{PROSE}', '{FRENCH}'), id) AS text", "if(id % 2 = 0, 'en', 'fr') AS lang")
    read = []
    real = language.letters
    monkeypatch.setattr(language, "letters", lambda t: read.append(t) or real(t))
    model = language.learn(docs)
    assert [name for name, _ in model] == ["en", "fr"] and 240 <= len(read) <= 2 * 900
    assert language.classify(FRENCH, model)[0] == "fr" and language.classify(PROSE, model)[0] == "en"


def test_repeated_rows_are_one_of_the_sample(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("CAST(7 AS BIGINT) AS doc_id", f"'{PROSE}' AS text", "'en' AS lang")
    read = []
    real = language.letters
    monkeypatch.setattr(language, "letters", lambda t: read.append(t) or real(t))
    assert [name for name, _ in language.learn(docs)] == ["en"] and len(read) == 1
    assert language.keep_known(docs).count() == 20_000


def test_clashing_names(clashing, odd):
    kept = language.keep_known(clashing)
    assert kept.columns == clashing.columns and kept.filter("__language <> 'own __language' or found <> 'own found'").count() == 0
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in language.keep_known(odd).collect())


def test_odd_rows(spark, odd, nothing):
    model = language.learn(odd)
    assert [name for name, _ in model] == ["en", "fr"]
    out = {r.doc_id: r.l for r in odd.select("doc_id", language.identified("text", model, spark).alias("l")).collect()}
    assert [out[d].lang_pred for d in (0, 1, 2, 8)] == ["und"] * 4 and out[0].score == 0
    assert out[4].lang_pred == "en" and out[7].lang_pred == "fr"
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and {4, 5, 7} <= {r.doc_id for r in kept.collect()}
    assert language.keep_known(nothing).count() == 0 and language.learn(nothing) == ()


def test_one_language_and_none():
    assert language.classify("abc", (("en", b"abc abc"),)) == ("en", 1.0, False)
    assert language.classify("abc", ()) == ("und", 0.0, True)


def test_long_documents_are_learned(spark):
    french = "Le port tranquille était plein de petits bateaux, et les pêcheurs réparaient leurs filets. "
    rows = [(i, "0 1 . " * 2000 * i + PROSE * 90, "en") for i in range(3)] + [(9, french * 120, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert [name for name, _ in model] == ["en", "fr"] and all(0 < len(raw) <= language.DICTIONARY_BYTES for _, raw in model)
    assert language.classify(french, model)[0] == "fr" and language.classify(PROSE, model)[0] == "en"
    assert language.keep_known(docs).count() == len(rows)
    many = spark.range(20_000).selectExpr("id AS doc_id", f"if(id = 77, '{PROSE}', '12 34') AS text", "'en' AS lang")
    assert [name for name, _ in language.learn(many)] == ["en"]
