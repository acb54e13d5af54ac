"""Language ID by compression: a text is encoded with a zstandard dictionary of raw text for every language, and the
language whose dictionary leaves the fewest bytes is chosen. Where the second-best is within a narrow margin the
choice is rejected.

What is encoded are the lower-cased letters of the whole text, runs of all else being one space, in blocks of 2048 bytes, so that
the dictionary and not the text's own past is what helps. Dictionaries are filled from a bounded sample: SAMPLE_DOCS
documents of each language that have a letter, the first by a hash of their ids and texts, up to DICTIONARY_BYTES. Documents of up
to SAMPLE_CHARS characters are taken whole, of longer ones as many from the first letter on, so every labelled language with a letter
is learned, whether ids are null, equal or clustered. Only text and language of the labelled rows are used.

Defined results: ``und`` with score 0 where the text is null or has no letter (numerals such as Ⅻ or ½ are none), or nothing was
learned; a document without an id is neither held out nor learned from by the query; of equally small
languages the first by name, with score 0; with a single learned language the score is 1; equal texts have equal results;
an empty table gives an empty result; other columns are ignored by the query and kept by ``keep_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import make_room, read

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 120, 8000, 65_536
#: Languages whose dictionaries are one broadcast.
AT_ONCE = 200
LEVEL, BLOCK = 12, 2048
MARGIN, HALF_SCORE = 0.005, 0.02
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: The same with word characters that are neither letters nor decimal digits: numerals, raised and circled digits. Slow.
_NUMERALS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_OTHER_THAN_LETTERS = re.compile(rf"[\W\d_{_NUMERALS}]+")
#: What ``letters`` leaves, and what stands before the first of it, for Spark.
_LETTER, _BEFORE = r"\p{L}", r"^\P{L}++"
Model = tuple[tuple[str, bytes], ...]


def letters(text: str | None) -> bytes:
    """The lower-cased letters of a text, with a space for what stands between."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    if words and not words.replace(" ", "").isalpha():
        words = _OTHER_THAN_LETTERS.sub(" ", words).strip()
    return words.encode("utf-8", "surrogatepass")


def learn(labelled: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A dictionary per language. Rows of the same id, text and language are one; a few times SAMPLE_DOCS texts of each language, cut to SAMPLE_CHARS, reach the driver."""
    rows = labelled.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{doc}`").cast("string"), F.col(f"`{text}`")).alias("h"))
    rows = rows.filter(F.col("l").isNotNull() & F.rlike("t", F.lit(_LETTER)))
    # of so many different rows about that many hashes lie below a bound
    counts = {r[0]: r[1] for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return ()
    order = F.pmod("h", F.lit(1 << 40))
    below = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, int((1 << 40) * min(1.0, (2 * SAMPLE_DOCS + 250) / max(n, 1))))])
    piece = F.when(F.length("t") <= SAMPLE_CHARS, F.col("t")).otherwise(F.left(F.regexp_replace("t", _BEFORE, ""), F.lit(SAMPLE_CHARS)))
    drawn = rows.filter(order < F.try_element_at(below, F.col("l"))).select("l", order.alias("o"), piece.alias("t"))
    sample = sorted(tuple(r) for r in drawn.groupBy("l", "o").agg(F.min("t").alias("t")).collect())
    filled: dict[str, list[bytes]] = {}
    for name, _, t in sample:
        parts = filled.setdefault(name, [])
        if len(parts) < SAMPLE_DOCS and (b := letters(t)) and sum(map(len, parts)) < DICTIONARY_BYTES:
            parts.append(b)
    return tuple((name, b" ".join(parts)[:DICTIONARY_BYTES]) for name, parts in sorted(filled.items()) if parts)


@lru_cache(1)
def _compressors(model: Model):
    import zstandard

    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}

    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICTIONARY_BYTES, source_size=BLOCK, **plain)

    def compressor(raw: bytes):
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)

    return [(name, compressor(raw)) for name, raw in model]


def forget() -> bool:
    """Drops the compressors of this process; whether there were any."""
    had = _compressors.cache_info().currsize > 0
    _compressors.cache_clear()
    return had


def smallest(text: str | None, model: Model) -> list[tuple[int, str]]:
    """Size and language of the two smallest encodings, none where there is nothing to encode."""
    raw = letters(text)
    if not raw:
        return []
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in _compressors(model))[:2]


def judged(sizes: list[tuple[int, str]]) -> tuple[str, float, bool]:
    """Language, score and whether the choice is rejected, by the smallest encodings."""
    if not sizes:
        return UNKNOWN, 0.0, True
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], margin / (margin + HALF_SCORE), margin < MARGIN


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, score and whether the choice is rejected."""
    return judged(smallest(text, model))


def identified(text: str | Column, model: Model, spark: SparkSession) -> Column:
    """A struct of lang_pred, score and rejected for every text. Of many languages each AT_ONCE are a broadcast of their own, whose smallest encodings meet."""
    if len(model) <= AT_ONCE:
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def of(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            make_room(__name__)
            for texts in frames:
                yield pd.DataFrame([classify(t, shared.value) for t in texts.tolist()], columns=["lang_pred", "score", "rejected"])

        return of(text)
    parts = [_smallest(text, model[i : i + AT_ONCE], spark) for i in range(0, len(model), AT_ONCE)]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def best(*columns: pd.Series) -> pd.DataFrame:
        rows = [judged(sorted((x["size"], x["name"]) for own in row for x in own)[:2]) for row in zip(*columns, strict=True)]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return best(*parts)


def _smallest(text: str | Column, model: Model, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<size:bigint,name:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"size": size, "name": name} for size, name in smallest(t, shared.value)] for t in texts.tolist()], dtype=object)

    return of(text)


def keep_known(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is recognised beyond doubt, with their own columns, whatever their names; learned from all labelled ones."""
    model = learn(docs, doc, text, lang)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), identified(F.col(f"`{text}`"), model, docs.sparkSession).alias("found"))
    return rows.filter("not found.rejected").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    held_out = F.coalesce(rest == 0, F.lit(False))
    model = learn(docs.filter(rest != 0))
    found = docs.select("doc_id", held_out.alias("held_out"), identified("text", model, spark).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.rejected")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
