"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source of n documents that should make up the share w of ``total`` documents has the mean repetition rate total * w / n.
Every document draws its number of copies from the Poisson distribution of that mean, by inverting the distribution at a
number in (0, 1) that is a hash of its id and a seed: the draw is repeatable, needs no state and no order. Documents are
exploded by their number and dealt to partitions by a hash of id and copy, by which each partition is also sorted: a global
shuffle in which a hot source is spread like any other.

Without given weights a source's weight is the square root of its number of documents, as a share of all.

Defined results: rows without a source are a source of their own; rows of equal ids draw alike; rows without an id draw by a hash
of their other columns (but maps), so equal ones draw alike;
sources without a given weight and those of weight 0 have no copies; an empty table gives an empty result; all columns of the
input are kept, whatever their names, beside which those made here give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.llm.common import read

SEED, TEMPER = "mix-1", 0.5
#: Bytes of distributions that are broadcast. Beyond, both sides are shuffled by source.
MOST_BROADCAST = 16_000_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, total: float | None = None, temper: float = TEMPER) -> DataFrame:
    """(mix_source, mix_rate): the mean number of copies of a document of each source."""
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(temper))
    if weights is not None:
        weight = F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for pair in (weights or {"": 0.0}).items() for x in pair]), F.coalesce("mix_source", F.lit(""))),
            F.lit(0.0)
        )
    counts = counts.withColumn("weight", weight)
    whole = counts.agg(F.sum("weight").alias("weights"), F.sum("n").alias("size"))  # one row
    size = F.lit(float(total)) if total is not None else F.col("size")
    share = F.try_divide(F.col("weight"), F.col("weights"))
    return counts.crossJoin(F.broadcast(whole)).select("mix_source", F.coalesce(share * size / F.col("n"), F.lit(0.0)).alias("mix_rate"))


def distributions(rated: DataFrame) -> DataFrame:
    """Adds mix_low and mix_cdf: the chances of at most mix_low, mix_low + 1, … copies, as far from the mean as the hash can tell apart.

    Chances are products of rate / k along the numbers k, of which only quotients count, and are divided by their sum.
    """
    reach = 9 * F.sqrt("mix_rate") + 30
    low, high = F.greatest(F.floor(F.col("mix_rate") - reach), F.lit(0)).cast("long"), F.ceil(F.col("mix_rate") + reach).cast("long")
    bounds = rated.withColumn("mix_low", low)
    steps = bounds.select("mix_source", "mix_rate", "mix_low", F.explode(F.sequence("mix_low", F.when(F.col("mix_rate") > 0, high).otherwise(0))).alias("k"))
    whole = W.partitionBy("mix_source")
    upto = whole.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("k") == F.col("mix_low"), 0.0).otherwise(F.ln(F.col("mix_rate") / F.col("k")))
    steps = steps.withColumn("log", F.sum(step).over(upto))
    steps = steps.withColumn("part", F.exp(F.col("log") - F.max("log").over(whole)))
    steps = steps.withColumn("cdf", F.sum("part").over(upto) / F.sum("part").over(whole))
    return steps.groupBy("mix_source", "mix_rate", "mix_low").agg(F.array_sort(F.collect_list("cdf")).alias("mix_cdf"))


def _upto(cdf: str, point: Column) -> Column:
    """How many of the rising numbers are at most ``point``, found by halving."""
    halves = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cdf) + F.lit(1.0))).cast("int"))

    def half(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.get(cdf, middle) <= point
        return F.when(at["lo"] >= at["hi"], at).when(below, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))

    return F.reduce(halves, F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), half)["lo"]


def draws(docs: DataFrame, doc: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """(row, mix_copy, mix_rate, mix_key): the documents, each a struct, as often as they were drawn, shuffled."""
    plain = docs.select(F.col(f"`{source}`").alias("mix_source"))
    rated = rates(plain, "mix_source", weights, total)
    # the distributions of all sources together, in bytes
    size = rated.agg(F.sum(18 * F.sqrt("mix_rate") + 64)).first()[0] or 0
    listed = distributions(rated)
    few = 8 * size <= MOST_BROADCAST
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != doc and "map<" not in f.dataType.simpleString()]
    name = F.coalesce(F.col(f"`{doc}`").cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.lit(0), *others).cast("string")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{source}`").alias("from"), name.alias("name"))
    drawn = rows.join(F.broadcast(listed) if few else listed, F.col("from").eqNullSafe(F.col("mix_source")))  # beyond the bound both sides are shuffled
    point = uniform(F.lit(seed), F.col("name"))
    copies = F.when(F.col("mix_rate") > 0, F.col("mix_low") + _upto("mix_cdf", point)).otherwise(0).cast("int")
    drawn = drawn.select("row", "name", "mix_rate", copies.alias("copies")).filter("copies > 0")
    each = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"), "mix_rate", "name")
    each = each.select("row", "mix_copy", "mix_rate", F.md5(F.concat_ws(":", F.lit(seed), "name", "mix_copy")).alias("mix_key"))
    return each.repartition("mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, doc: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """The documents as often as they were drawn, shuffled, with mix_copy, mix_rate and mix_key but for names that the documents have themselves."""
    taken = {c.lower() for c in docs.columns}
    made = [c for c in ("mix_copy", "mix_rate", "mix_key") if c not in taken]
    return draws(docs, doc, source, weights, total, seed).select(*(F.col("row")[c].alias(c) for c in docs.columns), *made)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "text", F.col("mix_copy").alias("copy"), F.round("mix_rate", 9).alias("rate"), F.col("mix_key").alias("shuffle_key"))


QUERIES = {"op7_mixing": op7_mixing}
SQL = {
    "op7_mixing": """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, text, (CAST(('0x' || substr(md5('mix-1:' || doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.doc_id, u.source, u.text, c.rate, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, round(rate, 9) AS rate, md5('mix-1:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, text, rate, unnest(range(1, copies + 1)) AS copy FROM m)"""
}
