"""Cues, neighbours, recitation history, status, revision queue, merging of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.sources.folder import shared_folder

DAY = 86_400_000
SUCCESS, MASTERY, INTERVALS, KEPT, QUEUE = 90, 3, (7, 16, 35), 10, 12
WEAK, OLD, HORIZON = 0.7, 0.3, 30.0
STATUSES = ("a_apprendre", "en_cours", "a_reviser", "maitrisee")
MUTE = ["lieu", "texte_sans_personnage"]


def is_mine(people: Column, roles: list[str]) -> Column:
    return F.array_contains(people, "*") | F.arrays_overlap(people, F.array(*map(F.lit, roles)))


def cues(elements: DataFrame, unit: list[str], order: str, mine: Column) -> DataFrame:
    """What precedes each of my speeches: cue_type (replique, didascalie, aucun), cue_text, cue_reason.

    As-of within the unit: no cue where the last speech is mine too; else the last element that is not mute.
    """
    before = W.partitionBy(*unit).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    speech = F.col("type") == "replique"
    e = elements.withColumns({"__mine": mine, "__last_mine": F.last(F.when(speech, mine), ignorenulls=True).over(before)})
    e = e.withColumn(
        "__cue",
        F.last(F.when(~F.col("type").isin(MUTE), F.struct(F.col("type").alias("type"), F.col("text").alias("text"))), ignorenulls=True).over(before)
    )
    chained = F.coalesce(F.col("__last_mine"), F.lit(False))
    none = chained | F.col("__cue").isNull()
    kind = F.when(none, "aucun").when(F.col("__cue.type") == "replique", "replique").otherwise("didascalie")
    reason = F.when(chained, "enchainement").when(F.col("__cue").isNull(), "debut_unite")
    return e.filter(speech & F.col("__mine")).withColumns({"cue_type": kind, "cue_text": F.when(~none, F.col("__cue.text")), "cue_reason": reason}).drop("__mine", "__last_mine", "__cue")


def neighbours(mine: DataFrame, key: list[str], order: str, id_: str) -> DataFrame:
    """Adds the previous and next of my speeches, null at the ends."""
    w = W.partitionBy(*key).orderBy(order)
    return mine.withColumns({"previous_id": F.lag(id_).over(w), "next_id": F.lead(id_).over(w)})


def success(score: Column, corrected: Column | None = None) -> Column:
    good = F.coalesce(score >= SUCCESS, F.lit(False))
    return good if corrected is None else good | F.coalesce(corrected, F.lit(False))


def newest(history: DataFrame, key: list[str], at: str, tie: str, kept: int = KEPT) -> DataFrame:
    """The newest ``kept`` entries of each key, ranked from 1."""
    w = W.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kept)


def newest_corrected(ranked: DataFrame) -> DataFrame:
    """Adds corrected: the newest entry of each key is taken as known, whatever its measured score, which stays."""
    return ranked.withColumn("corrected", F.col("rank") == 1)


def progress(ranked: DataFrame, key: list[str], at: str, score: str, now: Column, corrected: str | None = None) -> DataFrame:
    """Per key: attempts, current streak, successes, last score and time, due time and status at ``now``."""
    ok = success(F.col(score), None if corrected is None else F.col(corrected))
    per = ranked.groupBy(*key).agg(
        F.count("*").alias("attempts"), F.coalesce(F.min(F.when(~ok, F.col("rank"))) - 1, F.count("*")).cast("long").alias("streak"),
        F.count_if(ok).alias("successes"), F.max(at).alias("last_at"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("last_score")
    )
    step = F.get(F.array(*map(F.lit, INTERVALS)), F.least(F.col("streak") - MASTERY, F.lit(len(INTERVALS) - 1)).cast("int"))
    per = per.withColumn("due_at", F.when(F.col("streak") >= MASTERY, F.col("last_at") + step.cast("long") * F.lit(DAY)))
    status = F.when(
        F.col("streak") >= MASTERY, F.when(now <= F.col("due_at"), "maitrisee").otherwise("a_reviser")
    ).when(F.col("successes") >= MASTERY, "a_reviser").otherwise("en_cours")
    return per.withColumn("status", status)


def difficulty(last_score: Column, last_at: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (now - last_at) / float(DAY))
    weak = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (100 - last_score) / 100.0)), F.lit(1.0))
    return WEAK * weak + OLD * F.coalesce(F.least(F.lit(1.0), days / HORIZON), F.lit(1.0))


def spot_weight(checked_at: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), F.greatest(F.lit(0), now - checked_at) / float(DAY)), F.lit(1000.0))


def drawn(weighted: DataFrame, key: list[str], order: str, weight: str, point: Column) -> DataFrame:
    """Of each key the first row whose running weight exceeds ``point`` (0 to 1) of the whole.

    A scan of two levels: rows are dealt by ranges of key and order and kept as a table, whose parts are summed; running sums of
    these few tell which part of a key holds the point, and rows are only summed one by one within that part. So a single key may
    have all rows.
    """
    spark, folder = weighted.sparkSession, shared_folder(weighted.sparkSession, "drawn")
    ranged = weighted.filter(F.col(weight) > 0).repartitionByRange(*key, order).withColumn("__slice", F.spark_partition_id())
    ranged.write.parquet(folder)
    rows = spark.read.schema(ranged.schema).parquet(folder)
    w = W.partitionBy(*key)
    parts = rows.groupBy(*key, "__slice").agg(F.sum(weight).alias("__own"))
    upto = F.sum("__own").over(w.orderBy("__slice").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumns({"__upto": upto, "__all": F.sum("__own").over(w), "__last": F.max("__slice").over(w)})
    past = parts.filter((F.col("__upto") > point * F.col("__all")) | (F.col("__slice") == F.col("__last")))
    # of each key one part
    held = past.groupBy(*key).agg(F.min_by(F.struct("__slice", (F.col("__upto") - F.col("__own")).alias("__before"), "__all"), "__slice").alias("__p")).select(*key, "__p.*")
    named = held.select(*(F.col(k).alias(f"__of_{k}") for k in key), F.col("__slice").alias("__of"), "__before", "__all")
    same = F.col("__slice") == F.col("__of")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    inside = W.partitionBy(*key, "__slice").orderBy(order)
    own = rows.join(named, same).withColumn("__sum", F.col("__before") + F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # the last one of a part stands in where rounding leaves none past the point
    first = own.withColumn("__short", F.col("__sum") <= point * F.col("__all")).withColumn("__turn", F.row_number().over(inside))
    best = first.withColumn("__n", F.row_number().over(W.partitionBy(*key, "__slice").orderBy("__short", F.when(F.col("__short"), -F.col("__turn")).otherwise(F.col("__turn")))))
    return best.filter("__n = 1").select(*weighted.columns)


def rank_of(status: Column) -> Column:
    """Place of a status in the order of learning, 0 where it is unknown."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), status), F.lit(0)) - 1, F.lit(0))


def status_at(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), rank.cast("int"))


def worst_status(speeches: DataFrame, unit: str, status: str = "status") -> DataFrame:
    return speeches.groupBy(unit).agg(status_at(F.min(rank_of(F.col(status)))).alias("status"))


def merged_scores(local: DataFrame, imported: DataFrame, key: list[str], at: str, score: str, kept: int = KEPT) -> DataFrame:
    """Union of two histories: of equal times the imported entry counts, and the newest stay."""
    both = local.select(*key, at, score, F.lit(0).alias("side")).unionByName(imported.select(*key, at, score, F.lit(1).alias("side")))
    one = both.groupBy(*key, at).agg(F.max_by(score, F.struct("side", score)).alias(score))
    return newest(one, key, at, score, kept)


def merged_progress(local: DataFrame, imported: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge of (key, status, checked_at): the further status, the later check."""
    a, b = (side.select(*key, F.col("status").alias(f"s{i}"), F.col("checked_at").alias(f"c{i}")) for i, side in enumerate((local, imported)))
    m = a.join(b, key, "full_outer")
    return m.select(*key, status_at(F.greatest(rank_of(F.col("s0")), rank_of(F.col("s1")))).alias("status"), F.greatest("c0", "c1").alias("checked_at"))
