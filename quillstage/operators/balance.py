"""Weight of roles and actors, presence by unit, casting conflicts and costume changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOLLOW_PART, HOLLOW, SWOLLEN_PART, SWOLLEN = 0.25, 3.0, 2.5, 15.0
CUT_FIRST, CUT_NEVER, TOP_UNITS = 1.3, 0.6, 15
EVERYONE = "*"


def role_weights(said: DataFrame, unit: str, role: str, words: Column) -> DataFrame:
    """Per role: words, share of all, speeches, units, share of units, flag. The whole is an aggregate of one row."""
    named = said.filter(F.col(role) != EVERYONE)
    per = named.groupBy(F.col(role).alias("role")).agg(F.sum(words).cast("long").alias("words"), F.count("*").alias("speeches"), F.countDistinct(unit).alias("units"))
    units = said.agg(F.countDistinct(unit).alias("all_units"))
    whole = per.agg(F.sum("words").alias("__all"), F.count("*").alias("__roles"))
    per = per.crossJoin(F.broadcast(whole)).withColumn("word_share", F.coalesce(F.try_divide(100.0 * F.col("words"), F.col("__all")), F.lit(0.0)))
    # shares make up 100, or are all 0
    per = per.withColumn("__mean", F.when(F.col("__all") > 0, 100.0 / F.col("__roles")).otherwise(0.0))
    flag = F.when((F.col("word_share") < HOLLOW_PART * F.col("__mean")) & (F.col("word_share") < HOLLOW), "hollow").when(
        (F.col("word_share") > SWOLLEN_PART * F.col("__mean")) & (F.col("word_share") > SWOLLEN), "swollen"
    ).otherwise("")
    return per.crossJoin(F.broadcast(units)).select(
        "role", "words", F.round("word_share", 6).alias("word_share"), "speeches", "units",
        F.round(100.0 * F.col("units") / F.col("all_units"), 6).alias("unit_share"), flag.alias("flag")
    )


def presence(said: DataFrame, unit: str, role: str, roles: list[str]) -> DataFrame:
    """A row per unit, a column per role: X where it speaks."""
    marked = said.groupBy(unit).pivot(role, roles).agg(F.first(F.lit("X")))
    return marked.select(unit, *(F.coalesce(F.col(f"`{r}`"), F.lit("")).alias(r) for r in roles))


def unit_words(said: DataFrame, unit: str, role: str, words: Column) -> DataFrame:
    """Per unit: words, the roles present in order, whether everyone speaks at once."""
    return said.groupBy(unit).agg(
        F.sum(words).cast("long").alias("words"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col(role) != EVERYONE, F.col(role)))), ", ").alias("roles"),
        F.max(F.when(F.col(role) == EVERYONE, 1).otherwise(0)).cast("boolean").alias("collective")
    )


def actor_balance(weights: DataFrame, cast: DataFrame) -> DataFrame:
    """Per actor: words, share, distance from an equal share, advice. Roles without an actor stand for themselves.

    ``cast`` has (actor, role, place); of several actors of a role the last counts.
    """
    of = cast.groupBy("role").agg(F.max_by("actor", "place").alias("actor"))
    actors = cast.agg(F.countDistinct("actor").alias("n"))
    mapped = weights.join(of, "role", "left").withColumn("actor", F.coalesce("actor", F.concat(F.lit("[unmapped] "), F.col("role"))))
    per = mapped.groupBy("actor").agg(F.sum("words").cast("long").alias("words"))
    whole = per.agg(F.sum("words").alias("__all"))
    per = per.crossJoin(F.broadcast(actors)).crossJoin(F.broadcast(whole)).withColumn(
        "share", F.coalesce(F.try_divide(100.0 * F.col("words"), F.col("__all")), F.lit(0.0))
    )
    equal = 100.0 / F.greatest(F.col("n"), F.lit(1))
    advice = F.when(F.col("share") > CUT_FIRST * equal, "cut first").when(F.col("share") < CUT_NEVER * equal, "hollow").otherwise("")
    return per.select("actor", "words", F.round("share", 6).alias("share"), F.round(F.col("share") - equal, 6).alias("distance"), advice.alias("advice"))


def cut_candidates(units: DataFrame, unit: str, total: Column, top: int = TOP_UNITS) -> DataFrame:
    """The heaviest units with their share of ``total``; the unit breaks ties."""
    return units.orderBy(F.desc("words"), unit).limit(top).select(unit, "words", F.round(100.0 * F.col("words") / total, 6).alias("share"), "roles")


def conflicts(present: DataFrame, cast: DataFrame, scene: str) -> DataFrame:
    """(scene, actor, roles): an actor of two roles or more that speak in one scene. ``present`` has (scene, role)."""
    played = present.join(cast, "role")
    return played.groupBy(scene, "actor").agg(F.array_sort(F.collect_set("role")).alias("r")).filter(F.size("r") > 1).select(scene, "actor", F.array_join("r", " + ").alias("roles"))


def costume_changes(present: DataFrame, cast: DataFrame, place: str, scene: str) -> DataFrame:
    """Actors whose roles differ altogether from one scene to the next; quick within an act (the first two words of a label)."""
    several = cast.groupBy("actor").agg(F.countDistinct("role").alias("n")).filter("n > 1").select("actor")
    played = present.join(cast, "role").join(several, "actor", "left_semi")
    per = played.groupBy("actor", place, scene).agg(F.array_sort(F.collect_set("role")).alias("r"))
    w = W.partitionBy("actor").orderBy(place)
    per = per.withColumns({"to_place": F.lead(place).over(w), "to_scene": F.lead(scene).over(w), "to_r": F.lead("r").over(w)})
    act = lambda c: F.slice(F.split(c, " "), F.lit(1), F.lit(2))
    changed = per.filter((F.col("to_place") == F.col(place) + 1) & ~F.arrays_overlap("r", "to_r"))
    return changed.select(
        "actor", F.col(place).alias("place"), F.array_join("r", "/").alias("roles"), F.array_join("to_r", "/").alias("next_roles"),
        (act(F.col(scene)) == act(F.col("to_scene"))).alias("quick")
    )


# The green of the heaviest scene, from white, and from where on letters are light.
DEEP, LIGHT_FROM, LIGHT, DARK = (30, 125, 60), 0.55, "#fff", "#222"


def heat(cells: DataFrame, cast: DataFrame, place: str, scene: str) -> DataFrame:
    """(actor, place, words, roles, heat, background, colour, quick): what each actor has to say in each scene, by the most of any.

    ``cells`` has (place, scene, role, words). A change is quick where the next scene is of the same act (the first two words of a
    label) and the actor plays none of the same roles in it. The most is one row; the next scene is found by its number.
    """
    of = cast.groupBy("role").agg(F.max_by("actor", "place").alias("actor"))
    played = cells.groupBy(place, scene, "role").agg(F.sum("words").alias("words")).join(of, "role")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("less"), "role")))
    per = played.groupBy("actor", place, scene).agg(F.sum("words").cast("long").alias("words"), listed.alias("r"))
    names = lambda r: F.transform(r, lambda x: x["role"])
    after = per.select("actor", (F.col(place) - 1).alias(place), F.col(scene).alias("__scene"), F.col("r").alias("__r"))
    act = lambda c: F.slice(F.split(c, " "), F.lit(1), F.lit(2))
    quick = F.coalesce(~F.arrays_overlap(names("r"), names("__r")) & (act(F.col(scene)) == act(F.col("__scene"))), F.lit(False))
    most = per.agg(F.max("words").alias("__most"))
    share = F.coalesce(F.try_divide(F.col("words"), F.col("__most")), F.lit(0.0))
    each = per.join(after, ["actor", place], "left").crossJoin(F.broadcast(most)).withColumn("heat", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    channel = [(255 + F.col("heat") * (c - 255)).cast("int").cast("string") for c in DEEP]
    said = F.array_join(F.transform("r", lambda x: F.concat(F.initcap(x["role"]), F.lit(" "), (-x["less"]).cast("string"))), " · ")
    return each.select(
        "actor", F.col(place).alias("place"), "words", said.alias("roles"), F.round("heat", 6).alias("heat"),
        F.concat(F.lit("rgb("), F.concat_ws(",", *channel), F.lit(")")).alias("background"), F.when(F.col("heat") > LIGHT_FROM, LIGHT).otherwise(DARK).alias("colour"), quick.alias("quick")
    )


def csv_field(value: Column) -> Column:
    """A field of a line of CSV: in quotes, with its own doubled, where it has a comma, a quote or a line end."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))


def presence_csv(said: DataFrame, unit: str, label: Column, role: str, roles: list[str]) -> DataFrame:
    """(unit, line): the presence of ``roles`` as lines of CSV behind the label of each unit; the header's unit is null."""
    rows = presence(said, unit, role, roles)
    labels = said.groupBy(unit).agg(F.min(label).alias("__label"))
    lines = rows.join(labels, unit).select(unit, F.concat_ws(",", csv_field(F.col("__label")), *(F.col(f"`{r}`") for r in roles)).alias("line"))
    header = said.sparkSession.range(1).select(F.lit(None).cast(said.schema[unit].dataType).alias(unit), F.concat_ws(",", *(csv_field(F.lit(r)) for r in ["Unite", *roles])).alias("line"))
    return header.unionAll(lines)
