"""Group reading: flattened plays, contents, readers and slots, pages of long speeches, session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstage.functions import text as X

#: A page of a speech may end at a line end from this part of its quota on, and must before the other.
SOFT, HARD = 0.6, 1.4


def flattened(elements: DataFrame) -> DataFrame:
    """Elements with a scene row before the first of every unit that has a title: (piece, position, kind, text, people)."""
    head = F.struct(
        F.lit(-1).alias("elem_pos"), F.lit("scene").alias("kind"), F.concat_ws(" - ", "act", "scene").alias("text"),
        F.lit(None).cast("array<string>").alias("people")
    )
    row = F.struct("elem_pos", F.col("type").alias("kind"), "text", "people")
    # keyed by play first, so that both steps share one shuffle
    kept = elements.repartition("piece").withColumn("__first", F.row_number().over(W.partitionBy("piece", "unit_pos", "act", "scene", "implicit").orderBy("elem_pos")) == 1)
    both = F.when(F.col("__first") & ~F.col("implicit"), F.array(head, row)).otherwise(F.array(row))
    rows = kept.select("piece", "unit_pos", F.explode(both).alias("r")).select("piece", "unit_pos", "r.*")
    order = W.partitionBy("piece").orderBy("unit_pos", "elem_pos")
    return rows.withColumn("position", F.row_number().over(order) - 1).select("piece", "kind", "text", "people", "position")


def with_scene(flat: DataFrame) -> DataFrame:
    """As of every row the last scene row at or before it."""
    upto = W.partitionBy("piece").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return flat.withColumn("scene", F.last(F.when(F.col("kind") == "scene", F.col("text")), ignorenulls=True).over(upto))


def unassigned(people: DataFrame, slots: DataFrame, name: str) -> DataFrame:
    """Characters without a slot."""
    return people.select(name).distinct().join(slots, name, "left_anti")


def roles_by_slot(slots: DataFrame, name: str, slot: str) -> DataFrame:
    return slots.groupBy(slot).agg(F.array_sort(F.collect_set(name)).alias("roles"))


def hues(people: DataFrame, name: str) -> DataFrame:
    """A hue for each character, evenly around the circle in order of names; a cast is small by nature."""
    whole = W.partitionBy()
    return people.select(name, F.round(360.0 * (F.row_number().over(W.orderBy(name)) - 1) / F.count("*").over(whole), 6).alias("hue"))


def speech_pages(speeches: DataFrame, key: list[str], text: str, quota: int) -> DataFrame:
    """Pages of speeches by lines: a page is closed at the end of a line from SOFT of the quota on, and before it passes HARD.

    A fold over the lines of one speech: the state are the size of the open page, the number of the line and the lines at
    which pages turn, so it grows with the pages alone. Every line stays, without a shuffle; a null text has no pages.
    """
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("turns"))

    def step(state: Column, line: Column) -> Column:
        n = F.length(line) + 1
        turn = (state["size"] > 0) & ((state["size"] >= SOFT * quota) | (state["size"] + n > HARD * quota))
        return F.struct(
            F.when(turn, n).otherwise(state["size"] + n).alias("size"), (state["line"] + 1).alias("line"),
            F.when(turn, F.concat(state["turns"], F.array(state["line"]))).otherwise(state["turns"]).alias("turns")
        )

    rows = speeches.select(*key, F.split(text, "\n", -1).alias("__lines"))
    rows = rows.withColumn("__turns", F.aggregate("__lines", start, step, lambda s: s["turns"]))
    firsts, ends = F.concat(F.array(F.lit(0)), "__turns"), F.concat("__turns", F.array(F.size("__lines")))
    pages = F.zip_with(firsts, ends, lambda a, b: F.array_join(F.slice("__lines", a + 1, b - a), "\n"))
    return rows.select(*key, F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def page_groups(pages: DataFrame, doc: str, order: str, id_: str) -> DataFrame:
    """Consecutive rows of the same id as one: first and last place."""
    w = W.partitionBy(doc).orderBy(order)
    runs = pages.withColumn("__new", (~F.col(id_).eqNullSafe(F.lag(id_).over(w))).cast("int")).withColumn(
        "__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    return runs.groupBy(doc, "__run", id_).agg(F.min(order).alias("first_place"), F.max(order).alias("last_place")).drop("__run")


def off_scene(flat: DataFrame, forward: bool = True) -> DataFrame:
    """For every row the nearest one in the direction of reading that is no scene row, itself included."""
    w = W.partitionBy("piece").orderBy(F.desc("position") if forward else "position").rowsBetween(W.unboundedPreceding, 0)
    return flat.withColumn("target", F.last(F.when(F.col("kind") != "scene", F.col("position")), ignorenulls=True).over(w))


def reader_label(name: Column, reader: Column) -> Column:
    shown = F.initcap(F.lower(name))
    return F.when(reader.isNotNull(), F.concat(shown, F.lit(" ("), reader, F.lit(")"))).otherwise(shown)


def latest(messages: DataFrame, key: str, at: str) -> DataFrame:
    """The last message of each channel, for who comes late."""
    rest = [c for c in messages.columns if c not in (key, at)]
    return messages.groupBy(key).agg(F.max_by(F.struct(at, *rest), F.struct(at, *rest)).alias("m")).select(key, "m.*")


def piece_slug(title: Column) -> Column:
    return F.regexp_replace(X.strip_accents(F.lower(title)), " ", "-")


def roles_changed(old: Column, new: Column, active: Column) -> Column:
    """Active roles after a change of mine: those kept that were active, then those that came."""
    return F.array_distinct(F.concat(F.array_intersect(active, new), F.array_except(new, old)))


def outsiders(active: Column, mine: Column) -> Column:
    """Active roles that are none of mine, in their order; such a change is refused."""
    return F.array_except(active, mine)


def restored_roles(stored: DataFrame, cast: DataFrame, key: str, role: str) -> DataFrame:
    """(key, roles): the stored roles that the cast still has, in order of names; null where none is left."""
    left = stored.join(cast.select(key, role).distinct(), [key, role], "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    return stored.select(key).distinct().join(left, key, "left")


def session_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """State of rehearsal sessions after their events (action, argument): mode, revealed ids by when they were revealed, number of draws, place.

    What an id's last event since the last change of mode says, holds; nothing but the revealed ids of a session is gathered.
    """
    a, x = F.col("action"), F.col("argument")
    last = lambda kind: F.max_by(F.when(a == kind, x), F.when(a == kind, F.col(order)))
    cleared = F.max(F.when(a.isin("mask_all", "mode"), F.col(order)))
    whole = events.groupBy(key).agg(
        F.coalesce(last("mode"), F.lit("lecture")).alias("mode"), F.count_if(a == "draw").cast("int").alias("draws"),
        last("go").alias("place"), cleared.alias("__cleared")
    )
    shown = events.filter(a.isin("reveal", "hide")).join(whole.select(key, "__cleared"), key).filter(F.coalesce(F.col(order) > F.col("__cleared"), F.lit(True)))
    per = shown.groupBy(key, "argument").agg(
        F.max_by("action", order).alias("now"), F.max(F.when(a == "hide", F.col(order))).alias("__hid"),
        F.sort_array(F.collect_set(F.when(a == "reveal", F.col(order)))).alias("__when")
    )
    first = F.get(F.filter("__when", lambda t: F.coalesce(t > F.col("__hid"), F.lit(True))), F.lit(0))
    listed = per.filter("now = 'reveal'").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(first.alias("t"), "argument"))), lambda s: s["argument"]).alias("revealed")
    )
    return whole.join(listed, key, "left").select(key, "mode", F.coalesce("revealed", F.array().cast("array<string>")).alias("revealed"), "draws", "place")


def settings(text: Column, defaults: dict[str, int]) -> Column:
    """Settings from stored JSON, field by field; what is missing or no number has its default."""
    return F.struct(*[F.coalesce(F.get_json_object(text, f"$.{k}").try_cast("int"), F.lit(v)).alias(k) for k, v in defaults.items()])
