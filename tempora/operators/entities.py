"""Entities, their tree, the command log that edits them, and undo timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ROW, with_row_index
from .graph import below, closure, until_empty
from .temporal import islands


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return below(edges, roots)


def ancestor_tags(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, tags): the names of all ancestors."""
    named = closure(edges).join(names.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    return named.groupBy("node").agg(F.sort_array(F.collect_set("name")).alias("tags"))


def visible(entities: DataFrame, zoom: float) -> DataFrame:
    return entities.where(F.col("geometry").isNotNull() & ~F.coalesce("hidden", F.lit(False)) & F.lit(zoom).between(F.coalesce("min_zoom", F.lit(0.0)), F.coalesce("max_zoom", F.lit(99.0))))


def _subtree(entities: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """The ids of an entity and all below it."""
    root = entities.sparkSession.createDataFrame([(target,)], "id string")
    return root.unionByName(below(edges, root).select(F.col("node").alias("id"))).distinct()


def set_hidden(entities: DataFrame, edges: DataFrame, target: str, hidden: bool) -> DataFrame:
    """Visibility of an entity and all below it."""
    hit = _subtree(entities, edges, target).withColumn("_hit", F.lit(True))
    return entities.join(hit, "id", "left").withColumn("hidden", F.when(F.col("_hit"), F.lit(hidden)).otherwise(F.col("hidden"))).drop("_hit")


def delete(entities: DataFrame, edges: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without one entity and all below it."""
    gone = _subtree(entities, edges, target)
    return entities.join(gone, "id", "left_anti"), edges.join(gone.withColumnRenamed("id", "child"), "child", "left_anti").join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti")


def add_member(edges: DataFrame, parent: str, child: str) -> DataFrame:
    pos = edges.where(F.col("parent") == parent).agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos"))
    return edges.where(F.col("child") != child).select("parent", "child", "pos").unionByName(pos.select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), F.col("pos").cast(edges.schema["pos"].dataType)))


def fold_commands(commands: DataFrame, fields: list[str]) -> DataFrame:
    """State (target, ts, fields) after an ordered command log (idx, target, ts, type, field, value).

    set_* writes a field of a keyframe, remove_variable empties it everywhere,
    remove_keyframe drops a keyframe, delete drops the target. A command undoes
    what stands before it, so per cell the last relevant command decides: all of
    it is one aggregate by (target, ts) and one by target.
    """
    sets, idx = commands.where("type like 'set%' or type = 'add_variable'"), F.col("idx")
    per_field = [F.max_by(F.struct("idx", "value"), F.when(F.col("field") == f, idx)).alias(f"_{f}") for f in fields]
    frames = sets.groupBy("target", "ts").agg(F.max("idx").alias("_last"), *per_field)
    cuts = commands.where("type = 'remove_keyframe'").groupBy("target", "ts").agg(F.max("idx").alias("_cut"))
    wiped = [F.max(F.when((F.col("type") == "remove_variable") & (F.col("field") == f), idx)).alias(f"_w_{f}") for f in fields]
    whole = commands.groupBy("target").agg(F.max(F.when(F.col("type") == "delete", idx)).alias("_del"), *wiped)
    out = frames.join(cuts, ["target", "ts"], "left").join(whole, "target")
    gone = F.greatest(F.coalesce("_cut", F.lit(-1)), F.coalesce("_del", F.lit(-1)))
    value = lambda f: F.when(F.col(f"_{f}.idx") > F.greatest(gone, F.coalesce(f"_w_{f}", F.lit(-1))), F.col(f"_{f}.value")).alias(f)
    return out.where(F.col("_last") > gone).select("target", "ts", *[value(f) for f in fields])


def bulk_command(ids: DataFrame, idx: int, kind: str, field: str, value: Column, ts: Column) -> DataFrame:
    """One command for many targets."""
    return ids.select(F.lit(idx).cast("bigint").alias("idx"), F.col("id").alias("target"), ts.alias("ts"), F.lit(kind).alias("type"), F.lit(field).alias("field"), value.cast("string").alias("value"))


# Timelines: actions (timeline, idx, key, payload), timelines (id, parent, parent_idx)
def lineage(actions: DataFrame, timelines: DataFrame, timeline: str) -> DataFrame:
    """All actions that lead to a timeline's end, its own after those of its ancestors up to each fork."""
    rows = timelines.select("id", "parent", F.col("parent_idx").cast("bigint").alias("parent_idx"))
    start = rows.where(F.col("id") == timeline).select("*", F.lit((1 << 63) - 1).alias("upto"), F.lit(0).alias("depth"))
    over = lambda f: f.select(F.col("parent").alias("id"), F.col("parent_idx").alias("upto"), (F.col("depth") + 1).alias("depth")).join(rows, "id").select("id", "parent", "parent_idx", "upto", "depth")
    chain = until_empty(start, over, lambda: rows.count() + 1).select(F.col("id").alias("timeline"), "upto", "depth")
    found = actions.join(chain, "timeline").where("idx <= upto")
    return with_row_index(found, F.desc("depth"), F.col("idx")).withColumn("step", F.col(ROW) + 1).drop("upto", "depth", ROW)


def action_groups(actions: DataFrame) -> DataFrame:
    return islands(actions, ["timeline"], ["idx"], "key")


def undo_target(actions: DataFrame, at: int, redo: bool = False) -> DataFrame:
    """(timeline, idx): where undo (the end of the group before) or redo (the end of the next) leads from idx `at`."""
    groups = action_groups(actions)
    here = groups.where(F.col("idx") <= at).groupBy("timeline").agg(F.max_by("group", "idx").alias("_g"))
    wanted = F.col("_g") + (1 if redo else -1)
    return groups.join(here, "timeline").where(F.col("group") == wanted).groupBy("timeline").agg(F.max("idx").alias("idx"))


def branch(actions: DataFrame, timelines: DataFrame, source: str, at: int, new: str) -> DataFrame:
    """Timelines with a new one forked off `source` after action `at`."""
    row = timelines.sparkSession.createDataFrame([(new, source, at)], "id string, parent string, parent_idx bigint")
    return timelines.select("id", "parent", F.col("parent_idx").cast("bigint").alias("parent_idx")).unionByName(row)


def truncate(actions: DataFrame, timeline: str, at: int) -> DataFrame:
    return actions.where(~((F.col("timeline") == timeline) & (F.col("idx") >= at)))


def keyframe_dates(histories: DataFrame, members: DataFrame, entity: str, ts: str) -> DataFrame:
    """Distinct times at which any of the members (id) has a keyframe."""
    return histories.join(members.select(F.col("id").alias(entity)).distinct(), entity, "left_semi").select(ts).distinct()


def geocode(wanted: DataFrame, gazetteer: DataFrame, name: str) -> DataFrame:
    """`wanted` with lat and lng of the most populous place of its name in `gazetteer` (name, lat, lng, population); [0, 0] where there is none.

    Names match without regard to case and outer blanks; unknown populations
    come last, equals by coordinates. One row a name is joined, never all hits.
    """
    key = lambda c: F.lower(F.trim(c))
    best = gazetteer.groupBy(key(F.col("name")).alias("_k")).agg(F.max_by(F.struct("lat", "lng"), F.struct(F.coalesce("population", F.lit(-1)), "lat", "lng")).alias("_p"))
    return wanted.withColumn("_k", key(F.col(name))).join(best, "_k", "left").select(*wanted.columns, *[F.coalesce(F.col(f"_p.{c}"), F.lit(0.0)).alias(c) for c in ("lat", "lng")])
