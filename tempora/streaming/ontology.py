"""The ontology log: text lines `<id> <json>`, snapshots kept as reverse differences, and its streaming form."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import MapType, StringType, StructField, StructType

from ..functions.maps import negative_difference

EVENT = "date bigint, type string, data map<string,string>"


def encode(events: DataFrame) -> DataFrame:
    """value, day: one log line per event (id, date in ms, type, data), days as yyyy.MM.dd."""
    body = F.to_json(F.struct("date", "type", "data"))
    return events.select(F.concat_ws(" ", "id", body).alias("value"), F.date_format(F.timestamp_millis("date"), "yyyy.MM.dd").alias("day"))


def decode(lines: DataFrame) -> DataFrame:
    """(id, date, type, data) of log lines; lines that are no entry are left out."""
    out = lines.select(F.regexp_extract("value", r"^(\S+) (\{.*\})\s*$", 1).alias("id"), F.from_json(F.regexp_extract("value", r"^(\S+) (\{.*\})\s*$", 2), EVENT).alias("e"))
    return out.where("id <> '' and e.date is not null").select("id", "e.*")


def append(events: DataFrame, path: str) -> None:
    encode(events).write.mode("append").partitionBy("day").text(path)


def _merged(events: DataFrame) -> DataFrame:
    """One event per (id, date): the data of events at one time laid over each other in order of type, then data; the last type stays."""
    one = F.sort_array(F.collect_list(F.struct(F.coalesce("type", F.lit("")).alias("kind"), F.sort_array(F.map_entries("data")).alias("entries"))))
    none = F.create_map().cast("map<string,string>")
    data = F.aggregate("_all", none, lambda m, e: F.map_concat(m, F.coalesce(F.map_from_entries(e["entries"]), none)))  # later keys win
    return events.groupBy("id", "date").agg(one.alias("_all")).select("id", "date", F.element_at("_all", -1)["kind"].alias("type"), data.alias("data"))


def _folded(df: DataFrame, source: str, *order: Column) -> DataFrame:
    """df with `state`: the maps in `source` of each id laid one over the other in order, null values deleting their keys.

    Rows stream through the task that owns their id, sorted, with one state held
    at a time, so neither a long history nor a common id is gathered.
    """

    def run(batches):
        current, state = object(), {}
        for batch in batches:
            states = []
            for key, entries in zip(batch.column("id").to_pylist(), batch.column(source).to_pylist(), strict=True):
                if key != current:
                    current, state = key, {}
                for k, v in entries or ():
                    if v is None:
                        state.pop(k, None)
                    else:
                        state[k] = v
                states.append(list(state.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.map_(pa.string(), pa.string()))], names=[*batch.schema.names, "state"])

    rows = df.select(*[c for c in df.columns if c != "state"])
    schema = StructType([*rows.schema.fields, StructField("state", MapType(StringType(), StringType()))])
    return rows.repartition("id").sortWithinPartitions("id", *order).mapInArrow(run, schema)


def snapshots(events: DataFrame) -> DataFrame:
    """Each event with the whole state after it: later keys win, null values delete."""
    return _folded(_merged(events), "data", F.col("date"))


def reverse_differences(states: DataFrame) -> DataFrame:
    """The newest state whole, each earlier one as what turns the next one back into it."""
    w = Window.partitionBy("id").orderBy("date")
    following = F.lead("state").over(w)
    return states.withColumn("stored", F.when(following.isNull(), F.col("state")).otherwise(negative_difference(F.col("state"), following))).withColumn("is_head", following.isNull())


def resolve(stored: DataFrame) -> DataFrame:
    """States back from reverse differences: from the newest, differences laid over one after the other."""
    return _folded(stored, "stored", F.desc("date"))


def state_at(states: DataFrame, when: Column) -> DataFrame:
    return states.where(F.col("date") <= when).groupBy("id").agg(F.max_by("state", "date").alias("state"))


def states_at(events: DataFrame, when: Column) -> DataFrame:
    """The state of each id at one time, straight from its events: the last value of each key, null ones left out; no history is built."""
    gone = events.where(F.col("date") <= when)
    order = F.struct("date", F.coalesce("type", F.lit("")), F.sort_array(F.map_entries("data")))
    last = gone.withColumn("_at", order).select("id", "_at", F.explode_outer("data").alias("k", "v")).groupBy("id", "k").agg(F.max_by(F.struct("v"), "_at").alias("v"))
    kept = F.filter(F.collect_list(F.struct("k", "v.v")), lambda e: e["v"].isNotNull())
    return last.groupBy("id").agg(F.map_from_entries(kept).alias("state"))  # one entry a key of the id


def nearest_keyframe(states: DataFrame, when: Column) -> DataFrame:
    """Per id the date nearest to `when`, the earlier of equals."""
    return states.groupBy("id").agg(F.min_by("date", F.struct(F.abs(F.col("date") - when), F.col("date"))).alias("date"))


def delete_keyframes(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events without those of `gone` (id, date). Differences are built from states, so what follows is re-delta'd when it is stored next."""
    return events.join(gone.select("id", "date"), ["id", "date"], "left_anti")


def move_keyframes(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Events re-dated by `moves` (id, date, to); where the new time has an event already, both are merged by `snapshots`."""
    return events.join(moves.select("id", "date", "to"), ["id", "date"], "left").withColumn("date", F.coalesce("to", "date")).select(events.columns)


def between(states: DataFrame, start: int, end: int) -> DataFrame:
    return states.where(F.col("date").between(start, end))


def apply_mutations(current: Column, set_: Column, add: Column, remove: Column) -> Column:
    """An array of tags or relation ids: replaced by `set_` if given, then joined with `add`, then without `remove`."""
    empty = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(set_, current, empty), F.coalesce(add, empty)), F.coalesce(remove, empty))


def fresh(events: DataFrame, now_ms: Column, hours: int = 48) -> DataFrame:
    """Point events not older than the limit; other events whatever their age."""
    return events.where((F.col("type") != "point") | (now_ms - F.col("date") <= hours * 3_600_000))


def first_seen(events: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The first event of each key."""
    return events.groupBy(*key).agg(F.min_by(F.struct("*"), F.col(ts)).alias("e")).select("e.*")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Entries as they are appended, new files first."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "true").option("recursiveFileLookup", "true").schema("value string").text(path)
    return decode(lines)


def deduplicated(stream: DataFrame, key: str = "id", delay: str = "48 hours") -> DataFrame:
    """Each key once within the delay, which bounds the state."""
    return stream.withColumn("at", F.timestamp_millis("date")).withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def hydrate(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch to `merge`; until the log is drained, or again and again at an interval."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_states(stream: DataFrame) -> DataFrame:
    """Running state per id for update or complete mode: the newest entry and how many there were."""
    return stream.groupBy("id").agg(F.max("date").alias("date"), F.max_by("data", "date").alias("data"), F.count("*").alias("n"))


def job_status(query: StreamingQuery) -> dict:
    """idle, running or failed, with rows and seconds of the last batch."""
    last = query.lastProgress or {}
    error = query.exception()
    return {"status": "failed" if error else "running" if query.isActive else "idle", "batch": last.get("batchId"), "rows": last.get("numInputRows"), "seconds": (last.get("batchDuration") or 0) / 1000, "error": str(error) if error else None}
