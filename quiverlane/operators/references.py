"""References to records that do not exist, were deleted before, or arrive only later.

Three steps, none of which gathers the rows of one key in one place:

1. ``earliest_references`` reduces the copies of a record to its earliest load.
2. ``key_days`` reduces the references to distinct keys per day. One join with the histories of the
   parent keys tells which of them are at fault: those without any history are ``missing`` (the
   anti-join), the others are compared with the time spans in which their key was ``late`` or
   ``deleted``. That gives *fault spans*: a key, a day, and a half-open time span in which a
   reference to the key is at fault.
3. The spans are joined back to the references on (key, day). A hot key is thereby spread over its
   days, and adaptive execution splits what is still skewed, since the join is inner and its
   output partitioning isn't used again.

Defined results: a null key is no reference, and a row without a record id can't be reported. A
reference without a time can only be ``missing``. Parents or deletions without a key or a time are
ignored. Repeated rows change nothing. Empty tables are allowed on each side. Only the named
columns are read, so others may be called anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING, LATE, DELETED = "missing", "late", "deleted"

#: The period of a reference without a time.
NO_PERIOD = "none"


#: The day of a reference without a time.
NO_DAY = -(2**31)


def period_of(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(NO_PERIOD))


def day_of(at: Column) -> Column:
    return F.coalesce(F.unix_date(F.to_date(at)), F.lit(NO_DAY))


def earliest_references(table: DataFrame, name: str, record: str, fields: Sequence[str], at: str) -> DataFrame:
    """One row per non-null foreign key of each record: ``ref_table, ref_id, ref_field, node_id, ref_time, period``.

    Records are told apart by ``record`` and reduced to their earliest ``at``. Their copies have the
    same keys; should they not, the smallest counts.
    """
    keys = table.where(F.col(record).isNotNull()).select(F.col(record).alias("ref_id"), *[F.col(f).cast("bigint").alias(f"__{f}") for f in fields], F.col(at).alias("ref_time"))
    earliest = keys.groupBy("ref_id").agg(F.min("ref_time").alias("ref_time"), *[F.min(f"__{f}").alias(f"__{f}") for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f"__{f}").alias("node_id")) for f in fields]))
    return (
        earliest.select("ref_id", "ref_time", pairs.alias("p"))
        .where("p.node_id is not null")
        .select(F.lit(name).alias("ref_table"), "ref_id", F.col("p.ref_field").alias("ref_field"), F.col("p.node_id").alias("node_id"), "ref_time", period_of(F.col("ref_time")).alias("period"))
    )


def key_days(references: DataFrame) -> DataFrame:
    """The distinct foreign keys per day with the first and last time they are referred to."""
    return references.select("node_id", day_of(F.col("ref_time")).alias("day"), "ref_time").groupBy("node_id", "day").agg(F.min("ref_time").alias("first_ref"), F.max("ref_time").alias("last_ref"))


def deletion_spans(loads: DataFrame, deletions: DataFrame) -> DataFrame:
    """The spans ``node_id, from_time, to_time`` in which a key counts as deleted.

    A span runs from a deletion to the next load that is strictly later (null: for good). The next
    load is looked up within the day of the deletion, and beyond it in the first load of each later
    day, so that no window spans the whole history of a hot key.
    """
    deaths = deletions.where("node_id is not null and at is not null").distinct()
    births = loads.join(deaths.select("node_id").distinct(), "node_id", "left_semi")
    events = births.select("node_id", "at", F.lit(True).alias("born")).unionByName(deaths.select("node_id", "at", F.lit(False).alias("born"))).withColumn("day", day_of(F.col("at")))
    # ties: a load at the time of the deletion isn't later, so it has to come first in time
    following = Window.partitionBy("node_id", "day").orderBy(F.col("at").desc(), F.col("born").asc())
    within = events.withColumn("next_in_day", F.last(F.when(F.col("born"), F.col("at")), ignorenulls=True).over(following.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    days = events.groupBy("node_id", "day").agg(F.min(F.when(F.col("born"), F.col("at"))).alias("first_born"))
    later = Window.partitionBy("node_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("node_id", "day", F.min("first_born").over(later).alias("next_day"))
    return (
        within.where("not born")
        .join(days, ["node_id", "day"])
        .select("node_id", F.col("at").alias("from_time"), F.coalesce("next_in_day", "next_day").alias("to_time"))
        .groupBy("node_id", "to_time")
        .agg(F.min("from_time").alias("from_time"))
    )


def histories(loads: DataFrame, deletions: DataFrame) -> DataFrame:
    """``node_id, fate, from_time, to_time`` of all parent keys; null bounds are open, spans of a key don't overlap.

    Each key has one span before its first load, and one per deletion after it.
    """
    loads = loads.where("node_id is not null and at is not null")
    parents = loads.groupBy("node_id").agg(F.min("at").alias("first_load"))
    before = parents.select("node_id", F.lit(LATE).alias("fate"), F.lit(None).cast("timestamp_ntz").alias("from_time"), F.col("first_load").cast("timestamp_ntz").alias("to_time"))
    # before its first load a node is late, whatever was deleted then
    spans = deletion_spans(loads, deletions).join(parents, "node_id").select("node_id", F.lit(DELETED).alias("fate"), F.greatest("from_time", "first_load").cast("timestamp_ntz").alias("from_time"), F.col("to_time").cast("timestamp_ntz"))
    return before.unionByName(spans.where("to_time is null or from_time < to_time"))


def fault_spans(keys: DataFrame, loads: DataFrame, deletions: DataFrame) -> DataFrame:
    """``node_id, day, fate, from_time, to_time`` of the keys' days that have references at fault."""
    joined = keys.join(histories(loads, deletions), "node_id", "left").withColumn("fate", F.coalesce("fate", F.lit(MISSING)))
    met = "fate = 'missing' or (from_time is null or from_time <= last_ref) and (to_time is null or to_time > first_ref)"
    return joined.where(met).select("node_id", "day", "fate", "from_time", "to_time")


def orphan_references(references: DataFrame, loads: DataFrame, deletions: DataFrame) -> DataFrame:
    """The references at fault: ``ref_table, ref_id, ref_field, period, fate``.

    ``references`` as of :func:`earliest_references` (several may be united); ``loads`` and
    ``deletions`` are ``node_id, at``.
    """
    spans = fault_spans(key_days(references), loads, deletions).alias("s")
    held = (F.col("s.fate") == MISSING) | ((F.col("s.from_time").isNull() | (F.col("r.ref_time") >= F.col("s.from_time"))) & (F.col("s.to_time").isNull() | (F.col("r.ref_time") < F.col("s.to_time"))) & F.col("r.ref_time").isNotNull())
    on = (F.col("r.node_id") == F.col("s.node_id")) & (F.col("r.day") == F.col("s.day")) & held
    rows = references.withColumn("day", day_of(F.col("ref_time"))).alias("r")
    return rows.join(spans, on).select("r.ref_table", "r.ref_id", "r.ref_field", "r.period", "s.fate")


def orphan_counts(references: DataFrame, loads: DataFrame, deletions: DataFrame) -> DataFrame:
    """``ref_table, ref_field, period, fate, n_references`` of the references at fault."""
    return orphan_references(references, loads, deletions).groupBy("ref_table", "ref_field", "period", "fate").agg(F.count(F.lit(1)).alias("n_references"))
