"""References to records that do not exist (problem 4).

A reference holds if a parent row with its key is in force at its time: valid_from <= at and (valid_to is
null or at < valid_to). All others are orphans, by cause:

* ``missing``: no parent with the key, at any time,
* ``deleted``: a parent was in force before, none is now,
* ``late``: the key's first parent comes after the reference.

Method: references and the begin and end events of the parents' validity intervals are brought together
by (key, salt) and sorted by time, and the two sorted streams are merged linearly: a running sum of
begins and ends is the number of parents in force. References are counted by key first: those of a key with more than ``hot`` are spread
by their id over as many salts as it takes, and only its parents' events are repeated for each. No side is broadcast and neither has to fit a task.

Defined cases: parents with a null key, a null valid_from or an empty interval are never in force;
references with a null key are none; a reference with a null time is an orphan unless its key has no
parent at all (``missing``), in which case it is that: its cause is ``undated``. Repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import HOT


def orphans(references: DataFrame, parents: DataFrame, *, key: str, at: str, spread: Column, valid_from: str, valid_to: str, parent_key: str | None = None, hot: int = HOT) -> DataFrame:
    """The rows of ``references`` without a parent in force, with their ``orphan_cause``.

    ``spread`` is an expression over the references (a row id) that spreads equal keys over the salts.
    All columns of ``references`` are kept, whatever their names.
    """
    pk = parent_key or key
    live = parents.where(F.col(pk).isNotNull() & F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from))))
    few = references.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {int(hot)} and _key is not null").select("_key", F.ceil(F.col("_n") / F.lit(hot)).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    events = live.select(
        F.col(pk).alias("_key"),
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col(valid_from).alias("_at"), F.lit(1).alias("_step")),
                    F.when(F.col(valid_to).isNotNull(), F.struct(F.col(valid_to).alias("_at"), F.lit(-1).alias("_step"))),
                )
            )
        ).alias("_e"),
    ).select("_key", "_e._at", "_e._step")
    edges = events.join(few, "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    row = F.struct(*[F.col(f"`{c}`") for c in references.columns])
    named = references.select(row.alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.xxhash64(spread).alias("_hash")).where("_key is not null")
    refs = named.join(few, "_key", "left").withColumn("_salt", F.pmod("_hash", salts).cast("int")).drop("_salts", "_hash")
    both = refs.withColumn("_step", F.lit(None).cast("int")).unionByName(edges.withColumn("_row", F.lit(None).cast(refs.schema["_row"].dataType)))
    stream = Window.partitionBy("_key", "_salt").orderBy("_at", F.col("_step").isNull())
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumns({"_open": F.coalesce(F.sum("_step").over(so_far), F.lit(0)), "_begun": F.count_if(F.col("_step") == 1).over(so_far)})
    # a key is later registered if an event follows a reference that saw none; the reversed stream tells
    back = Window.partitionBy("_key", "_salt").orderBy(F.col("_at").desc(), F.col("_step").isNotNull())
    merged = merged.withColumn("_to_come", F.count_if(F.col("_step") == 1).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cause = (
        F.when((F.col("_begun") == 0) & (F.col("_to_come") == 0), "missing")
        .when(F.col("_at").isNull(), "undated")
        .when(F.col("_begun") > 0, "deleted")
        .otherwise("late")
    )
    found = merged.where(F.col("_step").isNull() & ((F.col("_open") <= 0) | F.col("_at").isNull()))
    return found.select("_row.*", cause.alias("orphan_cause"))


def orphan_report(found: DataFrame, *, table: str = "table_name", period: str = "period") -> DataFrame:
    """Orphans by table, period and cause, with the number of different keys."""
    return found.groupBy(table, period, "orphan_cause").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("source_id").alias("keys"))


_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def source_references(bundles: DataFrame, allocation: DataFrame, status: DataFrame) -> DataFrame:
    """All references to sources as ``table_name, record_id, source_id, recorded_at``; one row for each record and id."""

    def clean(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, _BLANKS, ""))

    lists = bundles.select(F.lit("bundle_registry").alias("table_name"), "record_id", "recorded_at", F.explode(F.array_distinct(F.transform(F.split("primary_sources", r"\|"), clean))).alias("source_id"))
    single = [t.select(F.lit(n).alias("table_name"), "record_id", "recorded_at", clean(F.col("source_id")).alias("source_id")) for n, t in (("source_allocation", allocation), ("source_status", status))]
    return lists.unionByName(single[0]).unionByName(single[1]).where("source_id is not null and source_id <> ''")
