"""Splits that keep related records together (problem 3).

Records that name a common source id within one language, directly or through others, form a
component. A persisted table has one row for each record and each key (language, source id)
seen so far, with its component and the component's split. A new delivery is linked to it
through its keys and its own record numbers; components that it joins are merged by pointer
jumping, and then: a component that had one split keeps it, one that had several is
*quarantined* (its records get no split until someone decides), and new components fill the
largest deficits against the wanted proportions.

A component is named after its smallest record when it is made, keeps the name, and takes the
smallest one when several are merged. A delivery that was seen before changes nothing.

Defined results: languages and ids are compared without case and surrounding blanks. Null, blank
and placeholder ids join nothing, nor does a record whose language is null or blank; such a record
is a component of its own. Null and empty arrays give a component of one record. A record delivered again
(same ``rec_no``), in one delivery or in several, counts once. A record without a number belongs
to nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components, group_by_shared_keys
from ..session import cut
from .tokens import NO_LABEL

#: Wanted proportions of the records.
PROPORTIONS = {"train": 0.9, "validation": 0.05, "test": 0.05}
#: Spellings of a split in older assignments.
SPLIT_NAMES = {"train": "train", "validation": "validation", "dev": "validation", "test": "test"}


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _plain_text(s: str) -> str:
    return s.strip().lower()


def record_keys(df: DataFrame, id_col: str = "rec_no", ids_col: str = "source_ids", lang_col: str = "language") -> DataFrame:
    """``(rec, key)``: one row for each record and usable source id; the key holds the language."""
    lang = _plain(F.col(lang_col))
    return (
        df.select(F.col(id_col).alias("rec"), lang.alias("lang"), F.explode(ids_col).alias("sid"))
        .withColumn("sid", _plain(F.col("sid")))
        .where(F.col("sid").isNotNull() & ~F.col("sid").isin(NO_LABEL) & F.col("lang").isNotNull() & (F.col("lang") != ""))
        .select("rec", F.concat_ws("\u0001", "lang", "sid").alias("key"))
        .distinct()
    )


def related_pairs(df: DataFrame, **columns: str) -> DataFrame:
    """``(rec_a, rec_b)``: of every component the smallest record with each other one."""
    return (
        group_by_shared_keys(record_keys(df, **columns)).where("rec <> root").select(F.col("root").alias("rec_a"), F.col("rec").alias("rec_b"))
    )


#: Ranges along which new components are laid; a table of so many rows is broadcast.
RANGES = 4096
QUARANTINED = "quarantined"


def _fill(sizes: DataFrame, taken: dict[str, float], proportions: dict[str, float]) -> DataFrame:
    """``(component, split)``: components laid along the deficits of the splits.

    Components are taken by a hash of their name; running totals over hash ranges (a fixed
    number of them) and within each range give every component its place on a line of all
    records, on which each split owns a stretch as long as its deficit. A component belongs to
    the split that owns its middle. No task sees more than one range.
    """
    placed = sizes.withColumn("h", F.pmod(F.xxhash64("component"), F.lit(RANGES)))
    by_range = {r["h"]: r["n"] for r in placed.groupBy("h").agg(F.sum("n").alias("n")).collect()}  # at most RANGES rows
    total_new = float(sum(by_range.values()))
    want = sum(proportions.values())
    total = total_new + sum(taken.values())
    deficit = {s: max(0.0, p / want * total - taken.get(s, 0.0)) for s, p in proportions.items()}
    scale = total_new / sum(deficit.values()) if sum(deficit.values()) > 0 else 0.0
    ends, run = [], 0.0
    for s, d in deficit.items():
        run += d * scale
        ends.append((s, run))
    starts, at = [], 0.0
    for h in sorted(by_range):
        starts.append((h, at))
        at += by_range[h]
    starts = sizes.sparkSession.createDataFrame(starts, "h bigint, start double")
    w = Window.partitionBy("h").orderBy(F.xxhash64(F.col("component"), F.lit(1)), "component")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.col("start") + before + F.col("n") / 2
    split = F.lit(ends[-1][0])
    for s, end in reversed(ends[:-1]):
        split = F.when(F.col("middle") < end, F.lit(s)).otherwise(split)
    return placed.join(F.broadcast(starts), "h").withColumn("middle", middle).select("component", split.alias("filled"))


def _record_node(c: str) -> Column:
    return F.concat(F.lit("r"), F.lpad(F.col(c).cast("string"), 20, "0"))


STATE = "node string, component string, split string, status string, n_records bigint"


def assign_splits(
    df: DataFrame,
    known: DataFrame | None = None,
    proportions: dict[str, float] | None = None,
    id_col: str = "rec_no",
    ids_col: str = "source_ids",
    lang_col: str = "language",
    split_col: str | None = "split",
) -> tuple[DataFrame, DataFrame]:
    """Splits of a delivery, and the table to persist for the next one.

    ``known`` is the table that the last call returned, ``(node, component, split, status,
    n_records)`` with a node for each record (``r`` and its number) and key (``k`` and its text).
    ``split_col`` is an older assignment of the records themselves; it counts like a persisted
    split. It may use the names in ``proportions`` and those in :data:`SPLIT_NAMES`.

    Returns ``(rec, component, split, status)`` with status ``kept``, ``new`` or
    ``quarantined`` (split null), and the new table.
    """
    proportions = proportions or PROPORTIONS
    spark = df.sparkSession
    known = spark.createDataFrame([], STATE) if known is None else known
    spelling = SPLIT_NAMES | {_plain_text(s): s for s in proportions}
    names = F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv])
    keys = cut(record_keys(df, id_col, ids_col, lang_col).where("rec is not null").select(_record_node("rec").alias("node"), F.concat(F.lit("k"), "key").alias("key")))
    old = names[_plain(F.col(split_col))] if split_col else F.lit(None).cast("string")
    recs = cut(df.select(F.col(id_col).alias("rec"), old.alias("old")).where("rec is not null").groupBy("rec").agg(F.min("old").alias("low"), F.max("old").alias("high")).withColumn("node", _record_node("rec")))

    # links: records of one key to its smallest record, and records to the components that know them or their keys
    delivered = recs.select("node").unionByName(keys.select(F.col("key").alias("node")).distinct())
    seen = cut(known.join(delivered, "node", "left_semi").select("node", F.concat(F.lit("c"), "component").alias("known")))
    hub = keys.groupBy("key").agg(F.min("node").alias("v"))
    links = (
        keys.join(hub.hint("merge"), "key").select(F.col("node").alias("u"), "v").where("u <> v")
        .unionByName(hub.join(seen, F.col("key") == F.col("node")).select(F.col("v").alias("u"), F.col("known").alias("v")))
        .unionByName(recs.join(seen, "node").select(F.col("node").alias("u"), F.col("known").alias("v")))
    )
    rooted = components(links.distinct())
    # a component's name sorts before a record's, so it is the root where there is one
    name = F.when(F.col("root").startswith("c"), F.substring("root", 2, 1 << 30)).otherwise(F.col("root"))
    of_record = cut(recs.join(rooted, "node", "left").select("node", "rec", "low", "high", F.when(F.col("root").isNull(), F.col("node")).otherwise(name).alias("component")))
    touched = seen.select(F.col("known").alias("node")).distinct().join(rooted, "node", "left").select(F.substring("node", 2, 1 << 30).alias("was"), F.when(F.col("root").isNull(), F.substring("node", 2, 1 << 30)).otherwise(name).alias("component"))
    touched = cut(touched)

    # membership of everything seen so far
    moved = known.join(touched, known["component"] == touched["was"], "left").select("node", F.coalesce(touched["component"], known["component"]).alias("component"), "split", "status")
    of_key = hub.join(of_record.select(F.col("node").alias("v"), "component"), "v").select(F.col("key").alias("node"), "component")
    fresh = of_record.select("node", "component").unionByName(of_key).join(seen, "node", "left_anti")
    nothing = F.lit(None).cast("string")
    members = cut(moved.unionByName(fresh.select("node", "component", nothing.alias("split"), nothing.alias("status"))))

    # what each component was told: by its rows in the table, and by older assignments of this delivery
    told = members.select("component", F.col("split").alias("low"), F.col("split").alias("high"), (F.col("status") == QUARANTINED).alias("apart"), F.col("node").startswith("r").cast("bigint").alias("n"))
    told = told.unionByName(of_record.select("component", "low", "high", F.lit(False).alias("apart"), F.lit(0).cast("bigint").alias("n")))
    comps = told.groupBy("component").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("apart").alias("apart"))
    apart = F.coalesce("apart", F.lit(False)) | (F.col("low") != F.col("high"))
    status = F.when(F.coalesce(apart, F.lit(False)), QUARANTINED).when(F.col("low").isNull(), "new").otherwise("kept")
    comps = cut(comps.select("component", "n", status.alias("status"), F.when(status == "kept", F.col("low")).alias("split")))
    taken = {r["split"]: float(r["n"]) for r in comps.where("status = 'kept'").groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row a split
    filled = _fill(comps.where("status = 'new'").select("component", "n"), taken, proportions)
    settled = cut(comps.join(filled, "component", "left").select("component", F.coalesce("split", "filled").alias("split"), "status", F.col("n").alias("n_records")))
    out = of_record.select("rec", "component").join(settled.hint("merge"), "component").select("rec", "component", "split", "status")
    return out, members.select("node", "component").join(settled.hint("merge"), "component").select("node", "component", "split", "status", "n_records")
