"""References to records that do not exist: direct orphans, and those that inherit from them.

The foreign-key graph is a list of ``ForeignKey`` edges between ``Records`` (tables reduced to one row
per record). A reference is a *direct* orphan if its target is missing, was deleted before the
reference was made, or came only later. A record that refers to a record with an orphaned reference is
itself an *inherited* orphan, and so on down the graph, to the fixpoint.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.joins import salted_join
from sievemark.operators.records import first_delivery, present
from sievemark.session import durable


@dataclass(frozen=True)
class Records:
    """A table of deliveries: ``key`` names the record, ``arrived`` its arrival, ``deleted`` (or None) its deletion."""

    name: str
    df: DataFrame
    key: str
    arrived: str
    deleted: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` refers to the key of ``parent``. ``at`` is the column with the time of the reference;
    with ``first`` set, the child's first delivery (by its arrival) counts, else its deliveries are alike."""

    child: str
    field: str
    parent: str
    at: str
    first: bool = False


def references(tables: dict[str, Records], edges: list[ForeignKey]) -> DataFrame:
    """``(table_name, field_name, record_id, ref_key, parent_name, ref_at)`` of every reference with a key.

    Null and empty keys refer to nothing. Repeated deliveries of a child stay repeated here.
    """
    out = []
    for e in edges:
        t = tables[e.child]
        src = first_delivery(t.df, t.key, t.arrived, e.field) if e.first else t.df.select(t.key, e.field, e.at)
        out.append(
            src.where(present(F.col(e.field)) & F.col(t.key).isNotNull()).select(
                F.lit(e.child).alias("table_name"), F.lit(e.field).alias("field_name"), F.col(t.key).alias("record_id"),
                F.col(e.field).alias("ref_key"), F.lit(e.parent).alias("parent_name"), F.col(e.at).alias("ref_at"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def lifetimes(tables: dict[str, Records], names: list[str]) -> DataFrame:
    """``(parent_name, ref_key, first_at, deleted_at)``: when each record came, and its earliest deletion."""
    out = []
    for n in names:
        t = tables[n]
        gone = F.min(t.deleted) if t.deleted else F.lit(None).cast(dict(t.df.dtypes)[t.arrived])
        g = t.df.where(F.col(t.key).isNotNull()).groupBy(t.key).agg(F.min(t.arrived).alias("first_at"), gone.alias("deleted_at"))
        out.append(g.select(F.lit(n).alias("parent_name"), F.col(t.key).alias("ref_key"), "first_at", "deleted_at", F.lit(True).alias("_there")))
    return reduce(DataFrame.unionByName, out)


def direct_orphans(tables: dict[str, Records], edges: list[ForeignKey]) -> DataFrame:
    """One row per record and reference that is a direct orphan:
    ``(table_name, field_name, record_id, ref_key, orphan_kind, period_month)``.

    ``orphan_kind`` is ``missing``, ``deleted`` (a deletion at or before the reference) or ``late`` (first
    arrival after it), the first that applies. Keys are compared character by character. A reference
    without a time can only be ``missing``, and its month is null.
    """
    refs = references(tables, edges)
    life = lifetimes(tables, sorted({e.parent for e in edges}))
    joined = salted_join(refs, life, ["parent_name", "ref_key"], spread=F.col("record_id"))
    kind = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("deleted_at") <= F.col("ref_at"), "deleted")
        .when(F.col("first_at") > F.col("ref_at"), "late")
    )
    return (
        joined.withColumn("orphan_kind", kind)
        .where(F.col("orphan_kind").isNotNull())
        .select("table_name", "field_name", "record_id", "ref_key", "orphan_kind", F.substring(F.col("ref_at").cast("string"), 1, 7).alias("period_month"))
        .distinct()
    )


def _depth(edges: list[ForeignKey]) -> int | None:
    """The number of edges on the longest path down the graph of tables; None if it has a cycle."""
    level = {t: 0 for e in edges for t in (e.child, e.parent)}
    for _ in level:
        changed = False
        for e in edges:
            if level[e.child] < level[e.parent] + 1:
                level[e.child] = level[e.parent] + 1
                changed = True
        if not changed:
            return max(level.values())
    return None


def orphan_cascade(tables: dict[str, Records], edges: list[ForeignKey]) -> DataFrame:
    """Direct orphans and all that inherit from them, one row per record and reference.

    Columns of ``direct_orphans`` plus ``orphan_class`` (``direct`` or ``inherited``) and ``steps``, the
    length of the shortest way to a direct orphan (0 for a direct one). The kind of an inherited orphan is
    ``inherited``. A reference that is a direct orphan is not repeated as an inherited one.

    Each round joins the newly orphaned records with the references to them (a semi-join down the graph).
    In a graph of tables without cycles the number of rounds is known and the plan stays lazy; with
    cycles the rounds go on until nothing new is found, each written to the shared folder.
    """
    direct = direct_orphans(tables, edges).withColumns({"orphan_class": F.lit("direct"), "steps": F.lit(0)})
    rounds = _depth(edges)
    if rounds is None:
        direct = durable(direct, "orphans")
    refs = references(tables, edges).select("table_name", "field_name", "record_id", "ref_key", "parent_name", F.substring(F.col("ref_at").cast("string"), 1, 7).alias("period_month")).distinct()
    known, frontier, step = direct, direct, 0
    while rounds is None or step < rounds - 1:
        step += 1
        bad = frontier.select(F.col("table_name").alias("parent_name"), F.col("record_id").alias("ref_key")).distinct()
        hit = salted_join(refs, bad, ["parent_name", "ref_key"], spread=F.col("record_id"), how="inner")
        new = (
            hit.join(known, ["table_name", "field_name", "record_id", "ref_key"], "left_anti")
            .withColumns({"orphan_kind": F.lit("inherited"), "orphan_class": F.lit("inherited"), "steps": F.lit(step)})
            .select(known.columns)
        )
        if rounds is None:
            new = durable(new, "orphans")
            if new.isEmpty():
                break
        known = known.unionByName(new)
        frontier = new
    return known


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Orphaned references per table, field, month, kind and class: ``n_references`` and ``n_records``."""
    return cascade.groupBy("table_name", "field_name", "period_month", "orphan_kind", "orphan_class").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records")
    )
