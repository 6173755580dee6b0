"""Folding of change logs (amendments): chains, current and as-of state, history, conflicts, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(log: DataFrame, *, base: str, date: str, ordinal: str) -> DataFrame:
    """Number a base's amendments by date, null dates first, ties by ordinal."""
    w = Window.partitionBy(base).orderBy(F.col(date).asc_nulls_first(), ordinal)
    return log.withColumn("seq", F.row_number().over(w))


def current_state(log: DataFrame, *, base: str, key: str, value: str, order: Column, until: Column | None = None) -> DataFrame:
    """Last writer per (base, key), of the changes up to ``until`` if given: value and number of writes. Partial aggregation before the shuffle."""
    rows = log if until is None else log.filter(until)
    return rows.groupBy(base, key).agg(F.max_by(value, order).alias("value"), F.count("*").alias("n_writes"))


def history(log: DataFrame, *, base: str, key: str, value: str, order: list) -> DataFrame:
    """Each change with its number in the key, the old value and whether it changed anything."""
    w = Window.partitionBy(base, key).orderBy(*order)
    out = log.withColumn("change_no", F.row_number().over(w)).withColumn("old_value", F.lag(value).over(w))
    return out.withColumn("changed", ~F.col("old_value").eqNullSafe(F.col(value)))


def conflicts(log: DataFrame, *, base: str, section: str, order: list, id: str) -> DataFrame:
    """Changes to a section that an earlier change of the same base touched: (id, previous id)."""
    w = Window.partitionBy(base, section).orderBy(*order)
    return log.withColumn("previous", F.lag(id).over(w)).filter("previous IS NOT NULL")


def orphans(changes: DataFrame, base_keys: DataFrame, *, on: list[str]) -> DataFrame:
    """Changes to keys the base never held."""
    return changes.join(base_keys.select(*on).distinct(), on, "left_anti")


def applied_changes(base: DataFrame, changes: DataFrame, *, keys: list[str], kind: str, value: str, order: list[str]) -> DataFrame:
    """``changes`` with applied, old_value and change_no: an amendment to a key that does not exist at its time is rejected, and later ones see that.

    ``kind`` is "add", "modify" or "remove"; ``base`` holds the keys that exist at first, with their values. An add makes the key exist (of an existing one it is a modification),
    a remove ends it, a modification or removal of a key that does not exist is an orphan and is not applied. old_value is the value before, null if the key did not exist;
    change_no counts the applied changes of a key. Kinds that are none of the three are never applied. One window per key, in the order of ``order``.
    """
    start = base.groupBy(*keys).agg(F.max(value).alias("_v")).select(*keys, F.lit(True).alias("_held"), "_v")
    rows = changes.join(start, keys, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda k: F.col(kind) == k
    live = F.coalesce(F.last(F.when(is_("add"), F.lit(True)).when(is_("remove"), F.lit(False)), ignorenulls=True).over(before), F.col("_held"))
    rows = rows.withColumn("_live", live).withColumn("applied", F.coalesce(is_("add") | (is_("modify") | is_("remove")) & F.col("_live"), F.lit(False)))
    written = F.when(F.col("applied"), F.struct(F.when(~is_("remove"), F.col(value)).alias("v")))
    last = F.last(written, ignorenulls=True).over(before)
    old = F.when(F.col("_live"), F.when(last.isNotNull(), last["v"]).otherwise(F.col("_v")))
    number = F.when(F.col("applied"), F.count_if("applied").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("old_value", old).withColumn("change_no", number).drop("_live", "_held", "_v")


def state_after(base: DataFrame, changes: DataFrame, *, keys: list[str], kind: str, value: str, order: list[str]) -> DataFrame:
    """(keys, value, n_changes) after all changes that ``applied_changes`` applies; keys that are removed at the end are left out."""
    done = applied_changes(base, changes, keys=keys, kind=kind, value=value, order=order).filter("applied")
    last = done.groupBy(*keys).agg(F.max_by(F.struct(F.col(kind).alias("k"), F.col(value).alias("v")), F.struct(*order)).alias("_l"), F.count("*").alias("n_changes"))
    start = base.groupBy(*keys).agg(F.max(value).alias("_v")).withColumn("_b", F.lit(True))
    both = start.join(last, keys, "full_outer").filter("_l IS NULL OR _l.k <> 'remove'")
    return both.select(*keys, F.when(F.col("_l").isNotNull(), F.col("_l.v")).otherwise(F.col("_v")).alias(value), F.coalesce("n_changes", F.lit(0)).cast("long").alias("n_changes"))


def date_order_issues(log: DataFrame, *, base: str, arrival: str, date: str) -> DataFrame:
    """Rows dated before the row that arrived just before them."""
    w = Window.partitionBy(base).orderBy(arrival)
    return log.withColumn("previous_date", F.lag(date).over(w)).filter(F.col(date) < F.col("previous_date"))
