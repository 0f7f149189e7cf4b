"""Life of specifications: changes and promotions in order of time, refused where the rules forbid them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.operators.specs import WEIGHTS
from costweave.session import stage

# States in order, and how complete (percent) an item has to be to enter each.
STATES = ("draft", "detailed", "final")
REQUIRED = {"detailed": 50, "final": 75}
FIELDS = tuple(WEIGHTS)


def history(commands: DataFrame, piece: str = "day") -> DataFrame:
    """Every command with ``old_value``, ``completeness`` (percent, after it), ``old_status``, ``new_status``, ``accepted`` and ``reason``.

    ``commands``: item, at, seq, action, field, value. ``set`` writes value into field (null or '' empties it), ``verify``
    marks the item, ``promote`` asks for the status in value. A promotion has to go up and needs the completeness of its
    target, ``final`` a verified item too. Commands of an item follow each other by (at, seq); seq tells commands apart.
    Unknown actions, fields and targets are refused. Null items, times or seqs make no history.

    An item's commands are cut into pieces of time (``piece``, a unit of date_trunc). Only a piece's last values travel
    along an item, a row a piece, so that an item with very many commands is no single task. A promotion's conditions
    don't depend on earlier promotions but for the status itself, which the first promotion that holds decides.
    """
    order = F.struct("at", "seq")
    field = F.when(F.col("action") == "set", F.col("field"))
    rows = commands.where("item is not null and at is not null and seq is not null").withColumn("piece", F.date_trunc(piece, "at"))
    written = lambda f: F.when(field == f, F.coalesce("value", F.lit("")))
    rows = stage(rows.select("item", "at", "seq", "action", "field", "value", "piece", *(written(f).alias(f"_{f}") for f in FIELDS), (F.col("action") == "verify").alias("_verify")), "commands")
    pieces = rows.groupBy("item", "piece").agg(*(F.max_by(f"_{f}", F.when(F.col(f"_{f}").isNotNull(), order)).alias(f"_{f}") for f in FIELDS), F.max("_verify").alias("_verify"))
    before = Window.partitionBy("item").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("item", "piece", *(F.last(f"_{f}", True).over(before).alias(f"{f}_start") for f in FIELDS), F.coalesce(F.max("_verify").over(before), F.lit(False)).alias("verified_start"))

    until = Window.partitionBy("item", "piece").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("item", "piece").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda f, w: F.coalesce(F.last(f"_{f}", True).over(w), F.col(f"{f}_start"), F.lit(""))
    rows = rows.join(starts, ["item", "piece"])
    rows = rows.select("item", "at", "seq", "action", "field", "value", *(held(f, until).alias(f"{f}_now") for f in FIELDS), *(held(f, earlier).alias(f"{f}_old") for f in FIELDS), (F.max("_verify").over(until) | F.col("verified_start")).alias("verified"))
    done = reduce(Column.__add__, (F.when(F.col(f"{f}_now") != "", w).otherwise(0) for f, w in WEIGHTS.items()))
    old = F.coalesce(*(F.when(field == f, F.nullif(F.col(f"{f}_old"), F.lit(""))) for f in FIELDS))
    rows = stage(rows.select("item", "at", "seq", "action", "field", "value", old.alias("old_value"), done.alias("completeness"), "verified"), "values")

    promote, target, complete = F.col("action") == "promote", F.col("value"), F.col("completeness")
    holds = {"detailed": promote & (target == "detailed") & (complete >= REQUIRED["detailed"]), "final": promote & (target == "final") & (complete >= REQUIRED["final"]) & F.col("verified")}
    first = rows.where(holds["detailed"] | holds["final"]).groupBy("item").agg(F.min(F.when(holds["detailed"], order)).alias("detailed_at"), F.min(F.when(holds["final"], order)).alias("final_at"))
    rows = rows.join(first, "item", "left")
    # an item that is final before it is detailed never becomes detailed
    detailed_at = F.when(F.col("final_at").isNull() | (F.col("detailed_at") < F.col("final_at")), F.col("detailed_at"))
    status = lambda reached: F.when(reached(F.col("final_at")), "final").when(reached(detailed_at), "detailed").otherwise("draft")
    rows = rows.withColumns({"old_status": status(lambda at: at < order), "new_status": status(lambda at: at <= order)})
    rank = lambda c: F.coalesce(*(F.when(F.col(c) == s, i) for i, s in enumerate(STATES)))
    refusal = (
        F.when(promote & rank("value").isNull(), "unknown status").when(promote & (rank("value") <= rank("old_status")), "not higher")
        .when(promote & (complete < F.when(target == "final", REQUIRED["final"]).otherwise(REQUIRED["detailed"])), "incomplete")
        .when(promote & (target == "final") & ~F.col("verified"), "not verified")
        .when((F.col("action") == "set") & ~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), "unknown field")
        .when(~F.coalesce(F.col("action").isin("set", "verify", "promote"), F.lit(False)), "unknown action")
    )
    rows = rows.withColumn("reason", refusal).withColumn("accepted", F.col("reason").isNull())
    return rows.select("item", "at", "seq", "action", "field", "value", "old_value", "completeness", "old_status", "new_status", "accepted", "reason")


def states(log: DataFrame) -> DataFrame:
    """(item, status, completeness, n_changes, n_refused) after all of ``history``."""
    last = F.max(F.struct("at", "seq", "new_status", "completeness")).alias("l")
    return log.groupBy("item").agg(last, F.count_if("accepted").alias("n_changes"), F.count_if(~F.col("accepted")).alias("n_refused")).select("item", F.col("l.new_status").alias("status"), F.col("l.completeness").alias("completeness"), "n_changes", "n_refused")
