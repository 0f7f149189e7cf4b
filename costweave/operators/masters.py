"""Masters made from lines in their order: later lines match masters that earlier lines of the same run have made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.operators import fuzzy
from costweave.session import Scratch, stage


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, leader): whether a node becomes a leader when nodes come in order and one linked to an earlier leader does not.

    ``nodes`` has node (its order), ``links`` pairs (node, earlier). A node none of whose earlier neighbours is a leader,
    or may still become one, is a leader; one with a leader among them is not; the others wait for the next round, a job
    over the links that are still open. Rounds are as many as the longest chain of nodes that wait for each other.
    """
    scratch = Scratch(nodes.sparkSession, "leaders")
    links = scratch.stage(links.where("node > earlier").select("node", "earlier").distinct(), "links")
    waiting = scratch.stage(nodes.select("node").distinct(), "waiting")
    done = None
    while not waiting.isEmpty():
        free = waiting.join(links, "node", "left_anti").select("node", F.lit(True).alias("leader"))
        free = scratch.stage(free, "free")
        led = scratch.stage(links.join(free.select(F.col("node").alias("earlier")), "earlier", "left_semi").select("node").distinct(), "led")
        now = stage(free.union(led.select("node", F.lit(False).alias("leader"))), "decided")
        done = now if done is None else done.union(now)
        waiting = scratch.stage(waiting.join(now, "node", "left_anti"), "waiting")
        # links of followers, and to followers, decide nothing any more
        links = scratch.stage(links.join(led, "node", "left_anti").join(led.select(F.col("node").alias("earlier")), "earlier", "left_anti").select("node", "earlier"), "links")
    scratch.close()
    return nodes.selectExpr("node", "true as leader").limit(0) if done is None else done


def sequential(lines: DataFrame, block: str, order: str) -> DataFrame:
    """(order, node, master, score, kind): the master of every line, kind new, exact or fuzzy.

    ``lines`` has ``order`` (a long that no two lines share), the block's column, description and unit. A line joins the
    best master of its block made before it (``fuzzy``'s score of FUZZY or more, ties: the earlier master), else it makes
    one; equal text, unit and block are one node. Null and blank descriptions and null blocks take no part; null units
    are equal to each other as a node, but give no bonus.
    """
    text = fuzzy.normal("description")
    rows = lines.where(F.col(block).isNotNull()).withColumn("text", text).where("text <> ''").select(F.col(order).alias("line"), block, "text", "unit")
    nodes = stage(rows.groupBy(block, "text", "unit").agg(F.min("line").alias("node")), "nodes")
    named = nodes.select(block, F.col("text").alias("description"), "unit", F.col("node").alias("master_id"))
    found = fuzzy.block_matches(named, named, block).join(nodes.select(F.col(block).alias("_block"), F.col("text").alias("_text"), F.col("unit").alias("_unit"), "node"), (F.col(block) == F.col("_block")) & (F.col("text") == F.col("_text")) & F.col("unit").eqNullSafe(F.col("_unit")))
    links = stage(found.where("master_id < node").select("node", F.col("master_id").alias("earlier"), "score"), "links")
    decided = stage(leaders(nodes, links), "leaders")
    lead = decided.where("leader").select(F.col("node").alias("earlier"))
    best = links.join(lead, "earlier", "left_semi").groupBy("node").agg(F.max_by(F.struct("earlier", "score"), F.struct("score", -F.col("earlier"))).alias("b"))
    of = decided.join(best, "node", "left").select("node", F.when(F.col("leader"), F.col("node")).otherwise(F.col("b.earlier")).alias("master"), F.when(~F.col("leader"), F.col("b.score")).alias("score"))
    rows = rows.join(nodes.select(block, "text", F.col("unit").alias("_unit"), "node"), [block, "text"]).where(F.col("unit").eqNullSafe(F.col("_unit"))).join(of, "node")
    again = F.col("line") != F.col("node")
    kind = F.when(F.col("line") == F.col("master"), "new").when((F.col("master") == F.col("node")) & again | (F.col("score") >= fuzzy.EXACT), "exact").otherwise("fuzzy")
    return rows.select(F.col("line").alias(order), "node", "master", F.coalesce("score", F.when(again, 1.0)).alias("score"), kind.alias("kind"))
