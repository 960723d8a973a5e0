"""Root and depth of every node of a parent table (Q13), for chains of any length.

SQL recursion takes one round for each level and has a limit of levels.  Here
each round doubles how far a node has looked: a node knows an ancestor and the
steps to it, and takes over what that ancestor knows.  A chain of a million
levels takes twenty rounds.  Only nodes that have not reached a root are joined
in the next round; each round is written to the shared checkpoint folder and
read again, so a lost executor repeats one round, and the next plan starts from
files of a known size.  (A checkpoint keeps the planner's estimate: the product
of both sides of each join, a number of twice the digits every round.)  Joins
are merges: narrow rows shuffle so small that the planner would broadcast millions
of them through the driver.  Every join is on a node, which has one row, so a
parent with very many children is met from the many side, where the join's skew
handling splits it.

Defined results: a null parent, or one that is no node, makes a root (depth 0);
nodes that lead into a cycle have a null root and depth; a repeated node goes
by its least parent; null nodes are left out.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def roots(df: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root, depth`` of each node of ``df``."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roots-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, round_: int) -> DataFrame:
        # A round reads the former one's folder only, so two of them take turns.
        path = f"{folder}/{round_ % 2}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    given = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.min(parent).alias("p"))
    known = given.select(F.col("n").alias("p"), F.lit(True).alias("there"))
    state = kept(given.hint("merge").join(known.hint("merge"), "p", "left").select(
        "n", F.when(F.col("there"), F.col("p")).otherwise(F.col("n")).alias("at"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"), (~F.coalesce("there", F.lit(False))).alias("done")), 0)
    total = state.count()
    # Behind so many doublings only a cycle can still go on.
    for k in range(max(1, math.ceil(math.log2(max(total, 2)))) + 1):
        going = state.where("not done").drop("done")
        if going.isEmpty():
            break
        ahead = state.select(F.col("n").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"), "done")
        step = going.hint("merge").join(ahead.hint("merge"), "at").select("n", F.col("far").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), "done")
        state = kept(state.where("done").unionByName(step), k + 1)
    return state.select(F.col("n").alias(node), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"))
