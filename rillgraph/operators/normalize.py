"""Arguments given by name, renumbered to the positions of the contract they call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(ports: DataFrame, args: DataFrame) -> DataFrame:
    """(site, idx, name, new_idx, state): ports(site, contract, idx, name) against args(contract, name, pos).

    A name of the contract takes its position; one it lacks goes behind all positions in
    order (dangling); a port without a name, or of an unknown contract, stays.
    """
    known = args.groupBy("contract").agg(F.count("*").alias("n_args"))
    own = ports.join(known, "contract", "left").join(args, ["contract", "name"], "left")
    state = F.when(F.col("n_args").isNull(), "unknown").when(F.col("name") == "", "unnamed").when(F.col("pos").isNull(), "dangling").otherwise("named")
    own = own.withColumn("state", state)
    behind = F.row_number().over(Window.partitionBy("site", "state").orderBy("idx")) - 1
    new = F.when(F.col("state") == "named", F.col("pos")).when(F.col("state") == "dangling", F.col("n_args") + behind).otherwise(F.col("idx"))
    return own.select("site", "idx", "name", new.cast("long").alias("new_idx"), "state")


def census(normalised: DataFrame) -> DataFrame:
    """One row: sites and ports that moved, dangling names."""
    moved = F.col("idx") != F.col("new_idx")
    return normalised.agg(F.countDistinct(F.when(moved, F.col("site"))).alias("sites"), F.count_if(moved).alias("ports"), F.count_if(F.col("state") == "dangling").alias("dangling"))
