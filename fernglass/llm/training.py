"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a class that one window keeps: below Spark's spark.sql.optimizer.windowGroupLimitThreshold, so that each
#: task passes on no more than these and a class that most rows have isn't gathered.
STEP = 500


def sampled(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """Of rows (id, class), one per id, at most per_class of every class: those with the least hashes of their ids
    in each of per_class / STEP equal shares of the hash's values. A class with few rows keeps nearly all of them; an
    empty table gives an empty sample."""
    shares = -(-per_class // STEP)
    h = F.xxhash64(id_col)
    order = W.partitionBy(class_col, "__fg_share").orderBy("__fg_h", id_col)
    ranked = rows.withColumn("__fg_h", h).withColumn("__fg_share", F.pmod(F.shiftright(h, 7), F.lit(shares)))
    return ranked.withColumn("__fg_n", F.row_number().over(order)).filter(F.col("__fg_n") <= per_class // shares).drop("__fg_h", "__fg_share", "__fg_n")
