"""Joins of rows with facts about their key where one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000  # a key with more than this part of all rows is hot; so fewer than SHARE keys are
_DEALT = 1 << 20


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """`rows` with the columns of `facts` (unique, non-null keys; `weight`: rows of the key), null where there are none.

    Facts of hot keys, fewer than SHARE, go to every task; their rows are dealt evenly over the
    shuffle in which all others meet their facts. The dealing numbers the rows of a task, which a
    repeated task numbers alike as long as it reads them in the same order, as a table scan does.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    given = [c for c in facts.columns if c not in (key, weight)]
    packed = facts.select(key, weight, F.struct(*given).alias("_fact"))
    hot = F.col(weight) * SHARE > F.lit(total)
    often = F.broadcast(packed.where(hot).select(key, F.col("_fact").alias("_often")))
    dealt = F.when(F.col("_often").isNotNull(), F.monotonically_increasing_id() % _DEALT).otherwise(F.lit(-1))
    rest = packed.where(~hot).select(key, F.lit(-1).cast("long").alias("_dealt"), "_fact")
    joined = rows.join(often, key, "left").withColumn("_dealt", dealt).join(rest, [key, "_dealt"], "left")
    fact = F.coalesce("_often", "_fact")
    return joined.select(*rows.columns, *(fact[c].alias(c) for c in given))
