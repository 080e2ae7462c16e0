"""Windows over the last few rows of a key, for keys of any size.

A window per key would sort a whole key in one task.  Here rows get a global
number in ``(keys, order)`` order, and the window runs over blocks of
consecutive numbers; each block also receives the last rows of the block
before it, so frames that cross the border are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.sources.rows import number_rows

BLOCK_ROWS = 200_000


def with_trailing(
    df: DataFrame, keys: list[str], order_by: list[str], frame: tuple[int, int], columns: dict[str, Column], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add aggregates over ``frame`` (for example ``(-9, 0)``) of each row.

    ``columns`` maps a name to an aggregate or to a function of the window.
    """
    reach = -frame[0]
    numbered = number_rows(df, [*keys, *order_by], "_position")
    block = F.floor(F.col("_position") / F.lit(block_rows)).cast("bigint")
    inside = F.col("_position") % F.lit(block_rows)
    homes = F.array_compact(F.array(block, F.when(inside >= block_rows - reach, block + 1)))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(homes))
    w = W.partitionBy("_block", *keys).orderBy("_position").rowsBetween(*frame)
    out = spread.select("*", *[(c(w) if callable(c) and not isinstance(c, Column) else c.over(w)).alias(n) for n, c in columns.items()])
    return out.filter("_home = _block").drop("_home", "_block", "_position")
