"""Join rows back to the verdict on their group without trusting the keys.

Cross-row rules need "every row of a bad group".  A window per key would put
a whole group into one task, which fails once a single key holds a large share
of the table.  Here groups are reduced first (partial aggregation runs before
the shuffle) and rows meet the small per-group result by a join in two parts:

* *hot* groups hold more than ``1 / HOT_SHARE`` of the rows, so fewer than
  ``HOT_SHARE`` of them can exist whatever the data; that proven bound makes
  them safe to broadcast, and their rows are never shuffled;
* all other groups are joined on the key with an ordinary shuffle, in which no
  key can exceed ``1 / HOT_SHARE`` of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def rows_of_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    keep: Column | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Rows whose group satisfies ``keep``, with the group's columns added.

    ``groups`` has one row per key and the number of its rows in ``size``.
    Null keys match only when ``null_safe`` is set.
    """
    total = groups.agg(F.sum(size).alias("_total")).scalar()
    marked = groups.withColumn("_hot", F.col(size) * F.lit(HOT_SHARE) > total)
    hot = marked.filter("_hot").drop("_hot")
    cold = marked.filter("NOT _hot").drop("_hot")
    wanted_hot, wanted_cold = (hot.filter(keep), cold.filter(keep)) if keep is not None else (hot, cold)
    carried = [c for c in groups.columns if c not in keys]

    def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        if not null_safe:
            return left.join(right, keys, how)
        renamed = right.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
        return left.join(renamed, cond, how)

    order = rows.columns + carried
    from_hot = on(rows, F.broadcast(wanted_hot), "inner").select(*order)
    rest = on(rows, F.broadcast(hot.select(*keys)), "left_anti")
    from_cold = on(rest, wanted_cold, "inner").select(*order)
    return from_hot.unionByName(from_cold)
