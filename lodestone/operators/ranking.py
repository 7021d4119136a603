"""Places of rows within groups, without sorting a group in one task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, order: str, by: list[str] | None = None, name: str = "_rank", ties: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the place from 0 by ``order`` (a number, null first, then ``ties``) within ``by``.

    Quantiles of ``order`` over all rows cut every group into cells, which are ranked apart; the counts of the cells before
    are added (one number a group and cell). So sparse, dense or skewed numbers and large groups spread alike. Null groups
    are groups.
    """
    by = by or []
    n = cells or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("c")).first()["c"] or []
    bounds = np.array(sorted(set(cuts)))

    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(), "right").astype(np.int32))

    zero = F.lit(0).cast(rows.schema[order].dataType)
    own = F.when(F.col(order).isNull(), -1).otherwise(cell(F.coalesce(F.col(order), zero))) if len(bounds) else F.lit(0)
    dealt = rows.withColumn("_cell", own)
    keys = [*by, "_cell"]
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    named = counts.select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)), "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)])
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), *(ties or []))) - 1
    placed = dealt.withColumn("_inside", inside).join(named, same)
    return placed.withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_cell", "_inside", "_before", *(f"_t{i}" for i in range(len(keys))))
