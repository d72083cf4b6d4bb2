"""Dense numbers over a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackenfold.tables import checkpoint


def running_totals(df: DataFrame, order_by: list[str], totals: dict[str, str]) -> DataFrame:
    """``df`` plus a column per entry (new name: summed column) with its total over all rows up to this one, in a total order.

    As in ``dense_numbers``: range partitions, and of each only its sums come to the driver.
    """
    parts = checkpoint(df.repartitionByRange(*order_by).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double" if df.schema[c].dataType.typeName() in ("double", "float") else "bigint").alias(n) for n, c in totals.items()]).orderBy("_p").collect()
    before, at = [], [0] * len(totals)
    for r in sums:
        before.append((r["_p"], *at))
        at = [a + r[n] for a, n in zip(at, totals)]
    base = parts.sparkSession.createDataFrame(before, "_p int, " + ", ".join(f"`_before_{n}` {parts.groupBy().agg(F.sum(c).alias('x')).schema['x'].dataType.simpleString()}" for n, c in totals.items()))
    within = Window.partitionBy("_p").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(base), "_p")  # a row per partition of the shuffle
    return out.select(*df.columns, *[(F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in totals.items()])


def dense_numbers(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` plus ``name``: start, start + 1, ... in the order of ``order_by``, which must be total.

    The rows are range-partitioned and written once; only the number of rows of
    each partition comes to the driver.
    """
    parts = checkpoint(df.repartitionByRange(*order_by).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], start
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order_by))
    # one row per partition of the shuffle
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _base bigint"))
    return parts.join(base, "_p").withColumn(name, (F.col("_base") + within - 1).cast("bigint")).drop("_p", "_base")
