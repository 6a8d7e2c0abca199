"""Scans along the rows of a group (the row before, running sums, the last n rows) that no large group makes one task's work.

Groups of up to `limit` rows are windows. Larger ones are dealt by ranges of (group, order) over all tasks and written once; a block is what one task got of a
group. Within blocks windows do as before, and a row for each block carries over what the next one needs: its last row, its sum, its last n rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stages

LIMIT = 100_000


class Scan:
    def __init__(self, rows: DataFrame, order: list[str], key: str = "id", limit: int = LIMIT):
        self.key, self.order = key, order
        large = rows.groupBy(F.col(key).alias("large__")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("large__")
        self.small, self.blocks = rows, None
        if not large.isEmpty():
            is_large = rows[key].eqNullSafe(large["large__"])
            self.small, self.blocks = rows.join(large, is_large, "left_anti"), self.dealt(rows.join(large, is_large, "left_semi"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        spark, place = rows.sparkSession, [self.key, *self.order]
        out = stages.scratch(spark, "blocks")
        dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place)
        dealt.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}).write.parquet(out)
        return spark.read.parquet(out)

    def changed(self, small: DataFrame, blocks: DataFrame | None) -> Scan:
        out = object.__new__(Scan)
        out.key, out.order, out.small, out.blocks = self.key, self.order, small, blocks
        return out

    def with_carried(self, blocks: DataFrame, carried: DataFrame) -> DataFrame:
        """blocks with what was carried to each."""
        carried = carried.withColumnsRenamed({"part__": "to__", self.key: "key__"})
        return blocks.join(carried, (F.col("part__") == F.col("to__")) & F.col(self.key).eqNullSafe(F.col("key__"))).drop("to__", "key__")

    @property
    def inside(self):
        return Window.partitionBy("part__", self.key).orderBy("at__")

    @property
    def along(self):
        return Window.partitionBy(self.key).orderBy("part__")

    def previous(self, **columns: Column) -> Scan:
        """With the row before's values."""
        small = self.small.withColumns({k: F.lag(c).over(Window.partitionBy(self.key).orderBy(*self.order)) for k, c in columns.items()})
        if self.blocks is None:
            return self.changed(small, None)
        value = F.struct(*[c.alias(k) for k, c in columns.items()])
        last = self.blocks.groupBy("part__", self.key).agg(F.max_by(value, "at__").alias("last__")).withColumn("carried__", F.lag("last__").over(self.along)).drop("last__")
        found = self.with_carried(self.blocks.withColumn("own__", F.lag(value).over(self.inside)), last)
        found = found.withColumns({k: F.coalesce("own__", "carried__")[k] for k in columns}).drop("own__", "carried__")
        return self.changed(small, found)

    def running(self, **columns: Column) -> Scan:
        """With sums up to each row."""
        small = self.small.withColumns({k: F.sum(c).over(Window.partitionBy(self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)) for k, c in columns.items()})
        if self.blocks is None:
            return self.changed(small, None)
        sums = self.blocks.groupBy("part__", self.key).agg(*[F.sum(c).alias(f"{k}__") for k, c in columns.items()])
        sums = sums.withColumns({f"{k}__": F.coalesce(F.sum(f"{k}__").over(self.along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k in columns})
        own = {k: F.sum(c).over(self.inside.rowsBetween(Window.unboundedPreceding, 0)) for k, c in columns.items()}
        found = self.with_carried(self.blocks.withColumns(own), sums)
        return self.changed(small, found.withColumns({k: F.col(k) + F.col(f"{k}__") for k in columns}).drop(*[f"{k}__" for k in columns]))

    def last(self, n: int, name: str, column: Column, and_this: bool = False) -> Scan:
        """With the values of the last n rows before each, or up to it; nulls are left out."""
        back, to = (-n + 1, 0) if and_this else (-n, -1)
        small = self.small.withColumn(name, F.collect_list(column).over(Window.partitionBy(self.key).orderBy(*self.order).rowsBetween(back, to)))
        if self.blocks is None:
            return self.changed(small, None)
        value = F.struct(column.alias("v"))
        late = self.blocks.withColumn("late__", F.row_number().over(Window.partitionBy("part__", self.key).orderBy(F.desc("at__")))).filter(F.col("late__") <= n)
        tails = late.groupBy("part__", self.key).agg(F.array_sort(F.collect_list(F.struct("at__", value.alias("x")))).alias("tail__"))
        tails = tails.withColumn("tail__", F.flatten(F.collect_list("tail__").over(self.along.rowsBetween(-n, -1))))
        found = self.with_carried(self.blocks.withColumn("own__", F.collect_list(value).over(self.inside.rowsBetween(back, to))), tails)
        both = F.concat(F.transform("tail__", lambda x: x["x"]), "own__")
        both = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))
        values = F.transform(F.filter(both, lambda x: x["v"].isNotNull()), lambda x: x["v"])
        return self.changed(small, found.withColumn(name, values).drop("own__", "tail__"))

    def rows(self) -> DataFrame:
        return self.small if self.blocks is None else self.small.unionByName(self.blocks.drop("part__", "at__"))
