"""Stored sums that follow changes of single rows, without reading the other groups again.

A change of rows is a table of signed rows: the old ones with a minus, the new ones with a plus.
Summed by group it is added to the stored sums. These lie in numbered parts (by the hash of the
group) and versions: a change writes a new version of the parts it touches and reads only them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of a store: at most as many numbers reach the driver.
PARTS = 256


def signed(old: DataFrame, new: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """(groups, sums, n): what replacing the rows ``old`` by ``new`` adds to each group.

    Null sums count as 0. Groups that the change leaves as they are drop out.
    """

    def side(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*groups, *[(F.coalesce(c, F.lit(0)) * sign).alias(c) for c in sums], F.lit(sign).cast("long").alias("n"))

    moved = added(side(old, -1).unionByName(side(new, 1)), groups, sums)
    some = F.col("n") != 0
    for c in sums:
        some = some | (F.col(c) != 0)
    return moved.where(some)


def added(rows: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """Partial aggregates of one kind added up; sums keep the scale of their decimals."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.groupBy(*groups).agg(*[_wide(F.sum(c), kinds[c]).alias(c) for c in sums], F.sum("n").alias("n"))


def _wide(total: Column, kind: T.DataType) -> Column:
    return total.cast(T.DecimalType(38, kind.scale)) if isinstance(kind, T.DecimalType) else total


@dataclass
class Store:
    """Sums by group under ``path``. Each change has a number of the caller's, counted from 1.

    Version 0 is the first load. A version counts once its job has finished; a change that runs
    again reads the versions before its own and replaces what it wrote, so it counts once.
    Changes are applied one after the other, by one writer.
    """

    spark: SparkSession
    path: str
    groups: list[str]
    sums: list[str]
    parts: int = PARTS

    def load(self, rows: DataFrame) -> None:
        """Version 0: all rows summed by group."""
        plain = rows.select(*self.groups, *[F.coalesce(c, F.lit(0)).alias(c) for c in self.sums], F.lit(1).cast("long").alias("n"))
        self._write(added(plain, self.groups, self.sums), 0)

    def apply(self, change: int, old: DataFrame, new: DataFrame) -> None:
        """Replace the rows ``old`` by ``new``; the plan reads the touched parts only."""
        if change < 1:
            raise ValueError("changes are numbered from 1")
        moved = self._placed(signed(old, new, self.groups, self.sums))
        touched = sorted(r["_part"] for r in moved.select("_part").distinct().collect())
        before = self._current(change - 1, touched)
        rows = moved.drop("_part")
        if before is not None:
            rows = before.unionByName(rows)
        # groups without rows stay as zeros: they hide what an older version says
        self._write(added(rows, self.groups, self.sums), change)

    def read(self) -> DataFrame:
        """(groups, sums, n) of every group that has rows, as of the last change."""
        now = self._current(None, None)
        if now is None:
            raise ValueError(f"nothing was loaded into {self.path}")
        return now.where("n <> 0")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(*self.groups), F.lit(self.parts)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> None:
        # all of a part in one file of bounded groups: the sums are few beside the rows
        placed = self._placed(rows).repartition("_part")
        placed.write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/version={version}")

    def _folders(self) -> dict[int, dict[int, str]]:
        """Folders of each finished version by part."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[int, dict[int, str]] = {}
        for entry in files.listStatus(root) if files.exists(root) else []:
            name, _, number = entry.getPath().getName().partition("=")
            if name != "version" or not files.exists(hadoop(entry.getPath(), "_SUCCESS")):
                continue
            inner = [f.getPath() for f in files.listStatus(entry.getPath()) if f.getPath().getName().startswith("_part=")]
            found[int(number)] = {int(p.getName().partition("=")[2]): p.toString() for p in inner}
        return found

    def _current(self, last: int | None, parts: list[int] | None) -> DataFrame | None:
        newest: dict[int, str] = {}
        for version, folders in sorted(self._folders().items()):
            if last is None or version <= last:
                newest.update(folders)
        paths = [p for part, p in sorted(newest.items()) if parts is None or part in parts]
        if not paths:
            return self._nothing(newest)
        return self.spark.read.parquet(*paths).select(*self.groups, *self.sums, "n")

    def _nothing(self, newest: dict[int, str]) -> DataFrame | None:
        """No rows, with the columns of the store if it has any part at all."""
        if not newest:
            return None
        some = next(iter(newest.values()))
        return self.spark.read.parquet(some).select(*self.groups, *self.sums, "n").limit(0)
