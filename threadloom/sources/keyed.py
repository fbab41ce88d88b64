"""Tables that are put to by key and read as of a number.

A put writes one immutable Parquet folder, named after its number; reading keeps, for every key, the rows of the last put
that touched it. A put that runs again under the same number replaces its own folder and nothing else, so a job that is
repeated after a failure changes nothing, and what held before a put can still be read after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import _files

_NUMBER, _GONE = "_put", "_gone"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key below ``path``. A key may have several rows; a put replaces all of them.

    A null in a key is one more value. Puts to one table come from one writer at a time.
    """

    path: str
    keys: list[str]
    schema: T.StructType

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number:018d}"

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the complete folders, in order."""
        where, fs = _files(spark, self.path)
        if not fs.exists(where):
            return []
        found = []
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.startswith(f"{kind}=") and fs.exists(_files(spark, f"{self.path}/{name}/_SUCCESS")[0]):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def last(self, spark: SparkSession) -> int:
        """Number of the last put, -1 if there is none."""
        return max(self._numbers(spark, "put") + self._numbers(spark, "base"), default=-1)

    def put(self, rows: DataFrame, number: int | None = None, touched: DataFrame | None = None) -> int:
        """Make ``rows`` all the rows of their keys; keys of ``touched`` without rows have none from now on.

        Returns the number of the put, the next free one if none is given.
        """
        spark = rows.sparkSession
        number = self.last(spark) + 1 if number is None else number
        names = self.schema.names
        kept = rows.select(*names, F.lit(number).cast("long").alias(_NUMBER), F.lit(False).alias(_GONE))
        if touched is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.keys]
            marks = touched.select(*self.keys).distinct().select(*self.keys, *empty).select(
                *names, F.lit(number).cast("long").alias(_NUMBER), F.lit(True).alias(_GONE)
            )
            kept = kept.unionByName(marks)
        kept.write.mode("overwrite").parquet(self._folder("put", number))
        return number

    def _since(self, spark: SparkSession, before: int | None) -> tuple[list[str], bool]:
        """Folders to read, and whether one of them alone holds the state."""
        puts, bases = ([n for n in self._numbers(spark, kind) if before is None or n < before] for kind in ("put", "base"))
        base = bases[-1:]
        later = [n for n in puts if not base or n > base[0]]
        return [self._folder("base", n) for n in base] + [self._folder("put", n) for n in later], not later

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows now, or as they were before the put of that number."""
        folders, settled = self._since(spark, before)
        if not folders:
            return spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema, T.StructField(_NUMBER, T.LongType()), T.StructField(_GONE, T.BooleanType())])
        rows = spark.read.schema(stored).parquet(*folders)
        if not settled:
            last = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max(_NUMBER).alias("_last"))
            same = F.col(_NUMBER) == F.col("_last")
            for i, k in enumerate(self.keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            rows = rows.join(last, same, "left_semi")
        return rows.where(~F.col(_GONE)).select(*self.schema.names)

    def compact(self, spark: SparkSession) -> None:
        """Write the state after the last put as one folder, so that reading no longer compares puts.

        Earlier folders stay, for jobs that still read what was before them.
        """
        last = self.last(spark)
        if last in self._numbers(spark, "base") or last < 0:
            return
        state = self.read(spark).select("*", F.lit(last).cast("long").alias(_NUMBER), F.lit(False).alias(_GONE))
        state.write.mode("overwrite").parquet(self._folder("base", last))
