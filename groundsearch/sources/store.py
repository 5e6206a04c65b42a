"""The vector store: one Parquet table, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("spec", T.StringType()), T.StructField("version", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("section", T.StringType()), T.StructField("paragraph", T.StringType()), T.StructField("heading", T.StringType()),
    T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("ordinal", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())),
])


class VectorStore:
    """A table under root.  Each replacement is a new version folder, current once it is complete, so readers never see half a table.

    The `keep` last versions stay, so that who reads an older one can go on; replace() sweeps those before them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = SCHEMA, keep: int = 2):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, keep
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        path = self._fs_path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Complete versions, the current one last."""
        found = self._fs().globStatus(self._fs_path(f"{self.root}/v*/_SUCCESS"))
        return sorted(str(v.getPath().getParent().getName()) for v in found or [])

    def _current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def exists(self) -> bool:
        return self._current() is not None

    def replace(self, rows: DataFrame) -> None:
        """Write rows as the next version."""
        last = self._current()
        number = int(last[1:].split("-")[0]) + 1 if last else 1
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.root}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        for old in self.versions()[: -self.keep]:
            self._fs().delete(self._fs_path(f"{self.root}/{old}"), True)

    def scan(self, *columns: str) -> DataFrame:
        """All rows; only the named columns are read."""
        current = self._current()
        if current is None:
            raise FileNotFoundError(f"no table under {self.root}; build it first")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/{current}")
        return rows.select(*columns) if columns else rows

    def count(self) -> int:
        """Rows, 0 without a table."""
        return self.scan().count() if self.exists() else 0
