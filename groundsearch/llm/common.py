"""Helpers shared by the operators of this package: shared-folder tables, Arrow batch limits, table reads."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.shared import shared_dir
from groundsearch.shipping import ship_package

#: ASCII white space that ends a word: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_scopes: list[str] = []
_written: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the files' readers nothing, and values made by
    monotonically_increasing_id() are fixed once written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _written.setdefault(_scopes[-1], []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() gave and that no result reads any more."""
    _delete(df.sparkSession, df.written_to)


def replace(used: list[DataFrame], df: DataFrame, what: str) -> DataFrame:
    """materialise() df, then delete the tables in used, which nothing else reads any more."""
    out = materialise(df, what)
    for table in used:
        discard(table)
    return out


@contextmanager
def scratch_scope(name: str):
    """Tables that materialise() writes inside belong to this scope; sweep() removes them."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def sweep(spark: SparkSession, name: str) -> None:
    """Delete what materialise() wrote in the scope.  Call it only when every result of the scope has been written out."""
    for path in _written.pop(name, []):
        _delete(spark, path)


def arrow_batches(spark: SparkSession, rows: int = 512, megabytes: int = 16) -> None:
    """Make the package known to Python workers, and bound their Arrow batches so that long texts don't fill their memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def row_ids(docs: DataFrame, name: str = "rid") -> DataFrame:
    """Add a unique id for each row, so that null or repeated document ids do no harm.

    monotonically_increasing_id() gives a row the same id in each job as long as docs is a file scan
    (with filters or projections on it) that keeps its splits and row order.  Splits depend on the
    number of cores unless spark.sql.files.minPartitionNum is set, and executors come and go, so it is set here.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


#: Plans that give their rows in the same partitions and order each time.
_STABLE = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "SubqueryAlias", "View"}


def fixed(docs: DataFrame, what: str = "input") -> DataFrame:
    """docs, written out unless its plan is a plain scan: operators that read it twice join by row_ids()."""
    plan = docs._jdf.queryExecution().analyzed()

    def stable(node) -> bool:
        children = node.children()
        return node.nodeName() in _STABLE and all(stable(children.apply(i)) for i in range(children.size()))

    return docs if plan.deterministic() and stable(plan) else materialise(docs, what)


#: Row ids that may be broadcast: 16 MB.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs less the rows whose id is in gone, a table of materialise().  A short list is broadcast, so texts stay where they are; a longer one is merged."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge"), name, "left_anti")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside deletes its shuffle files once written; else they stay until the driver happens to collect its garbage.

    A frame that is run a second time makes them anew, so this is for frames that are run once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(docs: DataFrame, name: str = "rid") -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name
