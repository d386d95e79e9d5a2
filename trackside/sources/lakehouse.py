"""Silver and gold tables as partitioned Parquet, and the catalog of views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trackside.operators.tables import upsert
from trackside.sources import files, snapshots
from trackside.specs import CATALOG, TableSpec


def table_path(root: str, name: str) -> str:
    layer = "gold" if name.startswith(("gold_", "features_")) else "silver"
    return f"{root.rstrip('/')}/{layer}/{name}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _typed(spark: SparkSession, spec: TableSpec, folder: str | None) -> DataFrame:
    if folder is None or not files.has_data(spark, folder):
        return empty(spark, spec.schema)
    extra = [f for f in spark.read.parquet(folder).schema.fields if f.name not in spec.schema.fieldNames()]
    return spark.read.schema(T.StructType(spec.schema.fields + extra)).parquet(folder)


def read_table(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """The table with its declared types; typed and empty when nothing has been published.

    Declared columns are read by name from every file (NULL where a file lacks one); further
    columns are those of the file Spark samples, so that no job has to open all footers. Of a
    table that is published whole, the newest version is read; it stays as it is under later ones.
    """
    path = table_path(root, spec.name)
    version = 0 if spec.partition_by else snapshots.current(spark, path)
    return _typed(spark, spec, snapshots.folder_of(spark, path, version) if version else path if spec.partition_by else None)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite exactly the partitions present in ``df``; the others stay.

    The rebalance hint shuffles by partition key and lets adaptive execution split a large
    partition over several tasks and merge small ones, so no key is one task or many tiny
    files.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def publish(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a whole table by a new version, made from the newest one at most; ``df`` may read the table itself."""
    snapshots.commit(spark, df, path, snapshots.current(spark, path))


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table that is published whole, the newest by default."""
    newest = snapshots.current(spark, path) if version is None else version
    return spark.read.parquet(snapshots.folder_of(spark, path, newest))


def store(spark: SparkSession, root: str, spec: TableSpec, df: DataFrame) -> None:
    """Publish a batch: by partition where the table is partitioned, else upsert on its keys.

    A batch that carries a partition key replaces that partition, which makes re-runs
    idempotent for session-keyed dimensions and facts alike.
    """
    path = table_path(root, spec.name)
    if spec.partition_by:
        replace_partitions(df, path, list(spec.partition_by))
    elif spec.keys:
        # Where another run has published meanwhile, the batch goes on top of what that has left.
        snapshots.update(spark, path, lambda folder: upsert(_typed(spark, spec, folder), df, list(spec.keys)))
    else:
        publish(spark, df, path)


def register_lakehouse(spark: SparkSession, root: str) -> list[str]:
    """One temporary view per catalog table; returns the names."""
    for name, spec in CATALOG.items():
        read_table(spark, root, spec).createOrReplaceTempView(name)
    return list(CATALOG)


def views(spark: SparkSession) -> dict[str, DataFrame]:
    """The registered views as DataFrames."""
    return {name: spark.table(name) for name in CATALOG}
