"""Parquet batches whose columns changed type from one to the next, read as one table.

Every batch has been written whole, so one footer tells its types. Batches are grouped by their types; a group is one scan,
and its columns are cast to the type that all groups agree on: text where any of them has text, else the widest number.
Types that have nothing in common become text as well.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTERS = 16  # read at a time
WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
NUMBERS = [*WHOLE, T.FloatType, T.DoubleType]


def agreed(kinds: list[T.DataType]) -> T.DataType:
    """The type that holds values of all these types."""
    distinct = [k for i, k in enumerate(kinds) if k not in kinds[:i] and not isinstance(k, T.NullType)]
    if len(distinct) < 2:
        return (distinct or kinds)[0]
    if all(type(k) in WHOLE for k in distinct):
        return max(distinct, key=lambda k: WHOLE.index(type(k)))
    if all(type(k) in NUMBERS or isinstance(k, T.DecimalType) for k in distinct):
        return T.DoubleType()
    if all(isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)) for k in distinct):
        return T.TimestampNTZType()
    return T.StringType()


def agreed_schema(schemas: list[T.StructType]) -> T.StructType:
    """Columns in order of first appearance, compared without case, each with the type agreed on."""
    kinds: dict[str, list[T.DataType]] = defaultdict(list)
    names: dict[str, str] = {}
    for schema in schemas:
        for f in schema.fields:
            names.setdefault(f.name.lower(), f.name)
            kinds[f.name.lower()].append(f.dataType)
    return T.StructType([T.StructField(names[k], agreed(v)) for k, v in kinds.items()])


def read_reconciled(spark: SparkSession, paths: list[str], base: str | None = None) -> DataFrame:
    """One table over batches of different types; partition columns come from the folders below ``base``."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    with ThreadPoolExecutor(FOOTERS) as pool:
        schemas = list(pool.map(lambda path: reader.parquet(path).schema, paths))
    groups: dict[str, list[str]] = defaultdict(list)
    by_text = {}
    for path, schema in zip(paths, schemas):
        groups[schema.json()].append(path)
        by_text[schema.json()] = schema
    wanted = agreed_schema(list(by_text.values()))

    def scan(text: str) -> DataFrame:
        rows = reader.schema(by_text[text]).parquet(*groups[text])
        have = {c.lower(): c for c in rows.columns}
        return rows.select(
            *[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
        )

    return reduce(DataFrame.unionByName, map(scan, groups))
