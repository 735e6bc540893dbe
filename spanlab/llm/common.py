"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.session import scratch_path

# Fixed value: the white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; file splits are the partitions."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage with files that every executor can read again; an empty
    table keeps its schema. Inside ``temporary()`` the files go at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _OPEN:
        _OPEN[-1].paths.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_path"] = path
    return out


class Scope:
    """Tables written inside one ``temporary()`` block."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """A written table that outlives the block (what is returned reads it)."""
        self.kept.add(df.__dict__["written_path"])
        return df


_OPEN: list[Scope] = []


@contextmanager
def temporary() -> Iterator[Scope]:
    """Delete the tables written inside the block at its end, but for those it keeps.

    Kept tables belong to the enclosing block, if there is one.
    """
    scope = Scope()
    _OPEN.append(scope)
    try:
        yield scope
    finally:
        _OPEN.pop()
        for spark, path in scope.paths:
            if path in scope.kept:
                if _OPEN:
                    _OPEN[-1].paths.append((spark, path))
                continue
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable over a one-element array)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def token_count(text: Column) -> Column:
    return F.size(words(text))
