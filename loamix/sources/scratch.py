"""Scratch tables in the shared folder that the cluster names, and versioned tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def private_root() -> str:
    root = tempfile.mkdtemp(prefix="loamix-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; on a local master, which has no other machine, a private one if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or private_root()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again, which ends its lineage."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_version(df: DataFrame, base: str) -> str:
    """Writes a new version of a table beside the old ones; readers go on with the old one until they ask again."""
    spark = df.sparkSession
    version = max(versions(spark, base), default=0) + 1
    path = f"{base.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions of a table: those whose write was committed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def load_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    known = versions(spark, base)
    if not known:
        raise FileNotFoundError(f"no version of {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/v={(version or known[-1]):08d}")


GRAPH_TABLES = ("nodes", "edges", "members", "summaries")


def save_graph(tables: dict[str, DataFrame], base: str) -> None:
    """New versions of a graph's tables; it exists when all of them do."""
    for name in GRAPH_TABLES:
        save_version(tables[name], f"{base.rstrip('/')}/{name}")


def graph_exists(spark: SparkSession, base: str) -> bool:
    return all(versions(spark, f"{base.rstrip('/')}/{name}") for name in GRAPH_TABLES)


def load_graph(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: load_version(spark, f"{base.rstrip('/')}/{name}") for name in GRAPH_TABLES}


def delete_table(spark: SparkSession, base: str) -> None:
    """Deletes a table with all its versions."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
