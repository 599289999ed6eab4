"""Folder listings through Hadoop's file system, so any storage the cluster knows works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.schema import RAW_FILES


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Entry names of a folder; empty where there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def raw_path(spark: SparkSession, folder: str, file_key: str) -> str:
    """Path of a logical file: its exact name, else the same name in any case."""
    wanted = RAW_FILES.get(file_key, f"{file_key}.csv")
    have = names(spark, folder)
    if wanted not in have:
        wanted = next((n for n in have if n.lower() == wanted.lower()), wanted)
    return f"{folder.rstrip('/')}/{wanted}"


def presence(spark: SparkSession, folder: str) -> DataFrame:
    """(table, file, exists) for every expected raw file."""
    have = set(names(spark, folder))
    rows = [(k, f, f in have) for k, f in RAW_FILES.items()]
    return spark.createDataFrame(rows, "table string, file string, exists boolean")
