"""Fold models on shared storage: ``root/task/model/fold=k``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tidemark.sources.files import names


def save_folds(root: str, task: str, model: str, folds: list[PipelineModel]) -> None:
    """Each fold is a folder of its own, so folds are written side by side."""
    base = f"{root.rstrip('/')}/{task}/{model}"
    spark = SparkSession.getActiveSession()

    def write(k: int) -> None:
        folds[k].write().overwrite().save(f"{base}/fold={k}")

    with ThreadPoolExecutor(max(1, len(folds))) as pool:
        list(pool.map(inheritable_thread_target(spark)(write), range(len(folds))))


def load_folds(spark: SparkSession, root: str, task: str, model: str) -> list[PipelineModel]:
    base = f"{root.rstrip('/')}/{task}/{model}"
    found = [n for n in names(spark, base) if n.startswith("fold=")]
    if not found:
        raise FileNotFoundError(f"no stored folds under {base}")
    found.sort(key=lambda n: int(n.split("=")[1]))
    read = inheritable_thread_target(spark)(lambda n: PipelineModel.load(f"{base}/{n}"))
    with ThreadPoolExecutor(len(found)) as pool:
        return list(pool.map(read, found))


def stored_models(spark: SparkSession, root: str, task: str) -> list[str]:
    return names(spark, f"{root.rstrip('/')}/{task}")
