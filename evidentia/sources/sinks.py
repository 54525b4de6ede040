"""Tables that the library writes: indexes, graphs, sessions, themes, caches."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(chunks: DataFrame, path: str) -> None:
    """Text, metadata and vector in one table; a smaller index leaves no stale rows."""
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_cache(rows: DataFrame, path: str) -> None:
    rows.select("key", "body").write.mode("append").parquet(path)


def write_session(folder: str, session: dict) -> str:
    """One JSON file, replaced in one step so that a reader never sees half of it."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = os.path.join(folder, f"{session['session_id']}.json")
    with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".tmp", delete=False, encoding="utf-8") as f:
        json.dump(session, f, ensure_ascii=False)
    os.replace(f.name, path)
    return path


def read_session(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """The session's row; KeyError if there is none."""
    found = spark.read.option("multiLine", "true").json(folder).where(F.col("session_id") == session_id)
    if found.isEmpty():
        raise KeyError(session_id)
    return found


def theme_status(all_ids: DataFrame, used_ids: DataFrame, previous: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, status, newly_used): used or remaining; with previous, what was used before stays used."""
    used = used_ids.select(id_col).distinct()
    before = previous.select(id_col).distinct() if previous is not None else used.limit(0)
    every = used.union(before).distinct().withColumn("used", F.lit(True))
    old = before.withColumn("old", F.lit(True))
    out = all_ids.select(id_col).distinct().join(every, id_col, "left").join(old, id_col, "left")
    return out.select(id_col, F.when(F.col("used"), "used").otherwise("remaining").alias("status"), (F.coalesce("used", F.lit(False)) & F.col("old").isNull()).alias("newly_used"))


def write_theme(status: DataFrame, path: str) -> None:
    """Two folders, status=used and status=remaining; writing again is idempotent."""
    status.write.mode("overwrite").partitionBy("status").parquet(path)


def link_files(paths: dict[str, str], folder: str) -> list[str]:
    """Put files into a folder by symbolic link, hard link or copy, whichever works first; what is there stays."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    made = []
    for name, source in sorted(paths.items()):
        target = os.path.join(folder, name + Path(source).suffix)
        if not os.path.lexists(target):
            for way in (os.symlink, os.link, shutil.copy2):
                try:
                    way(source, target)
                    break
                except OSError:
                    continue
        made.append(target)
    return made
