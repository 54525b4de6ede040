"""Themes: which documents of a collection a line of research has used, kept as snapshots."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import link_files, theme_status

#: Version of the manifest; snapshots that are kept besides the current one.
META_VERSION, KEEP = 1, 1


class Themes:
    """A folder of themes on a file system that all machines share: <theme>/snapshot-<id>/status=used|remaining and <theme>/meta.json.

    A write makes a new snapshot, whole, before it replaces the manifest in one step; a reader follows the manifest. So a failed write, or one
    that is under way, leaves the old snapshot readable, and a document that left is in no later snapshot. Only counts are in the
    manifest: ids stay in the tables, however many they are."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def meta(self, theme: str) -> dict:
        """The manifest; empty if there is none or it can't be read."""
        try:
            found = json.loads(Path(self._path(theme, "meta.json")).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def write_meta(self, theme: str, meta: dict) -> None:
        """Replaces the manifest in one step."""
        Path(self._path(theme)).mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self._path(theme), suffix=".tmp", delete=False, encoding="utf-8") as f:
            json.dump(meta, f, indent=2, ensure_ascii=False)
        os.replace(f.name, self._path(theme, "meta.json"))

    def open(self, theme: str, all_ids: DataFrame, used_ids: DataFrame, resume: bool = True) -> dict:
        """Materialise a theme from the ids (doc_id) of its evidence, and return its manifest.

        Used are those of used_ids that are in all_ids. With resume, newly_used are those that the last snapshot didn't have
        as used, else all. Null ids don't count; an empty collection gives an empty snapshot. Writing the same again gives the same
        rows in a new snapshot."""
        known = all_ids.select("doc_id").where("doc_id IS NOT NULL")
        used = used_ids.select("doc_id").join(known, "doc_id", "left_semi")
        before = self.read(theme).where("status = 'used'").select("doc_id") if resume and self.meta(theme) else None
        status = theme_status(known, used)
        if before is not None:
            old = before.withColumn("old", F.lit(True))
            status = status.join(old, "doc_id", "left").withColumn("newly_used", F.col("newly_used") & F.col("old").isNull()).drop("old")
        name = f"snapshot-{uuid.uuid4().hex}"
        status.write.partitionBy("status").parquet(self._path(theme, name))
        written = self.spark.read.schema("doc_id " + all_ids.schema["doc_id"].dataType.simpleString() + ", newly_used boolean, status string").parquet(self._path(theme, name))
        n = written.agg(F.count_if(F.col("status") == "used").alias("used"), F.count_if(F.col("status") == "remaining").alias("remaining"), F.count_if("newly_used").alias("new")).first()
        last = self.meta(theme)
        meta = {
            "meta_version": META_VERSION, "theme": theme, "snapshot": name, "id_type": all_ids.schema["doc_id"].dataType.simpleString(), "used_doc_ids_count": n["used"],
            "remaining_doc_ids_count": n["remaining"], "newly_used_count": n["new"], "resume": resume, "previous": ([last["snapshot"]] if last.get("snapshot") else [])[:KEEP],
        }
        self.write_meta(theme, meta)
        return meta

    def follow_up(self, theme: str, all_ids: DataFrame, more_ids: DataFrame, resume: bool = True) -> dict:
        """Open the theme again with further used documents besides those it has. KeyError if it was never opened."""
        used = self.read(theme).where("status = 'used'").select("doc_id")
        return self.open(theme, all_ids, used.union(more_ids.select("doc_id")).distinct(), resume)

    def read(self, theme: str, snapshot: str | None = None) -> DataFrame:
        """(doc_id, newly_used, status) of the current snapshot, or of a kept one. KeyError without it."""
        meta = self.meta(theme)
        name = snapshot or meta.get("snapshot")
        if not name or not os.path.isdir(self._path(theme, name)):
            raise KeyError(theme if not name else f"{theme}/{name}")
        return self.spark.read.schema(f"doc_id {meta.get('id_type', 'string')}, newly_used boolean, status string").parquet(self._path(theme, name))

    def prune(self, theme: str) -> list[str]:
        """Delete the snapshots that the manifest doesn't name: older ones and those of failed writes. Not while one is being written."""
        meta = self.meta(theme)
        kept = {meta.get("snapshot"), *meta.get("previous", [])}
        gone = sorted(p.name for p in Path(self._path(theme)).glob("snapshot-*") if p.is_dir() and p.name not in kept) if meta else []
        for name in gone:
            shutil.rmtree(self._path(theme, name))
        return gone

    def link(self, theme: str, paths: DataFrame, status: str = "used") -> list[str]:
        """Files (doc_id, path) of a theme's used or remaining documents in a folder of that name, by links where these work. Links of
        documents that left are removed. For collections of files that one machine looks through; tables need none of it."""
        held = self.read(theme).where(F.col("status") == status).join(paths, "doc_id")
        wanted = {str(r["doc_id"]): r["path"] for r in held.select("doc_id", "path").toLocalIterator()}
        folder = self._path(theme, status)
        made = link_files(wanted, folder)
        for found in Path(folder).iterdir():
            if str(found) not in made:
                found.unlink()
        return made

    def _path(self, theme: str, *parts: str) -> str:
        return os.path.join(self.folder, theme, *parts)
