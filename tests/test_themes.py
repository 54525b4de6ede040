"""Themes as snapshots with a manifest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evidentia.sources.themes import Themes


def rows(df):
    return {(r["doc_id"], r["status"], r["newly_used"]) for r in df.collect()}


def test_open_follow_up_and_prune(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    themes = Themes(spark, str(tmp_path))
    assert themes.meta("t") == {} and themes.prune("t") == []
    with pytest.raises(KeyError):
        themes.read("t")
    one = themes.open("t", ids(1, 2, 3, 4), ids(2, 2, 9))
    assert (one["used_doc_ids_count"], one["remaining_doc_ids_count"], one["newly_used_count"]) == (1, 3, 1) and themes.meta("t") == one
    assert rows(themes.read("t")) == {(1, "remaining", False), (2, "used", True), (3, "remaining", False), (4, "remaining", False)}
    two = themes.follow_up("t", ids(1, 2, 3), ids(3))  # 4 left the collection
    assert rows(themes.read("t")) == {(1, "remaining", False), (2, "used", False), (3, "used", True)}
    assert len(rows(themes.read("t", one["snapshot"]))) == 4 and two["previous"] == [one["snapshot"]]
    again = themes.open("t", ids(1, 2, 3), ids(2, 3))
    assert again["newly_used_count"] == 0 and themes.open("t", ids(1, 2, 3), ids(2, 3), resume=False)["newly_used_count"] == 2
    assert len(themes.prune("t")) == 2 and len(rows(themes.read("t"))) == 3
    assert themes.open("empty", ids(), ids(1))["used_doc_ids_count"] == 0 and themes.read("empty").count() == 0
    with_null = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert rows(Themes(spark, str(tmp_path / "n")).read("x")) == {(1, "used", True)} if Themes(spark, str(tmp_path / "n")).open("x", with_null, with_null) else False


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    themes = Themes(spark, str(tmp_path))
    all_ids = spark.range(5).withColumnRenamed("id", "doc_id")
    themes.open("t", all_ids, all_ids.where("doc_id < 2"))
    before, held = themes.meta("t"), rows(themes.read("t"))
    bad = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("doc_id"))
    with pytest.raises(Exception, match="lost"):
        themes.open("t", all_ids, bad)
    assert themes.meta("t") == before and rows(themes.read("t")) == held
    (tmp_path / "t" / "meta.json").write_text("{broken")
    assert themes.meta("t") == {}
    themes.write_meta("t", before)
    assert json.loads((tmp_path / "t" / "meta.json").read_text()) == before and rows(themes.read("t")) == held


def test_links_follow_the_snapshot(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(str(i))
    paths = spark.createDataFrame([(i, str(tmp_path / f"{i}.txt")) for i in range(3)], "doc_id long, path string")
    themes, ids = Themes(spark, str(tmp_path / "themes")), paths.select("doc_id")
    themes.open("t", ids, ids.where("doc_id < 1"))
    assert [os.path.basename(p) for p in themes.link("t", paths, "remaining")] == ["1.txt", "2.txt"]
    themes.follow_up("t", ids, ids.where("doc_id = 1"))
    assert [os.path.basename(p) for p in themes.link("t", paths, "remaining")] == ["2.txt"] and os.listdir(tmp_path / "themes" / "t" / "remaining") == ["2.txt"]
    assert (tmp_path / "themes" / "t" / "remaining" / "2.txt").read_text() == "2"
