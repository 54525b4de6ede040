"""Verification writes neither facts nor words between its steps."""

import pytest

import __spark_entry__
from evidentia.operators import attribution

LONG = " ".join(f"word{i} is number {i}." for i in range(1500))


@pytest.fixture
def written(monkeypatch):
    """The rows and columns of what verification writes."""
    seen, saved = [], attribution.saved
    monkeypatch.setattr(attribution, "saved", lambda df, name: seen.append((df.count(), df.columns)) or saved(df, name))
    return seen


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, LONG), (2, "It is so. It is not so."), (4, "It is new. It is number 7."), (8, "Alone it stands."), (5, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_verify_decision_writes_no_facts(spark, folder, written):
    got = {r["fact_id"]: (r["verified"], r["method"]) for r in __spark_entry__.queries()["verify_decision"](spark, folder).collect()}
    assert len(got) == 1506 and got["1:0"] == got["1:1499"] == got["2:1"] == (True, "local_exact") and got["4:0"] == got["8:0"] == (False, "none")
    assert written == [(1, ["doc", "parts"])]  # the one document of more facts than a row takes


def test_report_stats_writes_no_facts(spark, folder, written):
    got = {r["doc_id"]: r["verification_rate"] for r in __spark_entry__.queries()["report_stats"](spark, folder).collect()}
    assert got == {1: "1500/1500 = 100%", 2: "2/2 = 100%", 4: "0/2 = 0%", 8: "0/1 = 0%", 9: "0/1 = 0%"}
    assert written == [(1, ["doc", "parts"])]
