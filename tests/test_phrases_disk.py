"""Key phrases of all sentences take one shuffle: the documents' lines."""

import __spark_entry__


def test_key_phrases_shuffle_lines_once(spark, tmp_path):
    rows = [(d, "Graph ranking of deep models, a text model. The deep text model ranks.\nAnother line of the graph text: deep models.") for d in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["key_phrases"](spark, str(tmp_path))
    assert got.count() > 0 and got.groupBy("doc_id").count().select("count").distinct().count() == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
