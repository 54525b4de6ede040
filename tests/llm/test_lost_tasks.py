"""Tasks that fail once and are repeated, in a session of their own that allows it: the same rows."""

import subprocess
import sys

JOB = """
import sys, random
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
from evidentia.llm import common, exact_dedup, ngram_join, quality, spelling
common.HEAVY = exact_dedup.HEAVY = 5  # hot keys everywhere
rng = random.Random(1)
words = ["word%d" % i for i in range(40)]
texts = [" ".join(rng.choices(words, k=30)) + "\\n" + "a line that is shared" for _ in range(60)]
rows = [(i, texts[i % 60] + (" tail" if i % 7 == 0 else ""), "ab"[i % 2]) for i in range(240)]
plain = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
def fail_once(batches):
    from pyspark import TaskContext
    t = TaskContext.get()
    for n, b in enumerate(batches):
        yield b
    if t.attemptNumber() == 0:
        raise RuntimeError("lost")
failing = plain.mapInPandas(fail_once, plain.schema)
for job in (lambda d: exact_dedup.exact_groups(d).select("doc_id", "keep_id", "group_size", "kept"), ngram_join.ngram_components, quality.judge, lambda d: spelling.group_variants(spelling.vocabulary(spelling.occurrences(d, least=4)))):
    one, two = (sorted(map(repr, job(d).collect())) for d in (plain, failing))
    assert one == two and one, (one[:3], two[:3])
print("SAME")
"""


def test_repeated_tasks_give_the_same_rows(tmp_path):
    repo = __file__.rpartition("/tests/")[0]
    said = subprocess.run([sys.executable, "-c", JOB.format(repo=repo, shared=str(tmp_path))], capture_output=True, text=True, timeout=600)
    assert "SAME" in said.stdout, said.stderr[-3000:]
