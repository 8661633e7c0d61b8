"""Queries on executors that have no copy of the package: a session that is started in an empty folder, with a clean path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.sparkContext.setCheckpointDir(sys.argv[2])
sys.path.insert(0, sys.argv[1])  # the driver's path only
import pyspark.sql.functions as F
def here(_):
    try:
        import quillmark
        return True
    except ImportError:
        return False
from pyspark import cloudpickle
assert not any(spark.sparkContext.parallelize([1, 2], 2).map(here).collect()), "workers have the package"
failed = {}
exec(sys.argv[3])
for name, query in found.items():
    try:
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    except Exception as e:
        failed[name] = str(e)[-300:]
print("FAILED", sorted(failed), failed)
print("RAN", len(found))
"""


def run_from_empty_folder(tmp_path, choice):
    """Run the queries that ``choice`` (code that sets ``found``) names; the output."""
    empty = tmp_path / "empty"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path / "checkpoints"), choice], cwd=empty, env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED [] {}" in done.stdout, done.stdout[-3000:] + done.stderr[-2000:]
    return done.stdout


def test_every_query_with_python_workers_runs_without_the_package(tmp_path):
    names = ["repetition_score", "slop_score", "slop_score_own_lists", "programmatic_score", "p_values", "phrase_hits", "pattern_answers", "mixed_score_maps", "summary_rows", "leaderboard"]
    out = run_from_empty_folder(tmp_path, f"from quillmark.plans import catalog\nfound = {{n: catalog.queries()[n] for n in {names}}}")
    assert f"RAN {len(names)}" in out


def test_files_calls_and_conversations_without_the_package(tmp_path):
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "a.yaml").write_text('{"task_id": "t_001"}')
    code = f"""
from quillmark.operators import conversations, generate
from quillmark.sources import ingest
def files(spark, sf):
    return ingest.documents(spark, {str(tmp_path / "results")!r})
def calls(spark, sf):
    work = spark.createDataFrame([("g", "a b")], "generation_id string, prompt string")
    assert generate.call_model(work, generate.stub_client).first().output == "b a"
    return conversations.run(work, generate.stub_client, conversations.planning(F.lit("go")), {str(tmp_path / "log")!r}, F.array(conversations.turn("user", "p", F.col("prompt"))))
found = {{"files": files, "calls": calls}}
"""
    assert "RAN 2" in run_from_empty_folder(tmp_path, code)
