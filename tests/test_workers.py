import os
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {repo!r})
from topicvote.functions.stemmer import stem_word
df = spark.createDataFrame([("running",)], "w string")
print("stem:", df.select(stem_word("w")).first()[0])
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)],
        cwd=tmp_path, capture_output=True, text=True, timeout=120,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert "stem: run" in done.stdout, done.stderr[-2000:]


def test_package_is_shipped_once_by_many_threads(spark, monkeypatch):
    from topicvote import session

    made, make = [], session.shutil.make_archive

    def slow(*args):
        time.sleep(0.3)
        made.append(args)
        return make(*args)

    monkeypatch.setattr(session.shutil, "make_archive", slow)
    monkeypatch.setattr(session, "_shipped", set())
    monkeypatch.setattr(spark.sparkContext, "addPyFile", lambda path: None)
    together = threading.Barrier(8)

    def ship(_):
        together.wait()
        session.ship_package(spark)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(ship, range(8)))
    assert len(made) == 1
