import os
import subprocess
import sys
from pathlib import Path

import pytest

from strandloom import storage

ROOT = Path(__file__).resolve().parents[1]

CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", __spark_entry__.queries()["fastq_trim_se"](spark, "/root/testdata/sf0.001").count())
"""


GUARD = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
sys.modules["xxhash"] = None
import __spark_entry__
print("queries", len(__spark_entry__.queries()) > 100, any(q.startswith("op") for q in __spark_entry__.queries()))
"""


def test_queries_without_a_library_of_the_training_data():
    done = subprocess.run([sys.executable, "-c", GUARD], capture_output=True, text=True, timeout=60)
    assert "queries True False" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_workers_get_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3306" in done.stdout, done.stderr[-2000:]
