import os
import subprocess
import sys
from pathlib import Path

import pytest

from quiverlane import runtime

SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from quiverlane.operators.nested import flatten_objects
df = spark.createDataFrame([(1, '{{"a":[{{}}]}}')], "id long, p string")
print("ROWS", flatten_objects(df, "id", "p").count())
spark.stop()
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    root = str(Path(runtime.__file__).resolve().parent.parent)
    env = {**os.environ, "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_spread_and_cut(spark):
    few = spark.range(10).coalesce(1)
    assert runtime.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 9)
    assert runtime.spread(many).rdd.getNumPartitions() == 9
    assert runtime.cut(few).count() == 10
    assert runtime.checkpoint_dir(spark)


def test_no_local_folder_on_a_cluster():
    class Cluster:
        """A session of a cluster that names no shared folder."""

        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Cluster())
