"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that cut lineage goes to.

    A cluster names it in ``spark.checkpoint.dir`` and that setting is left alone. Where neither it nor
    a context directory is set, a local master (tests, notebooks) gets a local folder; any other
    would lose what is cut with the machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that losing an executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in no fewer partitions than there are cores.

    Work on texts takes far longer than reading them. Fewer partitions than cores hold so little
    that moving it costs less than idle cores; tables with more of them are left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return with_workers(df.repartition(cores) if df.rdd.getNumPartitions() < cores else df)


_shipped: set[str] = set()


def with_workers(df: DataFrame) -> DataFrame:
    """``df``, once Python workers can import this package.

    They find it by the working folder or PYTHONPATH of a local session. Anywhere else the package is
    handed to Spark, which serves it to the executors, those that join later included.
    """
    context = df.sparkSession.sparkContext
    root = Path(__file__).resolve().parent.parent
    near = Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId not in _shipped and not (near and context.master.startswith("local[")):
        archive = Path(tempfile.mkdtemp(prefix="package-")) / "quiverlane.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "quiverlane").rglob("*.py")):
                z.write(f, f.relative_to(root))
        context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
    return df
