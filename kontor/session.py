"""Sessions and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "kontor", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine (tests, bench); on a cluster the caller's own session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KONTOR_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session; Spark copies it to every executor."""
    sc = spark.sparkContext
    if not getattr(sc, "_kontor_shipped", False):
        sc._kontor_shipped = True
        home = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kontor-')}/kontor", "zip", home.parent, home.name)
        sc.addPyFile(made)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``. Only a session on one machine may leave it unset; it gets a temporary
    one, cleaned with the session. A cluster without a shared folder is an error, as no executor could read another's."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kontor-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; a frame that was cut already is left as it is.

    Used where a result is read more than once or a loop would grow its plan. The copy is on storage that
    all executors share, so losing an executor costs nothing but its running tasks. The bytes written are kept beside
    the frame (see :func:`held_bytes`).
    """
    if held_bytes(df) is not None:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    done._kontor_bytes = written_bytes(done)
    return done


def anew(df: DataFrame) -> DataFrame:
    """A frame from :func:`cut` without the estimates it inherits. A checkpoint keeps the estimated size of its plan, and
    that of a join is the product of its sides; a loop that joins its last result with itself so multiplies the digits of
    that number each round, until the driver has no memory for it."""
    plan = df._jdf.queryExecution().analyzed()
    done = DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.rdd(), df._jdf.schema(), False), df.sparkSession)
    done._kontor_bytes = held_bytes(df)
    return done


def release(spark: SparkSession) -> None:
    """Let go of what ended steps leave behind. Spark drops their shuffle files, broadcasts and checkpoints only once the
    driver's collector has found their frames unused, which a driver with room left may never do; its heap grows instead.
    For the ends of steps after which much is unused; results don't depend on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_bytes(df: DataFrame) -> int | None:
    """Bytes that a frame returned by :func:`cut` takes in the shared folder; null for other frames."""
    return getattr(df, "_kontor_bytes", None)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a checkpointed frame, from the file system, without a job."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    path = jvm.org.apache.hadoop.fs.Path(file.get())
    return path.getFileSystem(conf).getContentSummary(path).getLength()
