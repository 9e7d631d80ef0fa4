"""Session and table helpers shared by the library."""

from __future__ import annotations

import os
import sys
import tempfile

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of this library travel to the executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["evidra"])


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidra")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (a file or a folder, in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint that every executor can read.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary folder is made; a cluster without the setting is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.mkdtemp(prefix="evidra-"), "checkpoints"))
    done = df.checkpoint(eager=True)
    trimmed(df.sparkSession)
    return done


def trimmed(spark: SparkSession) -> bool:
    """Give the native memory that the driver's JVM has freed back to the system; False where the JVM has no such command.

    Each plan compiles code and packs its shuffles' statuses in native memory, in threads of its own; what they free
    stays with the C library's arenas, and over many plans that is more than what the driver has in use.
    """
    jvm = spark.sparkContext._jvm
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class is closed to the bridge; its interface is open.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True
