"""Tables that a plan uses several times are written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Written rows go once no table on the driver refers to them, unless the session says otherwise.
CLEANING = "spark.cleaner.referenceTracking.cleanCheckpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where none is set, a local session (tests, one machine) gets a temporary one;
    on a cluster that would be a folder of the driver's machine alone, so it is an
    error there.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    conf = sc._jsc.sc().conf()
    if not conf.contains(CLEANING):
        conf.set(CLEANING, "true")
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
