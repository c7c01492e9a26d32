"""Tables that a loop over the data reads again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed where the session names ``spark.checkpoint.dir``, else persisted.

    A checkpoint cuts the lineage and outlives lost executors; what is persisted is computed anew from its
    lineage where an executor is lost.
    """
    sc = df.sparkSession.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined() and (where := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(where)
        held = sc._jsc.sc().getCheckpointDir()
    return df.checkpoint() if held.isDefined() else df.persist()
