"""Cutting the lineage of tables that rounds of joins build on."""

from __future__ import annotations

import re
import tempfile
import threading

from pyspark.sql import DataFrame

_lock = threading.Lock()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    with _lock:
        if not context.getCheckpointDir():
            named = context.getConf().get("spark.checkpoint.dir")
            if not named and not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orbitway-"))
    # An eager checkpoint computes its last stage twice, to count and to write; this one looks at a first row instead of counting.
    written = df.checkpoint(eager=False)
    written.take(1)
    return written.toDF(*written.columns)  # columns of its own: tables that were cut from one another may be joined and put under each other
