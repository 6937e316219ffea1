"""Tables that a plan reads several times, worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(table: DataFrame) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local session may leave it out, and gets a temporary folder."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = table.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cloakwork-"))
    return context.getCheckpointDir()


def kept(table: DataFrame) -> DataFrame:
    """The table from a checkpoint, partitioned as it was; it survives lost executors."""
    _folder(table)
    return table.checkpoint()


def stored(table: DataFrame) -> DataFrame:
    """The table from Parquet beside the checkpoints: for very many narrow rows, which a checkpoint would hold uncompressed,
    and of which readers take some columns each."""
    path = f"{_folder(table)}/stored-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
