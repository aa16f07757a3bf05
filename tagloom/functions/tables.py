"""Cutting a table's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(session: SparkSession) -> str:
    if session.sparkContext.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not session.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        session.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return session.sparkContext.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows from the folder that spark.checkpoint.dir names, which driver and executors share; a temporary one only where it is unset and all runs on one machine."""
    _folder(rows.sparkSession)
    return rows.checkpoint()


def new_folder(session: SparkSession) -> str:
    """A path in that folder that nobody else uses; it isn't there yet."""
    return f"{_folder(session)}/{uuid.uuid4().hex}"
