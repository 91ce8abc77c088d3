"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """Writes the rows to the folder of ``spark.checkpoint.dir`` and reads them back.

    Several later steps then read a small table: plans stay small, nothing is computed twice, and a lost executor loses
    nothing. Without that setting (tests) a temporary folder serves.
    """
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/steps/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
