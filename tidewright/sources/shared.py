"""Tables in the folder that a cluster shares, for cutting lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back; where that is unset, a temporary folder serves a local master only."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidewright-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/tidewright/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
