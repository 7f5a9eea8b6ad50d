"""Session helpers: a local session for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Methods above 8,000 bytes of bytecode are not compiled by the JVM: let Spark split those stages instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "smelter", cores: int | str = "*", shuffle_partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and bench. On a cluster use the session the cluster provides."""
    if shuffle_partitions is None:
        shuffle_partitions = os.cpu_count() or 8
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a temporary folder taken instead;
    a session with a non-local master must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="smelter-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df):
    """Cut the lineage with a reliable checkpoint in the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_frame(spark: SparkSession, rows, schema):
    """A DataFrame of driver-side metadata rows. It becomes a local relation: its size is known to the optimizer
    and no job is needed to read it."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = [f.name for f in schema.fields]

    def plain(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.MapType):
            return list(value.items())
        if isinstance(kind, T.ArrayType):
            return [plain(v, kind.elementType) for v in value]
        if isinstance(kind, T.StructType):
            named = value.asDict() if isinstance(value, T.Row) else value
            named = dict(zip(kind.names, named)) if isinstance(named, (tuple, list)) else named
            return {f.name: plain(named[f.name], f.dataType) for f in kind.fields}
        return value

    table = pa.Table.from_pylist(
        [{n: plain(v, f.dataType) for n, v, f in zip(fields, row, schema.fields)} for row in rows],
        schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def pinned(df):
    """Compute a metadata-sized result (a few rows per column, table or panel) once and keep it on the driver."""
    return small_frame(df.sparkSession, df.collect(), df.schema)
