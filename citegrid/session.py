"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DateType, DecimalType, MapType, StructType, TimestampType


def build_session(app: str = "citegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. `conf` keys use __ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local session, all of whose tasks run on this
    machine, gets a folder of its own that is removed when the program ends; a cluster has to set it."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="citegrid-")
        atexit.register(shutil.rmtree, have, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(have)
    return have


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with the advice to broadcast it if it is counted to have at most `most` rows; else df, and the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def few(df: DataFrame, most: int) -> list[Row]:
    """The rows of a report of at most `most` rows. More rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def local(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows as a table whose size the planner knows, so that joins send it to the other side."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if any(isinstance(f.dataType, (ArrayType, MapType, StructType, DateType, TimestampType, DecimalType)) for f in kinds.fields):
        return spark.createDataFrame(rows, kinds)
    arrow = to_arrow_schema(kinds)
    cols = list(zip(*rows)) if rows else [()] * len(kinds.fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow), kinds)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """A report of at most `most` rows, computed once and held by the driver as a local table."""
    return local(df.sparkSession, few(df, most), df.schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder. Later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors through Spark's own file server, once per application, so that their Python finds it wherever
    they run."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="citegrid-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
