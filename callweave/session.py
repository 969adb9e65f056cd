"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, a temporary one if all runs on one machine (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="callweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and held in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: For wide rows: row groups and pages are closed by their bytes, not after a hundred rows. Readers hold a row group, unpacked.
WIDE_ROWS = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, **options) -> DataFrame:
    """df as a compressed table in the shared folder, with options of the writer: for wide rows, of which later steps read few columns."""
    path = new_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, held: list[str]) -> DataFrame:
    """df as a tightly compressed table in the shared folder; held gets its folder, for who removes it."""
    folder = new_folder(df.sparkSession)
    held.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: The driver holds what is broadcast. Files of long strings grow manyfold when they are read, so that Spark's limit, by size of files, is too high for them.
BROADCAST = 1 << 20


@contextlib.contextmanager
def bounded(spark: SparkSession, broadcast: int | None = BROADCAST) -> Iterator[None]:
    """What is written within leaves no shuffle files behind when it is done, and broadcasts no tables of larger files; settings are as before at its end."""
    mode, limit = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.autoBroadcastJoinThreshold"
    own = {mode: "true"} if spark.conf.isModifiable(mode) else {}
    if broadcast is not None:
        jvm = spark.sparkContext._jvm
        own[limit] = str(min(broadcast, jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit))))
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Tables of at most so many rows are not worth dealing by a key.
DEAL = 2_000_000


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt by key: joins on the key shuffle the other side only, however often they are made."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"callweave_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("path", new_folder(spark)).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files lie in a folder of their own
    return out


def dealt(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """df as a table in the shared folder, dealt by key where it is large, and how many rows it has."""
    folder = new_folder(df.sparkSession)
    n = added(df, folder)
    plain = df.sparkSession.read.schema(df.schema).parquet(folder)
    if n <= DEAL:
        return plain, n
    out = bucketed(plain, key)
    removed(df.sparkSession, folder)
    return out, n


#: Folders of tables that this process has written and not removed, in order.
MADE: list[str] = []


def new_folder(spark: SparkSession) -> str:
    MADE.append(f"{shared_dir(spark).rstrip('/')}/callweave-{uuid.uuid4().hex}")
    return MADE[-1]


def removed(spark: SparkSession, folder: str) -> None:
    """The folder and what is in it go, if they are there; whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in MADE:
        MADE.remove(folder)


@contextlib.contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are removed at its end; results that read them must be written elsewhere, or collected, before."""
    before = len(MADE)
    try:
        yield
    finally:
        for folder in MADE[before:]:
            removed(spark, folder)


def added(df: DataFrame, folder: str) -> int:
    """How many rows df has, all of which are now in the folder as well; they are counted as they are written."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("append").option("compression", "zstd").parquet(folder)
    return rows.get["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
