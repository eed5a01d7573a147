"""Session helpers: local test sessions, and a durable place to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "boutlens", **conf: str) -> SparkSession:
    """A session for tests and the bench.  Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def short_methods(spark: SparkSession) -> None:
    """Let Spark split the code of wide plans into methods that the JVM compiles.

    HotSpot only interprets methods over 8000 bytes of code, and one method per stage holds all expressions of a stage; beyond
    this limit Spark generates them one by one, in parts.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: settings that bound what one task reads of files and of a shuffle; Spark's own are 128m and 64m, over 200 parts of a shuffle
BOUNDS = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}
PARTS, MANY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 1024
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(text: str) -> int:
    digits = text.strip().lower().rstrip("bkmgt")
    return int(digits) * _UNITS[text.strip().lower()[len(digits):]]


@contextlib.contextmanager
def bounded_tasks(spark: SparkSession) -> Iterator[None]:
    """Tasks of jobs that run inside read at most ``BOUNDS``, so their memory doesn't grow with the input; smaller settings stay.

    Else Spark puts a shuffle into few tasks of up to 64 MB, compressed, and a sort, a window and two aggregates hold that unpacked;
    with few parts of a shuffle, into these.  Shuffles are written in ``MANY`` parts, which adaptive plans put together again by size.
    """
    before = {k: spark.conf.get(k) for k in BOUNDS}
    parts = spark.conf.get(PARTS, None)
    try:
        spark.conf.set(PARTS, str(max(MANY, int(parts or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))))
        for k, most in BOUNDS.items():
            if _bytes(before[k]) > most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
        if parts:
            spark.conf.set(PARTS, parts)
        else:
            spark.conf.unset(PARTS)


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is missing (local tests) is a temporary folder used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[app] = tempfile.mkdtemp(prefix="boutlens-")
    return _FALLBACK[app]


def materialize(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where one result feeds several passes: it cuts the lineage, survives the
    loss of executors, and keeps column pruning for the readers.  Runs one job.  With ``partition``, readers that filter
    on these columns open only their folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boutlens/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    # a partitioned table without rows has no file that tells its columns
    return spark.read.schema(df.schema).parquet(path) if partition else spark.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that `materialize` wrote.

    For tables of one step only: everything read from them must be written elsewhere, so that no lost task can ask for
    them again.
    """
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/boutlens/" not in folder:
                raise ValueError(f"not a table of this library: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_STORED: dict[tuple[str, ...], DataFrame] = {}


def stored(spark: SparkSession, label: str, build) -> DataFrame:
    """`materialize` once per session, label and set of input files, for tables that many plans read in several passes.

    The plan is built anew at each call, which is cheap; it names its input files, so input that has grown is not
    answered from an older table.
    """
    df = build()
    key = (spark.sparkContext.applicationId, label, *sorted(df.inputFiles()))
    if key not in _STORED:
        with bounded_tasks(spark):
            _STORED[key] = materialize(df, label.strip("/").replace("/", "_").replace(":", "_"))
    return _STORED[key]


def forget() -> None:
    """Drop the memory of stored tables, so that the next plan builds them again."""
    _STORED.clear()
