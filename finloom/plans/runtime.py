"""Session, lineage and sizing helpers shared by all operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that a checked broadcast may have.
BROADCAST_ROWS = 1_000_000
#: Largest number of bytes of its values.
BROADCAST_BYTES = 64 << 20


def session(app: str = "finloom", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only on a local master where it is unset,
    as in tests. On a cluster without the setting this is an error: no folder of one machine would do."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        where = tempfile.mkdtemp(prefix="finloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def few(df: DataFrame, groups: DataFrame, per_group: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``per_group`` rows for each row of ``groups`` and a count of
    ``groups`` (cheap, where ``df`` is not) proves that few enough."""
    return F.broadcast(df) if per_group * groups.count() <= rows else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, wherever they run: it is zipped into the shared folder and
    added to the application, once. Operators called without this need the package on the workers' PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    hadoop = sc._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark).rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(sc.applicationId)


_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, statistics are exact and
    the loss of an executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a query writes and reads; ``release`` deletes it."""
    _WRITTEN.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def release(spark: SparkSession, indexes: bool = False) -> None:
    """Delete the tables that ``stored`` has written and the files of queries; results that still read them must have
    been written before. With ``indexes`` also those that were kept for further queries."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [_WRITTEN.pop() for _ in range(len(_WRITTEN))]
    if indexes:
        gone += _KEPT.values()
        _KEPT.clear()
    for path in map(hadoop.Path, gone):
        path.getFileSystem(conf).delete(path, True)


_KEPT: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder in the shared folder that ``build`` has filled under this name, once an application: for indexes that
    many queries ask. It is built anew if it has gone."""
    hadoop, key = spark.sparkContext._jvm.org.apache.hadoop.fs, (spark.sparkContext.applicationId, name)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = _KEPT.get(key)
    if there is None or not hadoop.Path(f"{there}/_built").getFileSystem(conf).exists(hadoop.Path(f"{there}/_built")):
        there = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        build(there)
        hadoop.Path(there).getFileSystem(conf).create(hadoop.Path(f"{there}/_built")).close()
        _KEPT[key] = there
    return there


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``rows`` rows of together at most ``size``
    bytes, else as it is (a shuffle join)."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    width = [F.coalesce(wide[t](F.col(f"`{c}`")), F.lit(0)) if t in wide else F.lit(8) if not t.startswith(("array", "map", "struct")) else F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) for c, t in df.dtypes]
    n, b = df.limit(rows + 1).select(sum(width, F.lit(0)).cast("bigint").alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= size else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition only where a scan has fewer splits than the cluster has cores (one small file). A plan with a shuffle
    is left as it is: asking for its partitions would run it."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
