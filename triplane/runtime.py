"""What every operator needs of the session: tables, shared storage, durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the session names none (tests, notebooks on one machine) a temporary folder is made and set for this
    session, so that later calls agree on it.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="triplane-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


#: Spark's setting to remove an execution's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, tuple[SparkSession, str]] = {}


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = (spark, f"{shared_dir(spark)}/triplane-{app}-{uuid.uuid4().hex[:8]}")
    return _roots[app][1]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage with files that outlive any executor, keeps column pruning for the readers, and gives
    later joins a measured size. Once it is written, the shuffle files it came from are of no use and are removed.
    :func:`discard` removes one such table, :func:`release` all that a session wrote.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize`; nothing that is still to be computed may read them."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def _delete(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table the session wrote; results not yet computed from them are lost."""
    _, root = _roots.pop(spark.sparkContext.applicationId, (None, None))
    if root:
        _delete(spark, root)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_roots.values()):
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


def _file(path: str):  # noqa: ANN202
    """A Hadoop path and its file system, or None for a plain local path."""
    session = SparkSession.getActiveSession()
    if "://" not in path and not path.startswith(("file:", "hdfs:")) or session is None:
        return None
    p = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()), session.sparkContext._jvm


def write_text(path: str, text: str, append: bool = False) -> None:
    """A small text file, on any storage of the session when ``path`` is a URI, else a local file."""
    at = _file(path)
    if at is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("a" if append else "w", encoding="utf-8") as f:
            f.write(text)
        return
    p, fs, _ = at
    if append:
        text = (read_text(path) if fs.exists(p) else "") + text
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str, missing: str | None = None) -> str:
    """What :func:`write_text` wrote; ``missing``, if given, where there is no such file."""
    at = _file(path)
    if at is None:
        if missing is not None and not Path(path).exists():
            return missing
        return Path(path).read_text(encoding="utf-8")
    p, fs, jvm = at
    if missing is not None and not fs.exists(p):
        return missing
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that they need no copy of it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="triplane-code-")) / "triplane.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, Path("triplane") / f.relative_to(here))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
