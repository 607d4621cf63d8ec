"""Stages written to the folder that all executors share.

A stage cuts lineage, so that losing an executor never recomputes what came before, and fixes
values that a second run of the same plan could give differently (row identifiers above all).
Stages are Parquet rather than RDD checkpoints: columnar, compressed, with statistics.

A stage is kept as long as any DataFrame that reads it. The session refers to it by the index of its files, which every plan
over them holds; once nothing else does, the files are removed when the next stages are written, or by :func:`sweep`.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
#: Stages that may be there before a new one asks the JVM to find out which are still in use; if many are, twice as many as are left.
MANY = 64
_most = MANY
#: Session, path, and a weak reference to the index of the files.
_written: list[tuple[SparkSession, str, object]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else its context's checkpoint folder. Where neither is set, a local session gets a temporary folder.

    Whoever names a ``file://`` folder on a cluster says that all its machines share it.
    """
    folder = spark.conf.get(_FOLDER, None) or _own.get(spark.sparkContext.applicationId)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if (chosen := context.getCheckpointDir()).isDefined():
            return chosen.get().rstrip("/")
        if not context.isLocal():
            raise RuntimeError(f"{_FOLDER} must name a folder that all executors share")
        folder = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="platewise-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads the files at ``path`` alone; they are removed when no DataFrame reads them any more, at the latest when Python ends."""
    spark = df.sparkSession
    if not _written:
        # Registered now, so that it runs before the JVM is ended.
        atexit.unregister(clear)
        atexit.register(clear)
    index = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _written.append((spark, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return df


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    sweep(collect=len(_written) >= _most)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return kept(spark.read.schema(df.schema).parquet(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; what isn't a local folder is then its owner's to clear
        if "://" not in path or path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _in_use(index: object) -> bool:
    try:
        return index.get() is not None
    except Exception:  # of a session that has ended
        return False


def sweep(collect: bool = True) -> None:
    """Remove the stages that no DataFrame reads any more. With ``collect``, garbage is collected first, which finds all of them."""
    global _most
    if collect and _written:
        gc.collect()
        with suppress(Exception):  # of a session that has ended
            _written[-1][0].sparkContext._jvm.System.gc()
    for entry in [e for e in _written if not _in_use(e[2])]:
        _written.remove(entry)
        _remove(*entry[:2])
    if collect:
        _most = max(MANY, 2 * len(_written))


def clear() -> None:
    """Remove all stages written so far. Results that were not yet consumed can't be after this."""
    while _written:
        _remove(*_written.pop()[:2])
