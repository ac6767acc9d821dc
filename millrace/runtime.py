"""What the library needs from the session: the shared folder and the scale limits."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# A plan whose estimated input is below this size fits one task whatever its key
# distribution, so no key can be too heavy and no extra pass is needed to look for one.
SMALL_BYTES_CONF = "spark.millrace.smallBytes"
SMALL_BYTES = 64 * 1024 * 1024

# Most rows of one key that a single sort-and-scan task should be given.
ROWS_PER_TASK_CONF = "spark.millrace.rowsPerTask"
ROWS_PER_TASK = 4_000_000


@dataclass(frozen=True)
class Limits:
    small_bytes: int
    rows_per_task: int

    @classmethod
    def of(cls, spark: SparkSession) -> "Limits":
        return cls(
            int(spark.conf.get(SMALL_BYTES_CONF, str(SMALL_BYTES))),
            int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK))),
        )


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for the plan of ``df`` (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its executor, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.millrace.localRoot", own)
    return own


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    root = spark.conf.get("spark.millrace.localRoot", None) or shared_root(spark)
    return f"{root}/millrace/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input comes in far fewer pieces than there are cores.

    For heavy work per row (tokens, messages) over a small number of files that cannot be
    split.  A table of many files has enough pieces and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df  # no plain scan: its shuffle decides
    pieces = execution.toRdd().getNumPartitions()
    return df.repartition(cores) if pieces * 2 <= cores else df


def pin(df: DataFrame, purpose: str = "pinned") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and fixes values that depend on the
    physical layout.  Parquet keeps column pruning for the passes that follow.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    at, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def put_file(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that is there whole or not at all; False, and no change, if it is there already.

    It is written under another name and renamed.  One writer at a time.
    """
    at, fs = _file_system(spark, path)
    if fs.exists(at):
        return False
    own = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(own, at))


def get_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder and its subfolders, relative to it, sorted; none if there is no such folder."""
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return []
    root, found, each = fs.makeQualified(at).toUri().getPath().rstrip("/"), [], fs.listFiles(at, True)
    while each.hasNext():
        found.append(each.next().getPath().toUri().getPath()[len(root) + 1 :])
    return sorted(found)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, in place of the one that is there; folders are made as needed.

    Not every file system replaces on renaming, so the old file goes first; should the job end
    there, ``source`` is still in its place.
    """
    at, fs = _file_system(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to):
        fs.delete(to, False)
    elif not fs.exists(to.getParent()):
        fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"cannot rename {source} to {target}")
