"""What the sources of files have in common: stores by URI, folders of parts that appear when a write is committed."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import WriterCommitMessage


def opened(path: str):
    """The store of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def files(path: str, ending: str = "") -> list[tuple[str, int]]:
    """Path and size of a file, or of the visible files below a folder, by name."""
    from pyarrow import fs

    store, root = opened(path)
    info = store.get_file_info(root)
    found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")) and x.path.endswith(ending))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which the driver and all executors share; local sessions may go without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='traitloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/traitloom-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_remove, spark)
    _left.append(path)
    return path


#: Paths that ``scratch`` gave; what is there goes when the driver ends.
_left: list[str] = []


def _remove(spark: SparkSession) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _left:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM has gone before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what it takes is done once, and lost executors don't undo it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Part(WriterCommitMessage):
    """What a task attempt wrote: files with hidden names, and their names once the write counts."""

    task: int
    names: list[tuple[str, str]]
    rows: int = 0


def hidden(task: int, ending: str) -> tuple[str, str]:
    """A hidden name of this attempt, and the name that it gets."""
    return f".part-{task:06d}-{uuid.uuid4().hex}{ending}", f"part-{task:06d}{ending}"


def publish(path: str, parts: list[Part | None]) -> None:
    """Give the files of the attempts that count their names; what other attempts left stays hidden."""
    store, root = opened(path)
    if files(path):
        raise ValueError("the folder has files; write elsewhere")
    for p in parts:
        for old, new in p.names if p else []:
            store.move(f"{root}/{old}", f"{root}/{new}")


def discard(path: str, parts: list[Part | None]) -> None:
    store, root = opened(path)
    for p in parts:
        for old, _ in p.names if p else []:
            store.delete_file(f"{root}/{old}")
