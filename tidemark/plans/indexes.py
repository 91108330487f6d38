"""Search indexes that are built once for a state of their table and then read by every search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.sources import sinks
from tidemark.sources.scratch import scratch_dir

_SAVED: dict[tuple, str] = {}


def table_state(t, name: str) -> tuple:
    """Path, size and time of each file of a table: another state asks for another index."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
    fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    files = fs.listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def saved_folder(t, kind: str, write, table: str) -> str:
    """The folder of an index over a table; ``write(t, folder)`` fills it where this session has not done so yet."""
    key = (t.spark.sparkContext.applicationId, kind, table_state(t, table))
    if key not in _SAVED:
        path = f"{scratch_dir(t.spark, 'index')}/{kind}"
        write(t, path)
        _SAVED[key] = path
    return _SAVED[key]


def saved_index(t, kind: str, build, table: str = "documents") -> dict[str, DataFrame]:
    """The parts of an index over a table; ``build(t)`` gives them where this session has not saved them yet."""
    path = saved_folder(t, kind, lambda t, to: sinks.save_index(build(t), to, {"type": kind}), table)
    return sinks.load_index(t.spark, path)[0]
