"""Reuse of written tables across sessions (S5): a manifest in the shared folder.

An entry is a table with a few values, kept under its name and a digest of what it
was made from: the input files (path, time, length) and parameters. A rewritten
input has another digest, so an old table is never served for it. An entry is
written to a folder of its own and committed by one rename, so a reader finds a
whole entry or none, also when two sessions write at once or one is lost. Old
entries are removed when a new one of that name is committed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from canvass.session import checkpoint_dir

#: Entries of a name that stay, and the seconds that an older one stays at least (a session may still read it).
KEEP = 4
KEEP_SECONDS = 24 * 3600


def root(spark: SparkSession) -> str:
    """The manifest's folder, beside the sessions' own checkpoint folders."""
    own = checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or own.rstrip("/").rsplit("/", 1)[0]).rstrip("/") + "/canvass-reuse"


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> list:
    """[path, time, length] of every file under the paths, in order; no file is opened."""
    found = []
    for path in paths:
        p, fs = _path(spark, path)
        files = fs.listFiles(p, True) if fs.getFileStatus(p).isDirectory() else None
        while files is None or files.hasNext():
            f = fs.getFileStatus(p) if files is None else files.next()
            found.append([f.getPath().toString(), f.getModificationTime(), f.getLen()])
            if files is None:
                break
    return sorted(found)


def _entry(spark: SparkSession, name: str, inputs: Sequence[str], params) -> str:
    made_from = json.dumps([fingerprint(spark, inputs), params], sort_keys=True)
    return f"{root(spark)}/{name}/{hashlib.sha256(made_from.encode()).hexdigest()}"


def find(spark: SparkSession, name: str, inputs: Sequence[str], params=None) -> tuple[DataFrame, dict] | None:
    """The committed table and values made from just these inputs and parameters."""
    entry = _entry(spark, name, inputs, params)
    p, fs = _path(spark, entry)
    if not fs.exists(p):
        return None
    return spark.read.parquet(f"{entry}/table"), json.loads(spark.read.text(f"{entry}/values").first()[0])


def keep(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame],
         values: Callable[[DataFrame], dict] = lambda table: {}, params=None) -> tuple[DataFrame, dict]:
    """``find``, or else build the table, write it with its values (a dictionary
    made from the written table) and commit both.

    If the inputs change while the table is built, it is committed under what
    they were before: nobody will look for it there, and it is built again."""
    found = find(spark, name, inputs, params)
    if found:
        return found
    entry = _entry(spark, name, inputs, params)
    draft = f"{root(spark)}/{name}/.draft-{uuid.uuid4().hex}"
    build().write.parquet(f"{draft}/table")
    kept = values(spark.read.parquet(f"{draft}/table"))
    spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.text(f"{draft}/values")
    p, fs = _path(spark, draft)
    target, _ = _path(spark, entry)
    if fs.exists(target) or not fs.rename(p, target):  # another session was first: its entry is the same
        fs.delete(p, True)
    clear(spark, name)
    return spark.read.parquet(f"{entry}/table"), kept


def entries(spark: SparkSession, name: str) -> list[tuple[str, int]]:
    """(path, time) of a name's committed entries, newest first."""
    p, fs = _path(spark, f"{root(spark)}/{name}")
    if not fs.exists(p):
        return []
    found = [(f.getPath().toString(), f.getModificationTime()) for f in fs.listStatus(p) if not f.getPath().getName().startswith(".")]
    return sorted(found, key=lambda e: (-e[1], e[0]))


def clear(spark: SparkSession, name: str, keep_entries: int = KEEP, keep_seconds: float = KEEP_SECONDS) -> list[str]:
    """Remove the entries of a name beyond the newest ``keep_entries`` that are older
    than ``keep_seconds``, and drafts of that age that a lost session left. Returns their paths."""
    before = (time.time() - keep_seconds) * 1000
    gone = [path for path, at in entries(spark, name)[keep_entries:] if at < before]
    p, fs = _path(spark, f"{root(spark)}/{name}")
    if fs.exists(p):
        gone += [f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith(".draft-") and f.getModificationTime() < before]
    for path in gone:
        fs.delete(_path(spark, path)[0], True)
    return gone
