"""File-system helpers that work on any Hadoop URI (file, hdfs, s3a, ...).

Metadata operations (exists, list, delete, rename) go through the Hadoop
FileSystem of the session, so stored graphs and state tables live on the cluster's shared storage, not on a machine-local disk. Without a
JVM gateway (Spark Connect) plain local paths fall back to ``os``.
"""

from __future__ import annotations

import os
import shutil


def _fs(spark, path: str):
    try:
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001
        return None, None
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def exists(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    if fs is None:
        return os.path.exists(path)
    return bool(fs.exists(p))


def is_dir(spark, path: str) -> bool:
    fs, p = _fs(spark, path)
    if fs is None:
        return os.path.isdir(path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def list_names(spark, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if fs is None:
        return sorted(os.listdir(path)) if os.path.isdir(path) else []
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def delete(spark, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs is None:
        if os.path.exists(path):
            shutil.rmtree(path)
        return
    if fs.exists(p):
        fs.delete(p, True)


def rename(spark, path: str, to: str) -> None:
    """Move a folder to a name that does not exist."""
    fs, p = _fs(spark, path)
    if fs is None:
        os.rename(path, to)
    elif not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {path} to {to}")
