"""Where tables and files go that all executors must reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files_below(path: str) -> list[str]:
    """The file at path, or all below that folder but hidden ones, in the order of their names."""
    files, at = opened(path)
    if files.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    base = path.split(at)[0] if "://" in path else ""
    return sorted(base + i.path for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
