"""Files that appear whole and once: the first writer of a name wins, whoever else tries learns that it lost."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` unless it exists; readers never see a part of it. The text is written under a name of
    its own first, then given the wanted one: by a hard link on a local disk, by a rename elsewhere, which HDFS refuses
    if the name is taken."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        local = unquote(urlparse(str(fs.makeQualified(target).toUri())).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    won = not fs.exists(target) and fs.rename(draft, target)
    if not won:
        fs.delete(draft, False)
    return won


def _plain(value):
    return value.astimezone(timezone.utc).isoformat() if isinstance(value, datetime) else value


def commit(spark: SparkSession, folder: str, name: str, schema: str, row: tuple) -> bool:
    """Enter ``row`` as the commit ``name`` of ``folder``; False if that commit is another writer's."""
    columns = [f.split()[0] for f in schema.split(",")]
    text = json.dumps({c: _plain(v) for c, v in zip(columns, row, strict=True)})
    return put_if_absent(spark, f"{folder}/{name}.json", text + "\n")


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """All rows entered into ``folder``, or None before the first."""
    try:
        return spark.read.schema(schema).json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
