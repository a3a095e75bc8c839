"""A set of tables that is replaced as a whole: versions in folders of their own, and one pointer file.

A refresh writes all tables to a new folder and then the pointer, in one rename. Readers follow the
pointer, so they see the tables of one refresh whatever becomes of a later one. Files go through
Spark's own file systems. One refresh of a folder runs at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from martwright.sources.tables import path_exists

POINTER = "_current.json"
_VERSIONS = "versions"


@dataclass(frozen=True)
class Version:
    """A complete set of tables: its folder's name, the rows of its tables, and the sets before it."""

    name: str
    rows: dict[str, int] = field(default_factory=dict)
    before: tuple[str, ...] = ()

    def path(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/{_VERSIONS}/{self.name}"


def new_version() -> Version:
    return Version(uuid.uuid4().hex)


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def _file_system(spark: SparkSession, path: str):
    target = _hadoop(spark).Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> Version | None:
    """The version that readers see; None before the first one is published."""
    path = f"{folder.rstrip('/')}/{POINTER}"
    if not path_exists(spark, path):
        return None
    target, files = _file_system(spark, path)
    source = files.open(target)
    try:
        told = json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()
    return Version(told["version"], told["rows"], tuple(told["before"]))


def publish(spark: SparkSession, folder: str, version: Version, rows: dict[str, int]) -> Version:
    """Makes a completely written version the current one: the pointer file is replaced in one step."""
    now = current_version(spark, folder)
    before = (now.name, *now.before) if now else ()
    done = Version(version.name, dict(rows), before)
    target, files = _file_system(spark, f"{folder.rstrip('/')}/{POINTER}")
    written = _hadoop(spark).Path(f"{target}.{version.name}")
    out = files.create(written, True)
    try:
        told = {"version": done.name, "rows": done.rows, "before": list(before)}
        out.write(bytearray(json.dumps(told).encode()))
    finally:
        out.close()
    how = getattr(_hadoop(spark), "Options$Rename")
    replace = spark.sparkContext._gateway.new_array(how, 1)
    replace[0] = how.OVERWRITE
    context = _hadoop(spark).FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(context.makeQualified(written), context.makeQualified(target), replace)
    return done


def remove_superseded(spark: SparkSession, folder: str, kept: int = 1) -> list[str]:
    """Deletes versions other than the current one and the last kept ones before it, unfinished ones
    too; returns their names. Whoever still reads the version just superseded can go on."""
    now = current_version(spark, folder)
    if now is None:
        return []
    staying = {now.name, *now.before[:kept]}
    target, files = _file_system(spark, f"{folder.rstrip('/')}/{_VERSIONS}")
    gone = [
        status.getPath().getName() for status in files.listStatus(target)
        if status.getPath().getName() not in staying
    ]
    for name in gone:
        files.delete(_hadoop(spark).Path(target, name), True)
    return sorted(gone)
