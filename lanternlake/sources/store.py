"""Versioned tables: all tables of an index are written first, then one pointer makes them current."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import write_table

POINTER = "CURRENT"


def _folder(root: str):
    return pafs.FileSystem.from_uri(root)


def current(root: str) -> str | None:
    """Name of the current version, if there is one."""
    fs, path = _folder(root)
    if fs.get_file_info(f"{path}/{POINTER}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{path}/{POINTER}") as f:
        return f.read().decode().strip()


def point(root: str, version: str | None) -> None:
    """Make a version current in one rename; also the way back to an older one, or to none."""
    fs, path = _folder(root)
    fs.create_dir(path)
    if version is None:
        if fs.get_file_info(f"{path}/{POINTER}").type == pafs.FileType.File:
            fs.delete_file(f"{path}/{POINTER}")
        return
    temporary = f"{path}/{POINTER}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(version.encode())
    fs.move(temporary, f"{path}/{POINTER}")


def note(root: str, state: dict) -> str:
    """Write what a version consists of, and make it current."""
    version = uuid.uuid4().hex
    fs, path = _folder(root)
    fs.create_dir(f"{path}/{version}")
    with fs.open_output_stream(f"{path}/{version}/state.json") as f:
        f.write(json.dumps(state).encode())
    point(root, version)
    return version


def read_note(root: str, version: str | None = None) -> dict | None:
    """What a version consists of, the current one by default."""
    version = version or current(root)
    if version is None:
        return None
    fs, path = _folder(root)
    with fs.open_input_stream(f"{path}/{version}/state.json") as f:
        return json.loads(f.read())


def write_version(root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables as a new version, which is not current yet."""
    version = uuid.uuid4().hex
    for name, table in tables.items():
        write_table(table, f"{root}/{version}/{name}")
    return version


def install(root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables as a new version and make it current. A failure leaves the old version current."""
    version = write_version(root, tables)
    point(root, version)
    return version


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame | None:
    """A table of a version, the current one by default; none where it is not there."""
    version = version or current(root)
    if version is None or _folder(root)[0].get_file_info(f"{_folder(root)[1]}/{version}/{name}").type == pafs.FileType.NotFound:
        return None
    return spark.read.parquet(f"{root}/{version}/{name}")


def write_manifest(documents: DataFrame, path: str) -> None:
    """Manifest rows as JSON lines, by source without case."""
    documents.repartitionByRange(F.lower("source")).sortWithinPartitions(F.lower("source")).write.json(path)


def export(sheets: dict[str, DataFrame], path: str) -> None:
    """The sheets of a report as CSV folders with headers."""
    for name, sheet in sheets.items():
        sheet.write.option("header", True).mode("overwrite").csv(f"{path}/{name}")
