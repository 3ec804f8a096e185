"""Python data sources for Darwin Core archives and data packages. A file is one stream of rows: it is read as one partition, row by row. Files of
stores that only Spark reads are sent to the workers as Spark's own files first (see `sent`)."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.model import PlumblineError

STRIPPED = "".join(map(chr, range(33)))


def core_entry(names: list[str]) -> str:
    """occurrence.txt, else the first text file of the archive."""
    if "occurrence.txt" in names:
        return "occurrence.txt"
    found = next((n for n in names if n.lower().endswith(".txt") and not n.endswith("/")), None)
    if found is None:
        raise PlumblineError("the archive has no text file of records")
    return found


SENT = "sparkfile:"


def local(path: str) -> str:
    """Where a path's file is on this machine: that of a sent file differs by worker."""
    return SparkFiles.get(path.removeprefix(SENT)) if path.startswith(SENT) else path.removeprefix("file://")


def sent(spark: SparkSession, path: str) -> str:
    """The path as it is, or that of the file that Spark fetches from its store to every worker; of a data package with its resource."""
    if "://" not in path or path.startswith("file://"):
        return path
    spark.sparkContext.addFile(path)
    own = SENT + path.rpartition("/")[2]
    if not path.endswith(".zip"):
        spark.sparkContext.addFile(f"{path.rpartition('/')[0]}/{resource_of(own)}")
    return own


def open_archive(path: str) -> tuple[io.TextIOBase, str]:
    z = zipfile.ZipFile(local(path))
    return io.TextIOWrapper(z.open(core_entry(z.namelist())), encoding="utf-8", newline=""), "\t"


def resource_of(path: str) -> str:
    with open(local(path), encoding="utf-8") as f:
        resources = json.load(f).get("resources")
    if not isinstance(resources, list) or not resources or "path" not in resources[0]:
        raise PlumblineError(f"{path} names no resource")
    return resources[0]["path"]


def open_package(path: str) -> tuple[io.TextIOBase, str]:
    own = resource_of(path)
    at = SparkFiles.get(own.rpartition("/")[2]) if path.startswith(SENT) else os.path.join(os.path.dirname(local(path)), own)
    return open(at, encoding="utf-8", newline=""), ","


def rows_of(stream: io.TextIOBase, separator: str) -> Iterator[list[str]]:
    csv.field_size_limit(1 << 30)
    return ([c.strip(STRIPPED) for c in row] for row in csv.reader(stream, delimiter=separator) if row)


def header_of(opened: tuple[io.TextIOBase, str]) -> list[str]:
    with opened[0] as f:
        return [h.lstrip("﻿") for h in next(rows_of(f, opened[1]), [])]


class Reader(DataSourceReader):
    def __init__(self, path: str, opener, schema: StructType):
        self.path, self.opener, self.width = path, opener, len(schema.fields) - 1

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        stream, separator = self.opener(self.path)
        with stream as f:
            rows = rows_of(f, separator)
            next(rows, None)
            for n, row in enumerate(rows, 1):
                # what a short row lacks is missing, not empty
                yield (n, *row[: self.width], *[None] * (self.width - len(row)))


class _Source(DataSource):
    opener = None

    @property
    def path(self) -> str:
        return self.options["path"]

    def schema(self) -> StructType:
        names = header_of(type(self).opener(self.path))
        return StructType([StructField("record_ord", LongType()), *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.path, type(self).opener, schema)


class DarwinCoreSource(_Source):
    opener = staticmethod(open_archive)

    @classmethod
    def name(cls) -> str:
        return "dwca"


class DataPackageSource(_Source):
    opener = staticmethod(open_package)

    @classmethod
    def name(cls) -> str:
        return "datapackage"
