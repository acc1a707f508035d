"""A data source over a folder of companies' documents: a partition for each group of issuers, a pushed filter on the issuer, offsets for streams."""

from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "cik string, ordinal int, accession_number string, form_type string, filing_date date, report_date date, primary_document string"
_FIELDS = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")

from tessera.sources.files import store_of


@dataclass
class Issuers(InputPartition):
    """The documents of some issuers, by path."""

    paths: tuple[str, ...]


def rows_of(path: str, text: str) -> Iterator[tuple]:
    """A submissions document's filings in its order; arrays of other lengths, or a document of another issuer than its file's, are a ``ValueError``."""
    cik = path.rsplit("/", 1)[-1].removesuffix(".json")
    body = json.loads(text)
    columns = [body["filings"]["recent"][f] for f in _FIELDS]
    if str(body["cik"]).zfill(10) != cik or len({len(c) for c in columns}) > 1:
        raise ValueError(f"{path} is no document of company {cik}")
    day = lambda x: datetime.date.fromisoformat(x) if x and x.strip() else None
    for i, (accession, form, filed, reported, document) in enumerate(zip(*columns, strict=True)):
        yield cik, i, accession, form, day(filed), day(reported), document


class _Folder:
    """Files ``<ten digits>.json`` of a folder, in any store that the libraries of driver and executors reach."""

    def __init__(self, options: dict) -> None:
        self.path, self.groups = options["path"].rstrip("/"), int(options.get("groups", "64"))

    def files(self) -> list[tuple[str, int]]:
        """Names and times of change; an issuer has one file, so names alone are held."""
        store, path = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(path))
        return sorted((x.base_name, x.mtime_ns or 0) for x in found if x.base_name.endswith(".json") and len(x.base_name) == 15)

    def dealt(self, names: list[str]) -> list[Issuers]:
        groups: dict[int, list[str]] = {}
        for name in names:
            groups.setdefault(zlib.crc32(name.encode()) % self.groups, []).append(f"{self.path}/{name}")
        return [Issuers(tuple(paths)) for _, paths in sorted(groups.items())]

    @staticmethod
    def read(partition: Issuers) -> Iterator[tuple]:
        for whole in partition.paths:
            store, path = store_of(whole)
            with store.open_input_stream(path) as file:
                yield from rows_of(whole, file.readall().decode())


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.wanted = _Folder(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the issuer choose files; all others go back to Spark."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is None or f.attribute != ("cik",):
                yield f
            else:
                self.wanted = named if self.wanted is None else self.wanted & named

    def partitions(self) -> list[Issuers]:
        names = [name for name, _ in self.folder.files() if self.wanted is None or name.removesuffix(".json") in self.wanted]
        return self.folder.dealt(names) or [Issuers(())]

    def read(self, partition: Issuers) -> Iterator[tuple]:
        return self.folder.read(partition)


class FolderStream(DataSourceStreamReader):
    """Documents by their time of change: an offset is the latest time that was read, and files of later times are new."""

    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": max((t for _, t in self.folder.files()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Issuers]:
        return self.folder.dealt([name for name, t in self.folder.files() if start["changed"] < t <= end["changed"]]) or [Issuers(())]

    def read(self, partition: Issuers) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class CompanySubmissions(DataSource):
    """``spark.read.format("company_submissions").load(folder)``: the filings of documents named by their issuer's ten digits."""

    @classmethod
    def name(cls) -> str:
        return "company_submissions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanySubmissions)
