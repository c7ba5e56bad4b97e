"""Python data sources for archives that Spark's own readers can't open.

``label_json_zip``: bulk files, each a ZIP of one JSON document {meta, results: [...]}; one partition
a file, one row a record (file, position, raw). ``spl_zip``: releases, each a ZIP of nested package ZIPs;
packages of a release are spread over partitions, one row a package (package_name, xml).
"""

from __future__ import annotations

import glob
import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKAGES_A_PARTITION = 500
_SNIFF = 2048


class ArchiveError(Exception):
    pass


class _Part(InputPartition):
    def __init__(self, path: str, names: list[str] | None = None):
        self.path, self.names = path, names


def json_records(binary) -> Iterator[str]:
    """The records of one document's results as JSON texts, decoded one after the other."""
    text = io.TextIOWrapper(binary, "utf-8")
    decoder, held, started = json.JSONDecoder(), "", False
    while True:
        more = text.read(1 << 20)
        held += more
        if not started:
            at = held.find('"results"')
            at = held.find("[", at) if at >= 0 else -1
            if at < 0:
                if not more:
                    return
                continue
            held, started = held[at + 1 :], True
        while True:
            held = held.lstrip(" \t\r\n,")
            if held.startswith("]"):
                return
            try:
                record, end = decoder.raw_decode(held)
            except ValueError:
                break
            yield json.dumps(record, ensure_ascii=False)
            held = held[end:]
        if not more:
            raise ArchiveError("the document ends inside its results")


class JsonZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_json_zip"

    def schema(self) -> str:
        return "file string, position long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonZipReader(self.options["path"])


class _JsonZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with zipfile.ZipFile(partition.path) as z:
            members = z.namelist()
            if len(members) != 1:
                raise ArchiveError(f"{partition.path} has {len(members)} members")
            with z.open(members[0]) as f:
                for n, raw in enumerate(json_records(f)):
                    yield partition.path, n, raw


def package_names(release) -> list[str]:
    return [i.filename for i in release.infolist() if not i.is_dir() and i.filename.lower().endswith(".zip")]


def spl_of(package: bytes) -> bytes | None:
    """The first .xml of a package, if it looks like a structured label."""
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
        if name is None:
            return None
        xml = z.read(name)
    head = xml[:_SNIFF]
    return xml if b"<document" in head and b"urn:hl7-org:v3" in head else None


class SplZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spl_zip"

    def schema(self) -> str:
        return "package_name string, xml binary"

    def reader(self, schema) -> DataSourceReader:
        return _SplZipReader(self.options["path"], int(self.options.get("packages", PACKAGES_A_PARTITION)))


class _SplZipReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self):
        parts = []
        for path in sorted(glob.glob(self.path)):
            with zipfile.ZipFile(path) as z:
                names = package_names(z)
            parts += [_Part(path, names[i : i + self.most]) for i in range(0, len(names), self.most)]
        return parts

    def read(self, partition):
        with zipfile.ZipFile(partition.path) as release:
            for name in partition.names:
                xml = spl_of(release.read(name))
                if xml is not None:
                    yield name, xml


def register(spark) -> None:
    from rxloom.sources.pages import PagesSource

    for source in (JsonZipSource, SplZipSource, PagesSource):
        spark.dataSource.register(source)
