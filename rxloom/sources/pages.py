"""Offset pagination of a JSON interface as a data source, and resumable downloads."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rxloom.sources.retry import FetchError, with_retry


def get(url: str, headers: dict | None = None):
    try:
        return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=60)
    except urllib.error.HTTPError as e:
        wait = e.headers.get("Retry-After") if e.headers else None
        raise FetchError(e.code, float(wait) if wait and wait.isdigit() else None) from e


def page_url(base: str, endpoint: str, skip: int, limit: int, api_key: str | None = None, search: str | None = None) -> str:
    asked = {"skip": skip, "limit": limit} | ({"api_key": api_key} if api_key else {}) | ({"search": search} if search else {})
    return f"{base}/{endpoint}.json?{urllib.parse.urlencode(asked)}"


def iter_pages(fetch: Callable[[int, int], list], limit: int = 100, start: int = 0) -> Iterator[tuple[int, list]]:
    """Pages until an empty or a short one; a reported total is not relied on."""
    skip = start
    while page := fetch(skip, limit):
        yield skip, page
        if len(page) < limit:
            return
        skip += limit


class _Range(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class PagesSource(DataSource):
    """Options base, endpoint, limit, api_key, search; with `total` pages are spread over partitions,
    without it one partition reads until a short page."""

    @classmethod
    def name(cls) -> str:
        return "label_pages"

    def schema(self) -> str:
        return "position long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(dict(self.options))


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self):
        limit, total = int(self.o.get("limit", 100)), self.o.get("total")
        return [_Range(0, None)] if total is None else [_Range(s, s + limit) for s in range(0, int(total), limit)]

    def read(self, partition):
        def fetch(skip: int, limit: int) -> list:
            def once():
                try:
                    with get(page_url(self.o["base"], self.o["endpoint"], skip, limit, self.o.get("api_key"), self.o.get("search"))) as r:
                        return json.load(r).get("results", [])
                except FetchError as e:
                    if e.status == 404:  # nothing there
                        return []
                    raise

            return with_retry(once)

        limit = int(self.o.get("limit", 100))
        for skip, page in iter_pages(fetch, limit, partition.start):
            for n, record in enumerate(page):
                yield skip + n, json.dumps(record, ensure_ascii=False)
            if partition.end is not None:
                return


def download(url: str, path: str, chunk: int = 1 << 20, open_url=get) -> int:
    """Continues a partial file: 206 appends, 200 starts anew, 416 means it is whole. Returns its size."""
    part = f"{path}.part"
    have = os.path.getsize(part) if os.path.exists(part) else 0
    try:
        answer = open_url(url, {"Range": f"bytes={have}-"} if have else None)
    except FetchError as e:
        if e.status != 416:
            raise
        os.replace(part, path)
        return os.path.getsize(path)
    with answer, open(part, "ab" if answer.status == 206 else "wb") as f:
        while block := answer.read(chunk):
            f.write(block)
    os.replace(part, path)
    return os.path.getsize(path)
