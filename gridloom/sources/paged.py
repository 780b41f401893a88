"""A table behind a paged REST interface, as a Spark data source: one partition a page.

spark.dataSource.register(PagedSource); spark.read.format("paged_rows").options(url=..., dataset=...,
split=..., rows=20000).load(). With the option until_empty=true pages are asked for one after the other, by one
task, until one is empty: where the table's size is not known. Where the fetch option names 'module:function', pages come from that
function (url, params, headers) -> dict, which is how tests do without a network.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Rows a page holds, statuses worth another try, first and longest wait in seconds.
PAGE, AGAIN, WAIT, LONGEST = 100, (429, 502, 503, 504), 2.0, 45.0


def headers_from_env(name: str = "DATASET_TOKEN") -> dict[str, str]:
    token = os.environ.get(name)
    return {"Authorization": f"Bearer {token}"} if token else {}


def fetch(url: str, params: dict, headers: dict | None = None, tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> dict:
    """GET with waits that double, or as long as Retry-After says; other statuses raise at once."""
    wait = WAIT
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers=headers or {})
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, timeout=60) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or not left:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(min(float(after) if after and after.isdigit() else wait, LONGEST))
            wait *= 2
    raise RuntimeError("unreachable")


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        rows, start = int(self.options.get("rows", PAGE)), int(self.options.get("start", 0))
        if self.options.get("until_empty", "").lower() == "true":
            return [Page(start, rows)]
        return [Page(o, min(PAGE, start + rows - o)) for o in range(start, start + rows, PAGE)]

    def read(self, page: Page) -> Iterator[tuple]:
        for offset in range(page.offset, page.offset + page.length, PAGE):
            found = 0
            for row in self._page(Page(offset, min(PAGE, page.offset + page.length - offset))):
                found += 1
                yield row
            if not found:
                return

    def _page(self, page: Page) -> Iterator[tuple]:
        get = fetch
        if name := self.options.get("fetch"):
            module, _, function = name.partition(":")
            get = getattr(importlib.import_module(module), function)
        params = {"dataset": self.options.get("dataset", ""), "split": self.options.get("split", "train"), "offset": page.offset, "length": page.length}
        reply = get(self.options.get("url", ""), params, headers_from_env(self.options.get("tokenenv", "DATASET_TOKEN")))
        for i, entry in enumerate(reply.get("rows", [])):
            row = entry.get("row", entry)
            image = row.get("image")
            yield page.offset + i, row.get("html_table") or row.get("html"), image.get("src") if isinstance(image, dict) else None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "ord long, html string, image_url string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
