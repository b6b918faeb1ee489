"""A paged JSON feed as a Python data source, for batches and streams: one input partition a page.

A page is a JSON object with `items`. `path` is an address with `{page}` in it, an http(s) URL or a file on storage that all
executors reach (any that pyarrow opens); where it ends in a slash or names a folder, page N is `page-N.json` or the one file
of `page=N` in it. A page that fails is never read as empty: in a batch it is a row of status `unknown`, a stream stops
there and reads it again when it is started again, so no page is lost or repeated.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Answers that are worth another try; others are final.
AGAIN = frozenset((408, 425, 429, 500, 502, 503, 504))


class Missing(Exception):
    """There is no such page."""


class Page(InputPartition):
    def __init__(self, number: int, last: bool = False):
        self.number, self.last = number, last


class Feed:
    """Options: path, pages (else found out: the pages that follow one another from 1), size (items of a full page), retries, wait (seconds before the first retry), push (true: filters on `page` are pushed)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pages = options["path"], int(options["pages"]) if "pages" in options else None
        self.size, self.retries, self.wait = int(options.get("size", "0")), int(options.get("retries", "2")), float(options.get("wait", "0.2"))

    def _web(self, page: int) -> str:
        try:
            with urllib.request.urlopen(self.path.replace("{page}", str(page)), timeout=30) as answer:  # noqa: S310 (the caller's own address)
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise Missing(str(e)) from e
            if e.code not in AGAIN:
                raise ValueError(f"status {e.code}") from e
            after = e.headers.get("Retry-After", "")
            raise OSError(f"status {e.code}", float(after) if after.isdigit() else None) from e

    def _stored(self, page: int) -> str:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if "{page}" in path:
            path = path.replace("{page}", str(page))
        else:
            found = store.get_file_info(fs.FileSelector(f"{path.rstrip('/')}/page={page}", allow_not_found=True))
            files = sorted(f.path for f in found if f.is_file and f.base_name[0] not in "._")
            path = files[0] if files else f"{path.rstrip('/')}/page-{page}.json"
        if not store.get_file_info(path).is_file:
            raise Missing(path)
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8")

    def fetch(self, page: int) -> list:
        """The page's items; Missing, or the last error after all tries."""
        for n in range(self.retries + 1):
            try:
                text = self._web(page) if self.path.startswith(("http://", "https://")) else self._stored(page)
                items = json.loads(text).get("items") or []
                if not isinstance(items, list):
                    raise ValueError("items are no list")
                return items
            except (OSError, AttributeError) as e:
                if n == self.retries:
                    raise OSError(str(e)) from e
                asked = e.args[1] if len(e.args) > 1 and isinstance(e.args[1], float) else None
                time.sleep(asked if asked is not None else self.wait * 2**n)
        raise AssertionError

    def there(self, page: int) -> bool:
        try:
            self.fetch(page)
        except Missing:
            return False
        except (OSError, ValueError):
            pass  # there, but not to be read now
        return True

    def last(self, known: int = 0) -> int:
        """The last page: as told, or the last before one that is missing, from a page on that is known to be there; by doubling steps, then by halves."""
        if self.pages is not None:
            return self.pages
        low, step = known, 1
        while self.there(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.there(middle) else (low, middle)
        return low

    def rows(self, page: Page, fail: bool) -> Iterator[tuple]:
        """(page, status, partial, item, error); partial: a page before the last with fewer items than a full one."""
        try:
            items = self.fetch(page.number)
        except (Missing, OSError, ValueError) as e:
            if fail:
                raise
            yield page.number, "unknown", None, None, str(e)[:200]
            return
        partial = bool(self.size) and len(items) < self.size and not page.last
        if not items:
            yield page.number, "empty", partial, None, None
        for item in items:
            yield page.number, "ok", partial, json.dumps(item, sort_keys=True, ensure_ascii=False), None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.feed, self.low, self.high, self.only = Feed(options), 1, None, None

    def partitions(self) -> list[InputPartition]:
        last = self.feed.last()
        numbers = range(self.low, (last if self.high is None else min(last, self.high)) + 1)
        return [Page(i, i == last) for i in numbers if self.only is None or i in self.only]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return self.feed.rows(partition, fail=False) if partition is not None else iter(())  # Spark reads None where there are no partitions


class FilteredReader(PagedReader):
    """Filters on `page` choose the pages that are fetched. Spark asks for it only with spark.sql.python.filterPushdown.enabled, and refuses it otherwise."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("page",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            else:
                yield f


class PagedStream(DataSourceStreamReader):
    """Offsets are numbers of pages; `perTrigger` pages at most make a batch. A short page may still grow, so it waits until the next one is there unless `pages` says it is the last."""

    def __init__(self, options: dict[str, str]):
        self.feed, self.per, self.known = Feed(options), int(options.get("perTrigger", "100")), 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        last = self.feed.last(self.known)
        if self.feed.pages is None and self.feed.size and last > self.known:
            try:
                last -= len(self.feed.fetch(last)) < self.feed.size
            except (Missing, OSError, ValueError):
                pass  # read, and its failure seen, by the batch
        self.known = max(self.known, min(last, self.known + self.per))
        return {"page": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = max(self.known, end["page"])
        return [Page(i, i == self.feed.pages) for i in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.feed.rows(partition, fail=True)

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["page"])


class PagedSource(DataSource):
    """Rows (page, status, partial, item, error); register with spark.dataSource.register(PagedSource)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, status string, partial boolean, item string, error string"

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("push") == "true" else PagedReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)
