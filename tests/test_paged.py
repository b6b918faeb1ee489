"""The paged source: tri-state pages, retries, the last page, pushed filters, and streams that stop and go on."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from basketlens.sources.paged import Feed, Missing, PagedSource

N = 3


def put(folder, page, items):
    (folder / f"page-{page}.json").write_text(json.dumps({"items": items}))


@pytest.fixture
def source(spark):
    spark.dataSource.register(PagedSource)
    return lambda folder, **options: spark.read.format("paged_json").options(path=str(folder), wait="0", **options)


def test_states_and_partial_pages(source, tmp_path):
    put(tmp_path, 1, [{"id": 1}, {"id": 2}])
    put(tmp_path, 2, [])
    (tmp_path / "page-3.json").write_text("{broken")
    put(tmp_path, 4, [{"id": 7}])
    rows = source(tmp_path, size="2").load().collect()
    assert sorted((r.page, r.status, r.partial) for r in rows) == [(1, "ok", False), (1, "ok", False), (2, "empty", True), (3, "unknown", None), (4, "ok", False)]
    assert next(r.error for r in rows if r.page == 3)
    assert [r.status for r in source(tmp_path, pages="6").load().collect() if r.page > 4] == ["unknown"] * 2  # told that there are six


def test_last_page_is_found(tmp_path):
    for n in (0, 1, 2, 7, 8, 21):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(1, n + 1):
            put(folder, i, [i])
        feed = Feed({"path": str(folder)})
        assert feed.last() == n and feed.last(n // 2) == n
    with pytest.raises(Missing):
        feed.fetch(22)


def test_filters_on_pages_are_pushed(spark, source, tmp_path, monkeypatch):
    for i in range(1, 9):
        put(tmp_path, i, [i])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda where: source(tmp_path, push="true").load().where(where)
        for where, want in (("page = 3", [3]), ("page > 2 AND page <= 4", [3, 4]), ("page IN (1, 8, 20)", [1, 8]), ("page >= 7 AND status = 'ok'", [7, 8]), ("page < 1", []), ("page <> 5", [1, 2, 3, 4, 6, 7, 8])):
            assert sorted(r.page for r in load(where).collect()) == want
        for where, n in (("page = 3", 1), ("page > 2 AND page <= 4", 2), ("page <> 5", 8)):
            assert load(where).rdd.getNumPartitions() == n
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_answers_by_status():
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            asked.append(page)
            status = 404 if page == 9 else 403 if page == 8 else 503 if page == 2 and asked.count(2) < 3 else 429 if page == 3 and asked.count(3) < 2 else 200
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0")
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps({"items": [page]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        feed = Feed({"path": f"http://127.0.0.1:{server.server_port}/items?page={{page}}", "wait": "0"})
        assert [feed.fetch(i) for i in (1, 2, 3)] == [[1], [2], [3]] and asked == [1, 2, 2, 2, 3, 3]
        with pytest.raises(ValueError):
            feed.fetch(8)  # final: asked once
        with pytest.raises(Missing):
            feed.fetch(9)
        assert asked[-2:] == [8, 9]
    finally:
        server.shutdown()


def test_stream_goes_on_behind_a_failed_page(spark, tmp_path):
    """A page that fails stops the stream; it and those behind it come once it is mended, and a short page once it is full or another follows."""
    spark.dataSource.register(PagedSource)
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    for i in range(1, 4):
        put(feed, i, list(range(N * i, N * i + N)))
    (feed / "page-4.json").write_text("{broken")
    put(feed, 5, [100])

    def run():
        rows = spark.readStream.format("paged_json").options(path=str(feed), size=str(N), perTrigger="2", wait="0", retries="0").load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(60)

    def seen():
        return sorted((r.page, r.item) for r in spark.read.parquet(out).collect())

    run()
    assert {p for p, _ in seen()} == {1, 2}
    with pytest.raises(Exception, match="(?s)Expecting|STREAM|broken|page"):
        run()
    assert {p for p, _ in seen()} == {1, 2}
    put(feed, 4, [40, 41, 42])
    for _ in range(3):
        run()
    assert [p for p, _ in seen()] == [p for p in (1, 2, 3, 4) for _ in range(N)]
    put(feed, 5, [100, 101, 102])
    for _ in range(2):
        run()
    assert [p for p, _ in seen()] == [p for p in (1, 2, 3, 4, 5) for _ in range(N)]
