"""A feed that is read as a stream, stopped, changed and read on."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest

from fathom.streaming import feed


class Feed(http.server.BaseHTTPRequestHandler):
    records: dict = {}
    asked: list = []
    broken: set = set()
    loop = False

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        since, page, size = q.get("modified_since", ""), int(q.get("page", 0)), int(q["limit"])
        Feed.asked.append((since, page))
        if page in Feed.broken:
            self.send_error(404)
            return
        rows = sorted((r for r in Feed.records.values() if r["modified"] >= since), key=lambda r: (r["modified"], r["id"]))
        mine = rows[page * size : (page + 1) * size]
        following = f"http://127.0.0.1:{self.server.server_port}/?limit={size}&modified_since={since}&page={0 if Feed.loop else page + 1}"
        body = json.dumps({"results": mine, "next": following if Feed.loop or (page + 1) * size < len(rows) else None}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Feed.records, Feed.asked, Feed.broken, Feed.loop = {}, [], set(), False
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def put(*rows):
    for i, t, n in rows:
        Feed.records[i] = {"id": i, "modified": t, "n": n}


def run(spark, url, tmp_path, **options):
    feed.register(spark)
    stream = spark.readStream.format("fathom_feed").option("url", url).options(page_size="2", pages="2", **options).load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r["key"], r["modified"], json.loads(r["body"])["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_every_version_comes_once_through_restarts(spark, server, tmp_path):
    put(*[(f"p{i}", f"2024-01-0{1 + i // 4}", i) for i in range(9)])
    first = run(spark, server, tmp_path)
    assert first == sorted((f"p{i}", f"2024-01-0{1 + i // 4}", i) for i in range(9))
    assert run(spark, server, tmp_path) == first  # nothing new
    put(("p2", "2024-01-05", 22), ("new", "2024-01-03", 50), ("p8", "2024-01-06", 88))
    second = run(spark, server, tmp_path)
    assert sorted(set(second) - set(first)) == [("new", "2024-01-03", 50), ("p2", "2024-01-05", 22), ("p8", "2024-01-06", 88)] and len(second) == 12
    assert ("2024-01-03", 0) in Feed.asked and Feed.asked[-1][0] >= "2024-01-06"


def test_offsets_say_what_a_batch_is(server):
    put(*[(f"p{i}", "2024-01-01", i) for i in range(7)])
    reader = feed.FeedStreamReader({"url": server, "page_size": "2", "pages": "2"})
    start, one = reader.initialOffset(), reader.latestOffset()
    two, three = reader.latestOffset(), reader.latestOffset()
    assert two == json.loads(json.dumps(two)) and three == two and two["mark"] == "2024-01-01" and two["next"] == "" and one["next"]
    rows = lambda a, b, r: [x[0] for p in r.partitions(a, b) for x in r.read(p)]
    assert rows(start, one, reader) == ["p0", "p1", "p2", "p3"] and rows(one, two, reader) == ["p4", "p5", "p6"]
    again = feed.FeedStreamReader({"url": server, "page_size": "2", "pages": "2"})
    assert rows(start, one, again) == ["p0", "p1", "p2", "p3"] and again.latestOffset() == two  # replayed, and on from there
    put(("p9", "2024-01-01", 9))
    assert rows(two, again.latestOffset(), again) == ["p9"]


def test_failed_and_circling_pages(server):
    put(*[(f"p{i}", "2024-01-01", i) for i in range(5)])
    reader = feed.FeedStreamReader({"url": server, "page_size": "2"})
    Feed.broken = {1}
    one = reader.latestOffset()
    assert [p["keys"] for p in one["pages"]] == [["p0", "p1"]] and "page=1" in one["next"]
    assert reader.latestOffset() == one
    Feed.broken = set()
    assert [p["keys"] for p in reader.latestOffset()["pages"]] == [["p2", "p3"], ["p4"]]
    Feed.loop = True
    circling = feed.FeedStreamReader({"url": server, "page_size": "2"}).latestOffset()
    assert [p["keys"] for p in circling["pages"]] == [["p0", "p1"]] and circling["next"] == ""
