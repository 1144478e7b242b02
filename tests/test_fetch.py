"""Keyed fetches into files and a log, with failures in between."""

import http.server
import json
import os
import threading

import pytest

from fathom.sinks import fetch


class Site(http.server.BaseHTTPRequestHandler):
    asked: list = []
    running = most = 0
    lock = threading.Lock()

    def do_GET(self):
        key = self.path.rpartition("/")[2]
        with Site.lock:
            Site.asked.append(key)
            Site.running += 1
            Site.most = max(Site.most, Site.running)
        if key.startswith("gone"):
            self.send_error(404)
        else:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"  " if key.startswith("blank") else json.dumps({"id": key}).encode())
        with Site.lock:
            Site.running -= 1

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Site.asked, Site.most = [], 0
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x/{{key}}"
    s.shutdown()


def test_runs_go_on_where_they_were_cut_off(spark, url, tmp_path):
    folder, log = f"{tmp_path}/raw", f"{tmp_path}/log"
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "pulse_id string")
    names = [f"p{i}" for i in range(12)]
    with pytest.raises(Exception, match="status 404"):  # a task fails: what others have fetched stays, and the log knows none of it
        fetch.fetch_pending(keys(*names, "gone1"), url, folder, log, parallel=1, rate="500", strict="true")
    assert not [n for n in os.listdir(log) if n.endswith(".json")] if os.path.isdir(log) else True
    told = fetch.fetch_pending(keys(*names, " p1 ", "", None, "gone1", "blank", "a/b"), url, folder, log, parallel=3, rate="500")
    assert {r["pulse_id"]: r["status"] for r in told.collect()} == {**{n: "ok" for n in names}, "gone1": "error", "blank": "empty", "a/b": "ok"}
    assert sorted(os.listdir(folder)) == sorted([*(f"{n}.json" for n in names), "a%2Fb.json"]) and Site.most <= 3
    before = len(Site.asked)
    fetch.fetch_pending(keys(*names, "gone1", "p99"), url, folder, log, rate="500")
    assert sorted(Site.asked[before:]) == ["gone1", "p99"]
    assert json.load(open(f"{folder}/p99.json")) == {"id": "p99"}


def test_a_bucket_keeps_to_its_rate():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    bucket = fetch.Bucket(2.0, burst=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(13):
        bucket.take()
    assert now[0] == pytest.approx(5.0) and len(waits) == 10  # three at once, then two a second
    now[0] += 100
    for _ in range(3):
        bucket.take()
    assert len(waits) == 10


def test_options_are_checked():
    with pytest.raises(ValueError, match="has no"):
        fetch.FetchWriter({"url": "http://x", "folder": "f", "log": "l"})
    with pytest.raises(ValueError, match="log is missing"):
        fetch.FetchWriter({"url": "http://x/{key}", "folder": "f"})
