"""A crawl of a local site beside a breadth-first search; a round that was cut off; reports downloaded by tasks."""

import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.plans import crawl
from fathom.sources import files

LINKS = {
    "/": ["/a", "b", "#top", "mailto:x@y.z", "//other.invalid/x"], "/a": ["/c?x=1&amp;y=2", "/", "/gone"], "/b": ["/a#part", "/d/", "/r.pdf"],
    "/c?x=1&y=2": ["/e"], "/d/": ["f", "../a", "/q&#46;pdf"], "/e": ["/far"], "/d/f": [],
}


class Site(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        Site.asked.append(self.path)
        if self.path.endswith(".pdf"):
            self.send_response(200)
            self.send_header("content-type", "application/pdf")
            self.end_headers()
            self.wfile.write(b"%PDF" + self.path.encode())
        elif self.path in LINKS:
            self.send_response(200)
            self.end_headers()
            self.wfile.write("".join(f'<a href="{x}">x</a>' for x in LINKS[self.path]).encode())
        else:
            self.send_error(404)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    Site.asked = []
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_two_hops_equal_a_breadth_first_search(spark, site, tmp_path):
    start = spark.createDataFrame([(f"{site}/",), (f"{site}/#x",)], "url string")
    page = ~F.endswith(F.lit("x"), F.lit("y"))
    follow = lambda link, url: (crawl.host(link) == crawl.host(url)) & ~link.rlike(r"\.pdf$") & page
    folder = f"{tmp_path}/crawl"
    one = crawl.crawl(start, folder, 1, follow, rate=1000)
    assert {(r["url"].removeprefix(site), r["hop"]) for r in one.collect()} == {("/", 0), ("/a", 1), ("/b", 1)}
    two = crawl.crawl(start, folder, 2, follow, rate=1000)  # goes on from the rounds that are there
    want = {("/", 0, 200), ("/a", 1, 200), ("/b", 1, 200), ("/c?x=1&y=2", 2, 200), ("/gone", 2, 404)}
    assert {(r["url"].removeprefix(site), r["hop"], r["status"]) for r in two.collect()} - {("/d/", 2, 200)} == want
    assert sorted(Site.asked) == sorted(["/", "/a", "/b", "/c?x=1&y=2", "/d/", "/gone"])
    there = two.count()
    os.remove(f"{folder}/round-0002/_SUCCESS")  # as if the last round had been cut off
    again = crawl.crawl(start, folder, 2, follow, rate=1000)
    assert again.count() == there and len(Site.asked) == 9
    found = files.report_links(files.links(again.where("html IS NOT NULL")), "curated")
    told = crawl.reports(found, f"file://{tmp_path}/reports", rate=1000).collect()
    assert sorted(r["url"].removeprefix(site) for r in told) == ["/q.pdf", "/r.pdf"] and all(r["kept"] for r in told)
    assert len(os.listdir(f"{tmp_path}/reports")) == 2
    before = len(Site.asked)
    assert crawl.reports(found, f"file://{tmp_path}/reports", rate=1000).count() == 2 and len(Site.asked) == before


def test_character_references_stand_for_one_character(spark):
    cases = {"a&amp;b": "a&b", "&amp;lt;": "&lt;", "&lt;&gt;&quot;&apos;": "<>\"'", "&#65;&#x42;&#X1F600;": "AB😀", "&#0;&#xD800;": "��", "&nbsp;&": "&nbsp;&", "": "", None: None, "é&#233;": "éé"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.unescaped(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == cases
