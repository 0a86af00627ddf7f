"""The data source of pages against a server of this machine, and readers of single pages."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tarnfold.sources import pages, store


@pytest.fixture(scope="module")
def server():
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] = tries.get(self.path, 0) + 1
            status = {"/missing": 404, "/flaky": 503 if tries[self.path] < 3 else 200, "/down": 500}.get(self.path, 200)
            body = b"x" * 500 if self.path == "/large" else b"<p>hello</p>"
            self.send_response(status)
            self.send_header("Content-Type", "application/pdf" if self.path == "/pdf" else "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Retry-After", "0.01")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", tries
    s.shutdown()


def test_pages_are_rows_whatever_happens(spark, server):
    base, tries = server
    pages.register(spark)
    urls = [base + p for p in ("/a", "/missing", "/flaky", "/down", "/large", "/pdf")]
    df = spark.read.format("polite_pages").option("urls", json.dumps(urls)).option("delay_ms", "1").option("retries", "3").option("expect", "html").option("most_bytes", "100").load()
    got = {r.url.removeprefix(base): r for r in df.collect()}
    assert (got["/a"].status, bytes(got["/a"].body), got["/a"].failed) == (200, b"<p>hello</p>", None)
    assert got["/missing"].failed == "HTTP 404" and got["/flaky"].failed is None and tries["/flaky"] == 3
    assert "4 attempts" in got["/down"].failed and tries["/down"] == 4
    assert (got["/large"].failed, got["/large"].bytes, got["/large"].body) == ("too-large", 500, None) and "expected html" in got["/pdf"].failed
    assert spark.read.format("polite_pages").option("urls", "[]").load().count() == 0


def test_a_page_that_fails_does_not_stop_its_document(spark):
    rows = spark.createDataFrame([("d", 1, b"one"), ("d", 2, b"\xff"), ("e", 1, None)], "doc string, page int, content binary")
    got = {(r.doc, r.page): (r.text, (r.failed or "").split(":")[0]) for r in store.read_page_by_page(rows, lambda c: bytes(c).decode()).collect()}
    assert got == {("d", 1): ("one", ""), ("d", 2): (None, "UnicodeDecodeError"), ("e", 1): (None, "TypeError")}
