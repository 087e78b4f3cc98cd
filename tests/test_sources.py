import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestead.sources import http, readers


class Site(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path == "/page":
            if self.headers.get("If-None-Match") == '"v1"':
                return self.answer(304, b"")
            return self.answer(200, "<p>héllo".encode(), {"ETag": '"v1"', "Content-Type": "text/html; charset=utf-8"})
        if self.path == "/pdf":
            return self.answer(200, b"%PDF", {"Content-Type": "application/pdf"})
        if self.path == "/big":
            return self.answer(200, b"x" * 5000, {"Content-Type": "text/html"})
        if self.path == "/plain":
            return self.answer(200, b"User-agent: *", {})
        return self.answer(404, b"no", {})

    def answer(self, status, body, headers=None):
        self.send_response(status)
        for k, v in (headers or {}).items():
            self.send_header(k, v)
        if status != 304:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, base):
    rows = [(f"{base}/page", None), (f"{base}/page", None), (f"{base}/pdf", None), (f"{base}/big", None), (f"{base}/none", None), ("http://127.0.0.1:1/", None), (None, None)]
    urls = spark.createDataFrame(rows, "url string, etag string")
    got = {r.url.rsplit("/", 1)[1]: r for r in http.http_fetcher(spacing=0.01, most=1000, timeout=5)(urls).collect()}
    assert len(got) == 5
    assert (got["page"].status, got["page"].html, got["page"].etag) == (200, "<p>héllo", '"v1"')
    assert (got["pdf"].html, got["pdf"].reason) == (None, "not-html") and got["big"].reason == "too-large"
    assert (got["none"].status, got["none"].html) == (404, None) and (got[""].status, got[""].reason) == (None, "error")
    again = http.http_fetcher(spacing=0)(spark.createDataFrame([(f"{base}/page", '"v1"')], "url string, etag string")).first()
    assert (again.status, again.not_modified, again.html) == (304, True, None)


def test_text(base):
    assert http.fetch_text(f"{base}/plain") == "User-agent: *" and http.fetch_text(f"{base}/none") is None and http.fetch_text("nonsense") is None


def test_readers(spark, tmp_path):
    cases = [{"query": "how much?", "expect": ["/pricing"], "answerMustContain": ["49"], "answerMatchAny": True}, {"query": "who?", "expect": None, "note": "refuse"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    got = {r.query: r for r in readers.golden_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got["how much?"].answer_must_contain == ["49"] and got["how much?"].answer_match_any is True and got["who?"].expect is None
    (tmp_path / "a.xml").write_text("<a>\n</a>")
    one = readers.text_files(spark, str(tmp_path / "a.xml")).first()
    assert one.xml == "<a>\n</a>" and one.url.endswith("a.xml")


def test_intermediate_results_go_with_their_scope(spark):
    from pathlib import Path

    from lodestead import tables

    folder = Path(tables.shared_dir(spark))
    with tables.scratch(spark):
        assert tables.persisted(spark.range(3), "scoped").count() == 3 and list(folder.rglob("scoped-*"))
    assert not list(folder.rglob("scoped-*"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestead import tables

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(session)
