"""A paged source over a server in the test: limits, order, refusals, and a stream that takes what is new."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from larder.sources import paged


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        docs: list = []
        asked: list = []
        faults = 0

        def do_GET(self):
            where, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if where.path == paged.TAGS:
                rows = [{"id": 7}] if q["name__iexact"].lower() == "recette" else []
                return self.answer({"results": rows})
            if Handler.faults:
                Handler.faults -= 1
                return self.answer({}, 503)
            Handler.asked.append((int(q["page"]), int(q["page_size"])))
            rows = [d for d in Handler.docs if q["tags__id__all"] == "7" and q.get("modified__gt", "") < d["modified"] <= q.get("modified__lte", "9")]
            rows.sort(key=lambda d: d["modified"], reverse=True)
            start = (int(q["page"]) - 1) * int(q["page_size"])
            self.answer({"count": len(rows), "results": rows[start : start + int(q["page_size"])]})

        def answer(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    Handler.docs, Handler.asked, Handler.faults = [], [], 0
    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", Handler
    own.shutdown()


def doc(i):
    return {"id": i, "title": f"t{i}", "modified": f"2026-01-01T{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}", "content": None}


def test_table(spark, server):
    url, handler = server
    assert paged.documents(spark, url, "recette").count() == 0
    handler.docs, handler.faults = [doc(i) for i in range(730)], 2
    got = paged.documents(spark, url, "Recette", page_size="100")
    assert sorted(r.id for r in got.collect()) == list(range(230, 730))  # the 500 newest
    assert {p for p, size in handler.asked if size == 100} == {1, 2, 3, 4, 5}
    assert paged.documents(spark, url, "Recette", most="42", page_size="40").count() == 42
    with pytest.raises(Exception, match="tag not found"):
        paged.documents(spark, url, "other").collect()


def test_stream(spark, server, tmp_path):
    url, handler = server
    spark.dataSource.register(paged.PagedDocuments)
    target, done = f"file://{tmp_path}/out", f"file://{tmp_path}/done"

    def load():
        stream = spark.readStream.format("paged_documents").options(url=url, tag="recette", page_size="50").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", done).option("path", target).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.id for r in spark.read.schema(paged.SCHEMA).parquet(target).collect())

    handler.docs = [doc(i) for i in range(120)]
    assert load() == list(range(120))
    handler.docs = handler.docs + [doc(i) for i in range(120, 131)]
    assert load() == list(range(131))  # nothing twice


def test_to_import(spark):
    docs = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b"), (4, "b"), (None, "b"), (5, None)], "id long, modified string")
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (5, "a")], "id long, modified string")
    skip = spark.createDataFrame([(4,), (None,)], "id long")
    assert sorted(r.id for r in paged.to_import(docs, done, skip).collect()) == [2, 3]
