import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index, sinks
from corpusmill.plans import clients


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a&b>"), (2, None)], "i int, t string")
    sinks.write_json_lines(df, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"i":1,"t":"<a&b>"}', '{"i":2}']
    assert df.select(sinks.tool_json(F.struct("t")).alias("j")).first().j == '{"t":"\\u003ca\\u0026b\\u003e"}'
    texts = spark.createDataFrame([('{"a": 1}',), ("plain \"x\"\n",), ("",), (None,)], "t string")
    got = [r.j for r in texts.select(sinks.result_json(F.col("t")).alias("j")).collect()]
    assert got[0] == '{"a": 1}' and json.loads(got[1]) == 'plain "x"\n' and got[2:] == ['""', '""']


def test_json_with_more_behind_is_text(spark):
    texts = ["1 a", "{} x", "null x", '"a" "b"', '{"a":1}}', "1],[2", '1} ,{"b":2', '1,"c":2', "1,2", "  "]
    kept = [" [1] ", '{"a":[1,{"b":null}]}', "true", "-1.5e3"]
    df = spark.createDataFrame([(t,) for t in texts + kept], "t string")
    got = [r.j for r in df.select(sinks.result_json(F.col("t")).alias("j")).collect()]
    assert [json.loads(j) for j in got[: len(texts)]] == texts and got[len(texts) :] == kept


def test_attach(spark):
    corpus = spark.createDataFrame([("a b.txt", "AB"), ("c", "C")], "path string, text string")
    prompts = spark.createDataFrame([(1, "see @a\\ b.txt and @c"), (2, "see @gone"), (3, "none")], "id int, text string")
    got = {r.id: r for r in sinks.attach(prompts, corpus).collect()}
    assert got[1].text.endswith("\n\n[Attached: a b.txt]\nAB\n\n[Attached: c]\nC") and got[1].error is None
    assert got[2].error == "gone: not found" and got[3].text == "none"


def test_sealed_recall(spark):
    m = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["a", "a", " ", "b", "c"])], "conv_id long, turn long, role string, text string")
    key = F.lit(b"k" * 16)
    out = sinks.sealed_recall(m, 2, key).select(index.unseal(F.col("sealed"), key).cast("string").alias("log")).first()
    assert out.log == "b\nc"
    args = spark.createDataFrame([("t", "b", False), ("t", "c", True), ("t", "a", False)], "tool string, name string, required boolean")
    assert [r.name for r in sinks.required_first(args).orderBy("rank").collect()] == ["c", "a", "b"]


def parts(*messages, done=True):
    lines = [{"message": m, "done": False} for m in messages]
    if done:
        lines.append({"done": True})
    return lambda path, body: [json.dumps(x).encode() for x in lines]


def test_server():
    s = clients.Server(parts({"content": "a", "thinking": "t"}, {"content": "b", "tool_calls": [{"function": {"name": "f", "arguments": {}}}]}), "m")
    assert s.chat([], []) == {"content": "ab", "thinking": "t", "tool_calls": [{"name": "f", "arguments": {}}]}
    with pytest.raises(OSError):
        clients.Server(parts({"content": "a"}, done=False), "m").chat([], [])
    with pytest.raises(OSError):
        clients.Server(lambda *_: [b'{"error": "no"}'], "m").chat([], [])
    answers = {"/api/tags": {"models": [{"name": "x"}]}, "/api/show": {"capabilities": ["vision"], "model_info": {"llm.context_length": 4096}}, "/api/embed": {"embeddings": [[3.0, 4.0]]}}
    s = clients.Server(lambda path, body: [json.dumps(answers[path]).encode()], "m")
    assert s.models() == ["x"] and s.show() == (["vision"], 4096) and np.allclose(s.embed(["t"]), [[0.6, 0.8]])
    with pytest.raises(OSError):
        s.embed(["a", "b"])


def test_fetch():
    public = lambda host: ["8.8.8.8"]
    page = b"<!doctype html><html><body><nav>n</nav><article><p>hello</p></article></body></html>"
    pages = {"https://a/": (200, {}, page), "https://b/": (302, {"location": "/x"}, b""), "https://b/x": (200, {"content-type": "text/plain"}, b"word " * 20000), "https://c/": (404, {}, b""), "https://d/": (302, {"location": "http://a/"}, b""), "https://e/": (302, {"location": "https://e/"}, b"")}
    asked = []

    def send(url, address, max_bytes):
        asked.append((url, address))
        return pages[url]

    fetch = lambda url, resolve=public: clients.fetch(url, send=send, resolve=resolve)
    assert fetch("https://a/") == "HTTP 200\n\nhello" and asked == [("https://a/", "8.8.8.8")]
    assert fetch("https://b/").endswith("\n\n[content truncated]") and len(fetch("https://b/")) < 33000
    assert fetch("https://c/") == "HTTP 404\nError: Not Found" and "only https" in fetch("https://d/") and "redirects" in fetch("https://e/")
    assert "not a public host" in fetch("https://a/", lambda host: ["10.0.0.1"]) and fetch("ftp://a/").startswith("HTTP 0\nError")
    for ip in ("::ffff:10.0.0.1", "::ffff:192.168.1.1", "::ffff:169.254.169.254", "::1", "fe80::1%eth0", "224.0.0.1"):
        assert "not a public host" in fetch("https://a/", lambda host, ip=ip: ["8.8.8.8", ip])


def test_fetch_connects_to_the_checked_address():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.headers["Host"].encode() + self.path.encode())

        def log_message(self, *_):
            return None

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:  # a name that stands for nothing: only the address is used
        status, _, body = clients.get(f"http://no.such.host.invalid:{server.server_port}/x?y=1", "127.0.0.1")
        assert (status, body) == (200, f"no.such.host.invalid:{server.server_port}/x?y=1".encode())
    finally:
        server.shutdown()


def test_batch_top_k_in_blocks(spark, monkeypatch):
    from corpusmill.operators import search

    for name, n in (("QUERY_BLOCK", 2), ("QUERIES", 3), ("VECTOR_BLOCK", 5), ("SLICE", 2)):
        monkeypatch.setattr(search, name, n)
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, [1.0]), (98, None)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "qid long, q array<float>")
    got = search.batch_top_k(vectors, queries, "id", "qid", 3).collect()
    assert sorted((r.qid, r.rank, r.id) for r in got) == [(q, k + 1, i) for q in range(5) for k, i in enumerate((2, 5, 8))]
    assert search.batch_top_k(vectors, queries.limit(0), "id", "qid").count() == 0
