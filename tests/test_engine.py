import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import embedding as E
from corpusmill.functions import vectors as V
from corpusmill.operators import conversations as C
from corpusmill.operators import index as I
from corpusmill.operators import listing, reading, search
from corpusmill.plans import agent, settings, templates
from corpusmill.sources import files, paths
from corpusmill.streaming import streams


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "file.txt").write_text("hello world\nsecond line with Kafka\n")
    (tmp_path / "top.txt").write_text("top level file")
    (tmp_path / "binary.bin").write_bytes(b"\x00\x01\x02hi")
    (tmp_path / "notes.md").write_text("# meeting notes")
    (tmp_path / ".env").write_text("K=1")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("x")
    os.symlink("/etc/passwd", tmp_path / "out.txt")
    return tmp_path


def test_listing(spark, folder):
    e = files.entries(spark, str(folder))
    assert sorted(r.path for r in e.collect()) == [".env", "binary.bin", "notes.md", "sub", "sub/file.txt", "top.txt"]
    assert [r.path for r in listing.list_dir(e, 1, [".txt"]).collect()] == ["sub", "top.txt"]
    assert files.entries(spark, str(folder), 1).count() == 5
    assert listing.stat(e, "top.txt").first().permissions.startswith("-rw")
    drawn = {r.path: r.line for r in listing.tree(e).collect()}
    assert drawn["sub/file.txt"] == "│   └── file.txt" and drawn["top.txt"] == "└── top.txt"
    got = {r.path: r.content for r in files.contents(e, str(folder), 100).collect()}
    assert got["top.txt"] == b"top level file" and "out.txt" not in got
    assert files.binary_files(spark, str(folder), glob="*.txt").select("path").collect()
    assert [r.path for r in listing.search_name(e, "FILE").collect()] == ["sub/file.txt"]


def test_confinement(spark, tmp_path):
    root = paths.Root(str(tmp_path))
    (tmp_path / "a").mkdir()
    os.symlink("/etc", tmp_path / "escape")
    assert root.resolve("a/../a") == str(tmp_path.resolve() / "a") and root.resolve(".") == root.folder
    for bad in ("../x", "a/../../x", "/etc/passwd", "escape/passwd", "f\x00o"):
        with pytest.raises(paths.Escape):
            root.resolve(bad)
    df = spark.createDataFrame([(p,) for p in ("a/b", "../x", "a/../../x", "/e", ".")], "path string")
    assert {r.path for r in listing.confined(df).collect()} == {"a/b", "."}
    assert all(map(paths.blocked_address, "127.0.0.1 ::1 10.0.0.1 172.16.0.1 192.168.1.1 169.254.169.254 fe80::1 0.0.0.0".split()))
    assert not any(map(paths.blocked_address, "8.8.8.8 1.1.1.1 93.184.216.34 100.64.0.1".split()))


def test_exact_search_edges(spark):
    c = spark.createDataFrame([("a.txt", "X x\r\nno"), ("a/b", "100% x"), ("a-b", "x"), ("big", "x" * (1 << 20) + "x\nx"), ("none", None)], "path string, text string")
    assert [(r.path, r.line) for r in search.search_exact(c, "X").collect()] == [("a", 1)] * 0 + [("a/b", 1), ("a-b", 1), ("a.txt", 1)]
    assert search.search_exact(c, "%").count() == 1 and search.search_exact(c, "X", True).count() == 1


def test_reading(spark):
    c = spark.createDataFrame([("a", "l1\nl2\nl3"), ("e", "")], "path string, text string")
    assert [r.rendered for r in reading.read_lines(c.where("path = 'a'"), 2).orderBy("line").collect()] == ["     2\tl2", "     3\tl3"]
    wanted = spark.createDataFrame([(0, "a"), (1, "zz")], "pos int, path string")
    text = reading.render_batch(reading.read_batch(c, wanted)).first()["text"]
    assert text == "=== a ===\nl1\nl2\nl3\n\n=== zz ===\nError: not found"
    assert reading.read_document(c, "e").first().text == "(no extractable text)"
    long = spark.createDataFrame([("d", "\n\n".join("word " * 200 for _ in range(20)))], "path string, text string")
    assert reading.read_document(long, "d", 300).count() > 3
    image = spark.createDataFrame([("a.PNG", b"\x89PNG" * 40), ("b.txt", b"x")], "path string, content binary")
    assert "\n" not in reading.read_image(image, "a.PNG").first().base64 and reading.read_image(image, "b.txt").first().error == "b.txt: not an image"
    assert reading.read_image(image, "a.PNG", 10).first().base64 is None and "see" in reading.read_image(image, "a.PNG", vision=False).first().error
    with pytest.raises(reading.TooMany):
        reading.read_batch(c, spark.range(21).select(F.col("id").alias("pos"), F.lit("a").alias("path")))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.normalize(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.d for r in rows] == [3.0, 0.0, 2.0] and rows[1].n == [0.0, 0.0] and rows[2].c == 1.0 and rows[0].n == pytest.approx([0.6, 0.8])


def test_model_files(tmp_path):
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {"[UNK]": 0, "un": 1, "##able": 2, "able": 3, ",": 4}}, "normalizer": {"lowercase": True}}))
    vectors = np.arange(10, dtype="<f2").reshape(5, 2)
    head = json.dumps({"embeddings": {"dtype": "F16", "shape": [5, 2], "data_offsets": [0, 20]}}).encode()
    (tmp_path / "model.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + vectors.tobytes())
    (tmp_path / "config.json").write_text('{"normalize": false}')
    model = E.StaticModel.load(tmp_path)
    assert model.tokenizer.ids("Unable, unx") == [1, 2, 4, 0]
    assert model.embed(["unable", ""]).tolist() == [[3.0, 4.0], [0.0, 0.0]]


class Scripted:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def chat(self, messages, tools):
        self.seen.append(messages)
        return self.answers.pop(0)


def test_agent_over_a_corpus(spark):
    c = spark.createDataFrame([("cats.txt", "cats purr"), ("dogs.txt", "dogs bark")], "path string, text string")
    model = E.HashEmbedder()
    k = reading.extract_chunks(c).withColumn("embedding", E.column(model, F.col("text")))
    tools = agent.registry(spark, c, k, model)
    call = {"name": "search", "arguments": {"query": "purr"}}
    chat = Scripted({"tool_calls": [call, call], "thinking": "t"}, {"tool_calls": [{"name": "search", "arguments": {"query": "cats purr", "semantic": True, "top_k": 1}}, {"name": "nope"}]}, {"content": "done <ok>"})
    out = agent.Agent(chat, tools).run([{"role": "user", "content": "?"}])
    assert out.answer == "done <ok>" and out.reasoning == "t" and len(out.tool_calls) == 4
    assert out.tool_calls[0]["result"] == {"matches": [{"path": "cats.txt", "line": 1, "excerpt": "cats purr"}], "files_inspected": 2} == out.tool_calls[1]["result"]
    assert out.tool_calls[2]["result"]["matches"][0]["path"] == "cats.txt" and "error" in out.tool_calls[3]
    assert all("thinking" not in m for m in out.messages) and json.loads(out.to_json())["answer"] == "done <ok>"
    with pytest.raises(agent.OutOfCalls):
        agent.Agent(Scripted(*[{"tool_calls": [call]}] * 5), tools, max_calls=2).run([])
    assert tools["search"]({"query": "zzz"}) == '{"matches":null,"files_inspected":2}' and "2\t" not in tools["read"]({"path": "cats.txt"})


def test_index(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/index", "m1")
    listed = spark.createDataFrame([("a", 1, 9), ("b", 1, 9)], "path string, mtime_ms long, size long")
    k = spark.createDataFrame([("a", 1, 2, "", 1, "x"), ("a", 2, 2, "", 1, "yy"), ("b", 1, 1, "", 1, "z")], "path string, chunk_index int, total int, section string, tokens long, text string").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert index.stale(listed).count() == 2
    index.upsert(listed, k, 100)
    assert index.stale(listed).count() == 0 and index.chunk("a", 2).first().text == "yy"
    changed = spark.createDataFrame([("b", 2, 9)], "path string, mtime_ms long, size long")
    assert index.stale(changed).count() == 1
    index.upsert(changed, k.where("path = 'b'").withColumn("text", F.lit("new")), 200)
    assert index.status().first().asDict() == {"files": 2, "n_chunks": 3, "blob_size": 9} and index.chunk("b", 1).first().text == "new"
    index.evict(4096 + 4)
    assert [r.path for r in index.files().collect()] == ["b"]
    assert not any(r.path == "a" for r in index._all_chunks().collect())  # evicted data are deleted
    assert index.hits(changed, 300).count() == 1 and index.files().first().last_access == 300
    assert index.chunk("b", 1, 400).count() == 1 and index.files().first().last_access == 400
    # a write that failed before its commit, and was run again, leaves one copy
    index._write_chunks(k.where("path = 'b'"))
    index.upsert(changed, k.where("path = 'b'"), 500)
    assert [r.text for r in index.chunks().collect()] == ["z"]
    # another model starts empty; its first commit wipes the first one's data
    other = I.Index(spark, f"file://{tmp_path}/index", "m2")
    assert other.files().count() == 0 == other.chunks().count()
    other.upsert(listed, k, 600)
    assert sorted(r.text for r in other.chunks().collect()) == ["x", "yy", "z"] and index.files().count() == 0
    index.clear()
    assert index.files().count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_eviction_by_hand(spark, monkeypatch, few):
    monkeypatch.setattr(I, "FEW_FILES", few)
    rows = [(f"p{i:03}", 1, 1, "g", 1, 100 * (i % 7), 50 - i % 4) for i in range(120)]
    files_ = spark.createDataFrame(rows, I.FILES)
    for budget in (0, 5000, 100_000, 250_000, 1 << 40):
        left, want = budget, set()
        for r in sorted(rows, key=lambda r: (-r[6], r[0])):
            left -= r[5] + 4096
            if left < 0:
                break
            want.add(r[0])
        assert {r.path for r in I.evict(files_, budget).collect()} == want


def test_seal(spark):
    key = F.lit(b"0" * 16)
    df = spark.createDataFrame([(b"abc" * 50,), (b"",), (None,)], "x binary")
    for compress in (True, False):
        for k in (key, None):
            back = df.select("x", I.unseal(I.seal(F.col("x"), k, compress), k).alias("y")).collect()
            assert all(r.x == r.y for r in back)


def test_conversation_edges(spark):
    m = spark.createDataFrame([(1, 0, "system", "s" * 10), (1, 1, "user", "u" * 20), (1, 2, "assistant", None), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    r = C.context_report(m, 8, 0).where("conv_id = 1").first()
    assert (r.system_tokens, r.conversation_tokens, r.used, r.free) == (2, 5, 7, 1)
    assert {x.conv_id: (x.cut, x.ok) for x in C.compact_cut(m, 1).collect()} == {1: (1, True), 2: (None, False)}
    assert C.compact_cut(m, 0).where("conv_id = 1").first().cut == 3
    assert json.loads(C.transcript(m, "json").where("conv_id = 1").first().text) == [{"role": "user", "content": "u" * 20}]
    images = C.message_tokens(m.withColumn("i", F.array(F.lit("a"), F.lit("b"))), images="i").first().tokens
    assert images == 2 + 2 * 768


def test_settings_and_templates(tmp_path):
    at = tmp_path / "s"
    at.write_text("# c\nmax_search_results=abc\nunknown=1\ncache_max_bytes=0\nauto_context_min_score=0.5\n")
    s = settings.load(at)
    assert s["max_search_results"] == 200 and s["cache_max_bytes"] == 1 << 30 and s["auto_context_min_score"] == 0.5 and len(s) == 31
    settings.save(at, "max_search_results", "7")
    assert at.read_text().startswith("# c\nmax_search_results=7\nunknown=1") and settings.load(at)["max_search_results"] == 7
    with pytest.raises(ValueError):
        settings.save(at, "auto_context_min_score", "2")
    (tmp_path / "g").mkdir(), (tmp_path / "p").mkdir()
    (tmp_path / "g" / "a.md").write_text("---\ndescription: d\nargs: [x, y]\n---\nbody $1 $$2 $ARGS")
    (tmp_path / "p" / "a.md").write_text("own")
    (tmp_path / "g" / "b.md").write_text("---\nargs:\n  - q\n---\nB")
    a, b = templates.load(tmp_path / "g", tmp_path / "p")
    assert (a.body, a.source, b.args) == ("own", "project", ("q",))
    assert templates.parse("a", (tmp_path / "g" / "a.md").read_text(), "global").args == ("x", "y")
    assert templates.expand("$1-$2-$ARGS-$SELECTION ", ["p"], "s") == "p--p-s"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"request_id": "r", "seq": i, "message": {"content": c}, "done": i == 2} for i, c in enumerate("abc")]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    parts = streams.answer_parts(spark, str(tmp_path / "in"))
    q = parts.writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
    q.awaitTermination()
    r = C.stream_fold(spark.table("parts")).first()
    assert (r.content, r.complete) == ("abc", True)
    spark.createDataFrame([("a", 1, 1)], "path string, mtime_ms long, size long").write.parquet(str(tmp_path / "listed"))
    index = I.Index(spark, f"file://{tmp_path}/index", "m")
    read = lambda f: f.select("path", F.lit(1).alias("chunk_index"), F.lit(1).alias("total"), F.lit("").alias("section"), F.lit(1).cast("long").alias("tokens"), F.lit("t").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    streams.keep_index(spark.readStream.schema("path string, mtime_ms long, size long").parquet(str(tmp_path / "listed")), index, read, lambda: 5, str(tmp_path / "cp")).awaitTermination()
    assert index.status().first().files == 1
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "conv_id long, key string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    first = streams.first_injections(spark.readStream.schema("conv_id long, key string").parquet(str(tmp_path / "ev")))
    q = first.writeStream.format("memory").queryName("injected").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("injected").collect()) == ["a", "b"]
