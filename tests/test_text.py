import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import chunking
from corpusmill.functions import extract as X
from corpusmill.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("a  b \n\n\n c\t\n", "a  b\n\nc"), ("  \n \n", ""), ("", ""), ("x\r\n\r\n\r\ny", "x\n\ny"), ("\n\na", "a")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize_ws) == want == X.normalize_ws(text)


def test_clean_drops_page_numbers_and_footers(spark):
    text = "# part\nbody\nfoot\nPage 3 of 20\n7/9\nfoot\nmore\nfoot\n# part\n# part"
    assert one(spark, text, T.clean) == "# part\nbody\nmore\n# part\n# part"
    assert one(spark, "a\na", T.clean) == "a\na"


@pytest.mark.parametrize(("text", "n"), [("", 0), ("   ", 0), ("abc", 1), ("a" * 8, 2), ("é" * 9, 2), ("\n\t", 0), (" " * 9, 2)])
def test_tokens(spark, text, n):
    assert one(spark, text, T.estimate_tokens) == n == chunking.tokens(text)


def test_lines_and_excerpts(spark):
    assert one(spark, "a\r\nb\rc\n\nd\n", T.lines) == ["a", "b\rc", "", "d"]
    assert one(spark, "", T.lines) == []
    assert one(spark, "é" * 250 + " target", T.excerpt) == "é" * 200 + "…"
    assert one(spark, "  x ", T.excerpt) == "x"


def test_summary(spark):
    assert one(spark, "# h\n\n A  b. C d", T.summary) == "A b."
    assert one(spark, "w" * 130 + ". x", T.summary) == "w" * 120
    assert one(spark, "# only", T.summary) == ""


def test_names_and_keys(spark):
    assert [one(spark, x, T.extension) for x in (".env", "a.tar.gz", "none", "A.PY")] == [".env", ".gz", "", ".py"]
    names = ["slide10", "slide2", "slide02x", "a1b2", "a1b10"]
    df = spark.createDataFrame([(n,) for n in names], "x string").orderBy(T.natural_key(F.col("x")))
    assert [r.x for r in df.collect()] == ["a1b2", "a1b10", "slide2", "slide02x", "slide10"]
    assert [one(spark, x, T.column_index) for x in ("A1", "C3", "AA10", "9")] == [0, 2, 26, -1]
    assert one(spark, {0: "a", 2: "c"}, T.join_row, "map<int,string>") == "a\t\tc"
    assert one(spark, {1: ""}, T.join_row, "map<int,string>") == ""
    assert one(spark, "see @a\\ b.txt and @c", T.at_paths) == ["a b.txt", "c"]


def test_arguments(spark):
    assert [one(spark, x, T.as_int) for x in ("3", " 4 ", "3.9", "x")] == [3, 4, 3, None]
    assert [one(spark, x, T.as_bool) for x in ("Yes", "0", "maybe")] == [True, False, None]
    assert one(spark, '["a", 1, "b", null]', T.only_strings) == ["a", "b"]
    assert one(spark, '{"b": 1, "a": 2}', lambda c: T.call_key(F.lit("read"), c)) == 'read\x00{"a":2,"b":1}'


def test_binary_and_pages(spark):
    assert one(spark, b"\x00\x01\x02hi", T.is_text, "binary") is False and one(spark, b"hi", T.is_text, "binary") is True
    assert one(spark, " \n<!DOCTYPE html><p>", T.is_html) and not one(spark, "plain <html", T.is_html)
    assert one(spark, "HTTPS://a.example/x", T.url_allowed) and not one(spark, "http://a.example", T.url_allowed) and not one(spark, "file:///x", T.url_allowed)


@given(st.text(alphabet="ab# \n.é", max_size=400), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_chunks_keep_all_words_in_order(text, most):
    made = chunking.chunks(text, most)
    body = [w for s, p in chunking.segments(text) for w in p.split()]
    assert "".join(body) == "".join(w for c in made for w in c["text"].split())
    assert [c["chunk_index"] for c in made] == list(range(1, len(made) + 1)) and all(c["total"] == len(made) for c in made)


def test_chunk_rules():
    text = "\n\n".join(f"# Section {i}\n{'p' * 300}\n\n{'q' * 300}" for i in range(3))
    made = chunking.chunks(text, 100)
    assert [c["section"] for c in made] == [f"Section {i}" for i in range(3) for _ in range(2)]
    assert all("#" not in c["text"] for c in made) and chunking.chunks("# meeting notes\n") == [] == chunking.chunks(None)
    assert [len(c["text"]) for c in chunking.chunks("😀" * 16000)] == [8000, 8000]
    assert [len(chunking.chunks("x" * n, most)) for n, most in ((8001, 2000), (8003, 0), (8004, 2000))] == [1, 1, 2]
