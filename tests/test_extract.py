import io
import zipfile

import pytest

from corpusmill.functions import extract as X


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_plain_json_csv_xml():
    assert X.extract_text("a.py", b"x = 1\n") == "x = 1\n"
    assert X.extract_text("a.json", b'{ "b" : [1, 2.50],\n "a b": "c  d" }') == '{"b":[1,2.50],"a b":"c  d"}'
    assert X.extract_text("a.jsonl", b'{"a": 1}\n{"a": 2}') == '{"a": 1}\n{"a": 2}'
    assert X.extract_text("a.csv", b'a,"b,c"\n\n1,2,3\n') == "a\tb,c\n1\t2\t3"
    assert X.extract_text("a.tsv", b"a\tb\n") == "a\tb"
    assert X.extract_text("a.xml", b"<a> x <b>y</b>\n z</a>") == "x\ny\nz"
    assert X.extract_text(".env", b"K=1") == "K=1"


def test_unknown_and_broken():
    assert X.extract_text("a.unknown", b"text") == "text"
    for name, body in (("a.bin", b"\x00x"), ("a.bin", b"\xff"), ("a.xml", b"<a><b></a>"), ("a.docx", b"no zip"), ("a.docx", archive(x="1"))):
        with pytest.raises(X.Unsupported):
            X.extract_text(name, body)


def test_html():
    page = "<!doctype html><html><head><title>t</title><script>var a='<p>'</script></head><body><p>One<p>Two<br>three<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><noscript>n</noscript>&amp; end"
    assert X.html_text(page) == "One\nTwo\nthree\n\na\nb\n\ncd\n\n& end" or X.html_text(page).replace("\n\n", "\n") == "One\nTwo\nthree\na\nb\ncd\n& end"
    assert "nav" not in X.article_markdown("<html><body><nav>nav</nav><article><h2>T</h2><p>a <b>b</b> <a href='/x'>c</a></article></body></html>")
    assert X.article_markdown("<html><body><article><h2>T</h2><p>a <b>b</b> <a href='/x'>c</a></article></body></html>") == "## T\n\na **b** [c](/x)"


def test_office():
    w = "<w:document xmlns:w='w'><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:p><w:t>d</w:t></w:p></w:document>"
    assert X.extract_text("a.docx", archive(word__document_xml=w)) == "a\tb\nc\nd\n"
    slide = "<s xmlns:a='a'><a:p><a:t>{}</a:t></a:p></s>"
    deck = archive(ppt__slides__slide10_xml=slide.format("ten"), ppt__slides__slide2_xml=slide.format("two"), ppt__slides__slide1_xml=slide.format(" "))
    assert X.extract_text("a.pptx", deck) == "# slide2.xml\n\ntwo\n\n\n# slide10.xml\n\nten\n"
    shared = "<sst><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r><rPh><t>no</t></rPh></si></sst>"
    sheet = '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c><v>5</v></c><c><v>6</v></c></row></s>'
    assert X.extract_text("a.xlsx", archive(xl__sharedStrings_xml=shared, xl__worksheets__sheet1_xml=sheet)) == "# sheet1.xml\n\none\t\ttwo\n5\t6"


def test_rtf():
    assert X.extract_text("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par World\'41 \{x\}\emdash }") == "Hello\nWorldA {x}—"


def test_rows(spark):
    got = X.extract(spark.createDataFrame([("a.txt", b"x"), ("b.docx", b"bad")], "path string, content binary")).collect()
    assert got[0].text == "x" and got[0].error is None and got[1].text is None and got[1].error
