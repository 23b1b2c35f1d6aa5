"""Queries over files that are made from the documents: a folder of files, formats, streams; and their SQL.

The folder has each document at source/lang/docN, every eleventh binary, every thirteenth an image, and entries that walks skip
or that lead out. Formats hold a document's whole text but for control characters (PDF: printable ASCII).
"""

from __future__ import annotations

import html
import io
import json
import os
import zipfile
import zlib
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import extract
from corpusmill.functions import text as T
from corpusmill.operators import conversations as C
from corpusmill.operators import index as I
from corpusmill.operators import listing, reading, search
from corpusmill.plans.registry import _CALLS, _CLEAN, _M, _PATHS, _SP, _calls, _cut_sql, documents, messages, paths, query, table
from corpusmill.sources import files, lines
from corpusmill.sources.paths import Escape, lexical
from corpusmill.sources.shared import new_folder, pieces, staged
from corpusmill.streaming import streams

# --- a folder of files --------------------------------------------------------------------------------------------------

_made: dict[tuple[str, str], str] = {}
_EXTRA = {".env": b"K=1\n", "node_modules/skipped.txt": b"x", ".git/config": b"x", "lib/vendor/skipped.go": b"x", "lib/_kept.go": b"package lib\n"}


def _local(uri: str) -> str:
    """The path of a folder that all machines mount; other stores are refused, as tasks would write to their own disks."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{uri}: listings need a folder that all machines mount")
    return unquote(at.path)


def corpus_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder, made once a session, by tasks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _made:
        return _made[key]
    root = _local(new_folder(spark, "files"))
    d = paths(spark, sf_dir).join(documents(spark, sf_dir), "doc_id").select("doc_id", "path", "text")

    def write(batches):
        for piece in pieces(batches):
            for n, path, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                path = f"{path}.png" if n % 13 == 0 else path
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write((b"\x00" if n % 11 == 0 else b"") + text.encode())
                os.chmod(at, 0o644)
                os.utime(at, (1000 * (n % 7), 1000 * (n % 7)))
            yield pa.RecordBatch.from_arrays([pa.array([piece.num_rows], pa.int64())], ["n"])

    d.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    for path, content in _EXTRA.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "wb") as f:
            f.write(content)
    os.makedirs(os.path.join(root, "empty"), exist_ok=True)
    for name, to in (("out.txt", "/etc/passwd"), ("in.txt", ".env")):
        if not os.path.islink(os.path.join(root, name)):
            os.symlink(to, os.path.join(root, name))
    _made[key] = root
    return root


_FOLDER_FILES = f"select case when doc_id % 13 = 0 then path || '.png' else path end as path, case when doc_id % 13 = 0 then name || '.png' else name end as name, doc_id, doc_id % 11 = 0 as bin, coalesce(text, '') as text, strlen(coalesce(text, '')) + (doc_id % 11 = 0)::int as size from ({_PATHS})"
_FOLDER = f"""select path, 'file' as type, 3 as depth, size::bigint as size from ({_FOLDER_FILES})
union all select distinct coalesce(source, 'none') || '/' || coalesce(lang, 'none'), 'dir', 2, null::bigint from documents union all select distinct coalesce(source, 'none'), 'dir', 1, null::bigint from documents
union all values ('.env', 'file', 1, 4), ('empty', 'dir', 1, null), ('lib', 'dir', 1, null), ('lib/_kept.go', 'file', 2, 12), ('in.txt', 'symlink', 1, null)"""


def _entries(spark, sf_dir, depth=None) -> DataFrame:
    e = files.entries(spark, corpus_folder(spark, sf_dir), depth)
    return e.select("path", "type", "depth", F.when(F.col("type") == "file", F.col("size")).alias("size"))


def _contents(spark, sf_dir, max_bytes=None) -> DataFrame:
    root = corpus_folder(spark, sf_dir)
    return files.contents(files.entries(spark, root), root, max_bytes)


@query(_FOLDER)
def scan_tree(spark, sf_dir):
    """Every entry: hidden ones and links within the root, nothing below skipped names, no link that leads out."""
    return _entries(spark, sf_dir)


@query(f"select * from ({_FOLDER}) where depth <= 2")
def scan_tree_depth(spark, sf_dir):
    return _entries(spark, sf_dir, 2)


@query("select path, type, depth from (values ('node_modules', 'dir', 1), ('node_modules/skipped.txt', 'file', 2), ('lib', 'dir', 1), ('lib/vendor', 'dir', 2), ('lib/vendor/skipped.go', 'file', 3), ('lib/_kept.go', 'file', 2)) v(path, type, depth)")
def skip_names(spark, sf_dir):
    """What is below node_modules and lib where nothing is skipped."""
    e = files.entries(spark, corpus_folder(spark, sf_dir), skip=("",))
    return e.where("path like 'node_modules%' or path like 'lib%'").select("path", "type", "depth")


@query(f"select path, 'file' as type, size::bigint as size_bytes, '-rw-r--r--' as permissions, nullif(lower(regexp_extract(name, '(\\.[^.]*)$', 1)), '') as extension, (1000 * (doc_id % 7))::bigint as mod_time from ({_FOLDER_FILES}) where doc_id = 26")
def stat_entry(spark, sf_dir):
    path = paths(spark, sf_dir).where("doc_id = 26").first()["path"] + ".png"
    return listing.stat(files.entries(spark, corpus_folder(spark, sf_dir)), path).withColumn("mod_time", F.unix_seconds("mod_time"))


_SMALL = 3000


@query(f"select path, sha256(case when bin then encode(chr(0) || text) else encode(text) end) as sha from ({_FOLDER_FILES}) where size <= {_SMALL} union all values ('.env', sha256('K=1' || chr(10))), ('in.txt', sha256('K=1' || chr(10))), ('lib/_kept.go', sha256('package lib' || chr(10)))")
def read_contents(spark, sf_dir):
    """Contents of files that aren't too large, links followed within the root."""
    return _contents(spark, sf_dir, _SMALL).select("path", F.sha2("content", 256).alias("sha"))


@query(f"select path, size::bigint as size, case when doc_id % 13 = 0 then (1000 * (doc_id % 7) * 1000)::bigint end as mtime_ms from ({_FOLDER_FILES}) where doc_id % 13 = 0 and size <= {_SMALL}")
def read_binary_files(spark, sf_dir):
    """Through Spark's own reader, name and size pruned before any content is read."""
    return files.binary_files(spark, "file://" + corpus_folder(spark, sf_dir), _SMALL, "*.png").select("path", "size", "mtime_ms")


_NUMBERED = "string_agg(lpad(i::varchar, greatest(6, length(i::varchar))::int, ' ') || chr(9) || case when ends_with(l, chr(13)) then left(l, length(l) - 1) else l end || chr(10), '' order by i)"


@query(f"""with f as (select path, bin, text from ({_FOLDER_FILES}) union all values ('.env', false, 'K=1' || chr(10)), ('in.txt', false, 'K=1' || chr(10)), ('lib/_kept.go', false, 'package lib' || chr(10))),
p as (select path, string_split(text, chr(10)) as parts from f where not bin and text <> ''),
n as (select path, {_NUMBERED} as text from p, unnest(case when parts[-1] = '' then parts[:-2] else parts end) with ordinality u(l, i) group by path)
select path, case when bin then null when f.text = '' then '(empty file)' else n.text end as text, case when bin then path || ': binary' end as error from f left join n using (path)""")
def read_any(spark, sf_dir):
    """Any file as text: lines with their numbers, binary files refused."""
    return extract.read_any(_contents(spark, sf_dir))


@query(f"""with f as (select path, text from ({_FOLDER_FILES}) where not bin union all values ('.env', 'K=1' || chr(10)), ('lib/_kept.go', 'package lib' || chr(10))),
p as (select path, string_split(text, chr(10)) as parts from f where text <> '')
select path, i as line, case when ends_with(l, chr(13)) then left(l, length(l) - 1) else l end as text from p, unnest(case when parts[-1] = '' then parts[:-2] else parts end) with ordinality u(l, i)""")
def read_split_lines(spark, sf_dir):
    """Lines of all text files, each file cut into ranges of 1000 bytes."""
    root = corpus_folder(spark, sf_dir)
    listed = files.entries(spark, root).where("type = 'file'")
    small = files.contents(listed, root).where(T.is_text(F.col("content"))).select("path")
    return lines.numbered_lines(listed.join(small, "path", "left_semi").select("path", "size"), root, range_bytes=1000)


@query(f"select path, size::bigint as size, case when size <= {_SMALL} then replace(base64(case when bin then encode(chr(0) || text) else encode(text) end), chr(10), '') end as base64, case when size > {_SMALL} then path || ': larger than {_SMALL} bytes' end as error from ({_FOLDER_FILES}) where doc_id % 13 = 0")
def read_image(spark, sf_dir):
    return reading.read_images(_contents(spark, sf_dir).where("path like '%.png'"), _SMALL)


_PATHS_ASKED = [("a/b", "a/b"), ("a/../c", "c"), (".", "."), ("", "."), ("a//b/./c/", "a/b/c"), ("..", None), ("../x", None), ("a/../../x", None), ("/etc/passwd", None), ("a/../..", None), ("..x/y", "..x/y"), ("a/..", ".")]
_CONFINED = "(values " + ", ".join(f"({i}, '{p}', {'null' if r is None else repr(r)})" for i, (p, r) in enumerate(_PATHS_ASKED)) + ") v(i, asked, resolved)"


@query(f"select doc_id, asked || case when resolved is null then '' else '/x' || doc_id end as path, case when resolved = '.' then '' else resolved || '/' end || 'x' || doc_id as resolved from documents join {_CONFINED} on i = doc_id % {len(_PATHS_ASKED)} where resolved is not null and asked <> ''")
def confined_paths(spark, sf_dir):
    """Paths that stay below the root, and what they stand for."""
    forms = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r is not None).alias("ok")) for p, r in _PATHS_ASKED])
    one = F.element_at(forms, (F.col("doc_id") % len(_PATHS_ASKED) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", one["p"].alias("p"), one["ok"].alias("ok")).where("p <> ''")
    d = d.select("doc_id", F.when(F.col("ok"), F.concat("p", F.lit("/x"), F.col("doc_id").cast("string"))).otherwise(F.col("p")).alias("path"))

    @F.pandas_udf("string")
    def resolved(values: pd.Series) -> pd.Series:
        def one(path):
            try:
                return lexical(path)
            except Escape:
                return None

        return values.map(one)

    both = d.withColumn("resolved", resolved("path"))
    inside = listing.confined(d).select("doc_id")  # by a column expression, and by Python: the same rows
    return both.where("resolved is not null").join(inside, "doc_id")


# --- formats ------------------------------------------------------------------------------------------------------------

_WHOLE = r"regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g')"
_ASCII = "regexp_replace(coalesce(text, ''), '[^ -~\\n]', '', 'g')"


def _made_from(text: str) -> str:
    return f"select doc_id, {text} as text, string_split({text}, chr(10)) as lines, list_transform(string_split({text}, chr(10)), lambda x: trim(x, {_SP})) as a from documents"


#: Whole texts but for control characters, which some formats can't hold; printable ASCII for PDF, whose fonts' encodings aren't read.
_PLAIN, _PLAIN_ASCII = _made_from(_WHOLE), _made_from(_ASCII)


def _texts(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F\x7F]", "").alias("text"))


_NORMAL = f"trim(array_to_string(list_filter(a, lambda x, i: x <> '' or i = 1 or a[i - 1] <> ''), chr(10)), {_SP})"


def _made_of(spark, sf_dir, ending: str, make) -> DataFrame:
    """path, text, error of files that make(doc_id, text without control characters) gives as bytes."""
    d = _texts(spark, sf_dir)

    def run(batches):
        for piece in pieces(batches):
            ids, texts = (c.to_pylist() for c in piece.columns)
            yield pa.RecordBatch.from_arrays([pa.array([f"d{n}{ending}" for n in ids], pa.string()), pa.array([make(n, t) for n, t in zip(ids, texts, strict=True)], pa.binary())], ["path", "content"])

    return extract.extract(d.mapInArrow(run, "path string, content binary"))


def _zip(**entries: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def _expected(ending: str, text: str, error: str = "null::varchar", more: str = "") -> str:
    return f"select 'd' || doc_id || '{ending}' as path, {text} as text, {error} as error from ({_PLAIN}){more}"


@query(_expected(".md", "text"))
def extract_plain(spark, sf_dir):
    return _made_of(spark, sf_dir, ".md", lambda n, t: t.encode())


@query(_expected(".zzz", "case when doc_id % 3 = 0 then text end", "case doc_id % 3 when 1 then 'binary content' when 2 then 'not UTF-8' end"))
def extract_maybe(spark, sf_dir):
    """Files of unknown kinds: only UTF-8 without NULs is text."""
    return _made_of(spark, sf_dir, ".zzz", lambda n, t: t.encode() + (b"", b"\x00", b"\xff\xfe")[n % 3])


@query(_expected(".json", "case when doc_id % 4 = 3 then '{ \"a\" : ' else '{\"b\":[' || doc_id || ',2.50,\"x  y\"],\"a\":' || to_json(text)::varchar || '}' end"))
def extract_json(spark, sf_dir):
    """White space outside strings goes; keys and numbers stay as they are; what is no JSON stays."""
    return _made_of(spark, sf_dir, ".json", lambda n, t: b'{ "a" : ' if n % 4 == 3 else f'{{ "b" :\n [ {n} , 2.50,\t"x  y" ] ,  "a" : {json.dumps(t, ensure_ascii=False)} }}\n'.encode())


@query(_expected(".xml", "array_to_string(list_filter(a, lambda x: x <> ''), chr(10))"))
def extract_xml(spark, sf_dir):
    return _made_of(spark, sf_dir, ".xml", lambda n, t: ("<r n='1'>" + "".join(f"<a> {html.escape(line)} </a>\n" for line in t.split("\n")) + "</r>").encode())


@query(_expected(".html", _NORMAL))
def extract_html(spark, sf_dir):
    """Visible text: head, script, style, noscript and template are silent, blocks and br end lines."""
    head = "<!doctype html><html><head><title>t</title></head><body><script>var x = '<p>no</p>';</script><style>p {}</style>"
    return _made_of(spark, sf_dir, ".html", lambda n, t: (head + "".join(f"<p>{html.escape(line)}</p>" if i % 2 else f"<span>{html.escape(line)}</span><br>" for i, line in enumerate(t.split("\n"))) + "<noscript>n</noscript><template>t</template></body></html>").encode())


_ARTICLE = "'## Doc ' || doc_id || chr(10) || chr(10) || array_to_string(list_filter(list_transform(a, lambda x: case when x = '' then '' else '*x* ' || x || chr(10) || chr(10) end), lambda x: x <> ''), '') || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '[t](/u' || doc_id || ')'"


@query(f"select doc_id, case when doc_id % 5 = 0 then 'only a menu' else {_ARTICLE} end as text from ({_PLAIN})")
def extract_article(spark, sf_dir):
    """A page's article as Markdown, without navigation and footers; a page with nothing else gives its visible text."""
    d = _texts(spark, sf_dir)

    def page(n: int, text: str) -> str:
        if n % 5 == 0:
            return "<html><body><nav>only a menu</nav></body></html>"
        lines = "".join(f"<p><em>x</em> {html.escape(line.strip(T.SPACE))}</p>" for line in text.split("\n") if line.strip(T.SPACE))
        return f"<html><head><title>t</title></head><body><nav>menu</nav><article><header>h</header><h2>Doc {n}</h2>{lines}<ul><li>one</li><li>two</li></ul><a href='/u{n}'>t</a><aside>ad</aside></article><footer>f</footer></body></html>"

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([page(n, t) for n, t in zip(*(c.to_pylist() for c in piece.columns), strict=True)], pa.string())], ["doc_id", "html"])

    return extract.page_text(d.mapInArrow(run, "doc_id long, html string"), article=True).select("doc_id", "text")


@query(_expected(".csv", "array_to_string(list_transform(lines, lambda x: x || chr(9) || doc_id), chr(10))"))
def extract_csv(spark, sf_dir):
    """Quoted fields become tab-joined lines; blank lines between records are no records."""
    return _made_of(spark, sf_dir, ".csv", lambda n, t: "\r\n\r\n".join('"' + line.replace('"', '""') + f'",{n}' for line in t.split("\n")).encode())


@query(_expected(".docx", "array_to_string(lines, chr(10)) || chr(10) || chr(9) || 'end' || chr(10) || 'x' || chr(10)"))
def extract_docx(spark, sf_dir):
    def make(n, t):
        body = "".join(f"<w:p><w:r><w:t>{html.escape(line)}</w:t></w:r></w:p>" for line in t.split("\n"))
        return _zip(word__document_xml=f"<w:document xmlns:w='w'><w:body>{body}<w:p><w:r><w:tab/><w:t>end</w:t><w:br/><w:t>x</w:t></w:r></w:p></w:body></w:document>")

    return _made_of(spark, sf_dir, ".docx", make)


@query(_expected(".pptx", f"'# slide1.xml' || chr(10) || chr(10) || 'first ' || doc_id || chr(10) || case when trim(text, {_SP}) <> '' then chr(10) || chr(10) || '# slide2.xml' || chr(10) || chr(10) || text || chr(10) else '' end || chr(10) || chr(10) || '# slide10.xml' || chr(10) || chr(10) || 'tenth' || chr(10)"))
def extract_pptx(spark, sf_dir):
    """Slides by number, blank ones left out."""

    def make(n, t):
        slide = lambda x: f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>{html.escape(x)}</a:t></a:p></p:sld>"
        return _zip(ppt__slides__slide10_xml=slide("tenth"), ppt__slides__slide2_xml=slide(t), ppt__slides__slide1_xml=slide(f"first {n}"))

    return _made_of(spark, sf_dir, ".pptx", make)


@query(_expected(".xlsx", "'# sheet1.xml' || chr(10) || chr(10) || array_to_string(list_transform(a, lambda x: x || chr(9) || chr(9) || doc_id), chr(10))"))
def extract_xlsx(spark, sf_dir):
    """Cells by their columns, strings through the shared table, phonetic marks left out, empty rows dropped."""

    def make(n, t):
        lines = t.split("\n")
        shared = "".join(f"<si><t xml:space='preserve'>{html.escape(line)}</t><rPh><t>no</t></rPh></si>" for line in lines)
        rows = "".join(f"<row><c r='A{i}' t='s'><v>{i}</v></c><c r='C{i}'><v>{n}</v></c></row><row><c r='A9'><v> </v></c></row>" for i in range(len(lines)))
        return _zip(xl__sharedStrings_xml=f"<sst>{shared}</sst>", xl__worksheets__sheet1_xml=f"<worksheet><sheetData>{rows}</sheetData></worksheet>")

    return _made_of(spark, sf_dir, ".xlsx", make)


@query(_expected(".rtf", _NORMAL))
def extract_rtf(spark, sf_dir):
    """Groups without text are skipped; escapes and paragraph words become text."""

    def make(n, t):
        written = lambda c: "\\" + c if c in "\\{}" else c if c < "\x7f" else "".join(f"\\'{b:02x}" for b in c.encode())
        body = "\\par\n".join("".join(map(written, line)) for line in t.split("\n"))
        return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}{\\info{\\title none}}\\f0\\fs24 " + body + "\\par\n}").encode()

    return _made_of(spark, sf_dir, ".rtf", make)


@query(f"select 'd' || doc_id || '.pdf' as path, array_to_string(list_filter(list_transform(lines, lambda x: rtrim(x)), lambda x: trim(x) <> ''), chr(10)) as text from ({_PLAIN_ASCII})")
def extract_pdf(spark, sf_dir):
    """Content streams, plain and deflated, by the reader that needs no other program."""
    d = documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[^ -~\\n]", "").alias("text"))

    def make(n, t):
        shown = [line.rstrip(" ") for line in t.split("\n") if line.strip(" ")]
        body = b"BT /F1 12 Tf 72 720 Td\n" + b"".join(b"(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode() + b") Tj 0 -14 Td\n" for line in shown) + b"ET"
        head = b"/Length 1"
        if n % 2:
            head, body = b"/Filter /FlateDecode " + head, zlib.compress(body)
        return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n4 0 obj\n<< " + head + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"

    def run(batches):
        for piece in pieces(batches):
            ids, texts = (c.to_pylist() for c in piece.columns)
            yield pa.RecordBatch.from_arrays([pa.array([f"d{n}.pdf" for n in ids], pa.string()), pa.array([extract.pdf_plain(make(n, t)) for n, t in zip(ids, texts, strict=True)], pa.string())], ["path", "text"])

    return d.mapInArrow(run, "path string, text string")


@query(f"select doc_id, strlen(text) > 700 as refused from ({_PLAIN})")
def zip_guard(spark, sf_dir):
    """An archive's entry that inflates beyond a limit is refused, however small it is packed."""
    d = _texts(spark, sf_dir)

    def refused(text: str) -> bool:
        with zipfile.ZipFile(io.BytesIO(_zip(a_xml=text))) as z:
            try:
                extract._entry(z, "a.xml", 700)
            except extract.Unsupported:
                return True
        return False

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([refused(t) for t in piece.column(1).to_pylist()], pa.bool_())], ["doc_id", "refused"])

    return d.mapInArrow(run, "doc_id long, refused boolean")


@query(f"""with p as (select 'd' || doc_id || '.html' as path, {_NORMAL} as text from ({_PLAIN})), c as (select p.path, coalesce(k.text, '') as t from p left join ({_CLEAN.format(source=f"select 'd' || doc_id || '.html' as path, {_NORMAL} as text from ({_PLAIN})")}) k using (path))
select path, case when t = '' then '(no extractable text)' else {_cut_sql('t', 1000, "chr(10) || '[truncated to 1000 bytes — call read(path=\"' || path || '\") alone for the full chunked manifest]' || chr(10)")} end as text, null::varchar as error from c""")
def read_any_documents(spark, sf_dir):
    """Documents among any files: extracted, cleaned, cut with a notice."""
    d = _texts(spark, sf_dir)
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(escaped(x), F.lit("<br>"))), ""), F.lit("</body></html>"))
    return extract.read_any(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), page.cast("binary").alias("content")), 1000)


# --- streams ------------------------------------------------------------------------------------------------------------


@query(f"""select conv_id::varchar as request_id, string_agg(case when role = 'assistant' then text else '' end, '' order by turn) as content, string_agg(case when role <> 'assistant' then text else '' end, '' order by turn) as thinking, max(turn) >= 3 as complete from ({_M}) group by conv_id""")
def token_stream(spark, sf_dir):
    """Parts of answers as files of JSON lines, read as a stream to a table, and folded."""
    said = F.col("role") == "assistant"
    m = messages(spark, sf_dir)
    parts = m.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("long").alias("seq"), F.struct(F.when(said, F.col("text")).alias("content"), F.when(~said, F.col("text")).alias("thinking")).alias("message"), (F.col("turn") == 3).alias("done"))
    at = new_folder(spark, "parts")
    parts.write.json(f"{at}/in")
    stream = streams.answer_parts(spark, f"{at}/in").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return C.stream_fold(spark.read.parquet(f"{at}/out")).drop("tool_calls")


def _one_file(df: DataFrame, at: str) -> None:
    df.coalesce(1).write.mode("append").parquet(at)


@query("select 'f' || doc_id as path, case when doc_id % 10 = 0 then 2 else 1 end::bigint as mtime_ms, case when doc_id % 10 = 0 then 200 else 100 end::bigint as last_access, 1::bigint as n_chunks from documents")
def incremental_index(spark, sf_dir):
    """A stream of listings keeps an index: the second listing has a tenth of the files changed, and only those are read."""
    at = new_folder(spark, "listings")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    listed = lambda changed: d.select("path", F.when(F.lit(changed) & (F.col("doc_id") % 10 == 0), 2).otherwise(1).cast("long").alias("mtime_ms"), F.lit(1).cast("long").alias("size"))
    index = I.Index(spark, f"{at}/index", "m")
    read = lambda f: f.select("path", F.lit(1).alias("chunk_index"), F.lit(1).alias("total"), F.lit("").alias("section"), F.lit(1).cast("long").alias("tokens"), F.lit("t").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    for changed, now in ((False, 100), (True, 200)):
        _one_file(listed(changed), f"{at}/in")
        stream = spark.readStream.schema("path string, mtime_ms long, size long").parquet(f"{at}/in")
        streams.keep_index(stream, index, read, lambda now=now: now, f"{at}/checkpoint").awaitTermination()
    return index.files().select("path", "mtime_ms", "last_access", "n_chunks")


@query(f"""select path, 'added' as change from (select concat_ws('/', coalesce(lang, 'none'), 'f' || doc_id) as path from documents) union all
select concat_ws('/', coalesce(lang, 'none'), 'f' || doc_id), case when doc_id % 10 = 0 then 'changed' else 'removed' end from documents where doc_id % 10 = 0 or doc_id % 7 = 0 union all select 'new/g' || doc_id, 'added' from documents where doc_id % 5 = 0""")
def folder_changes(spark, sf_dir):
    """A stream over a folder: all its files; then, run again, what was added, changed and removed meanwhile."""
    top = _local(new_folder(spark, "followed"))
    root = f"{top}/root"
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def put(path: str, text: str, time: int) -> None:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text.encode())
        os.utime(f"{root}/{path}", (time, time))

    def first(batches):
        for piece in pieces(batches):
            for _, path, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                put(path, text, 1000)
            yield pa.RecordBatch.from_arrays([pa.array([piece.num_rows], pa.int64())], ["n"])

    def second(batches):
        for piece in pieces(batches):
            for n, path, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if n % 10 == 0:
                    put(path, text, 2000)
                elif n % 7 == 0 and os.path.exists(f"{root}/{path}"):
                    os.remove(f"{root}/{path}")
                if n % 5 == 0:
                    put(f"new/g{n}", text, 2000)
            yield pa.RecordBatch.from_arrays([pa.array([piece.num_rows], pa.int64())], ["n"])

    for work in (first, second):
        d.mapInArrow(work, "n long").agg(F.sum("n")).collect()
        found = files.changes(spark, root, f"{top}/snapshots").select("path", "change")
        found.writeStream.format("parquet").option("path", f"file://{top}/out").option("checkpointLocation", f"file://{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"file://{top}/out")


@query(f"""select conv_id, seq, min(case when not failed then seq end) over (partition by conv_id, name, path, coalesce(start_line, -1) order by seq rows between unbounded preceding and 1 preceding) as source from ({_CALLS})""")
def tool_memo_stream(spark, sf_dir):
    """Calls that come in three batches, the stream stopped and started between them: what each turn's memo says."""
    at = new_folder(spark, "calls")
    calls = _calls(spark, sf_dir).select("conv_id", "turn", "seq", "name", "arguments", "error")
    for low, high in ((0, 2), (3, 4), (5, 1 << 40)):
        calls.where(F.col("seq").between(low, high)).write.mode("append").parquet(f"{at}/in")
        with streams.with_rocksdb(spark):
            found = streams.turn_memo(spark.readStream.schema(calls.schema).parquet(f"{at}/in"), 3_600_000)
            found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("conv_id", "seq", "source")


@query("select conv_id, 'k' || (turn % 2) as key, round from (select distinct conv_id, turn % 2 as turn from conversations), (values (1), (2)) r(round)")
def conv_state(spark, sf_dir):
    """Keys that weren't injected before: each once, and once more after the conversation is cleared."""
    at = new_folder(spark, "events")
    keys = messages(spark, sf_dir).select("conv_id", F.concat(F.lit("k"), (F.col("turn") % 2).cast("string")).alias("key"))
    cleared = keys.select("conv_id", F.lit(None).cast("string").alias("key")).distinct()
    rounds = []
    for i, events in enumerate((keys, cleared, keys)):
        _one_file(events, f"{at}/in")
        first = streams.first_injections(spark.readStream.schema("conv_id long, key string").parquet(f"{at}/in"))
        first.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if i != 1:
            rounds.append(staged(spark.read.parquet(f"{at}/out").groupBy("conv_id", "key").agg(F.count("*").alias("times")), "seen"))
    again = rounds[1].withColumn("round", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select("conv_id", "key", "round")


@query("select count(*) as done, count(*) as total, true as rising from documents")
def progress(spark, sf_dir):
    """What a stream's callback was told last; it never went back."""
    at = new_folder(spark, "progress")
    d = table(spark, sf_dir, "documents").select("doc_id")
    d.write.parquet(f"{at}/in")
    told: list[tuple[int, int]] = []
    callback = streams.Progress(lambda done, total: told.append((done, total)), d.count())
    step = streams.with_progress(lambda batch, _: None, callback)
    stream = spark.readStream.schema("doc_id long").parquet(f"{at}/in").writeStream.foreachBatch(step)
    stream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame([(*told[-1], told == sorted(told))], "done long, total long, rising boolean")
