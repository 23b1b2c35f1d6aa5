"""Text of files by format. `extract_text` dispatches on the extension; `extract` runs it over a DataFrame of contents."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import subprocess
import zipfile
import zlib
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.text import SPACE
from corpusmill.sources.shared import pieces

#: Extensions by format.
PLAIN = set(
    """.txt .text .md .markdown .mdx .rst .adoc .asciidoc .log .logs .out .err .diff .patch .go .py .js .jsx .ts .tsx .c .h
    .cpp .cc .hpp .java .kt .rs .rb .php .pl .lua .swift .scala .clj .ex .exs .erl .hs .dart .r .jl .cs .fs .sql .sh .bash
    .zsh .fish .ps1 .bat .cmd .awk .sed .yaml .yml .toml .ini .cfg .conf .properties .env .tf .tfvars .hcl .css .scss .sass
    .less .graphql .gql""".split()
)
JSON = set(".json .geojson .topojson .jsonld .har .ipynb .map .webmanifest .arb .avsc .avpr .avro .jsonc .json5 .jsonl .ndjson".split())
DOCUMENTS = set(".pdf .docx .xlsx .pptx .rtf .html .htm .csv .tsv .xml .json".split())
#: Elements after which a line ends, and those without text.
BLOCKS = set("p div li ul ol tr table section article header footer blockquote pre h1 h2 h3 h4 h5 h6 hr dl dd dt figure nav aside main address".split())
SILENT = set("script style head noscript template".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: RTF control words that stand for text, and destinations without any.
RTF_TEXT = {"par": "\n", "sect": "\n", "page": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "emspace": "\u2003", "enspace": "\u2002", "qmspace": "\u2005", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
RTF_SILENT = set(
    """aftncn aftnsep aftnsepc annotation atnauthor atndate atnicn atnid atnparent atnref atntime atrfend atrfstart author
    background bkmkend bkmkstart blipuid buptim category colorschememapping colortbl comment company creatim datafield datastore
    defchp defpap do doccomm docvar dptxbxtext ebcend ebcstart factoidname falt fchars ffdeftext ffentrymcr ffexitmcr ffformat
    ffhelptext ffl ffname ffstattext field file filetbl fldinst fldrslt fldtype fname fontemb fontfile fonttbl footer footerf
    footerl footerr footnote formfield ftncn ftnsep ftnsepc g generator gridtbl header headerf headerl headerr hl hlfr hlinkbase
    hlloc hlsrc hsv htmltag info keycode keywords latentstyles lchars levelnumbers leveltext lfolevel linkval list listlevel
    listname listoverride listoverridetable listpicture liststylename listtable listtext lsdlockedexcept""".split()
)
#: Bytes of an archive's entry, and what a reader says of files without text and of cut documents.
MAX_ENTRY = 512 << 20
NO_TEXT, EMPTY = "(no extractable text)", "(empty file)"
CUT = ("\n[truncated to {} bytes — call read(path=\"", "\") alone for the full chunked manifest]\n")


class Unsupported(ValueError):
    """The format can't be read here."""


def normalize_ws(text: str) -> str:
    """As functions.text.normalize_ws, for text that is in Python already."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.strip(SPACE)
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip(SPACE)


def plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def maybe(content: bytes) -> str:
    """Any content that is UTF-8 without NULs."""
    if b"\x00" in content:
        raise Unsupported("binary content")
    try:
        return content.decode()
    except UnicodeDecodeError:
        raise Unsupported("not UTF-8") from None


def compact_json(content: bytes) -> str:
    """White space outside strings dropped, all else as it is; text that is no JSON stays."""
    text = plain(content)
    try:
        json.loads(text)
    except ValueError:
        return text
    return re.sub(r'("(?:\\.|[^"\\])*")|\s+', lambda m: m[1] or "", text)


def _expat(content: bytes, start=None, end=None, data=None) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise Unsupported(f"XML: {e}") from None


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def xml_text(content: bytes) -> str:
    """Each piece of text between tags that isn't blank, trimmed, a line each."""
    out, held = [], []

    def flush(*_):
        if text := "".join(held).strip(SPACE):
            out.append(text)
        held.clear()

    _expat(content, flush, flush, held.append)
    return "\n".join(out)


class _Page(HTMLParser):
    """Text of a page by the tree that browsers build: implied ends of p, li, dt, dd, tr, td and options."""

    CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    ENDS_P = BLOCKS - {"li", "tr", "dd", "dt"} | {"form", "center", "fieldset", "details", "summary", "figcaption", "hgroup", "menu", "search"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def _close(self, tag: str) -> None:
        while self.open:
            top = self.open.pop()
            self.silent -= top in SILENT
            if top in BLOCKS and not self.silent:
                self.out.append("\n")
            if top == tag:
                return

    def handle_starttag(self, tag, attributes):
        if "head" in self.open and tag not in SILENT | {"title", "meta", "link", "base", "html"}:
            self._close("head")
        if tag in self.ENDS_P and "p" in self.open:
            self._close("p")
        for other in self.CLOSES.get(tag, ()):
            if self.open and self.open[-1] == other:
                self._close(other)
        if tag in ("tr",) and self.open and self.open[-1] in ("td", "th"):
            self._close(self.open[-1])
        if tag == "br" and not self.silent:
            self.out.append("\n")
        if tag in VOID:
            if tag in BLOCKS and not self.silent:
                self.out.append("\n")
            return
        self.open.append(tag)
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close(tag)
        elif tag == "p" and not self.silent:
            self.out.append("\n")
        elif tag == "br" and not self.silent:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def html_text(content: str) -> str:
    """A page's visible text: scripts, styles, head, noscript and templates left out, lines ended by block elements and br."""
    page = _Page()
    page.feed(content)
    page.close()
    while page.open:
        page._close(page.open[-1])
    return normalize_ws("".join(page.out))


def article_markdown(content: str) -> str:
    """Main content as simple Markdown, by a rule of our own: the first article, main or body element without navigation, asides, headers and footers; headings, list items, links and emphasis marked. Fallbacks: the page's visible text, the whole page, its source."""

    class Article(_Page):
        SKIP = {"nav", "aside", "header", "footer", "form"}

        def __init__(self):
            super().__init__()
            self.links: list[str] = []

        def handle_starttag(self, tag, attributes):
            super().handle_starttag(tag, attributes)
            if tag in self.SKIP:
                self.silent += 1
            if self.silent:
                return
            if re.fullmatch("h[1-6]", tag):
                self.out.append("\n" + "#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "a":
                self.links.append(dict(attributes).get("href") or "")
                self.out.append("[")

        def _close(self, tag):
            while self.open:
                top = self.open.pop()
                self.silent -= (top in SILENT) + (top in self.SKIP)
                if not self.silent:
                    if top in ("b", "strong"):
                        self.out.append("**")
                    elif top in ("i", "em"):
                        self.out.append("*")
                    elif top == "a" and self.links:
                        self.out.append(f"]({self.links.pop()})")
                    if top in BLOCKS:
                        self.out.append("\n\n" if top != "li" else "\n")
                if top == tag:
                    return

    whole = content
    for name in ("article", "main", "body"):
        if m := re.search(rf"<{name}\b.*?</{name}\s*>", whole, re.S | re.I):
            content = m[0]
            break

    def read(page: _Page, source: str) -> str:
        page.feed(source)
        page.close()
        while page.open:
            page._close(page.open[-1])
        return normalize_ws("".join(page.out))

    # an article without text gives way to the page's visible text, that to the whole page as Markdown, and that to the page as it is
    return read(Article(), content) or html_text(whole) or read(Article(), whole) or whole


def csv_text(content: bytes, separator: str = ",") -> str:
    """Fields joined by tabs, a line for each record; blank lines skipped, ragged rows and stray quotes allowed."""
    rows = csv.reader(io.StringIO(plain(content), newline=""), delimiter=separator)
    return "\n".join("\t".join(row) for row in rows if row)


def _entry(archive: zipfile.ZipFile, name: str, most: int | None = None) -> bytes:
    """An entry of an archive; one that inflates to more than so many bytes is refused."""
    most = MAX_ENTRY if most is None else most
    with archive.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise Unsupported(f"{name} is larger than {most} bytes")
    return data


def _natural(name: str) -> list:
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.findall(r"\d+|\D", name)]


def _runs(content: bytes) -> str:
    """Text runs of a document or slide, with tabs, breaks and paragraph ends."""
    out, inside = [], []

    def start(name, _):
        name = _local(name)
        if name == "t":
            inside.append(1)
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")

    def end(name):
        if _local(name) == "t" and inside:
            inside.pop()
        elif _local(name) == "p":
            out.append("\n")

    _expat(content, start, end, lambda x: out.append(x) if inside else None)
    return "".join(out)


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unsupported(str(e)) from None


def docx_text(content: bytes) -> str:
    with _archive(content) as z:
        if "word/document.xml" not in z.namelist():
            raise Unsupported("word/document.xml not found")
        return _runs(_entry(z, "word/document.xml"))


def pptx_text(content: bytes) -> str:
    """Slides by number, each under "# slideN.xml"; blank ones left out."""
    with _archive(content) as z:
        names = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=_natural)
        slides = [(n.rpartition("/")[2], _runs(_entry(z, n))) for n in names]
    return "\n\n".join(x for name, text in slides if text.strip(SPACE) for x in (f"# {name}", text))


def _shared_strings(content: bytes) -> list[str]:
    out, held, state = [], [], {"t": 0, "phonetic": 0}

    def start(name, _):
        name = _local(name)
        state["t"] += name == "t"
        state["phonetic"] += name == "rPh"

    def end(name):
        name = _local(name)
        state["t"] -= name == "t"
        state["phonetic"] -= name == "rPh"
        if name == "si":
            out.append("".join(held))
            held.clear()

    _expat(content, start, end, lambda x: held.append(x) if state["t"] and not state["phonetic"] else None)
    return out


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet(content: bytes, shared: list[str]) -> str:
    rows, cells, state = [], {}, {"column": -1, "kind": "", "value": 0}
    held: list[str] = []

    def start(name, attributes):
        name = _local(name)
        if name == "row":
            cells.clear()
            state["column"] = -1
        elif name == "c":
            place = _column(attributes.get("r", ""))
            state["column"] = place if place >= 0 else max(cells, default=-1) + 1
            state["kind"] = attributes.get("t", "")
            held.clear()
        elif name in ("v", "t"):
            state["value"] += 1

    def end(name):
        name = _local(name)
        if name in ("v", "t"):
            state["value"] -= 1
        elif name == "c":
            text = "".join(held)
            if state["kind"] == "s" and text.strip().isdigit() and int(text) < len(shared):
                text = shared[int(text)]
            cells[state["column"]] = text.strip(SPACE)
        elif name == "row" and any(cells.values()):
            rows.append("\t".join(cells.get(i, "") for i in range(max(cells) + 1)))

    _expat(content, start, end, lambda x: held.append(x) if state["value"] else None)
    return "\n".join(rows)


def xlsx_text(content: bytes) -> str:
    """Sheets by number, each under "# sheetN.xml", rows tab-joined by their cells' columns; empty rows and sheets left out."""
    with _archive(content) as z:
        names = set(z.namelist())
        shared = _shared_strings(_entry(z, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), key=_natural)
        found = [(n.rpartition("/")[2], _sheet(_entry(z, n), shared)) for n in sheets]
    return "\n\n".join(x for name, text in found if text.strip(SPACE) for x in (f"# {name}", text))


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:(?!>>\s*stream|endobj).)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_PDF_TOKEN = re.compile(rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<number>[-+]?[0-9]*\.?[0-9]+)|(?P<open>\[)|(?P<close>\])|/[^\s/<>\[\]()]+|(?P<operator>[A-Za-z'\"*]+[0-9]?)", re.S)
#: Escapes in PDF strings.
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m):
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r\n") else _PDF_ESCAPES.get(m[1], m[1])

    data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def _pdf_content(body: bytes) -> str:
    """What a content stream shows: strings as they come, a line for each move to another."""
    out, held = [], []
    for m in _PDF_TOKEN.finditer(body):
        if m["text"] is not None:
            held.append(_pdf_string(m["text"]))
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace"))
        elif m["number"] and held and float(m["number"]) < -200:  # a gap within an array of strings
            held.append(" ")
        elif (operator := m["operator"]) is not None:
            if operator in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm", b"ET") and out and not out[-1].endswith("\n"):
                out.append("\n")
            if operator in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(held).rstrip(" ") if operator == b"TJ" else "".join(held))
            held.clear()
    return "".join(out)


def pdf_plain(content: bytes) -> str:
    """Text of the content streams of a PDF, plain or deflated, in the order of the file; streams that can't be read are left out."""
    pages = []
    for m in _PDF_STREAM.finditer(content):
        body = m["body"]
        if b"/Image" in m["head"] or b"/FontFile" in m["head"]:
            continue
        if b"/FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body, MAX_ENTRY)
            except zlib.error:
                continue
        if b"BT" in body and (text := _pdf_content(body)).strip(SPACE):
            pages.append(text.strip("\n"))
    return "\n".join(pages)


def pdf_text(content: bytes) -> str:
    """Through the pdftotext program where there is one and it finds text; else by a reader of our own."""
    program, text = shutil.which("pdftotext"), ""
    if program:
        done = subprocess.run([program, "-layout", "-", "-"], input=content, capture_output=True, check=False, timeout=120)
        text = "" if done.returncode else plain(done.stdout)
    if not text.strip(SPACE):
        text = pdf_plain(content)
    if not text.strip(SPACE):
        raise Unsupported("PDF: no text")
    return text


_RTF = re.compile(rb"(?P<open>\{)|(?P<close>\})|\\'(?P<hex>..)|\\(?P<word>[a-z]+)(?:[0-9]+ ?)?|\\(?P<sign>[^a-z])|(?P<text>[^\\{}]+)|\\", re.S)


_BELOW_32 = bytes(range(32))


def rtf_text(content: bytes) -> str:
    """Text of a rich-text file: destinations without text skipped to the end of their group, control words and escapes turned into text, bytes below 32 dropped."""
    out, silent, stack = [], False, []
    for m in _RTF.finditer(content):
        kind = m.lastgroup
        if kind == "open":
            stack.append(silent)
        elif kind == "close":
            silent = stack.pop() if stack else silent
        elif kind == "word":
            word = m["word"].decode()
            if word in RTF_SILENT:
                silent = True
            elif not silent:
                out.append(RTF_TEXT.get(word, "").encode())
        elif not silent and kind == "hex" and re.fullmatch(rb"[0-9a-fA-F]{2}", m["hex"]):
            out.append(bytes([int(m["hex"], 16)]))
        elif not silent and kind == "sign":
            out.append({b"{": b"{", b"}": b"}", b"\\": b"\\", b"~": "\u00a0".encode()}.get(m["sign"], b""))
        elif not silent and kind == "text":
            out.append(m["text"].translate(None, _BELOW_32))
    return normalize_ws(plain(b"".join(out)))


def extract_text(name: str, content: bytes) -> str:
    """A file's text by its extension; raises Unsupported."""
    ext = os.path.splitext("x" + os.path.basename(name))[1].lower() if not os.path.basename(name).startswith(".") else "." + os.path.basename(name).rpartition(".")[2].lower()
    if ext in PLAIN:
        return plain(content)
    if ext in JSON:
        return compact_json(content)
    if ext in (".csv", ".tsv"):
        return csv_text(content, "\t" if ext == ".tsv" else ",")
    if ext in (".html", ".htm"):
        return html_text(plain(content))
    by = {".xml": xml_text, ".rtf": rtf_text, ".docx": docx_text, ".pptx": pptx_text, ".xlsx": xlsx_text, ".pdf": pdf_text}
    return by.get(ext, maybe)(content)


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, text, error: a file that can't be read has an error and no text."""

    def run(batches):
        for batch in pieces(batches):
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(extract_text(path, content or b""))
                    errors.append(None)
                except (Unsupported, csv.Error, zipfile.BadZipFile, subprocess.TimeoutExpired) as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select(path_col, content_col).toDF("path", "content").mapInArrow(run, "path string, text string, error string")


def page_text(pages: DataFrame, html_col: str = "html", article: bool = False) -> DataFrame:
    """pages with the column text: visible text, or the article as Markdown, of pages; other bodies as they are."""
    names, at = pages.columns, pages.columns.index(html_col)
    one = article_markdown if article else html_text

    def run(batches):
        for batch in pieces(batches):
            bodies = batch.column(at).to_pylist()
            texts = [None if b is None else one(b) if re.match(r"<!doctype html|<html", b[:512].strip(SPACE), re.I) else b for b in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, text string")


def read_any(files: DataFrame, max_bytes: int = 131072) -> DataFrame:
    """files: path, content. path, text, error: documents extracted, cleaned and cut after max_bytes bytes (at a whole character) with a notice; other files as numbered lines, binary ones refused."""
    document = T.extension(T.file_name(F.col("path"))).isin(*DOCUMENTS)
    cleaned = T.clean(F.col("text"))
    cut = F.concat(T.cut_bytes(cleaned, max_bytes), F.concat(F.lit(CUT[0].format(max_bytes)), "path", F.lit(CUT[1])))
    shown = F.when(cleaned == "", NO_TEXT).when(F.octet_length(cleaned) > max_bytes, cut).otherwise(cleaned)
    documents = extract(files.where(document)).select("path", F.when(F.col("error").isNull(), shown).alias("text"), "error")
    others = files.where(~document)
    lines = F.transform(T.lines(F.col("content").cast("string")), lambda x, i: F.concat(T.numbered(i + 1), F.lit("\t"), x, F.lit("\n")))
    numbered = F.when(F.octet_length("content") == 0, EMPTY).otherwise(F.array_join(lines, ""))
    plain_ = others.select("path", F.when(T.is_text(F.col("content")), numbered).alias("text"), F.when(~T.is_text(F.col("content")), F.concat("path", F.lit(": binary"))).alias("error"))
    return documents.unionByName(plain_)
