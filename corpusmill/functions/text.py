"""Text functions as Column expressions: cleaning, lines, excerpts, token estimates, formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that lines and texts are trimmed of (Unicode's, without the ASCII separators 28 to 31).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters of an excerpt; bytes and times from which a repeated line is boilerplate; characters of a summary.
EXCERPT = 200
BOILERPLATE_BYTES, BOILERPLATE_TIMES = 80, 3
SUMMARY = 120
#: Fixed value: a line that is a page number.
PAGE_NUMBER = r"^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$"
PUNCTUATION_OR_WORD = r"[!-/:-@\[-`{-~]|[^ \t\n\r!-/:-@\[-`{-~]+"


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often a lambda inside body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines as an array: split at line feeds, a carriage return before each dropped, no empty line after a last line feed."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.endswith("\r"), F.left(x, F.char_length(x) - 1)).otherwise(x))


def numbered(line: Column) -> Column:
    """A line number as "%6d"."""
    n = line.cast("string")
    return F.lpad(n, F.greatest(F.lit(6), F.length(n)), F.lit(" "))


def cut_bytes(text: Column, most: int) -> Column:
    """The first bytes of a text, without a character that would be cut."""
    raw = text.cast("binary")
    tail = lambda back: F.conv(F.hex(F.substring(raw, most + 1 - back, 1)), 16, 10).cast("int")  # noqa: E731  the byte that many before the first left out
    inside = lambda back: tail(back).bitwiseAND(0xC0) == 0x80
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), F.lit(most) - back).cast("string"))


def normalize_ws(text: Column) -> Column:
    """Each line trimmed, runs of blank lines made one, the whole trimmed; spaces within lines stay."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: _trim(x))
    kept = _let(trimmed, lambda a: F.filter(a, lambda x, i: (x != "") | (i == 0) | (F.get(a, i - 1) != "")))
    return _trim(F.array_join(kept, "\n"))


def is_page_number(line: Column) -> Column:
    return F.lower(_trim(line)).rlike(PAGE_NUMBER)


def drop_boilerplate(text: Column) -> Column:
    """Without page-number lines and short lines that the text has three times or more; blank and "# " lines stay.

    The short lines' counts come from one sorted pass over the text's own lines, so a text of n lines costs n log n.
    """
    short = F.array_sort(F.filter(F.transform(F.split(text, "\n", -1), lambda x: _trim(x)), lambda t: (t != "") & (F.octet_length(t) <= BOILERPLATE_BYTES)))
    often = _let(short, lambda a: F.array_distinct(F.filter(a, lambda x, i: F.coalesce(F.get(a, i + BOILERPLATE_TIMES - 1) == x, F.lit(False)))))

    def keep(x, found):
        t = _trim(x)
        return (t == "") | t.startswith("# ") | ~(F.lower(t).rlike(PAGE_NUMBER) | F.array_contains(found, t))

    return _let(often, lambda found: F.array_join(F.filter(F.split(text, "\n", -1), lambda x: keep(x, found)), "\n"))


def clean(text: Column) -> Column:
    """drop_boilerplate, then normalize_ws."""
    return normalize_ws(drop_boilerplate(text))


def estimate_tokens(text: Column) -> Column:
    """Code points by four, at least 1 where anything is not white space."""
    n = F.floor(F.char_length(text) / 4).cast("long")
    return F.when((n == 0) & (_trim(text) != ""), F.lit(1).cast("long")).otherwise(n)


def excerpt(line: Column, most: int = EXCERPT) -> Column:
    """Trimmed, and cut after so many code points with an ellipsis."""
    t = _trim(line)
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def summary(text: Column, most: int = SUMMARY) -> Column:
    """First line that is neither blank nor a "# " line, white space made single; up to its first sentence end if that comes within so many bytes, else so many code points."""
    content = F.filter(F.transform(F.split(text, "\n", -1), lambda x: _trim(x)), lambda t: (t != "") & ~t.startswith("# "))
    one = F.regexp_replace(F.coalesce(F.try_element_at(content, F.lit(1)), F.lit("")), f"[{SPACE}]+", " ")
    at = F.regexp_instr(one, F.lit(r"[.!?] "))
    head = F.left(one, at)
    within = (at > 0) & (F.octet_length(head) - 1 <= most)
    return F.when(within, head).otherwise(F.left(one, F.lit(most)))


def truncate(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def split_every(text: Column, n: int) -> Column:
    """Pieces of n code points; the last may be shorter, an empty text has none."""
    pieces = F.floor((F.char_length(text) + n - 1) / n).cast("int")
    return F.when(pieces > 0, F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(text, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def column_index(reference: Column) -> Column:
    """0-based column of a cell reference such as C3: 2; -1 without letters."""
    letters = F.split(F.upper(F.regexp_extract(reference, r"^([A-Za-z]*)", 1)), "")
    real = F.filter(letters, lambda c: c != "")
    return F.aggregate(real, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def join_row(cells: Column) -> Column:
    """map of column to value as one tab-joined row up to the last column; nothing but empty cells: ''."""
    last = F.array_max(F.map_keys(cells))
    row = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))
    return _let(row, lambda r: F.when(F.exists(r, lambda x: x != ""), F.array_join(r, "\t")).otherwise(F.lit("")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(name: Column) -> Column:
    """Lower-case, with its dot; '' without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value: each run padded with zeros to 20 digits."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def walk_key(path: Column) -> Column:
    """Sorts paths as a depth-first walk with sorted folders meets them."""
    return F.split(path, "/", -1)


def basic_split(text: Column) -> Column:
    """Words by white space; each ASCII punctuation mark alone."""
    return F.regexp_extract_all(text, F.lit(PUNCTUATION_OR_WORD), F.lit(0))


def at_paths(line: Column) -> Column:
    """Paths after @ in a line; a backslash may stand before a space in one."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"@((?:\\[ \t]|[^ \t])+)"), F.lit(1)), lambda p: F.regexp_replace(p, r"\\([ \t])", "$1"))


def is_text(content: Column) -> Column:
    """No NUL among the first 8192 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) == 0


def is_html(body: Column) -> Column:
    """The first 512 characters, trimmed, begin like a page."""
    head = F.lower(_trim(F.left(body, F.lit(512))))
    return head.startswith("<!doctype html") | head.startswith("<html")


def url_allowed(url: Column, https_only: bool = True) -> Column:
    """An absolute URL with a scheme that may be fetched."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://[^/?#]+", 1))
    return scheme.isin(["https"] if https_only else ["http", "https"])


def blocked_ipv4(ip: Column) -> Column:
    """Loopback, private, link-local, multicast or unspecified IPv4 addresses, also in their IPv6 form (::ffff:10.0.0.1); not an IPv4 address: null."""
    parts = F.transform(F.split(F.regexp_replace(ip, "(?i)^(?:0{0,4}:){2,5}ffff:(?=[0-9.]+$)", ""), r"\."), lambda x: x.try_cast("int"))
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda x: x.between(0, 255))
    blocked = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | a.between(224, 239) | F.forall(parts, lambda x: x == 0)
    return F.when(valid, blocked)


def expand_template(template: Column, args: Column, selection: Column) -> Column:
    """$$ is a dollar sign, $ARGS all arguments joined, $SELECTION the selection, $9 to $1 single arguments ('' if absent); trimmed."""
    out = F.replace(template, F.lit("$$"), F.lit("$"))
    out = F.replace(out, F.lit("$ARGS"), F.array_join(args, " "))
    out = F.replace(out, F.lit("$SELECTION"), selection)
    for i in range(9, 0, -1):
        out = F.replace(out, F.lit(f"${i}"), F.coalesce(F.try_element_at(args, F.lit(i)), F.lit("")))
    return _trim(out)


def _one_decimal(x: Column) -> Column:
    """As "%.1f" of a number in C: the binary value rounded, half to even."""
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    part = size - whole
    eight, two = part * 8, part * 2  # both exact; their sum with its error is ten times the part
    ten = eight + two
    error = two - (ten - eight)
    low = F.floor(ten)
    rest = ten - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    tenths = whole * 10 + low + F.when(up, 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_count(n: Column) -> Column:
    """Below 1000 as it is, else thousands with one decimal and k."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(_one_decimal(n / 1000.0), F.lit("k")))


def context_bar(used: Column, total: Column, width: int = 30) -> Column:
    filled = F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(width), F.floor(used * width / total)))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def format_elapsed(seconds: Column) -> Column:
    return F.when(seconds < 10, F.concat(_one_decimal(seconds), F.lit("s"))).otherwise(F.concat(F.rint(seconds).cast("decimal(20,0)").cast("string"), F.lit("s")))


def chunk_key(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("#"), index.cast("string"))


def hash_name(text: Column) -> Column:
    return F.sha2(text, 256)


def call_key(name: Column, arguments_json: Column) -> Column:
    """Tool name and arguments with sorted keys, a NUL between."""
    return F.concat(name, F.lit("\x00"), F.to_json(F.try_parse_json(arguments_json)))


def as_int(x: Column) -> Column:
    """Whole number from text such as 3 or 3.9 (cut off); else null."""
    return F.coalesce(_trim(x).try_cast("long"), _trim(x).try_cast("double").try_cast("long"))


def as_float(x: Column) -> Column:
    return _trim(x).try_cast("double")


def as_bool(x: Column) -> Column:
    t = F.lower(_trim(x))
    return F.when(t.isin("true", "1", "yes", "y", "on"), True).when(t.isin("false", "0", "no", "n", "off"), False)


def only_strings(variant_array: Column) -> Column:
    """Of a JSON array's text, the elements that are strings."""
    parts = F.from_json(variant_array, "array<variant>")
    return F.transform(F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
