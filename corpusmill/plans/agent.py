"""A tool-calling loop over a chat model, with memoised calls; and a registry of retrieval tools over a corpus."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import extract
from corpusmill.functions import text as T
from corpusmill.functions.embedding import Embedder
from corpusmill.operators import listing, reading, search
from corpusmill.operators.text_index import TextIndex


class ChatModel(Protocol):
    def chat(self, messages: list[dict], tools: list[dict]) -> dict:
        """An answer: content, thinking?, tool_calls? [{name, arguments}]."""


@dataclass
class Result:
    answer: str
    reasoning: str = ""
    tool_calls: list[dict] = field(default_factory=list)
    messages: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        out = {"answer": self.answer} | ({"reasoning": self.reasoning} if self.reasoning else {}) | ({"tool_calls": self.tool_calls} if self.tool_calls else {})
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


class OutOfCalls(RuntimeError):
    """The model asked for more tool calls than allowed; messages holds the history without the unanswered turn."""

    def __init__(self, messages: list[dict]):
        super().__init__("too many tool calls")
        self.messages = messages


def result_json(text: str) -> str:
    """Valid JSON as it is, other text as a JSON string."""
    try:
        json.loads(text)
        return text
    except ValueError:
        return json.dumps(text, ensure_ascii=False)


#: Rows of a result that a tool gives back at most.
MAX_ROWS = 10_000


def rows_json(df: DataFrame, most: int = MAX_ROWS) -> str:
    """A result as compact JSON, with <, > and & escaped; one of more rows is refused, never cut."""
    rows = df.select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: ask for less")
    return escaped("[" + ",".join(r[0] for r in rows) + "]")


def escaped(text: str) -> str:
    return re.sub("[<>&]", lambda m: f"\\u{ord(m[0]):04x}", text)


class Agent:
    def __init__(self, model: ChatModel, tools: dict[str, Callable[[dict], str]], schemas: list[dict] | None = None, max_calls: int = 100):
        self.model, self.tools, self.schemas, self.max_calls = model, tools, schemas or [{"type": "function", "function": {"name": n}} for n in tools], max_calls

    def run(self, messages: list[dict]) -> Result:
        history, records, memo, thoughts = list(messages), [], {}, []
        for _ in range(self.max_calls + 1):
            answer = self.model.chat(history, self.schemas)
            if answer.get("thinking"):
                thoughts.append(answer["thinking"])
            calls = answer.get("tool_calls") or []
            turn = {"role": "assistant", "content": answer.get("content", "")}
            if not calls:
                return Result(turn["content"], "\n".join(thoughts), records, [*history, turn])
            if len(records) + len(calls) > self.max_calls:
                break
            history.append(turn | {"tool_calls": calls})
            for call in calls:
                name, arguments = call["name"], call.get("arguments") or {}
                key = name + "\x00" + json.dumps(arguments, sort_keys=True)
                error = None
                if key in memo:
                    text = memo[key]
                else:
                    try:
                        text = memo[key] = self.tools[name](arguments)
                    except KeyError:
                        text = error = f"unknown tool {name}" if name not in self.tools else "an argument is missing"
                    except (ValueError, OSError) as e:
                        text = error = str(e)
                records.append({"name": name, "arguments": arguments, "result": json.loads(result_json(text))} | ({"error": error} if error else {}))
                history.append({"role": "tool", "tool_name": name, "content": text if error is None else f"Error: {text}"})
        raise OutOfCalls(history)


def _schema(name: str, description: str, required: list[str], **properties: str | dict) -> dict:
    kinds = {k: {"type": v} if isinstance(v, str) else v for k, v in properties.items()}
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": kinds, "required": required}}}


_STRINGS = {"type": "array", "items": {"type": "string"}}


def definitions(vision: bool = False, fetch: bool = False) -> list[dict]:
    """JSON schemas of the tools, in a stable order; read_image only for models that see, fetch_url only where it is enabled."""
    out = [
        _schema("list_dir", "Entries of a folder, up to a depth.", ["path"], path="string", depth="integer", extensions=_STRINGS, name_contains="string", sort_by={"type": "string", "enum": ["name", "modified_time"]}),
        _schema("read", "One file (path, for a text from start_line to end_line) or several (paths). Documents give their text; a long one gives a list of its chunks.", [], path="string", paths=_STRINGS, start_line="integer", end_line="integer"),
        _schema("search", "Lines that hold the query as it stands; with semantic, the passages nearest in meaning, of all files or of the one at path.", ["query"], query="string", semantic="boolean", path="string", case_sensitive="boolean", extensions=_STRINGS, top_k="integer", threshold="number"),
        _schema("stat_file", "Type, size, time and permissions of one entry.", ["path"], path="string"),
        _schema("get_chunk", "The whole text of one chunk.", ["path", "chunk_index"], path="string", chunk_index="integer"),
    ]
    if vision:
        out.append(_schema("read_image", "An image, for the model to look at.", ["path"], path="string"))
    if fetch:
        out.append(_schema("fetch_url", "A web page's main text.", ["url"], url="string"))
    return out


def as_whole(value, default: int) -> int:
    """A whole number from a JSON number or text; else the default."""
    try:
        return int(float(value.strip() if isinstance(value, str) else value))
    except (TypeError, ValueError, AttributeError, OverflowError):
        return default


def as_flag(value, default: bool) -> bool:
    if isinstance(value, bool):
        return value
    return {"true": True, "1": True, "yes": True, "y": True, "on": True, "false": False, "0": False, "no": False, "n": False, "off": False}.get(str(value).strip().lower(), default)


def as_number(value, default: float) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def registry(spark: SparkSession, corpus: DataFrame, chunks: DataFrame | None = None, embedder: Embedder | None = None, entries: DataFrame | None = None, files: DataFrame | None = None, vision: bool = False, fetch: Callable[[str], str] | None = None, text_index: TextIndex | None = None) -> dict[str, Callable[[dict], str]]:
    """Tools over a corpus (path, text), its chunks with embeddings, a listing, and contents (files: path, content), an index of these for exact search; each takes arguments and gives text. A disabled tool is there but refuses."""

    def need(a: dict, name: str) -> str:
        if not isinstance(a.get(name), str):
            raise ValueError(f'missing required argument "{name}"')
        return a[name]

    def search_tool(a: dict) -> str:
        query = need(a, "query")
        if not as_flag(a.get("semantic"), False):
            contents = files if files is not None else corpus.select("path", F.col("text").cast("binary").alias("content"))
            fold = as_flag(a.get("case_sensitive"), False)
            report = search.search_report(contents, query, fold) if text_index is None else text_index.report(query, fold)
            r = report.select(F.to_json("matches").alias("m"), "files_inspected", "truncated").first()
            return escaped(f'{{"matches":{r["m"] or "null"},"files_inspected":{r["files_inspected"]}{",\"truncated\":true" if r["truncated"] else ""}}}')
        if embedder is None or chunks is None:
            raise ValueError("semantic search needs an embedder and an index")
        q = embedder.embed([query])[0].tolist()
        if str(a.get("path") or "").strip():
            found = search.search_document(chunks, a["path"], q, as_whole(a.get("top_k"), 5), as_number(a.get("threshold"), 0.3)).select(F.to_json(F.struct("*"))).collect()  # top_k rows
            return escaped(f'{{"query":{json.dumps(query, ensure_ascii=False)},"results":[{",".join(r[0] for r in found)}],"count":{len(found)}}}')
        return '{"matches":' + rows_json(search.search_semantic(chunks, q, as_whole(a.get("top_k"), 10), as_number(a.get("threshold"), 0.0), a.get("extensions"))) + "}"

    def one_file(path: str) -> DataFrame:
        own = files.where(F.col("path") == path) if files is not None else corpus.where(F.col("path") == path).select("path", F.col("text").cast("binary").alias("content"))
        if own.isEmpty():
            raise ValueError(f"{path}: not found")
        return own

    def read_tool(a: dict) -> str:
        if "paths" in a:
            wanted = [p for p in a["paths"] or [] if isinstance(p, str)]
            if not wanted:
                raise ValueError('missing required argument "paths" (non-empty array of paths)')
            table = spark.createDataFrame(list(enumerate(wanted)), "pos int, path string")
            text = corpus if files is None else extract.read_any(files.join(table.select("path").distinct(), "path", "left_semi")).where("error is null").select("path", "text")
            return reading.render_batch(reading.read_batch(text, table)).first()["text"]
        path = need(a, "path")
        if _extension(path) in extract.DOCUMENTS and files is not None:
            r = extract.extract(one_file(path)).first()
            if r["error"]:
                raise ValueError(f"extract text: {r['error']}")
            rows = reading.read_documents(spark.createDataFrame([(path, r["text"])], "path string, text string"))
            first = rows.where("text is not null").first()
            if first is not None:
                return escaped(json.dumps({"text": first["text"], "tokens": first["tokens"], "cleaned": True}, ensure_ascii=False, separators=(",", ":")))
            return '{"manifest":' + rows_json(rows.select("chunk_index", "total", "path", "section", "tokens", "summary").orderBy("chunk_index")) + ',"cleaned":true}'
        own = one_file(path)
        if not own.select(T.is_text(F.col("content"))).first()[0]:
            raise ValueError(f"{path}: binary")
        end = as_whole(a.get("end_line"), 0)
        lines = reading.read_lines(own.select("path", F.col("content").cast("string").alias("text")), as_whole(a.get("start_line"), 0), end, 131072)
        return "\n".join(r["rendered"] for r in lines.orderBy("line").collect()) or "(empty file)"  # bounded by the byte budget

    def chunk_tool(a: dict) -> str:
        if chunks is None:
            raise ValueError("no index")
        found = reading.get_chunk(chunks, need(a, "path"), as_whole(a.get("chunk_index"), 0)).drop("embedding")
        if found.isEmpty():
            raise ValueError(f"{a['path']}: no chunk {a.get('chunk_index')}")
        return rows_json(found)[1:-1]

    def image_tool(a: dict) -> str:
        r = reading.read_images(one_file(need(a, "path")), vision=vision).first()
        if r["error"]:
            raise ValueError(r["error"])
        return json.dumps({"path": r["path"], "size": r["size"], "image": r["base64"]}, separators=(",", ":"))

    def fetch_tool(a: dict) -> str:
        if fetch is None:
            raise ValueError("fetch_url is disabled")
        return fetch(need(a, "url"))

    tools = {"search": search_tool, "read": read_tool, "get_chunk": chunk_tool, "read_image": image_tool, "fetch_url": fetch_tool}
    if entries is not None:
        tools["list_dir"] = lambda a: rows_json(listing.list_dir(entries, as_whole(a.get("depth"), 1), a.get("extensions"), a.get("name_contains"), a.get("sort_by", "name")))

        def stat_tool(a: dict) -> str:
            found = rows_json(listing.stat(entries, need(a, "path")))
            if found == "[]":
                raise ValueError(f"{a['path']}: not found")
            return found[1:-1]

        tools["stat_file"] = stat_tool
    return tools


def _extension(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[1].lower()
