"""What a console shows and takes: streamed answers as text, the clipboard, and slash commands over a session's data."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import conversations as C
from corpusmill.operators import listing
from corpusmill.operators.index import Index
from corpusmill.plans import settings

#: Headings of a streamed answer.
THINKING, DONE_THINKING, RESPONSE = "Thinking...", "...done thinking.", "── Response ──"
#: Programs that take a text for the clipboard, in the order they are looked for.
CLIPBOARDS = (("pbcopy",), ("xclip", "-selection", "clipboard"), ("xsel", "--clipboard", "--input"))


class StreamPrinter:
    """Writes the parts of streamed answers as they come: thinking under its heading if it is shown, each stretch of content under its own."""

    def __init__(self, write: Callable[[str], object], show_thinking: bool = True):
        self.write, self.show_thinking = write, show_thinking
        self.thinking = self.headed = self.wrote = False

    def part(self, part: dict) -> None:
        message = part.get("message") or {}
        if self.show_thinking and message.get("thinking"):
            if not self.thinking:
                self.write(f"\n{THINKING}\n")
                self.thinking = True
            self.write(message["thinking"])
            self.wrote = True
        if message.get("content"):
            if self.thinking:
                self.write(f"\n{DONE_THINKING}\n\n")
                self.thinking = False
            if not self.headed:
                self.write(("" if self.wrote else "\n") + RESPONSE + "\n")
                self.headed = True
            self.write(message["content"])
            self.wrote = True


def copy_text(text: str, which: Callable[[str], str | None] = shutil.which, run: Callable[..., object] = subprocess.run) -> str:
    """Gives a text to the first clipboard program there is, and that program's name."""
    for command in CLIPBOARDS:
        if which(command[0]):
            run(list(command), input=text.encode(), check=True)
            return command[0]
    raise OSError("no clipboard utility found (tried " + ", ".join(c[0] for c in CLIPBOARDS) + ")")


@dataclass
class Session:
    """A conversation (messages of one conv_id) with what its slash commands work on; `run` gives what a command says."""

    messages: DataFrame
    context_length: int = 0
    entries: DataFrame | None = None
    index: Index | None = None
    tools: list[dict] = field(default_factory=list)
    settings_path: str | None = None
    models: Callable[[], list[str]] = list
    model: str = ""
    summarise: Callable[[DataFrame], str] | None = None
    copy: Callable[[str], str] = copy_text
    recall: list[str] = field(default_factory=list)

    def run(self, line: str) -> str:
        """One command; ValueError for one that isn't known or is used wrongly."""
        name, *rest = line.split()
        command = getattr(self, "_" + name.removeprefix("/").replace("-", "_"), None) if name.startswith("/") else None
        if command is None:
            raise ValueError(f"unknown command {name}")
        return command(rest)

    def _transcript(self, form: str = "markdown") -> str:
        row = C.transcript(self.messages, form).first()
        return row["text"] if row else ""

    def _help(self, _) -> str:
        return "\n".join(sorted("/" + n[1:].replace("_", "-") for n in vars(Session) if n.startswith("_") and not n.startswith("__") and n != "_transcript"))

    def _clear(self, _) -> str:
        self.messages = self.messages.where("role = 'system'")
        return "Conversation history cleared."

    def _forget_history(self, _) -> str:
        self.recall.clear()
        return "Command history erased."

    def _tools(self, rest) -> str:
        full = bool(rest) and rest[0] in ("full", "-v", "all")
        out = [f"Available tools ({len(self.tools)}):"]
        for t in (t["function"] for t in self.tools):
            out.append(f"  {t['name']}: {t['description']}")
            required = t["parameters"]["required"]
            out += [f"    {k}{' (required)' if k in required else ''}" for k in sorted(t["parameters"]["properties"], key=lambda k: (k not in required, k))] if full else []
        return "\n".join(out)

    def _model(self, rest) -> str:
        known = self.models()
        if not rest:
            return "\n".join([f"Current model: {self.model}", *(("✓ " if m == self.model else "  ") + m for m in known)])
        if rest[0] not in known:
            raise ValueError(f"unknown model {rest[0]}")
        self.model = rest[0]
        if self.settings_path:
            settings.save(self.settings_path, "model", self.model)
        return f"Switched to model {self.model} (saved as default)."

    def _save(self, rest) -> str:
        if not rest:
            raise ValueError("usage: /save <file>")
        Path(rest[0]).write_text(self._transcript())
        return f"saved conversation to {rest[0]}"

    def _export(self, rest) -> str:
        if len(rest) < 2 or rest[0] != "json":
            raise ValueError("usage: /export json <file>")
        Path(rest[1]).write_text(self._transcript("json"))
        return f"exported conversation to {rest[1]}"

    def _copy(self, rest) -> str:
        if rest and rest[0] == "last":
            row = C.last_assistant(self.messages).first()
            if row is None:
                raise ValueError("no answer to copy yet")
            self.copy(row["text"])
            return "last answer copied to clipboard"
        self.copy(self._transcript())
        return "conversation copied to clipboard"

    def _tree(self, rest) -> str:
        if self.entries is None:
            raise ValueError("no listing")
        drawn = listing.tree(self.entries, glob=rest[0] if rest else None).orderBy(T.walk_key(F.col("path")))
        return "\n".join([".", *(r["line"] for r in drawn.toLocalIterator())])

    def _cache(self, rest) -> str:
        if self.index is None:
            raise ValueError("no index")
        if rest and rest[0] == "clear":
            self.index.clear()
            return "cache cleared"
        r = self.index.status().first()
        return f"files: {r['files']}, chunks: {r['n_chunks']}, bytes: {r['blob_size']}"

    def _context(self, _) -> str:
        schema = len(json.dumps(self.tools, separators=(",", ":")).encode()) if self.tools else 0
        r = C.context_report(self.messages, self.context_length, schema).select("*", T.context_bar(F.col("used"), F.col("context_length")).alias("bar"), T.format_count(F.col("used")).alias("shown")).first()
        return f"{r['bar']} {r['shown']} of {r['context_length']}\nsystem {r['system_tokens']}, tools {r['tool_tokens']}, conversation {r['conversation_tokens']}, free {r['free']}" if r else "no messages"

    def _compact(self, rest) -> str:
        keep = int(rest[0]) if rest else 2
        cut = C.compact_cut(self.messages, keep).first()
        if cut is None or not cut["ok"] or cut["cut"] <= 1 or self.summarise is None:
            return "nothing to compact"
        before = self.messages.count()
        told = self.messages.select("conv_id").distinct().withColumn("text", F.lit(self.summarise(self.messages)))
        self.messages = C.compact(self.messages, keep, told)
        return f"compacted {before} messages to {self.messages.count()}"

    def _config(self, rest) -> str:
        if self.settings_path is None:
            raise ValueError("no settings")
        if len(rest) >= 2:
            settings.save(self.settings_path, rest[0], " ".join(rest[1:]))
            return f"{rest[0]} = {' '.join(rest[1:])}"
        return "\n".join(f"{k} = {settings.shown(v)}" for k, v in settings.load(self.settings_path).items())
