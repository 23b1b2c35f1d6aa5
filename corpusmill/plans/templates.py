"""Prompt templates: Markdown files with an optional front matter; a project's replace global ones of the same name."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    description: str
    args: tuple[str, ...]
    body: str
    source: str


def parse_args(text: str) -> tuple[str, ...]:
    """[a, b], "a, b" or "a b"."""
    text = text.strip().removeprefix("[").removesuffix("]")
    return tuple(x.strip().strip("\"'") for x in (text.split(",") if "," in text else text.split()) if x.strip())


def parse(name: str, text: str, source: str) -> Template:
    description, args = "", ()
    if m := re.match(r"---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S):
        text = text[m.end() :]
        listed: list[str] | None = None
        for line in m[1].splitlines():
            key, _, value = line.partition(":")
            if listed is not None and (item := re.match(r"\s*-\s+(.*)", line)):
                listed.append(item[1].strip().strip("\"'"))
                continue
            listed = None
            if key.strip() == "description":
                description = value.strip().strip("\"'")
            elif key.strip() == "args":
                args = parse_args(value)
                listed = [] if not value.strip() else None
                if listed is not None:
                    args = listed
    return Template(name, description, tuple(args), text.strip(), source)


def expand(body: str, args: list[str], selection: str = "") -> str:
    """$$, $ARGS, $SELECTION, $9 to $1, in this order."""
    out = body.replace("$$", "$").replace("$ARGS", " ".join(args)).replace("$SELECTION", selection)
    for i in range(9, 0, -1):
        out = out.replace(f"${i}", args[i - 1] if i <= len(args) else "")
    return out.strip()


def load(global_folder: str | Path, project_folder: str | Path) -> list[Template]:
    found: dict[str, Template] = {}
    for source, folder in (("global", Path(global_folder)), ("project", Path(project_folder))):
        for path in sorted(folder.glob("*.md")) if folder.is_dir() else ():
            found[path.stem] = parse(path.stem, path.read_text(), source)
    return [found[k] for k in sorted(found)]


def merge(global_: DataFrame, project: DataFrame) -> DataFrame:
    """Two tables (name, body): the project's row where both have a name."""
    g, p = global_.alias("g"), project.alias("p")
    both = g.join(p, F.col("g.name") == F.col("p.name"), "full")
    source = F.when(F.col("p.name").isNotNull(), "project").otherwise("global")
    return both.select(F.coalesce("p.name", "g.name").alias("name"), F.when(F.col("p.name").isNotNull(), F.col("p.body")).otherwise(F.col("g.body")).alias("body"), source.alias("source"))
