"""Embedders: static word-piece vectors from files, and a deterministic one for tests. Each gives an Arrow-batched column function."""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KNOWN_WORDS = 200_000
#: Ids whose vectors are gathered at a time.
_GATHER = 1 << 16
#: Characters cut into ids at a time; a longer text stands alone.
_CHARS = 1 << 19
_TYPES = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}


class Embedder(Protocol):
    """Anything that turns texts into unit vectors of one length."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


def column(embedder: Embedder, text: Column) -> Column:
    """array<float> of each text; null texts as empty ones."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(texts.fillna("").tolist()).astype(np.float32)))

    return run.asNondeterministic()(text)  # so that a filter on it doesn't compute it twice


def column_with_size(model: StaticModel, text: Column) -> Column:
    """struct<e: array<float>, n: int> of each text: its vector and how many ids it has, from one pass."""

    @F.pandas_udf("e array<float>, n int")
    def run(texts: pd.Series) -> pd.DataFrame:
        vectors, sizes = model.embed_with_sizes(texts.fillna("").tolist())
        return pd.DataFrame({"e": list(vectors), "n": sizes.astype(np.int32)})

    return run.asNondeterministic()(text)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows to unit length in double; zero rows stay."""
    vectors = np.asarray(vectors, np.float64)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(length > 0, vectors / np.where(length > 0, length, 1), vectors).astype(np.float32)


class HashEmbedder:
    """Eight sums of code points, by byte offset modulo 8; deterministic, for tests."""

    def __init__(self, normalize: bool = True):
        self.normalize = normalize

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 8), np.float32)
        for i, text in enumerate(texts):
            at = 0
            for c in text:
                out[i, at % 8] += ord(c)
                at += len(c.encode())
        return unit(out) if self.normalize else out


#: Words by space, tab and line ends; each ASCII punctuation mark alone.
split_words = re.compile(r"[!-/:-@\[-`{-~]|[^ \t\n\r!-/:-@\[-`{-~]+").findall


class WordPiece:
    """Greedy longest match of a vocabulary, continuations behind a prefix; a word that can't be covered is one unknown."""

    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", max_chars: int = 100, lowercase: bool = True):
        self.vocabulary, self.prefix, self.max_chars, self.lowercase = vocabulary, prefix, max_chars, lowercase
        self.unknown = vocabulary.get(unknown, 0)
        self.longest = max(map(len, vocabulary), default=0)
        self.known: dict[str, list[int]] = {}
        self.trie: _Trie | None = None

    @classmethod
    def load(cls, path: str | Path) -> WordPiece:
        """From a tokenizer.json."""
        raw = json.loads(Path(path).read_text())
        model, normalizer = raw.get("model") or {}, raw.get("normalizer") or {}
        return cls(model.get("vocab") or {}, model.get("unk_token") or "[UNK]", model.get("continuing_subword_prefix") or "##", model.get("max_input_chars_per_word") or 100, normalizer.get("lowercase") is not False)

    def word(self, word: str) -> list[int]:
        if len(word) > self.max_chars:
            return [self.unknown]
        ids, at = [], 0
        while at < len(word):
            head = self.prefix if at else ""
            ends = range(min(len(word), at + self.longest), at, -1)
            end = next((e for e in ends if head + word[at:e] in self.vocabulary), None)
            if end is None:
                return [self.unknown]
            ids.append(self.vocabulary[head + word[at:end]])
            at = end
        return ids

    def ids(self, text: str) -> list[int]:
        words = split_words(text.lower() if self.lowercase else text)
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return list(itertools.chain.from_iterable(map(known.__getitem__, words)))


    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has: `ids` for many texts at once.

        Words are found in one byte buffer, and each distinct one goes through the trie of pieces, all of them a byte a step.
        """
        if self.trie is None:
            self.trie = _Trie(self.vocabulary, self.prefix)
        encoded = [(t.lower() if self.lowercase else t).encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int64)
        buf = np.frombuffer(b"".join(encoded), np.uint8)
        start, end = _word_places(buf, offsets)
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        edges = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(buf[np.cumsum(inside[:-1], dtype=np.int8) > 0])])
        coded = words.dictionary_encode()
        ids, counts = self.trie.pieces(coded.dictionary, self.max_chars, self.unknown)
        first = np.cumsum(counts) - counts
        word = coded.indices.to_numpy()
        n = counts[word]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        before = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, offsets)]
        return ids[np.repeat(first[word], n) + place], np.diff(before)


_SPACE_BYTES = np.isin(np.arange(256), [0x09, 0x0A, 0x0D, 0x20])
_MARK_BYTES = np.isin(np.arange(256), [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])


def _word_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of split_words, within texts."""
    mark, member = _MARK_BYTES[buf], ~(_SPACE_BYTES | _MARK_BYTES)[buf]
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    some = offsets[1:] > offsets[:-1]
    first[offsets[:-1][some]] = member[offsets[:-1][some]]
    last[offsets[1:][some] - 1] = member[offsets[1:][some] - 1]
    return np.flatnonzero(first | mark), np.flatnonzero(last | mark) + 1


class _Trie:
    """Pieces by their bytes: node 0 begins a word, node 1 goes on. A move is (node, byte), and moves are kept in order."""

    def __init__(self, vocabulary: dict[str, int], prefix: str):
        whole = [(0, w.encode(), i) for w, i in vocabulary.items() if w]
        inner = [(1, w[len(prefix) :].encode(), i) for w, i in vocabulary.items() if w.startswith(prefix) and len(w) > len(prefix)]
        entries = whole + inner
        sizes = np.array([len(b) for _, b, _ in entries], np.int64)
        starts = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(b for _, b, _ in entries), np.uint8)
        node, ids = np.array([r for r, _, _ in entries], np.int64), np.array([i for _, _, i in entries], np.int64)
        moves, to, value, depth = [], [], [np.full(2, -1, np.int64)], 0
        nodes, active = 2, np.arange(len(entries))
        while len(active):
            found, own = np.unique(node[active] << 8 | buf[starts[active] + depth], return_inverse=True)
            moves.append(found)
            to.append(nodes + np.arange(len(found)))
            node[active] = nodes + own
            depth += 1
            done = sizes[active] == depth
            at = np.full(len(found), -1, np.int64)
            at[own[done]] = ids[active[done]]
            value.append(at)
            nodes += len(found)
            active = active[~done]
        self.moves, self.to, self.value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (moves, to, value))
        order = np.argsort(self.moves)
        self.moves, self.to = np.append(self.moves[order], np.iinfo(np.int64).max), np.append(self.to[order], 0)

    def pieces(self, words: pa.LargeBinaryArray, max_chars: int, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        buf = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        bad = chars[edges[1:]] - chars[edges[:-1]] > max_chars
        left, pos, end = np.flatnonzero(~bad), edges[:-1][~bad].copy(), edges[1:][~bad]
        node, best, stop = np.zeros(len(left), np.int64), np.full(len(left), -1, np.int64), np.zeros(len(left), np.int64)
        owners, found = [np.flatnonzero(bad)], [np.full(int(bad.sum()), unknown, np.int64)]
        while len(left):
            inside = pos < end
            key = node << 8 | buf[np.where(inside, pos, 0)]
            j = np.searchsorted(self.moves, key)
            hit = inside & (self.moves[j] == key)
            node = np.where(hit, self.to[j], node)
            pos = pos + hit
            value = np.where(hit, self.value[node], -1)
            best, stop = np.where(value >= 0, value, best), np.where(value >= 0, pos, stop)
            dead = np.flatnonzero(~hit)
            if len(dead):
                some = dead[best[dead] >= 0]
                owners.append(left[some])
                found.append(best[some])
                lost = dead[best[dead] < 0]
                bad[left[lost]] = True
                owners.append(left[lost])
                found.append(np.full(len(lost), unknown, np.int64))
                pos[some], node[some], best[some] = stop[some], 1, -1
                over = np.zeros(len(left), bool)
                over[lost] = True
                over[some] = pos[some] >= end[some]
                keep = ~over
                left, pos, end, node, best, stop = (x[keep] for x in (left, pos, end, node, best, stop))
        owner, ids = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.empty(0, bool)
        keep = ~bad[owner] | last  # a word that fails is one unknown, whatever it had
        owner, ids = owner[keep], ids[keep]
        return ids, np.bincount(owner, minlength=len(words))


def read_safetensors(path: str | Path) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file."""
    return tensors(Path(path).read_bytes(), str(path))


def tensors(data: bytes, path: str = "") -> dict[str, np.ndarray]:
    """Tensors of a safetensors file's bytes; halves are widened."""
    n = int.from_bytes(data[:8], "little")
    header = json.loads(data[8 : 8 + n])
    out = {}
    for name, entry in header.items():
        if name != "__metadata__":
            a, b = entry["data_offsets"]
            if entry["dtype"] not in _TYPES:
                raise ValueError(f"{name}: {entry['dtype']} is not a float type that is read here")
            out[name] = np.frombuffer(data[8 + n + a : 8 + n + b], _TYPES[entry["dtype"]]).reshape(entry["shape"]).astype(np.float32)
    return out


class StaticModel:
    """Mean of the word pieces' vectors, summed in double, to unit length if the model says so."""

    def __init__(self, tokenizer: WordPiece, vectors: np.ndarray, normalize: bool = True):
        self.tokenizer, self.vectors, self.normalize = tokenizer, vectors, normalize

    @classmethod
    def load(cls, folder: str | Path) -> StaticModel:
        """tokenizer.json, model.safetensors and, if there, config.json (normalize) of a folder."""
        folder = Path(folder)
        tensors = read_safetensors(folder / "model.safetensors")
        vectors = tensors.get("embeddings", next((t for t in tensors.values() if t.ndim == 2), None))
        if vectors is None or vectors.ndim != 2:
            raise ValueError("no table of vectors")
        config = folder / "config.json"
        return cls(WordPiece.load(folder / "tokenizer.json"), vectors, bool(json.loads(config.read_text()).get("normalize", True)) if config.exists() else True)

    def embed_with_sizes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and how many ids it has; ids outside the table are left out. Some texts are cut into ids at a time, some ids' vectors gathered."""
        out, sizes = np.zeros((len(texts), self.vectors.shape[1]), np.float64), np.zeros(len(texts), np.int64)
        first, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held < _CHARS and i < len(texts) - 1:
                continue
            ids, n = self.tokenizer.batch(texts[first : i + 1])
            owner = np.repeat(np.arange(first, i + 1), n)
            fits = (ids >= 0) & (ids < len(self.vectors))
            ids, owner = ids[fits], owner[fits]
            sizes[first : i + 1] = np.bincount(owner - first, minlength=i + 1 - first)
            for a in range(0, len(ids), _GATHER):
                some, own = ids[a : a + _GATHER], owner[a : a + _GATHER]
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                out[own[heads]] += np.add.reduceat(self.vectors[some], heads, axis=0, dtype=np.float64)
            first, held = i + 1, 0
        out = (out / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        return (unit(out) if self.normalize else out), sizes

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.embed_with_sizes(texts)[0]
