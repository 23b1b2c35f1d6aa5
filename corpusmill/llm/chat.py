"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn the turn mark, the role, the text mark, the text and the end mark. The marks
are special tokens of the tokenizer, so no token crosses one. In roles and texts a backslash goes before each
backslash and into each "<|", so no mark can occur in them, and `unescape` undoes it. The rendered text is encoded
once with offsets; for each assistant text's span, binary search in the tokens' sorted ends and starts gives
the tokens under the loss mask.

Rows are hash-partitioned by conversation and sorted by turn there; a task streams them, and holds a few conversations. What stands
between two marks is encoded by itself, as the tokenizer does it too, through the table of fragments of `token_output`, for the texts of
several conversations at once; a token's offsets follow from its bytes. Tests hold ids and offsets against the tokenizer's
own of the whole text. `format_chats` gives a row for each conversation, however long; a row holds at most 2 GB.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns with equal numbers are
ordered by role and text, repeated rows are repeated turns, a null turn comes first; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._common import exact, shuffle_partitions, staged
from corpusmill.llm.token_output import FragmentEncoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters of the conversations that are encoded together.
BATCH = 1 << 19
_FORMATTED = "conv_id long, formatted string, ids array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[list[str], list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, turn by turn, and the sorted spans of the texts to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        out.append(head + body + END)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(out[-1])
    return out, spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    found = re.findall(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", formatted, re.S)
    return [(unescape(role), unescape(text)) for role, text in found]


@functools.lru_cache(1)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
    return made


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens (rows of offsets: start, end) that share a character with a span."""
    edge = np.zeros(len(offsets) + 1, np.int64)
    if len(offsets) and spans:
        a, b = np.array(spans).T
        full = b > a
        first = np.searchsorted(offsets[:, 1], a[full], "right")
        last = np.searchsorted(offsets[:, 0], b[full], "left")
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


class ChatEncoder:
    """Ids and offsets of rendered turns."""

    def __init__(self, path: str):
        whole = tokenizer(path)
        self.fragments = FragmentEncoder(path)
        self.marks = [np.array([whole.token_to_id(x)], np.int32) for x in (TURN, TEXT, END)]
        words = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size(with_added_tokens=True))]
        self.bytes = np.array([len(w) for w in words], np.int64)  # a byte-level token has a character for each byte

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > _kernel.PIECE:
                out.append(self.fragments.encode_long(np.frombuffer(texts[at], np.uint8)).astype(np.int32))
                at += 1
                continue
            stop, size = at, 0
            while stop < len(texts) and size <= _kernel.PIECE and len(texts[stop]) <= _kernel.PIECE:
                size += len(texts[stop])
                stop += 1
            ids, ranges = self.fragments.encode(np.frombuffer(b"".join(texts[at:stop]), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts[at:stop]]))).astype(np.int64))
            ids = ids.astype(np.int32)
            out += [ids[a:b] for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True)]
            at = stop
        return out

    def encode(self, conversations: list[list[tuple[str, str]]]) -> list[np.ndarray]:
        """The ids of each conversation's (role, text) turns, marks included."""
        turn, text, end = self.marks
        ids = iter(self._ids([escape(x).encode() for turns in conversations for t in turns for x in t]))
        return [np.concatenate([np.empty(0, np.int32), *[x for _ in turns for x in (turn, next(ids), text, next(ids), end)]]) for turns in conversations]

    def offsets(self, ids: np.ndarray, formatted: str) -> np.ndarray:
        """(start, end) of each token by character; a token within a character has that character."""
        ends = np.cumsum(self.bytes[ids])
        heads = np.cumsum(np.frombuffer(formatted.encode(), np.uint8) & 0xC0 != 0x80)  # characters that begin up to each byte
        return np.stack([heads[ends - self.bytes[ids]] - 1, heads[ends - 1]], 1) if len(ids) else np.empty((0, 2), np.int64)


@functools.lru_cache(1)
def encoder(path: str) -> ChatEncoder:
    return ChatEncoder(path)


def _conversations(batches, path: str, learn: str):
    """Rows (conv_id, role, text) in order: a row (conv_id, formatted, ids, mask) for each conversation."""
    made = encoder(path)
    names: list[int | None] = []
    held: list[list[tuple[str, str]]] = []
    size = 0

    def done():
        formatted, masks, ids = [], [], made.encode(held)
        for turns, own in zip(held, ids, strict=True):
            rendered, spans = render(turns, learn)
            formatted.append("".join(rendered))
            masks.append(mask_of(made.offsets(own, formatted[-1]), spans))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(formatted), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "formatted", "ids", "mask"])
        names.clear()
        held.clear()
        return out

    for rows in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if not names or names[-1] != conv_id:
                if size > BATCH:
                    yield done()
                    _kernel.release()
                    size = 0
                names.append(conv_id)
                held.append([])
            held[-1].append((role or "", text or ""))
            size += len(held[-1][-1][1])
    if names:
        yield done()


def format_chats(rows: DataFrame, tokenizer_path: str, learn: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, ids and mask (per token: learnt or not)."""
    rows = rows.select(exact(id_col).cast("long").alias("conv_id"), exact(turn_col).alias("turn"), exact(role_col).alias("role"), exact(text_col).alias("text"))
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(lambda batches: _conversations(batches, tokenizer_path, learn), _FORMATTED)


def chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Query op2: all conversations and conversation -7, formatted, masked and written as a table; all columns are read back from it."""
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(extra), path)
    written = staged(out, "chats")

    def read(batches):
        decode = tokenizer(path)
        for batch in batches:
            rows = []
            ids, masks = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            for i, end in enumerate(ends.tolist()):
                first = int(ends[i - 1]) if i else 0
                turns, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0
                formatted = batch.column(1)[i].as_py()
                parsed = parse(formatted)
                for role, text in parsed:
                    turns.update(f"{role}\n{text}\n".encode())
                for a, b in zip(*_kernel.spans(masks[first:end]), strict=True):
                    text = unescape(decode.decode(ids[first + a : first + b].tolist(), skip_special_tokens=False))
                    chars += len(text)
                    learnt.update(text.encode())
                rows.append((batch.column(0)[i].as_py(), len(parsed), turns.hexdigest(), chars, learnt.hexdigest(), len(formatted)))
            yield as_batch(rows)
            _kernel.release()

    def as_batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return written.select("conv_id", "formatted", "ids", "mask").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
