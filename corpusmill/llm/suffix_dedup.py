"""Suffix dedup by depth-limited radix sort: bytes covered by a long enough string of an earlier document are removed.

Suffixes are ordered only through the threshold's bytes, by passes from the most significant digit; groups that are
equal after the last pass are exactly the repeated windows. On a cluster the first pass can't move every suffix with its
bytes (fifty times the corpus): it deals suffixes by a digit that equal windows must share, their rarest k-mer, and drops what
is alone there. Suffixes that are left go on, neighbours packed in one string, to their digit's bucket, where the further
passes take 8 bytes each, through byte 50. Copies of whole texts go the same way. See `_windows` for the exchange.

A window is removed where a document with a smaller id has it too, judged on the input; the least id keeps it.

Defined cases: a null or empty text has no bytes; texts shorter than the threshold lose nothing; rows with equal ids don't
remove each other's bytes; a null id counts as smaller than all others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._windows import Kind, judge

THRESHOLD, K = 50, 16
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finish(text: np.ndarray, _, removed: np.ndarray) -> tuple:
    n = int(removed.sum())
    return len(text), n, len(_kernel.spans(removed)[0]) if n else 0, text[~removed].tobytes() if n else text.tobytes()


def remove_repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept (the bytes left) of every row."""
    return judge(docs, Kind("bytes", threshold, k, False), _finish, _OUT, id_col, text_col)


def suffix_digest(docs: DataFrame) -> DataFrame:
    """Query op5: strings of 50 bytes."""
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
