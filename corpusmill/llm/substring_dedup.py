"""Substring dedup by super-k-mers: words covered by a window of words that occurs again are removed.

Consecutive windows that share a minimiser (the rarest of their k-mers of words, ties by hash) travel as one packed string to the
minimiser's bucket, where sorting counts windows exactly; see `_windows` for the passes. Windows are judged on the
input: every occurrence goes, the first included.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; repeated rows repeat each other's
windows, whatever their ids; null ids are kept as null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _kernel
from corpusmill.llm._windows import Kind, judge

WINDOW, K = 35, 8
_OUT = "doc_id long, n_words long, n_removed long, kept string"


def _finish(text: np.ndarray, units: tuple[np.ndarray, np.ndarray] | None, removed: np.ndarray) -> tuple:
    some = []
    stretches = [(0, *units, 0)] if units else ((number, start, end, at) for number, start, end, at, _ in _kernel.stretches(text, _kernel.WHITE, 0))
    for number, start, end, at in stretches:
        own = np.flatnonzero(~removed[number : number + len(start)])
        if len(own):
            first, last = at + int(start[own[0]]), at + int(end[own[-1]])
            data, base = text[first:last].tobytes(), first - at
            some.append(b" ".join([data[x - base : y - base] for x, y in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
    return len(removed), int(removed.sum()), b" ".join(some).decode()


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    return judge(docs, Kind("words", window, k, True), _finish, _OUT, id_col, text_col)


def substring_digest(docs: DataFrame) -> DataFrame:
    """Query op7: windows of 35 words."""
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
