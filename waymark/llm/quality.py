"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For every text the share of characters inside repeated n-grams and lines is measured with numpy
on the hashes of its words; a document is kept if no share passes its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches, texts_of
from .words import Words, windows

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """Largest shares of a kept document's characters."""

    #: inside an n-gram's later occurrences, by n
    repeated: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    #: inside all occurrences of the most frequent n-gram, by n
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    #: inside later occurrences of a line
    line_chars: float = 0.20
    #: later occurrences of a line, of all lines with a word
    lines: float = 0.30
    min_words: int = 50
    repeat_words_percent: int = 50


def covered(w: np.ndarray, n: int, n_words: int, first: bool) -> np.ndarray | None:
    """Which words lie in windows of n words that occur twice or more; first: whether their first
    occurrence counts. None: no window is repeated."""
    s = np.sort(w)
    if len(s) < 2 or not (s[1:] == s[:-1]).any():
        return None
    _, at, group, count = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
    hit = count[group] > 1
    if not first:
        hit[at] = False
    step = np.zeros(n_words + 1, np.int64)
    where = np.flatnonzero(hit)
    step[where] += 1
    step[where + n] -= 1
    return np.cumsum(step[:-1]) > 0


def _top(w: np.ndarray, n: int, chars: np.ndarray) -> float:
    """Characters in all occurrences of the most frequent window, ties: of that with most characters."""
    if not len(w):
        return 0
    _, at, count = np.unique(w, return_index=True, return_counts=True)
    most = count.max()
    return 0 if most < 2 else min(int(chars[-1]), int(most * (chars[at + n] - chars[at])[count == most].max()))


def measure(texts: list[str], limits: Limits) -> dict[str, list]:
    """The columns of `repetition` for some texts."""
    words = Words(texts, lower=False, lengths=True)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "max_repeated_share", "max_top_share")}
    for i, text in enumerate(texts):
        h, length = (x[words.offsets[i] : words.offsets[i + 1]] for x in (words.hashes, words.lengths))
        chars = np.concatenate(([0], np.cumsum(length)))
        n, total = len(h), max(1, int(chars[-1]))
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        seen: set[str] = set()
        dup_lines = dup_chars = 0
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_chars += len(x)
            seen.add(x)
        again = covered(windows(h, 3), 3, n, first=True)
        repeat = 0 if again is None else int(again.sum())
        line_share = dup_chars / max(1, sum(map(len, lines)))
        failed = n < limits.min_words or 100 * repeat > limits.repeat_words_percent * n
        repeated = top = 0.0
        good = not failed and line_share <= limits.line_chars and dup_lines <= limits.lines * max(1, len(lines))
        for k, most in limits.top.items():
            share = _top(windows(h, k), k, chars) / total
            top = max(top, share)
            good &= share <= most
        for k, most in limits.repeated.items():
            mask = covered(windows(h, k), k, n, first=False)
            if mask is None:  # longer windows are not repeated either
                break
            share = int(length[mask].sum()) / total
            repeated = max(repeated, share)
            good &= share <= most
        row = (n, int(chars[-1]), sum(map(text.count, SYMBOLS)), dup_lines, repeat, failed, bool(good), line_share, repeated, top)
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, max_repeated_share double, max_top_share double"


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id and the measures of its whole text.

    Null and empty texts have no words: all counts 0, base_failed true, kept false. Repeated rows
    and null ids give a row each; other columns of `docs` are not read. No shuffle: a text is
    judged alone, and a task holds one Arrow batch."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        got = measure(texts_of(batch, text_col), limits)
        yield {id_col: batch.column(id_col), **{k: pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.float64() if k.endswith("share") else pa.int64()) for k, v in got.items()}}

    return over_batches(docs.select(id_col, text_col), f, f"{id_col} {id_type}, {SCHEMA}")


def kept(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(texts_of(batch, text_col), limits)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
