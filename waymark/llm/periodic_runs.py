"""Periodic runs of words: stretches that repeat a block of words over and over.

The words of a text are read one by one. A diagonal is a lag p together with the number of words up
to here that equal the word p places earlier: each new word makes the diagonals of its earlier
occurrences longer, and a diagonal whose word differs ends and gives its run at once, if it has
become long enough. The diagonals are sparse. A lag is opened only where a window of words ends
whose nearest earlier occurrence is p words back, for a window length that any long enough run of
that lag must repeat, so that a frequent word doesn't open one for each of its earlier places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches
from .words import mix

_FACTOR = np.uint64(0x9FB21C651E98DF25)

RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _longer(h: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of all windows of `to` words from those of all windows of `size` words."""
    n = len(h) - (to - size)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at in (*range(0, to - size, size), to - size):
        out = out * _FACTOR + h[at : at + n]
    return mix(out)


def _nearest(h: np.ndarray) -> np.ndarray | None:
    """How far back each window's nearest equal one is, 0 for none; None: no two are equal."""
    s = np.sort(h)
    if len(s) < 2 or not (s[1:] == s[:-1]).any():
        return None
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    back = np.zeros(len(h), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def _openings(ids: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """(last word, lag, window length) of windows seen `lag` words earlier, by last word.

    A run of smallest period p repeats at lag p at least (exponent - 1) * p words in a row, and in it
    the nearest earlier occurrence of a window of p - 1 words or more is p words back: a nearer one
    would give the stretch both periods, and with them a smaller common one. So windows of w words
    find all lags from w / (exponent - 1) to w + 1, and each window length begins where the one
    before it stops. Where no two windows of a length are equal, no longer ones are."""
    h, size, lag = mix(ids.astype(np.uint64) + np.uint64(1)), 1, 1
    found: list[np.ndarray] = []
    while exponent * lag <= len(ids):
        w = (exponent - 1) * lag
        h, size = _longer(h, size, w), w
        back = _nearest(h)
        if back is None:
            break
        at = np.flatnonzero((back >= lag) & (back <= w + 1))
        found.append(np.stack((at + w - 1, back[at], np.full(len(at), w)), 1))
        lag = w + 2
    if not found:
        return []
    out = np.concatenate(found)
    return list(map(tuple, out[np.argsort(out[:, 0], kind="stable")].tolist()))


def runs_of(words: list, min_words: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of `words`, by start, then period."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods would need windows of every length")
    n = len(words)
    if n < min_words:
        return []
    known = dict(zip(words, range(n)))
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    openings = _openings(ids, exponent)
    if not openings:
        return []
    w, out, active, k, i = ids.tolist(), [], {}, 0, 0
    while active or k < len(openings):
        if not active:
            i = openings[k][0]
        longer, ended = {}, []
        for p, m in active.items():
            if i < n and w[i] == w[i - p]:
                longer[p] = m + 1
            else:
                ended.append((p, i - m - p, m + p))
        for p, start, length in ended:
            # a diagonal inside one that ends with it, of a lag that divides its own, has a smaller period
            if length >= max(min_words, exponent * p) and not any(q < p and p % q == 0 and at <= start for q, at, _ in ended):
                out.append((start, length, p))
        while k < len(openings) and openings[k][0] == i:
            _, p, m = openings[k]
            k += 1
            # equal hashes propose, equal words decide
            if p not in longer and w[i - m + 1 : i + 1] == w[i - m + 1 - p : i + 1 - p]:
                longer[p] = m
        active = longer
        i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that lie in a run behind its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def periodic_runs(docs: DataFrame, min_words: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, n_words, the maximal runs of its whole text and the text without them.

    Words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte. A run is a stretch of smallest period q and at
    least max(`min_words`, `exponent` * q) words that no neighbouring word extends with that period; runs are
    in order of start, then period, and may overlap. In `collapsed` each run keeps its first q words, unless
    another run drops them; all kept words are joined by one space.

    Null, empty and blank texts have no words, no runs and an empty text. Repeated rows and null ids give a
    row each; other columns are not read, whatever their names; an empty table gives an empty one. No
    shuffle: a text is judged alone and whole. A task holds one Arrow batch and, of one text, its words and
    their hashes: time is of order n log n for n words, whatever repeats."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        n_words, offsets, found, texts = [], [0], [], []
        for text in batch.column(text_col).cast(pa.large_binary()).to_pylist():
            # bytes are split at exactly the six characters that end a word
            words = (text or b"").split()
            runs = runs_of(words, min_words, exponent)
            n_words.append(len(words))
            found += runs
            offsets.append(len(found))
            texts.append(collapsed(words, runs))
        fields = list(zip(*found, strict=True)) or [[], [], []]
        runs_column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"]))
        yield {id_col: batch.column(id_col), "n_words": n_words, "runs": runs_column, "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}

    return over_batches(docs.select(id_col, text_col), f, f"{id_col} {id_type}, n_words bigint, {RUNS}, collapsed string")
