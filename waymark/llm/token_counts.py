"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines, both with what they emit on their transitions:

* The splitter reads one symbol a code point (its class, with the bounded look-ahead folded in) and
  marks where a piece of text begins, as the pattern of byte-level tokenizers splits it. A text is
  cut into chunks; all chunks run at once from every state, which gives each a map from states to
  states, and a parallel prefix scan composes those maps into the state in which each chunk begins.
* The counter reads the bytes of a piece through an automaton of the vocabulary whose states know
  the tokens that end there. A token extends a prefix if it may stand behind the prefix's last
  token, that is if the merges leave that pair as it is; the transition then carries one token more
  than the prefix before it. Exactly one token qualifies at each byte, so the counts are those of
  the merges themselves. Counts of recent pieces are kept in a bounded memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import over_batches, texts_of

LETTER, NUMBER, OTHER, SPACE_LAST, SPACE_MORE, WHITE_LAST, WHITE_MORE, APOS_1, APOS_2, CUT = range(10)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, PREFIX, TAKE_1, TAKE_2 = range(8)
_CHUNK = 128
_BLOCK = 1 << 20
_MEMORY = 400_000


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state."""
    to, starts = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[symbol] = inside
        starts[symbol] = [s not in (inside, PREFIX) for s in range(8)]
    for symbol, take in ((APOS_1, TAKE_1), (APOS_2, TAKE_2)):
        alone = [s not in (IN_OTHER, PREFIX) for s in range(8)]
        to[symbol] = np.where(alone, take, IN_OTHER)
        starts[symbol] = alone
    to[SPACE_LAST], starts[SPACE_LAST] = PREFIX, True
    to[WHITE_LAST], starts[WHITE_LAST] = CLOSED, True
    for symbol in (SPACE_MORE, WHITE_MORE):
        to[symbol] = IN_WHITE
        starts[symbol] = [s != IN_WHITE for s in range(8)]
    to[:, TAKE_1], starts[:, TAKE_1] = CLOSED, False
    to[:, TAKE_2], starts[:, TAKE_2] = TAKE_1, False
    to[CUT], starts[CUT] = CLOSED, False
    return to, starts


_TO, _STARTS = _machine()
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_LAST by code point."""
    if not _classes:
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        every, table = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8)
        at = np.array(points)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE_LAST)):
            for m in regex.finditer(pattern, every):
                table[at[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps one behind the other, row by row."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Of maps m1, m2, ...: m1, m1 then m2, ..., each composed in log2(n) rounds over all rows at once."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def symbols(text: str, cuts: np.ndarray) -> np.ndarray:
    """The splitter's symbols of a text; cuts: places of white space that only part two texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _class_table()[codes]
    white = kind == WHITE_LAST
    more = np.append(white[1:], True)
    kind[white & more] = WHITE_MORE
    blank = codes == 32
    kind[blank] = np.where(more[blank], SPACE_MORE, SPACE_LAST)
    apos = np.flatnonzero(codes == 39)
    if len(apos):
        after = np.concatenate((codes, np.zeros(2, np.uint32)))
        a, b = after[apos + 1], after[apos + 2]
        kind[apos[np.isin(a, [115, 116, 109, 100])]] = APOS_1  # 's 't 'm 'd
        kind[apos[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = APOS_2  # 're 've 'll
    kind[cuts] = CUT
    return kind


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Places at which a piece begins."""
    n = -(-len(kind) // _CHUNK)
    grid = np.full(n * _CHUNK, CUT, np.uint8)
    grid[: len(kind)] = kind
    columns = np.ascontiguousarray(grid.reshape(n, _CHUNK).T)
    flat = _TO.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for column in columns:
        maps = flat[(column * np.uint8(8))[:, None] | maps]
    begin = np.zeros(n, np.uint8)
    begin[1:] = prefix_scan(maps)[:-1, CLOSED]
    mark, state, emits = np.zeros((_CHUNK, n), bool), begin, _STARTS.ravel()
    for i, column in enumerate(columns):
        at = (column * np.uint8(8)) | state
        mark[i], state = emits[at], flat[at]
    return np.flatnonzero(mark.T.ravel()[: len(kind)])


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter(dict):
    """Tokens by piece of text, counted when first asked for and remembered."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without a space put in front is needed")
        alphabet = _byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        special = set(self.special)
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
        ids = {t: spec["model"]["vocab"][t] for t in raw}
        self.bytes_of = {ids[t]: b for t, b in raw.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges) if a + b in ids}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.parts = {new: (rank, pair) for pair, (rank, new) in sorted(self.merge.items(), key=lambda x: -x[1][0])}
        self.never = len(merges) + 1
        self.fits: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[int, int, int]]] = {}
        self._compile()

    def _compile(self) -> None:
        """The automaton: go[state << 8 | byte], and the tokens that end in a state, longest first."""
        go: dict[int, int] = {}
        ends: list[int] = [-1]
        for i, b in self.bytes_of.items():
            state = 0
            for byte in b:
                state = go.setdefault(state << 8 | byte, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        children: list[list[int]] = [[] for _ in ends]
        for key in go:
            children[key >> 8].append(key & 255)
        fail, found = [0] * len(ends), [()] * len(ends)
        row = [0]
        for state in row:
            for byte in children[state]:
                to = go[state << 8 | byte]
                back = fail[state]
                while state and back and (back << 8 | byte) not in go:
                    back = fail[back]
                fail[to] = go.get(back << 8 | byte, 0) if state else 0
                own = ends[to]
                found[to] = (((own, len(self.bytes_of[own])),) if own >= 0 else ()) + found[fail[to]]
                row.append(to)
        self.go, self.fail, self.found = go, fail, found

    def merged(self, b: bytes) -> list[int]:
        """The tokens of some bytes by the merges alone."""
        out = [self.single[x] for x in b]
        while len(out) > 1:
            best = min((self.merge[p] + (p,) for p in zip(out, out[1:], strict=False) if p in self.merge), default=None)
            if best is None:
                break
            _, new, pair = best
            i, done = 0, []
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                    done.append(new)
                    i += 2
                else:
                    done.append(out[i])
                    i += 1
            out = done
        return out

    def _edge(self, token: int, left: bool) -> list[tuple[int, int, int]]:
        """The tokens that stand at an edge of `token` while it is put together: each with the rank
        of the merge that made it and of the merge that used it up."""
        key = token << 1 | left
        known = self.edges.get(key)
        if known is None:
            known, used = [], self.never
            while True:
                made, pair = self.parts.get(token, (-1, None))
                known.append((token, made, used))
                if pair is None:
                    break
                used, token = made, pair[0 if left else 1]
            self.edges[key] = known
        return known

    def _test(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a (-1: at the beginning).

        It may unless a merge takes tokens from both sides: x at a's right edge and y at b's left
        edge that exist at the same time, with a merge ranked before the one that uses x up and not
        after the one that uses y up (of equal merges the left one goes first)."""
        for token in (a, b):
            if token not in self.reached:
                self.reached[token] = token < 0 or self.merged(self.bytes_of[token]) == [token]
        if a < 0 or not self.reached[b]:
            return self.reached[b]
        merge = self.merge
        right = self._edge(b, True)
        for x, made, used in self._edge(a, False):
            for y, made2, used2 in right:
                if made < used2 and made2 < used:
                    m = merge.get((x, y))
                    if m is not None and m[0] < used and m[0] <= used2:
                        return False
        return True

    def count(self, b: bytes) -> int:
        """Tokens of one piece: one run of the counter over its bytes."""
        go, fail, found, fits = self.go, self.fail, self.found, self.fits
        last, total, state = [-1], [0], 0
        for i, byte in enumerate(b, 1):
            to = go.get(state << 8 | byte)
            while to is None and state:
                state = fail[state]
                to = go.get(state << 8 | byte)
            state = to or 0
            for token, n in found[state]:
                before = last[i - n]
                key = before << 20 | token
                fit = fits.get(key)
                if fit is None:
                    fit = fits[key] = self._test(before, token)
                if fit:
                    last.append(token)
                    total.append(total[i - n] + 1)
                    break
        return total[-1]

    def __missing__(self, piece: str) -> int:
        if len(self) > _MEMORY:
            self.clear()
        if len(self.fits) > 6 * _MEMORY:
            self.fits.clear()
        n = self.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = n
        return n


def _count_block(parts: list[str], counter: Counter) -> np.ndarray:
    """Tokens of each of some texts."""
    text = "\n".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = piece_starts(symbols(text, ends[:-1]))
    stop = np.append(starts[1:], len(text))
    part = np.searchsorted(ends, starts)
    stop = np.minimum(stop, ends[part])
    n = list(map(counter.__getitem__, [text[a:b] for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]))
    return np.bincount(part, n, len(parts)).astype(np.int64)


def _long(text: str, counter: Counter) -> int:
    """Tokens of a text longer than a block. Splitting has no memory at a piece's beginning, so a
    block ends there, short of pieces that what follows may yet change."""
    total, rest, at = 0, "", 0
    while at < len(text):
        rest, at = rest + text[at : at + _BLOCK], at + _BLOCK
        if at >= len(text):
            break
        starts = piece_starts(symbols(rest, np.empty(0, np.int64)))
        starts = starts[starts < len(rest) - 4]
        if len(starts) > 2:
            total += int(_count_block([rest[: starts[-2]]], counter)[0]) if rest[: starts[-2]] else 0
            # the look-ahead behind the block's end was white space or not: keep what decides it
            rest = rest[starts[-2] :]
    return total + int(_count_block([rest], counter)[0])


def count_texts(texts: list[str], counter: Counter) -> np.ndarray:
    """Tokens of each text; special strings inside count as one token each."""
    total = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        if parts:
            np.add.at(total, owner, _count_block(parts, counter))
            parts.clear()
            owner.clear()

    special = regex.compile("|".join(map(regex.escape, counter.special))) if counter.special else None
    for i, text in enumerate(texts):
        pieces = special.split(text) if special else [text]
        total[i] += len(pieces) - 1
        for p in pieces:
            if len(p) > _BLOCK:
                total[i] += _long(p, counter)
            elif p:
                parts.append(p)
                owner.append(i)
                size += len(p)
        if size > _BLOCK:
            flush()
            size = 0
    flush()
    return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of `docs`, over its whole text.

    tokenizer: path of a byte-level BPE file that every executor has. Null texts count as empty: no
    bytes, no tokens. Repeated rows and null ids give a row each. There is no shuffle; a task holds
    one Arrow batch, a block of a million characters and a bounded memory of pieces."""

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        texts = texts_of(batch, text_col)
        n = count_texts(texts, _counters[tokenizer])
        yield {id_col: batch.column(id_col), "n_bytes": np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit}

    return over_batches(docs.select(id_col, text_col), f, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
