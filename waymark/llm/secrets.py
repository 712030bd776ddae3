"""Secrets in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags tokens as begin, inside or outside of a secret. A token is a run of ASCII letters and
digits or one other character that isn't white space. Begin and inside are admitted only in chunks (runs
of graphic ASCII characters) of eight characters or more that hold a digit or a capital behind a small
letter; inside only follows begin or inside within its chunk. Everywhere else the chain is outside, so
decoding the stretches of admitted chunks alone is exact for the whole text.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, released, stored, texts_of

#: Kinds of the patterns with their least lengths, and the group whose length counts.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "crf")
OUT, BEGIN, IN = range(3)

_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_CHUNK = re.compile(r"(?<![!-~])(?:[!-/:-~]*+[0-9]|[!-~]*?[a-z][A-Z])[!-~]*+")
_CUE = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|private|login")
_FORBIDDEN = -1e9
_BEFORE, _AFTER, _LEAST = 64, 32, 8


@dataclass(frozen=True)
class Settings:
    """What the field learns from. Only the labelled sample is bounded: scans cover everything."""

    #: distinct windows around chunks of the corpus: those with a pattern's match, and those without
    positives: int = 1000
    negatives: int = 2000
    #: made-up windows of each class, so that there is a model without any match in the corpus
    made: int = 600
    #: tokens of the longest window learned from
    longest: int = 96
    buckets: int = 1 << 15
    rounds: int = 60
    rate: float = 0.15
    ridge: float = 0.02
    #: characters of the shortest span the field adds
    least: int = 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start, then kind as listed."""
    found = []
    low = text.lower()
    for kind, pattern, group, least in PATTERNS:
        if kind == "assign" and not any(w in low for w in _WORDS) or kind == "access" and "AKIA" not in text or kind == "hex" and not _LONG_HEX.search(text):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves in the patterns' matches, without keys and without digits alone."""
    out = []
    for _, pattern, group, least in PATTERNS:
        out += [m.span(group) for m in pattern.finditer(text) if len(m.group(group)) >= least and not m.group(group).isdigit()]
    return out


def chunks(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CHUNK.finditer(text) if m.end() - m.start() >= _LEAST]


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Admitted chunks, together as long as only white space is between them."""
    out: list[list[tuple[int, int]]] = []
    for start, end in chunks(text):
        if out and text[out[-1][-1][1] : start].isspace():
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
    return out


def _shape(token: str) -> str:
    """The classes of a token's characters, each run as one."""
    return re.sub(r"(.)\1+", r"\1", "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c for c in token))


def _class(token: str) -> str:
    if not ("0" <= token[0] <= "9" or "A" <= token[0] <= "Z" or "a" <= token[0] <= "z"):
        return token
    s = _shape(token)
    return s if len(s) < 4 else "mix" + "".join(sorted(set(s)))


def _word(token: str) -> str:
    return token.lower() if len(token) <= 14 else _class(token)


def file_features(text: str, n_chunks: int) -> list[str]:
    """Of the whole text: its length, how dense admitted chunks are, how many lines look like settings."""
    lines = text.count("\n") + 1
    return [f"f:len{min(20, len(text).bit_length())}", f"f:chunks{min(12, (64 * n_chunks * 8 // (len(text) + 1)).bit_length())}", f"f:set{min(4, 4 * (text.count('=') + text.count(': ')) // lines)}"]


def features(text: str, spans: list[tuple[int, int]], of_file: list[str], buckets: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(token spans, ids of features by token, whether a token may be begin and inside) of a stretch."""
    places, rows, admitted = [], [], []
    before = [_word(t) for t in _TOKEN.findall(text[max(0, spans[0][0] - _BEFORE) : spans[0][0]])][-3:]
    after = _TOKEN.search(text, spans[-1][1], spans[-1][1] + _AFTER)
    last = _word(after.group()) if after else "<end>"
    history = ["<begin>"] * (3 - len(before)) + before
    for start, end in spans:
        found = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text, start, end)]
        size, outline = min(12, (end - start) // 6), _shape(text[start : min(end, start + 64)])[:10]
        for k, (a, b, token) in enumerate(found):
            p1, p2, p3 = history[-1], history[-2], history[-3]
            following = _class(found[k + 1][2]) if k + 1 < len(found) else "<gap>"
            kind, n = _class(token), min(10, len(token) // 4)
            switches = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:]))
            variety = len(set(token[:64])) * 4 // min(64, len(token))
            vowels = sum(c in "aeiouAEIOU" for c in token[:64]) * 6 // min(64, len(token))
            cue = "".join("1" if _CUE.search(w) else "0" for w in (p1, p2, p3))
            names = (
                "bias", f"c:{kind}", f"n:{n}", f"cn:{kind}:{n}", f"s:{min(8, switches)}:{n}", f"d:{variety}:{n}", f"v:{vowels}:{n}", f"o:{outline}", f"o:{size}:{min(k, 3)}",
                f"x:{following}:{n}", f"p1:{p1}", f"p2:{p2}", f"p3:{p3}", f"q:{p1}:{p2}", f"cue:{cue}:{p1 in '=:'}", f"l:{last}" if k + 1 == len(found) else "l:", *of_file,
            )
            places.append((a, b))
            rows.append([zlib.crc32(x.encode()) % buckets for x in names])
            admitted.append((token[0].isalnum(), k > 0))
            history.append(_word(token))
    return places, np.array(rows, np.int32), np.array(admitted, bool)


@dataclass(frozen=True)
class Model:
    """weights of features by state, and of moves from state to state; both ends of a stretch are outside."""

    weights: np.ndarray
    moves: np.ndarray
    settings: Settings

    def emissions(self, ids: np.ndarray, admitted: np.ndarray) -> np.ndarray:
        e = self.weights[ids].sum(1)
        e[:, BEGIN][~admitted[:, 0]] = _FORBIDDEN
        e[:, IN][~admitted[:, 1]] = _FORBIDDEN
        return e

    def decode(self, e: np.ndarray) -> list[int]:
        """The best states by Viterbi; ties go to the lower state."""
        score, back = self.moves[OUT] + e[0], []
        for row in e[1:]:
            through = score[:, None] + self.moves
            back.append(through.argmax(0))
            score = through.max(0) + row
        state = int((score + self.moves[:, OUT]).argmax())
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the field tags in a whole text."""
        found = stretches(text)
        of_file = file_features(text, sum(map(len, found))) if found else []
        out: list[list[int]] = []
        for stretch in found:
            places, ids, admitted = features(text, stretch, of_file, self.settings.buckets)
            inside = False
            for (a, b), state in zip(places, self.decode(self.emissions(ids, admitted)), strict=True):
                if state == BEGIN:
                    out.append([a, b])
                elif state == IN and inside:
                    out[-1][1] = b
                inside = state != OUT
        return [(a, b) for a, b in out if b - a >= self.settings.least]

    def all_spans(self, text: str) -> list[tuple[str, int, int]]:
        """The patterns' spans, and the field's where they touch none of those; by start, then kind as listed."""
        base = base_spans(text)
        more = [("crf", a, b) for a, b in self.spans(text) if not any(a < y and x < b for _, x, y in base)]
        return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _likelihood(w: np.ndarray, moves: np.ndarray, ids: np.ndarray, admitted: np.ndarray, tags: np.ndarray, sizes: np.ndarray):
    """Gradients of the log-likelihood of padded windows, by forward and backward sums over all of them at once."""
    n, t, _ = ids.shape
    e = w[ids].sum(2)
    e[..., BEGIN][~admitted[..., 0]] = _FORBIDDEN
    e[..., IN][~admitted[..., 1]] = _FORBIDDEN
    live = np.arange(t) < sizes[:, None]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    ahead, behind = np.empty((t, n, 3)), np.empty((t, n, 3))
    ahead[0] = moves[OUT] + e[:, 0]
    for k in range(1, t):
        ahead[k] = np.where(live[:, k, None], total(ahead[k - 1][:, :, None] + moves, 1) + e[:, k], ahead[k - 1])
    whole = total(ahead[-1] + moves[:, OUT], 1)
    behind[-1] = moves[:, OUT]
    for k in range(t - 2, -1, -1):
        behind[k] = np.where(live[:, k + 1, None], total(moves[None] + (e[:, k + 1] + behind[k + 1])[:, None, :], 2), behind[k + 1])
    share = np.exp(np.minimum(0, ahead + behind - whole[None, :, None])).transpose(1, 0, 2) * live[..., None]
    wrong = -share
    np.add.at(wrong, (*np.nonzero(live), tags[live]), 1)
    grad = np.stack([np.bincount(ids.ravel(), np.repeat(wrong[..., s].ravel(), ids.shape[2]), len(w)) for s in range(3)], 1)
    pairs = np.zeros((3, 3))
    for k in range(1, t):
        at = live[:, k]
        if at.any():
            both = ahead[k - 1][at][:, :, None] + moves + (e[at, k] + behind[k][at])[:, None, :] - whole[at, None, None]
            pairs -= np.exp(np.minimum(0, both)).sum(0)
            np.add.at(pairs, (tags[at, k - 1], tags[at, k]), 1)
    np.add.at(pairs, (OUT, tags[:, 0]), 1)
    pairs[OUT] -= share[:, 0].sum(0)
    ends = np.arange(n), sizes - 1
    np.add.at(pairs, (tags[ends], OUT), 1)
    pairs[:, OUT] -= share[ends].sum(0)
    return grad, pairs


def train(windows: list[tuple[str, list[tuple[int, int]], list[str]]], settings: Settings = Settings()) -> Model:
    """The field of (text, secrets in it, features of its file), by full steps of Adam with a ridge penalty."""
    rows = []
    for text, secrets, of_file in windows:
        for stretch in stretches(text):
            places, ids, admitted = features(text, stretch, of_file, settings.buckets)
            if len(places) <= settings.longest:
                tags = np.zeros(len(places), np.int64)
                for start, end in secrets:
                    inside = [k for k, (a, b) in enumerate(places) if a < end and start < b]
                    if inside and admitted[inside[0], 0]:
                        tags[inside] = IN
                        tags[inside[0]] = BEGIN
                # a tag that a token may not have: the span crosses a gap, nothing to learn from
                if not (admitted[tags == IN, 1].all() and admitted[tags == BEGIN, 0].all()):
                    continue
                rows.append((ids, admitted, tags))
    w, moves = np.zeros((settings.buckets, 3)), np.zeros((3, 3))
    fixed = np.zeros((3, 3))
    fixed[OUT, IN] = _FORBIDDEN
    if not rows:
        w[:, OUT] = 1.0
        return Model(w, moves + fixed, settings)
    rows.sort(key=lambda r: len(r[0]))
    groups = []
    for part in (rows[k : k + 256] for k in range(0, len(rows), 256)):
        sizes = np.array([len(r[0]) for r in part])
        ids = np.zeros((len(part), sizes.max(), part[0][0].shape[1]), np.int32)
        admitted, tags = np.zeros((*ids.shape[:2], 2), bool), np.zeros(ids.shape[:2], np.int64)
        for k, (i, a, y) in enumerate(part):
            ids[k, : len(i)], admitted[k, : len(i)], tags[k, : len(i)] = i, a, y
        groups.append((ids, admitted, tags, sizes))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, moves)]
    for step in range(1, settings.rounds + 1):
        grads = [np.zeros_like(w), np.zeros_like(moves)]
        for g in groups:
            for total, part in zip(grads, _likelihood(w, moves + fixed, *g), strict=True):
                total += part
        for x, grad, (mean, square) in zip((w, moves), grads, state, strict=True):
            grad = grad / len(rows) - settings.ridge / len(rows) * x
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            x += settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(w, moves + fixed, settings)


#: Words and looks of made-up windows.
_KEYS = "password passwd pwd secret token api_key apikey auth credential access_key private_key client_secret bearer authorization login signing_key session".split()
_PREFIXES = ("", "", "", "", "sk_live_", "ghp_", "xoxb-", "pk-", "key-", "SG.", "eyJ")
_FILLER = "the of and to in is was for on that with as by at from note see value line item page".split()
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.hexdigits.lower())


def _pick(r: np.random.Generator, of) -> str:
    return of[int(r.integers(len(of)))]


def made_secret(r: np.random.Generator) -> str:
    """A random string of letters and digits in one of several looks, that a pattern need not know."""
    while True:
        body = "".join(_pick(r, _ALPHABETS[0] if k == 0 else a) for a in [_pick(r, _ALPHABETS)] for k in range(int(r.integers(12, 44))))
        if any(c.isdigit() for c in body) and any(c.isalpha() for c in body):
            return _pick(r, _PREFIXES) + body


def _harmless(r: np.random.Generator) -> str:
    """Something with digits or capitals that is no secret."""
    n = lambda lo, hi: int(r.integers(lo, hi))
    word = lambda: "".join(_pick(r, "aeioubcdfglmnprst") for _ in range(n(3, 9)))
    return (
        f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}", f"+{n(1, 99)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}", f"{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}", f"{n(1990, 2040)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}:{n(10, 60)}:00Z",
        f"{word()}.{n(1, 99)}@{word()}.example.com", f"https://www.{word()}.com/{word()}/{n(1, 9999)}", f"{word()}{word().title()}{word().title()}()", f"{n(1, 99)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", f"{word()}_{word()}_{n(1, 99)}.txt",
        f"version-{n(1, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(10**7, 10**12)}", f"{n(0, 2**31):08x}-{n(0, 65536):04x}-4{n(0, 4096):03x}-a{n(0, 4096):03x}-{n(0, 2**47):012x}", f"{word()}-{word()}-{n(1900, 2030)}", f"[{n(1, 99)}]({word()}{n(1, 9)})", f"{word().title()}{n(100, 99999)}",
    )[n(0, 15)]


def made_windows(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """n windows with a secret and n without, in sentences and in settings."""
    r, out = np.random.default_rng(seed), []
    for k in range(2 * n):
        lead, tail = (" ".join(_pick(r, _FILLER) for _ in range(int(r.integers(0, 6)))) for _ in range(2))
        quote = _pick(r, ("", "", '"', "'"))
        if k < n:
            key, between = _pick(r, _KEYS), _pick(r, (" = ", "=", ": ", ":", " "))
            key = _pick(r, (key, key.upper(), key.title()))
            head, s = f"{lead}{_pick(r, (' ', chr(10)))}{key}{between}{quote}", made_secret(r)
            out.append((f"{head}{s}{quote} {tail}", [(len(head), len(head) + len(s))]))
        else:
            key = _pick(r, _KEYS if r.integers(4) == 0 else _FILLER) + _pick(r, (" = ", "=", ": ", " ", " ", " "))
            out.append((f"{lead} {key}{quote}{_harmless(r)}{quote} {tail}", []))
    return [(t, s, file_features(t * int(r.integers(1, 20)), int(r.integers(0, 3)))) for t, s in out]


def _other_secrets(windows: list, seed: int = 11) -> list:
    """The windows with their secrets replaced by made-up ones, and half of the keys by other words."""
    r, out = np.random.default_rng(seed), []
    for text, secrets, of_file in windows:
        if len(secrets) == 1:
            (a, b), new = secrets[0], made_secret(r)
            head = text[:a]
            if r.integers(2):
                head = re.sub(r"(?i)(password|passwd|secret|token|api_?key)(?=\W*$)", lambda m: _pick(r, _KEYS), head)
            out.append((head + new + text[b:], [(len(head), len(head) + len(new))], of_file))
    return out


_SAMPLE = "positive boolean, body string, starts array<int>, ends array<int>, of_file array<string>"


def fit(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Model:
    """The field learned from windows around admitted chunks: the patterns' matches mark secrets, chunks without a
    key word near them are none.

    At most `Settings.positives` and `Settings.negatives` distinct windows are taken, those of least hash,
    wherever in the corpus they are; copies count once. Made-up windows and windows with other secrets put in
    teach what the patterns don't know. Ids, languages and sources are not read. Nulls and empty texts give no
    window; without any the made-up ones alone are learned from."""

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"positive": [], "body": [], "starts": [], "ends": [], "of_file": []}
        for text in texts_of(batch, text_col):
            found = stretches(text)
            of_file = file_features(text, sum(map(len, found))) if found else []
            for stretch in found:
                start, end = stretch[0][0], stretch[-1][1]
                if end - start > 8 * settings.longest:
                    continue
                a = max(0, start - _BEFORE)
                part = text[a : end + _AFTER]
                secrets = [(x, y) for x, y in _secret_parts(part) if x < end - a and start - a < y]
                # digits alone are secrets to the patterns, and what stands near a key word may be one: neither is learned as harmless
                if not secrets and (base_spans(part) or _CUE.search(part.lower())):
                    continue
                for column, value in zip(out.values(), (bool(secrets), part, [x for x, _ in secrets], [y for _, y in secrets], of_file), strict=True):
                    column.append(value)
        yield out

    windows = stored(over_batches(docs.select(text_col), f, _SAMPLE).dropDuplicates(["body"]), "windows")
    order = [F.xxhash64("body"), F.col("body")]
    found = []
    for positive, most in ((True, settings.positives), (False, settings.negatives)):
        for row in windows.filter(F.col("positive") == positive).orderBy(*order).limit(most).collect():
            found.append((row.body, list(zip(row.starts, row.ends, strict=True)), list(row.of_file)))
    released(windows)
    return train(found + _other_secrets(found) + made_windows(settings.made), settings)


SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint>>, masked string"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with `<kind>` in place of spans; overlapping ones go together, under the first one's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, its secrets as spans of code points, and its text with them masked.

    Spans are of the patterns (kinds assign, access, hex; each kind's leftmost non-overlapping matches) and of
    the field (crf, where it touches none of the patterns' spans), by start, then kind in that order. Null
    and empty texts have no spans and an empty text. Repeated rows and null ids give a row each; ties of paths
    go to the lower state; other columns are not read, whatever their names; an empty table gives an empty
    one. No shuffle: a text is scanned alone and whole, and a task holds one Arrow batch and the model."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = texts_of(batch, text_col)
        spans = [sent.value.all_spans(t) for t in texts]
        yield {id_col: batch.column(id_col), "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], "masked": [masked(t, s) for t, s in zip(texts, spans, strict=True)]}

    return over_batches(docs.select(id_col, text_col), f, f"{id_col} {id_type}, {SCHEMA}")
