"""Toxicity: a linear classifier whose score may not hinge on which group a text mentions.

Features are the words of a text and their first bytes (so that inflected forms of one stem share
evidence), as 64-bit hashes, each seen at least once, twice or three times. Those whose document frequencies differ most between the labels are
kept. Weights minimise logistic loss plus a penalty on the squared change of the log odds under
counterfactuals: the identity terms of a labelled text are swapped for others of their kind; a text
without any gets a neutral mention of a group, which may change nothing, and then another group's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, stored, texts_of
from .words import NOT_ALNUM, Words, hash_of

# Identity terms in English, German, French and Spanish, in groups whose members may stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"), ("elderly", "young"),
    ("frauen", "männer"), ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"), ("schwarze", "weiße", "asiaten"), ("einwanderer", "einheimische", "flüchtlinge"), ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques"), ("immigrés", "autochtones", "réfugiés"), ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "nativos", "refugiados"), ("discapacitados", "sordos", "ciegos"),
)
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled texts whose forms are hashed at once.
_SLICE = 64
#: Marks of a feature seen once, twice and three times or more in a text.
_LEVELS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


@dataclass(frozen=True)
class Settings:
    #: Labelled rows to learn from at most, those with the least hash of their id. This bound on
    #: the fit is the only one: every document is scored.
    max_rows: int = 20_000
    features: int = 4096
    min_docs: int = 4
    ridge: float = 2e-4
    #: weight of the squared change of log odds under a swap
    counterfactual: float = 1.0
    steps: int = 400
    rate: float = 0.1
    threshold: float = 0.7


_NEXT = {w: group[(i + 1) % len(group)] for group in reversed(IDENTITY_GROUPS) for i, w in enumerate(group)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.I)


def swapped(text: str) -> str:
    """The text with each identity term replaced by the next of its group."""
    return _TERMS.sub(lambda m: _NEXT[m[0].lower()], text)


def mentioning(text: str) -> str:
    """The text with a neutral mention of one identity term, which the text's own bytes choose, behind it."""
    terms = sorted(_NEXT)
    return f"{text} {terms[zlib.crc32(text.encode('utf-8', 'surrogatepass')) % len(terms)]}"


def counterfactuals(text: str) -> list[str]:
    """The text and forms of it that ought to have its score: swapped, or, of a text without identity terms,
    with a neutral mention, and with that mention swapped."""
    if _TERMS.search(text):
        return [text, swapped(text)]
    one = mentioning(text)
    return [text, one, swapped(one)]


def _with_levels(rows: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), and the same features marked as seen twice and three times or more."""
    order = np.lexsort((feature, rows))
    r, f = rows[order], feature[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(r)))
    r, f = r[at], f[at]
    deep = [n >= k for k in range(1, len(_LEVELS) + 1)]
    return np.concatenate([r[d] for d in deep]), np.concatenate([f[d] ^ x for d, x in zip(deep, _LEVELS, strict=True)])


def _pairs(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of some texts. keep: sorted features, which then go by their place."""
    w = Words(texts, ends=NOT_ALNUM, prefixes=PREFIXES)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(w.offsets))
    rows, found = [], []
    maybe = np.ones(1 << 16, bool)
    if keep is not None:  # only what may be kept is sorted
        maybe[:] = False
        for x in _LEVELS:
            maybe[((keep ^ x) & np.uint64(0xFFFF)).astype(np.int64)] = True
    for h in (w.hashes, *w.prefixes):
        at = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)] & (h != 0))
        rows.append(row[at])
        found.append(h[at])
    r, f = _with_levels(np.concatenate(rows), np.concatenate(found))
    if keep is None:
        return r, f
    place = np.minimum(np.searchsorted(keep, f), max(0, len(keep) - 1))
    hit = keep[place] == f if len(keep) else np.zeros(0, bool)
    r, f = r[hit], place[hit]
    order = np.lexsort((f, r))
    return r[order], f[order]


def _counts(batch: pa.RecordBatch) -> Iterator[dict]:
    y = np.asarray(batch.column("toxic").to_pylist(), bool)
    r, f = _pairs(texts_of(batch))
    feature, group = np.unique(f, return_inverse=True)
    pos = np.bincount(group, y[r], len(feature)).astype(np.int64)
    yield {"feature": feature.view(np.int64), "pos": pos, "neg": np.bincount(group, minlength=len(feature)) - pos}


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        r, f = _pairs(texts, self.features)
        z = self.bias + np.bincount(r, self.weights[f.astype(np.int64)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_weights(pairs, changes, y: np.ndarray, n_features: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias. pairs: (row, feature) of the texts; changes: (counterfactual, feature, sign) of
    the features that only one of its two texts has."""
    n, w, b = len(y), np.zeros(n_features), 0.0
    (r, f), (dr, df, sign) = pairs, changes
    n_changes = int(dr.max()) + 1 if len(dr) else 1
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, s.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[f], n), -50, 50)))
        change = np.bincount(dr, sign * w[df], n_changes)
        g = np.bincount(f, (p - y)[r], n_features) / n + s.ridge * w + 2 * s.counterfactual / n * np.bincount(df, sign * change[dr], n_features)
        gb = float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - s.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= s.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows of `labels` (doc_id, toxic) that are found in `docs` (doc_id, text).

    Rows with a null doc_id or label are skipped; a document labelled twice is toxic if one label
    says so, and of several texts of one id the first in order is taken. At most settings.max_rows
    ids are used: they are broadcast, so `docs` is filtered without a shuffle, and what reaches the
    driver is bounded by max_rows and features. Ids may be of any type that both tables have.
    Without labels or with one class only, every score is the share of toxic labels."""
    sample = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    ids = stored(sample, "toxicity-ids")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    train = stored(found.repartition(16), "toxicity-train")
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < pos < n:
        share = min(max((pos + 0.5) / (n + 1), 0.01), 0.99) if n else 0.01
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))), settings.threshold)
    a, b = F.col("pos"), F.col("neg")
    odds = F.log((a + 0.5) / (pos + 1.0)) - F.log((b + 0.5) / (n - pos + 1.0))
    best = (
        over_batches(train, _counts, "feature long, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") + F.col("neg") >= settings.min_docs)
        .orderBy(F.desc(F.abs(odds) * F.sqrt(a + b)), "feature")
        .limit(settings.features)
        .collect()
    )
    terms = [hash_of(t) for t in _NEXT]
    keep = np.unique(np.array([r.feature for r in best] + [t - (1 << 64) if t >> 63 else t for t in terms], np.int64).view(np.uint64))

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        own, up, down = [], [], []
        for at in range(0, batch.num_rows, _SLICE):
            forms = [counterfactuals(t) for t in texts_of(batch.slice(at, _SLICE))]
            every = [x for some in forms for x in some]
            r, f = _pairs(every, keep)
            features = iter(np.split(f.astype(np.int32), np.searchsorted(r, np.arange(1, len(every)))))
            for some in forms:
                of = [next(features) for _ in some]
                own.append(of[0])
                up.append([np.setdiff1d(x, z) for x, z in zip(of, of[1:], strict=False)])
                down.append([np.setdiff1d(z, x) for x, z in zip(of, of[1:], strict=False)])
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "f": own, "up": up, "down": down}

    id_type = train.schema["doc_id"].dataType.simpleString()
    rows = over_batches(train, rows_of, f"doc_id {id_type}, toxic int, f array<int>, up array<array<int>>, down array<array<int>>").orderBy("doc_id").drop("doc_id").toArrow()
    y, lists = rows.column("toxic").to_numpy().astype(float), {c: rows.column(c).combine_chunks() for c in ("f", "up", "down")}
    flat = lambda x: (np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), x.flatten())
    row, feature = flat(lists["f"])
    # a counterfactual's number is its place among all of them
    (one, plus), (other, minus) = (flat(lists[c].flatten()) for c in ("up", "down"))
    plus, minus = plus.to_numpy(), minus.to_numpy()
    sign = np.concatenate((np.ones(len(plus)), -np.ones(len(minus))))
    w, bias = fit_weights((row, feature.to_numpy().astype(np.int64)), (np.concatenate((one, other)), np.concatenate((plus, minus)).astype(np.int64), sign), y, len(keep), settings)
    return Model(keep, w, float(bias), settings.threshold)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row of `docs`, from its whole text and nothing else.

    Null and empty texts get the score of a text without features. A row is judged alone: no
    shuffle, repeated rows and null ids give a row each."""

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        s = model.scores(texts_of(batch, text_col))
        yield {id_col: batch.column(id_col), "score": s, "predicted": (s >= model.threshold).astype(np.int32)}

    return over_batches(docs.select(id_col, text_col), f, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model doesn't call toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(texts_of(batch, text_col)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
