"""Katz backoff language model of order two, learnt and evaluated as shuffles of packed arrays.

P(w | h) = d(r) r / (c(h) + 1/2)          for a pair seen r > 0 times behind h,
         = a(h) P1(w)                     else, with a(h) = left(h) / (1 - sum of P1 over words seen behind h).

d are Good-Turing discounts of counts up to five; left(h) is what the seen pairs leave of one. Half a
count is held back in each context, so that something is left even where every pair is frequent. P1
is the unigram level of the same recursion: discounted counts over N + 1/2 for every word of the
training text; what they leave is the place of the words never seen. Sums over the words seen behind a context and one unknown word are exactly one.

Tokens travel as 64-bit hashes. Scoring needs, for every token of every text, its pair's count, its
context's total and its word's count, and these meet in buckets by context; contexts so frequent
that a bucket would stand out are dealt by the pair, and their totals summed up. A chunk of documents
sends a bucket each distinct pair once, with the places of the documents that have it. The counts of
the most frequent words are broadcast; a bucket of pairs is told the others' counts by the words' own
buckets, which a first pass over the texts asks for each word and bucket of pairs once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import parts, stored, texts_of
from .words import hash_of, mix, word_hashes

END, BEGIN = np.uint64(hash_of("\x00end\x01")), np.uint64(hash_of("\x00begin\x01"))
DISCOUNTED = 5
#: Words whose counts are broadcast, at most; the others' counts are joined, with equal results.
HEAD = 1_000_000
#: Contexts that are dealt by the pair, at most.
HOT = 16_384
BUCKETS = 8  # for each shuffle partition
_CHUNK_TOKENS, _CHUNK_DOCS = 2_000_000, 60_000
_PAIRS, _TAIL, _COUNTS, _DOCS, _SUMS, _BASE, _UNSEEN, _UNSEEN_HOT, _HOT_SUMS, _RARE, _ASK, _KNOWN = range(12)
_ROW = "bucket int, kind int, chunk long, n int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, ids array<long>"
_COLUMNS = [x.split()[0] for x in _ROW.split(", ")]


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0 ... DISCOUNTED from n[r], the number of events seen r times (n[0] is not read).

    Good-Turing: d = (r*/r - s) / (1 - s) with r* = (r + 1) n[r+1] / n[r] and s = (k + 1) n[k+1] / n[1].
    A count for which that is no number within (0, 1], as in small texts, gets (r - 1/2) / r."""
    d, k = np.ones(DISCOUNTED + 1), DISCOUNTED
    for r in range(1, k + 1):
        d[r] = (r - 0.5) / r
        if n[1] > 0 and n[r] > 0:
            s = (k + 1) * n[k + 1] / n[1]
            x = ((r + 1) * n[r + 1] / (n[r] * r) - s) / (1 - s) if s < 1 else 0
            if 0 < x <= 1:
                d[r] = x
    return d


@dataclass(frozen=True)
class Unigrams:
    words: np.ndarray  # sorted hashes of the head
    counts: np.ndarray
    log_p: np.ndarray  # log10 P1 of the head
    log_rest: float  # of a word that has no probability of its own
    discount: np.ndarray
    total: int
    distinct: int
    documents: int
    hot: np.ndarray  # sorted
    hot_totals: np.ndarray

    def place(self, w: np.ndarray) -> np.ndarray:
        """Place in the head, -1 outside."""
        if not len(self.words):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)

    def log_own(self, c: np.ndarray) -> np.ndarray:
        """log10 P1 of words seen c > 0 times."""
        return np.log10(np.where(c <= DISCOUNTED, self.discount[np.minimum(c, DISCOUNTED)], 1.0) * c / (self.total + 0.5))

    def hot_place(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)


def _count_words(docs: DataFrame, train: Column) -> DataFrame:
    """(word, n): counts of the tokens of training texts, their ends included."""
    schema = "word long, n long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []

        def merged():
            u, inv = np.unique(np.concatenate([words, *held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)]), len(u)).astype(np.int64)

        for batch in batches:
            texts = texts_of(batch)
            held += [word_hashes(texts)[0], np.full(len(texts), END)]
            if sum(map(len, held)) > 2_000_000:
                words, counts = merged()
                held.clear()
                if len(words) > 2_000_000:
                    yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": counts}, schema=arrow)
                    words, counts = words[:0], counts[:0]
        words, counts = merged()
        yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": counts}, schema=arrow)

    return stored(docs.filter(train).select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


def _unigrams(counted: DataFrame, buckets: int, head: int | None, cached: int) -> tuple[Unigrams, int]:
    """The unigram level, and the least count in its head, which is of `cached` words at most, or of
    `head` if only so many words have probabilities of their own."""
    hist = counted.groupBy(F.least("n", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).toPandas().sort_values("c", ascending=False)
    total, distinct = int(hist["tokens"].sum()), int(hist["words"].sum())
    n = np.zeros(DISCOUNTED + 2)
    for c, words in zip(hist["c"], hist["words"], strict=True):
        if c <= DISCOUNTED + 1:
            n[int(c)] = words
    fits = hist[hist["words"].cumsum() <= (cached if head is None else head)]["c"]
    least = int(fits.min()) if len(fits) else (1 << 62)
    top = counted.filter(F.col("n") >= least).toArrow()
    words, counts = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(words)
    words, counts = words[by], counts[by]
    d = discounts(n)
    p = np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0) * counts / (total + 0.5)
    if head is None:
        by_count = hist["c"].to_numpy()
        rest = 1 - (np.where(by_count <= DISCOUNTED, d[np.minimum(by_count, DISCOUNTED)], 1.0) * hist["tokens"].to_numpy()).sum() / (total + 0.5)
    else:
        rest = (1 - p.sum()) / (distinct - len(words) + 1)
    ends = counts[words == END]
    documents = int(ends[0]) if len(ends) else 0
    if not len(ends) and total:
        documents = int(counted.filter(F.col("word") == int(END.astype(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    often = np.flatnonzero(counts * 4 * buckets > total)
    often = often[np.argsort(-counts[often], kind="stable")][:HOT]
    hot, totals = np.append(words[often], BEGIN), np.append(counts[often], documents)
    by = np.argsort(hot)
    return Unigrams(words, counts, np.log10(p) if len(p) else p, float(np.log10(max(rest, 1e-300))), d, total, distinct, documents, hot[by], totals[by]), least


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _row(**values) -> dict:
    return {c: values.get(c) for c in _COLUMNS}


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sizes, last places) of texts, one behind the other, each with its end."""
    h, at = word_hashes(texts)
    size = np.diff(at) + 1
    ends = np.cumsum(size) - 1
    w = np.empty(len(h) + len(texts), np.uint64)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = h, END
    return w, size, ends


def _ask(docs: DataFrame, model, buckets: int) -> DataFrame:
    """Rows for the words' buckets: the words outside the head, and the buckets of the pairs they end."""
    arrow = to_arrow_schema(StructType.fromDDL(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Unigrams = model.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            w, to = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            b = (mix(w) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            w, to = w[by], to[by]
            cut = np.searchsorted(b[by], np.arange(buckets + 1))
            rows = [_row(bucket=i, kind=_ASK, chunk=0, a=_bytes(w[x:y], np.uint64), b=_bytes(to[x:y], np.uint32)) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k : k + 256], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            w, sizes, ends = _tokens(texts_of(batch))
            context = np.roll(w, 1)
            context[ends - sizes + 1] = BEGIN
            tail = m.place(w) < 0
            w, context = w[tail], context[tail]
            held.append((w, np.where(m.hot_place(context) >= 0, mix(context ^ mix(w)), mix(context)) % np.uint64(buckets)))
            size += len(w)
            if size > 2_000_000:
                yield from packed()
                held, size = [], 0
        if size:
            yield from packed()

    return docs.select("text").mapInArrow(run, _ROW)


def _distinct(w: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((to, w))
    w, to = w[by], to[by]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (to[1:] != to[:-1])
    return w[new], to[new]


def _tell(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows for the buckets of pairs: the counts of the words asked for, where the training text has them."""
    arrow = to_arrow_schema(StructType.fromDDL(_ROW))

    def found(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        asks, counts = ([r for r in rows if r["kind"] == kind] for kind in (_ASK, _COUNTS))
        if not asks or not counts:
            return None
        w, to = _distinct(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in asks]), np.concatenate([np.frombuffer(r["b"], np.uint32) for r in asks]))
        own, n = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in counts]), np.concatenate([np.frombuffer(r["f"], np.int64) for r in counts])
        by = np.argsort(own)
        own, n = own[by], n[by]
        at = np.minimum(np.searchsorted(own, w), len(own) - 1)
        has = own[at] == w
        return w[has], n[at][has], to[has]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows: list[dict] = []

        def packed() -> Iterator[pa.RecordBatch]:
            w, n, to = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(to, kind="stable")
            w, n = w[by], n[by]
            cut = np.searchsorted(to[by], np.arange(buckets + 1))
            out = [_row(bucket=i, kind=_KNOWN, chunk=0, a=_bytes(w[x:y], np.uint64), f=_bytes(n[x:y], np.int64)) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[k : k + 256], schema=arrow)

        def take() -> None:
            if (x := found(rows)) is not None:
                held.append(x)

        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["bucket"] != r["bucket"]:
                    take()
                    rows = []
                    if sum(len(x[0]) for x in held) > 4_000_000:
                        yield from packed()
                        held = []
                rows.append(r)
        take()
        if held:
            yield from packed()

    return asked.repartition(parts(asked.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROW)


def _order(bits: int, buckets: int, bucket: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places in order of bucket, context and word: by one number where three of `bits` fit into 63, which a
    text of very many different words may exceed, else by all three."""
    if 2 * bits + buckets.bit_length() <= 63:
        return np.argsort(bucket << 2 * bits | context << bits | word, kind="stable")
    return np.lexsort((word, context, bucket))


def _send(docs: DataFrame, held_out: Column, model, buckets: int) -> DataFrame:
    """Rows for the buckets: distinct pairs and rare words of a chunk, with the documents that have them."""
    arrow = to_arrow_schema(StructType.fromDDL(_ROW))

    def code(m: Unigrams, w: np.ndarray) -> tuple[bytes, bytes]:
        at = m.place(w)
        return _bytes(np.where(at < 0, 0xFFFFFFFF, at), np.uint32), _bytes(w[at < 0], np.uint64)

    def chunk_rows(chunk: int, ids: list, texts: list[str], held: np.ndarray) -> Iterator[pa.RecordBatch]:
        m: Unigrams = model.value
        order = np.argsort(held, kind="stable")  # training documents come first
        ids, texts, held = [ids[i] for i in order], [texts[i] for i in order], held[order]
        w, size, ends = _tokens(texts)
        doc = np.repeat(np.arange(len(texts)), size)
        u, inv = np.unique(w, return_inverse=True)
        place = m.place(u)
        known = place >= 0
        c = np.where(known, m.counts[place] if len(m.counts) else 0, 0)
        log_base = np.where(known, np.log10((c + 0.1) / (m.total + 0.1 * (m.distinct + 1))), 0.0)
        yield pa.RecordBatch.from_pylist(
            [_row(bucket=int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), kind=_DOCS, chunk=chunk, n=len(texts), ids=ids, a=_bytes(size, np.int64),
                  b=_bytes(np.bincount(doc, log_base[inv], len(texts)), np.float64), c=_bytes(np.bincount(doc, known[inv], len(texts)), np.int64), d=_bytes(held, np.uint8))],
            schema=arrow,
        )
        n_train = int((~held).sum())
        # pairs
        at_context = np.roll(inv, 1)
        begin = len(u)
        bits = (begin + 1).bit_length()
        at_context[ends - size + 1] = begin
        v = np.append(u, BEGIN)
        hot = m.hot_place(v) >= 0
        bucket_of = (mix(v) % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(hot[at_context], (mix(v[at_context] ^ mix(w)) % np.uint64(buckets)).astype(np.int64), bucket_of[at_context])
        by = _order(bits, buckets, bucket, at_context, inv)
        where = doc[by]
        in_bucket, in_context, in_word = bucket[by], at_context[by], inv[by]
        new = np.flatnonzero(np.concatenate(([True], (in_bucket[1:] != in_bucket[:-1]) | (in_context[1:] != in_context[:-1]) | (in_word[1:] != in_word[:-1]))))
        pair_context, pair_word, count = in_context[new], in_word[new], np.diff(np.append(new, len(by)))
        cut = np.searchsorted(in_bucket[new], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            x, y = cut[b], cut[b + 1]
            if x == y:
                continue
            ctx, word = pair_context[x:y], pair_word[x:y]
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
            (a, bb), (d, e) = code(m, v[ctx[first]]), code(m, v[word])
            stop = new[y] if y < len(new) else len(by)
            rows.append(_row(bucket=b, kind=_PAIRS, chunk=chunk, n=n_train, a=a, b=bb, c=_bytes(np.diff(np.append(first, y - x)), np.uint32), d=d, e=e, f=_bytes(count[x:y], np.uint32), g=_bytes(where[new[x] : stop], np.uint16)))
            if len(rows) >= 128:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        # rare words
        rare = np.flatnonzero(~known[inv])
        low = (1 << bits) - 1
        key = bucket_of[inv[rare]] << bits | inv[rare]
        by = np.argsort(key, kind="stable")
        key, where = key[by], doc[rare][by]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        cut = np.searchsorted(key[new] >> bits, np.arange(buckets + 1))
        for b in range(buckets):
            x, y = cut[b], cut[b + 1]
            if x < y:
                stop = new[y] if y < len(new) else len(key)
                rows.append(_row(bucket=b, kind=_TAIL, chunk=chunk, a=_bytes(u[key[new[x:y]] & low], np.uint64), f=_bytes(count[x:y], np.uint32), g=_bytes(where[new[x] : stop], np.uint16)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk's number depends on its place alone, so a repeated task names it the same
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        texts: list[str] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            i, t, x = batch.column("doc_id").to_pylist(), texts_of(batch), np.asarray(batch.column("held").to_pylist(), bool)
            at = 0
            for j, text in enumerate(t):
                size += len(text) // 5 + 1
                if size > _CHUNK_TOKENS or len(texts) + j - at >= _CHUNK_DOCS:
                    ids += i[at : j + 1]
                    texts += t[at : j + 1]
                    held.append(x[at : j + 1])
                    yield from chunk_rows(number, ids, texts, np.concatenate(held))
                    number, ids, texts, held, size, at = number + 1, [], [], [], 0, j + 1
            ids += i[at:]
            texts += t[at:]
            held.append(x[at:])
        if texts:
            yield from chunk_rows(number, ids, texts, np.concatenate(held))

    return docs.select("doc_id", "text", held_out.alias("held")).mapInArrow(run, _ROW)


def _counts_by_bucket(counted: DataFrame, least: int, buckets: int) -> DataFrame:
    """The counts of words outside the head, packed for their buckets."""
    arrow = to_arrow_schema(StructType.fromDDL(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held) -> Iterator[pa.RecordBatch]:
            w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (mix(w) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            w, n, b = w[by], n[by], b[by]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            rows = [_row(bucket=i, kind=_COUNTS, chunk=0, a=_bytes(w[x:y], np.uint64), f=_bytes(n[x:y], np.int64)) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k : k + 256], schema=arrow)

        held: list = []
        size = 0
        for batch in batches:
            held.append((batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size > 1_000_000:
                yield from packed(held)
                held, size = [], 0
        if held and size:
            yield from packed(held)

    return counted.filter(F.col("n") < least).mapInArrow(run, _ROW)


class _Sums:
    """Sums by chunk and document, given out when they have grown."""

    def __init__(self, kind: int, width: int):
        self.kind, self.width, self.held, self.size = kind, width, {}, 0

    def add(self, chunk: int, docs: np.ndarray, columns: list[np.ndarray]) -> None:
        self.held.setdefault(chunk, []).append((docs, columns))
        self.size += len(docs)

    def rows(self) -> list[dict]:
        out = []
        for chunk, some in self.held.items():
            docs = np.concatenate([x for x, _ in some])
            u, inv = np.unique(docs, return_inverse=True)
            sums = [np.bincount(inv, np.concatenate([c[k] for _, c in some]), len(u)) for k in range(self.width)]
            out.append(_row(bucket=0, kind=self.kind, chunk=chunk, a=_bytes(u, np.uint16), b=_bytes(sums[0], np.float64), c=_bytes(np.stack(sums[1:]), np.uint32) if self.width > 1 else None))
        self.held, self.size = {}, 0
        return out


def _meet(sent: DataFrame, model) -> DataFrame:
    """What each bucket can tell: sums by document, counts of counts, sums of frequent contexts, and
    the unseen pairs with what their contexts' weights need."""
    arrow = to_arrow_schema(StructType.fromDDL(_ROW))

    def bucket_rows(m: Unigrams, rows: list[dict], sums: _Sums, base: _Sums, hot_sums: np.ndarray, rare: np.ndarray) -> Iterator[dict]:
        pairs = [r for r in rows if r["kind"] == _PAIRS]
        yield from (r for r in rows if r["kind"] == _DOCS)
        tails = [r for r in rows if r["kind"] == _TAIL]
        if tails:
            counts = [r for r in rows if r["kind"] == _COUNTS]
            w = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in counts] or [np.empty(0, np.uint64)])
            n = np.concatenate([np.frombuffer(r["f"], np.int64) for r in counts] or [np.empty(0, np.int64)])
            by = np.argsort(w)
            w, n = w[by], n[by]
            for r in tails:
                own, docs = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["g"], np.uint16)
                at = np.minimum(np.searchsorted(w, own), max(0, len(w) - 1))
                c = np.where(w[at] == own, n[at], 0) if len(w) else np.zeros(len(own), np.int64)
                c = np.repeat(c, np.frombuffer(r["f"], np.uint32))
                base.add(r["chunk"], docs, [np.log10((c + 0.1) / (m.total + 0.1 * (m.distinct + 1))), c > 0])
        if not pairs:
            return

        def decode(ids: bytes, tails: bytes) -> np.ndarray:
            at = np.frombuffer(ids, np.uint32)
            out = m.words[np.minimum(at, max(0, len(m.words) - 1))].copy() if len(m.words) else np.zeros(len(at), np.uint64)
            out[at == 0xFFFFFFFF] = np.frombuffer(tails, np.uint64)
            return out

        context = np.concatenate([np.repeat(decode(r["a"], r["b"]), np.frombuffer(r["c"], np.uint32)) for r in pairs])
        word = np.concatenate([decode(r["d"], r["e"]) for r in pairs])
        count = [np.frombuffer(r["f"], np.uint32) for r in pairs]
        docs = np.concatenate([np.frombuffer(r["g"], np.uint16) for r in pairs])
        of_row = np.repeat(np.arange(len(pairs)), [len(c) for c in count])
        entry = np.repeat(np.arange(len(word)), np.concatenate(count))
        row = of_row[entry]
        trains = docs < np.array([r["n"] for r in pairs])[row]
        _, first, inv = np.unique(mix(context) + word, return_index=True, return_inverse=True)
        r = np.bincount(inv[entry], trains, len(first)).astype(np.int64)  # by distinct pair
        ctx, w = context[first], word[first]
        at = m.place(w)
        log_p1 = np.where(at >= 0, m.log_p[at] if len(m.log_p) else 0.0, m.log_rest)
        told = [x for x in rows if x["kind"] == _KNOWN]
        if told:
            own, n = np.concatenate([np.frombuffer(x["a"], np.uint64) for x in told]), np.concatenate([np.frombuffer(x["f"], np.int64) for x in told])
            by = np.argsort(own)
            own, n = own[by], n[by]
            tail = np.flatnonzero(at < 0)
            place = np.minimum(np.searchsorted(own, w[tail]), len(own) - 1)
            has = own[place] == w[tail]
            log_p1[tail[has]] = m.log_own(n[place[has]])
        seen = r > 0
        rare += np.bincount(r[seen & (r <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)
        u, group = np.unique(ctx, return_inverse=True)
        hot = m.hot_place(u)
        stats = np.empty((len(u), DISCOUNTED + 2))
        stats[:, 0] = np.where(hot >= 0, m.hot_totals[hot], np.bincount(group, r, len(u)))
        for k in range(1, DISCOUNTED + 1):
            stats[:, k] = np.bincount(group, r == k, len(u))
        stats[:, DISCOUNTED + 1] = np.bincount(group, np.where(seen, 10.0**log_p1, 0.0), len(u))
        is_hot = hot >= 0
        hot_sums[hot[is_hot]] += stats[is_hot, 1:]

        pair = inv[entry]
        rr, cc = r[pair], group[pair]
        value = np.where(rr > 0, np.where(rr > DISCOUNTED, np.log10(np.maximum(rr, 1)), 0.0) - np.log10(stats[cc, 0] + 0.5), log_p1[pair])
        bounds = np.searchsorted(row, np.arange(len(pairs) + 1))
        for i, x in enumerate(pairs):
            z = slice(bounds[i], bounds[i + 1])
            sums.add(x["chunk"], docs[z], [value[z], *(rr[z] == k for k in range(1, DISCOUNTED + 1))])
        chunks = [x["chunk"] for x in pairs]
        un = np.flatnonzero((rr == 0) & (stats[cc, 0] > 0))
        for kind, some in ((_UNSEEN, un[~is_hot[cc[un]]]), (_UNSEEN_HOT, un[is_hot[cc[un]]])):
            if len(some):
                used, ref = np.unique(cc[some], return_inverse=True)
                body = _bytes(stats[used], np.float64) if kind == _UNSEEN else _bytes(hot[used], np.uint32)
                yield _row(bucket=0, kind=kind, chunk=0, n=len(some), ids=chunks, a=body, b=_bytes(ref, np.uint32), c=_bytes(row[some], np.uint32), d=_bytes(docs[some], np.uint16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Unigrams = model.value
        sums, base = _Sums(_SUMS, DISCOUNTED + 1), _Sums(_BASE, 2)
        hot_sums, rare = np.zeros((len(m.hot), DISCOUNTED + 1)), np.zeros(DISCOUNTED + 2, np.int64)
        rows: list[dict] = []

        def out(some: list[dict]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(some), 64):
                yield pa.RecordBatch.from_pylist(some[k : k + 64], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["bucket"] != r["bucket"]:
                    yield from out(list(bucket_rows(m, rows, sums, base, hot_sums, rare)))
                    rows = []
                    for x in (sums, base):
                        if x.size > 4_000_000:
                            yield from out(x.rows())
                rows.append(r)
        if rows:
            yield from out(list(bucket_rows(m, rows, sums, base, hot_sums, rare)))
        used = np.flatnonzero(hot_sums.any(axis=1))
        last = [_row(bucket=0, kind=_RARE, chunk=0, a=_bytes(rare, np.int64))]
        if len(used):
            last.append(_row(bucket=0, kind=_HOT_SUMS, chunk=0, ids=used.tolist(), a=_bytes(hot_sums[used], np.float64)))
        yield from out([*sums.rows(), *base.rows(), *last])

    spark = sent.sparkSession
    return stored(sent.repartition(parts(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROW), "katz")


def _log_alpha(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of the backoff weight from (total, contexts' numbers of pairs seen 1 ... k times, sum of P1)."""
    r = np.arange(1, DISCOUNTED + 1)
    left = (0.5 + stats[:, 1:-1] @ ((1 - d[1:]) * r)) / (stats[:, 0] + 0.5)
    return np.log10(left) - np.log10(np.maximum(1 - stats[:, -1], 1e-12))


def _finish(met: DataFrame, totals: np.ndarray, id_type: str) -> DataFrame:
    """Scores from what the buckets told. totals: of the frequent contexts."""
    rare = np.zeros(DISCOUNTED + 2, np.int64)
    arrow = to_arrow_schema(StructType.fromDDL("hot long, v array<double>"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["a"], np.float64).reshape(len(r["ids"]), -1)
                yield pa.RecordBatch.from_pydict({"hot": r["ids"], "v": list(v)}, schema=arrow)

    width = DISCOUNTED + 1
    told = met.filter(F.col("kind") == _RARE).select("a").toArrow().column("a").to_pylist()
    for x in told:
        rare += np.frombuffer(x, np.int64)
    d = discounts(rare.astype(float))
    sums = met.filter(F.col("kind") == _HOT_SUMS).select("ids", "a").mapInArrow(split, "hot long, v array<double>").groupBy("hot").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).toPandas()
    stats = np.zeros((len(totals), DISCOUNTED + 2))
    stats[:, 0] = totals
    if len(sums):
        stats[sums["hot"].to_numpy(), 1:] = sums[[f"v{k}" for k in range(width)]].to_numpy()
    hot_alpha = _log_alpha(stats, d)
    r = np.arange(1, DISCOUNTED + 1)
    log_seen = np.log10(d[1:] * r)
    schema = "chunk long, kind int, a binary, b binary, c binary, d binary, ids array<long>"
    out_arrow = to_arrow_schema(StructType.fromDDL(schema))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums(_SUMS, 1)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["kind"] in (_DOCS, _BASE):
                    out.append({k: x[k] for k in out_arrow.names})
                elif x["kind"] == _SUMS:
                    docs = np.frombuffer(x["a"], np.uint16)
                    hist = np.frombuffer(x["c"], np.uint32).reshape(DISCOUNTED, -1)
                    held.add(x["chunk"], docs, [np.frombuffer(x["b"], np.float64) + log_seen @ hist])
                else:
                    alpha = hot_alpha[np.frombuffer(x["a"], np.uint32)] if x["kind"] == _UNSEEN_HOT else _log_alpha(np.frombuffer(x["a"], np.float64).reshape(-1, DISCOUNTED + 2), d)
                    alpha = alpha[np.frombuffer(x["b"], np.uint32)]
                    chunk, docs = np.frombuffer(x["c"], np.uint32), np.frombuffer(x["d"], np.uint16)
                    by = np.argsort(chunk, kind="stable")
                    for k, part in zip(np.unique(chunk), np.split(by, np.flatnonzero(np.diff(chunk[by])) + 1), strict=True):
                        held.add(x["ids"][k], docs[part], [alpha[part]])
            if held.size > 4_000_000:
                out += [{k: y[k] for k in out_arrow.names} for y in held.rows()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=out_arrow)
        out = [{k: y[k] for k in out_arrow.names} for y in held.rows()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=out_arrow)

    result = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    result_arrow = to_arrow_schema(StructType.fromDDL(result))

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["kind"] == _DOCS)
        n = len(head["ids"])
        score, base, known = np.zeros(n), np.frombuffer(head["b"], np.float64).copy(), np.frombuffer(head["c"], np.int64).copy()
        for r in rows:
            if r["kind"] == _SUMS:
                score[np.frombuffer(r["a"], np.uint16)] += np.frombuffer(r["b"], np.float64)
            elif r["kind"] == _BASE:
                docs = np.frombuffer(r["a"], np.uint16)
                base[docs] += np.frombuffer(r["b"], np.float64)
                known[docs] += np.frombuffer(r["c"], np.uint32)
        values = {"doc_id": head["ids"], "held_out": np.frombuffer(head["d"], np.uint8).astype(bool), "n_tokens": np.frombuffer(head["a"], np.int64), "n_known": known, "base_score": base, "score": score}
        return pa.Table.from_pydict(values, schema=result_arrow)

    kinds = (_DOCS, _SUMS, _BASE, _UNSEEN, _UNSEEN_HOT)
    return met.filter(F.col("kind").isin(*kinds)).drop("bucket", "n", "e", "f", "g").mapInArrow(weigh, schema).groupBy("chunk").applyInArrow(gather, result)


def scores(docs: DataFrame, held_out: Column, head: int | None = None, cached: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text).

    The model is learnt from the rows for which held_out is false, and every row is scored with it:
    score is log10 of the text's probability, its end included; base_score the sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))). Words are lower-cased in A-Z; null and empty texts are their
    end alone. Every training word has a unigram probability of its own; with `head`, only the most
    frequent words, at most so many, and the others share what is left. `cached` is how many counts are
    broadcast, at most, and changes no result. Without a training row every token is unknown. Repeated rows and null ids give a row
    each; other columns are not read."""
    spark = docs.sparkSession
    buckets = BUCKETS * parts(spark)
    counted = _count_words(docs, ~held_out)
    unigrams, least = _unigrams(counted, buckets, head, cached)
    model = spark.sparkContext.broadcast(unigrams)
    counts = _counts_by_bucket(counted, least, buckets)
    sent = _send(docs, held_out, model, buckets).unionByName(counts)
    if head is None and unigrams.distinct > len(unigrams.words):
        sent = sent.unionByName(_tell(_ask(docs, model, buckets).unionByName(counts), buckets))
    met = _meet(sent, model)
    found = _finish(met, unigrams.hot_totals.astype(float), docs.schema["doc_id"].dataType.simpleString())
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")
