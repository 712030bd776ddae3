"""SentencePiece encoding and decoding over a relational lattice.

Text is written as the model writes it (a space is U+2581, one is put in front) and cut into units
that no piece crosses. For the units of a corpus that are frequent, substrings up to the longest
piece are exploded, equi-joined to the piece table, grouped to one lattice a unit, and folded with
Spark's higher-order functions; the result is a table of bounded size that is broadcast. The
remaining units are rare; a task folds their lattices itself, by the same rule, as it meets them.

Two folds: for a unigram model the Viterbi path of the greatest sum of scores; for a BPE model, whose
scores are ranks of merges and whose encoding is no best path, the best-scoring edge that joins two
neighbouring spans is taken until none is left, the leftmost of equals first. Characters without a
piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ARROW_ROWS, over_batches, stored, texts_of

SPACE = "▁"
#: Units whose encoding is broadcast, at most, and their greatest length.
FREQUENT = 250_000
UNIT_CHARS = 48
_MEMORY = 300_000
_CONTROL = "\t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Pieces:
    """A model's pieces. scores: of those that match text; bytes_of: what each id decodes to."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    kind: str  # "bpe" or "unigram"
    longest: int

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.kind, self.ids, self.scores)).encode("utf-8", "surrogatepass")).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score)"""
        return spark.createDataFrame([(p, i, self.scores[p]) for p, i in self.ids.items()], "piece string, id int, score double")


def load(path: str) -> Pieces:
    """The pieces of a SentencePiece model file with byte pieces and without normalisation."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that keep text as it is and put a space in front can be decoded exactly")
    sp = SentencePieceProcessor(model_proto=model.SerializeToString())
    ids, scores, raw, byte_ids = {}, {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            raw.append(piece.encode())
    return Pieces(ids, scores, raw, byte_ids, "bpe" if model.trainer_spec.model_type == 2 else "unigram", max(map(len, ids)))


def unit_pattern(pieces: Pieces) -> re.Pattern:
    """Units: a run of spaces with what follows it up to the next. White space that is in no piece
    of several characters is a unit of its own."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces.ids):
        raise ValueError("pieces with a space inside are not supported")
    alone = "".join(c for c in _CONTROL if not any(c in p and len(p) > 1 for p in pieces.ids))
    return re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def written(text: str) -> str:
    """The text as the model sees it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


#: In front of a unit that stands for itself; other keys are words, written with one space in front.
_MARK = "\x00"


def _plain(text: str) -> bool:
    """Whether every space of the text begins a unit, so that its words by single spaces make it up."""
    return bool(text) and text[0] != " " and "  " not in text and SPACE not in text and _MARK not in text


def _key(unit: str) -> str:
    """What a unit goes by: its word if one space is in front of it, else itself behind the mark."""
    return unit[1:] if unit[0] == SPACE and unit[1:2] not in (SPACE, _MARK) else _MARK + unit


def _units_of(key: str, pattern: re.Pattern) -> list[str]:
    """The units of a word, one but where it holds white space that is a unit of its own."""
    return [key[1:]] if key[:1] == _MARK else [SPACE + key] if key.isalnum() else pattern.findall(SPACE + key)


def _span_ids(unit: str, bounds: list[int], p: Pieces) -> list[int]:
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        i = p.ids.get(unit[a:b])
        if i is not None:
            out.append(i)
        else:
            out += [p.byte_ids[x] for x in unit[a:b].encode("utf-8", "surrogatepass")]
    return out


class Merges:
    """A BPE model's merges as whole numbers: that of ids a and b is at[a * n + b] = rank * n + id.

    A character without a piece is n and more, and merges with nothing. joined: the pairs of
    characters that stand side by side in some piece; no piece crosses any other pair."""

    def __init__(self, p: Pieces):
        self.n = n = len(p.bytes_of) + 1
        self.ids = p.ids
        made = Counter(s for piece, s in p.scores.items() if len(piece) > 1)
        rank = {s: i for i, s in enumerate(sorted(made, reverse=True))}
        # ties are the leftmost's, which one number can't say: how pieces of equal scores begin
        self.tied = sorted({piece[:2] for piece, s in p.scores.items() if len(piece) > 1 and made[s] > 1})
        self.at = {}
        for piece, score in p.scores.items():
            for k in range(1, len(piece)):
                left, right = p.ids.get(piece[:k]), p.ids.get(piece[k:])
                if left is not None and right is not None and len(piece) > 1:
                    self.at[left * n + right] = rank[score] * n + p.ids[piece]
        self.joined = {piece[i : i + 2] for piece in p.ids for i in range(len(piece) - 1)}

    def parts(self, unit: str) -> list[str]:
        """The unit cut where no piece crosses."""
        joined, cut = self.joined, [0]
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in joined:
                cut.append(i)
        return [unit] if len(cut) == 1 else [unit[x:y] for x, y in zip(cut, [*cut[1:], len(unit)], strict=True)]

    def fold(self, unit: str, p: Pieces) -> list[int]:
        n, get, none = self.n, self.at.get, 1 << 62
        spans = [i if (i := self.ids.get(c)) is not None else n + ord(c) for c in unit]
        joins = [get(a * n + b, none) for a, b in zip(spans, spans[1:], strict=False)]
        while joins and (best := min(joins)) < none:
            i = joins.index(best)
            spans[i : i + 2] = [best % n]
            del joins[i]
            if i < len(joins):
                joins[i] = get(spans[i] * n + spans[i + 1], none)
            if i:
                joins[i - 1] = get(spans[i - 1] * n + spans[i], none)
        if max(spans) < n:
            return spans
        return [j for i in spans for j in ([i] if i < n else [p.byte_ids[x] for x in chr(i - n).encode("utf-8", "surrogatepass")])]


#: Merges of the models that this process has met, and what it has folded with them.
_MERGES: dict[str, tuple[Merges, dict[str, bytes]]] = {}


def merges_of(p: Pieces) -> tuple[Merges, dict[str, bytes]]:
    """The model's merges and a memory of folded parts, which later tasks of one process find filled."""
    if p.digest not in _MERGES:
        _MERGES.clear()
        _MERGES[p.digest] = Merges(p), {}
    return _MERGES[p.digest]


def merge_unit(unit: str, p: Pieces) -> list[int]:
    """Ids of one unit by merges: the lattice's best edge over two neighbouring spans, again and again."""
    return list(array("i", merged(unit, p)))


def merged(unit: str, p: Pieces) -> bytes:
    """Ids of one unit by merges, as bytes.

    A unit is cut where no piece crosses; a short part's spans are searched again after each merge,
    a long one's are a heap."""
    merges, known = merges_of(p)
    out = b""
    for part in merges.parts(unit):
        if (ids := known.get(part)) is None:
            short = len(part) <= 2 * UNIT_CHARS and not any(x in part for x in merges.tied)
            found = merges.fold(part, p) if short else _merge_long(part, p)
            ids = array("i", found).tobytes()
            if len(known) > 2 * _MEMORY:
                known.clear()
            if len(part) <= UNIT_CHARS:
                known[part] = ids
        out += ids
    return out


def _merge_long(unit: str, p: Pieces) -> list[int]:
    n, scores = len(unit), p.scores
    end, start = list(range(1, n + 1)), [0, *range(n)]  # by a span's begin: its end; by a span's end: its begin
    heap = [(-scores[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in scores]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, a, m, b = heapq.heappop(heap)
        if not (alive[a] and end[a] == m and m < n and alive[m] and end[m] == b):
            continue
        end[a], alive[m], start[b] = b, False, a
        if b < n and (s := scores.get(unit[a : end[b]])) is not None:
            heapq.heappush(heap, (-s, a, b, end[b]))
        if a > 0 and (s := scores.get(unit[start[a] : b])) is not None:
            heapq.heappush(heap, (-s, start[a], a, b))
    bounds, at = [0], 0
    while at < n:
        at = end[at]
        bounds.append(at)
    return _span_ids(unit, bounds, p)


def viterbi_unit(unit: str, p: Pieces) -> list[int]:
    """Ids of one unit by the greatest sum of scores; of equal sums the smaller last pieces' list."""
    unknown = min(p.scores.values()) - 10
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for e in range(1, len(unit) + 1):
        some = [(best[s][0] + p.scores[unit[s:e]], best[s][1] + [p.ids[unit[s:e]]]) for s in range(max(0, e - p.longest), e) if unit[s:e] in p.scores]
        if unit[e - 1 : e] not in p.scores:
            some.append((best[e - 1][0] + unknown, best[e - 1][1] + [p.byte_ids[x] for x in unit[e - 1 : e].encode("utf-8", "surrogatepass")]))
        best.append(max(some, key=lambda x: (x[0], x[1])))
    return best[-1][1]


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): for each unit of `units` (unit string), its substrings that are pieces, as an array
    of (start, end, id, score). pieces: (piece, id, score), a vocabulary, broadcast; units without
    any edge are left out."""
    n = F.length("unit")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - s + 1)), lambda k: F.struct((s - 1).alias("start"), (s - 1 + k).alias("end"))))
    )
    exploded = units.filter(n > 0).select("unit", F.explode(spans).alias("e")).select("unit", "e.start", "e.end", F.expr("substring(unit, e.start + 1, e.end - e.start)").alias("piece"))
    return exploded.join(F.broadcast(pieces), "piece").groupBy("unit").agg(F.collect_list(F.struct("start", "end", "id", "score")).alias("edges"))


def fold_merges(unit: Column, edges: Column) -> Column:
    """Ids by merges, or null where a character has no piece: an aggregate over the spans' bounds."""
    code = lambda a, b: a * 64 + b
    score_of = F.map_from_entries(F.transform(edges, lambda e: F.struct(code(e["start"], e["end"]), e["score"])))
    id_of = F.map_from_entries(F.transform(edges, lambda e: F.struct(code(e["start"], e["end"]), e["id"])))
    n = F.length(unit)

    def fold(maps: Column) -> Column:
        def step(bounds: Column, _: Column) -> Column:
            joins = F.transform(F.sequence(F.lit(0), F.size(bounds) - 3), lambda i: F.struct(F.try_element_at(maps["score"], code(F.get(bounds, i), F.get(bounds, i + 2))).alias("s"), (-i).alias("i")))
            best = F.array_max(F.filter(joins, lambda j: j["s"].isNotNull()))
            drop = lambda b: F.when(b.isNull(), bounds).otherwise(F.concat(F.slice(bounds, 1, 1 - b["i"]), F.slice(bounds, 3 - b["i"], F.size(bounds))))
            return F.when(F.size(bounds) < 3, bounds).otherwise(F.transform(F.array(best), drop)[0])

        bounds = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
        return F.transform(F.array(bounds), lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.try_element_at(maps["id"], code(F.get(b, i), F.get(b, i + 1)))))[0]

    ids = F.transform(F.array(F.struct(score_of.alias("score"), id_of.alias("id"))), fold)[0]
    return F.when(F.exists(ids, lambda i: i.isNull()), None).otherwise(ids)


def fold_viterbi(unit: Column, edges: Column) -> Column:
    """Ids of the path of the greatest sum of scores, or null where no path spans the unit."""
    empty = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("ids"))

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: (e["end"] == end) & F.get(best, e["start"]).isNotNull())
        paths = F.transform(here, lambda e: F.struct((F.get(best, e["start"])["s"] + e["score"]).alias("s"), F.concat(F.get(best, e["start"])["ids"], F.array(e["id"])).alias("ids")))
        return F.concat(best, F.array(F.array_max(paths)))

    return F.get(F.aggregate(F.sequence(F.lit(1), F.length(unit)), F.array(empty), step), F.length(unit))["ids"]


def encode_units(units: DataFrame, p: Pieces) -> DataFrame:
    """(unit, ids) for distinct units of at most 63 characters whose characters all have pieces."""
    fold = fold_merges if p.kind == "bpe" else fold_viterbi
    edges = lattice(units.filter(F.length("unit") < 64), p.table(units.sparkSession), p.longest)
    return edges.select("unit", fold(F.col("unit"), F.col("edges")).alias("ids")).filter("ids is not null")


def _unit_counts(docs: DataFrame, pattern: re.Pattern, text_col: str) -> DataFrame:
    """(unit, n) of the units that a task has met three times or more within a stretch of texts."""
    arrow = to_arrow_schema(StructType.fromDDL("unit string, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()  # by word, or by unit with a mark in front

        def out() -> pa.RecordBatch:
            units: Counter = Counter()
            for word, c in counts.items():
                if c >= 3 and len(word) < UNIT_CHARS:
                    for u in _units_of(word, pattern):
                        units[u] += c
            often = list(units.items())
            counts.clear()
            return pa.RecordBatch.from_pydict({"unit": [u for u, _ in often], "n": [c for _, c in often]}, schema=arrow)

        for batch in batches:
            for text in texts_of(batch, text_col):
                counts.update(text.split(" ") if _plain(text) else map(_key, pattern.findall(written(text))))
                if len(counts) > 2 * _MEMORY:
                    yield out()
        yield out()

    return docs.select(text_col).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, p: Pieces, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(unit, ids) of at most `most` units of `docs`, those of the greatest counts."""
    counted = stored(_unit_counts(docs, unit_pattern(p), text_col), "units")
    hist = counted.groupBy(F.least("n", F.lit(1 << 20)).alias("c")).count().orderBy(F.desc("c")).toPandas()
    fits = hist["c"][hist["count"].cumsum() <= most]
    least = int(fits.min()) if len(fits) else 1 << 62
    return encode_units(counted.filter(F.col("n") >= least).select("unit"), p)


class Encoder:
    """Encodes texts with a table of frequent units; the others it folds itself and remembers for a while.

    (ids as bytes, whether they decode to what they came from) is held for each word and unit, so
    that a text's round trip is that of its parts."""

    def __init__(self, p: Pieces, frequent: dict[str, bytes]):
        self.p, self.frequent, self.pattern = p, frequent, unit_pattern(p)
        self.fold = merged if p.kind == "bpe" else lambda u, p: array("i", viterbi_unit(u, p)).tobytes()
        self.recent: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # keys whose ids decode to something else

    def _rare(self, key: str) -> bytes:
        ids = self.recent.get(key)
        if ids is None:
            if len(self.recent) > _MEMORY:
                self.recent.clear()
            units = _units_of(key, self.pattern)
            # a word of one unit has just been looked up
            ids = self.fold(units[0], self.p) if len(units) == 1 else b"".join([self.frequent.get(_key(u)) or self.fold(u, self.p) for u in units])
            if not same_bytes(ids, "".join(units), self.p):
                self.wrong.add(key)
            if len(key) <= UNIT_CHARS:
                self.recent[key] = ids
        return ids

    def __call__(self, text: str) -> tuple[np.ndarray, bool]:
        """(ids, whether they decode to the text)"""
        frequent, rare = self.frequent, self._rare
        if plain := _plain(text):
            keys = text.split(" ")
        else:
            keys = list(map(_key, self.pattern.findall(written(text))))
        ids = np.frombuffer(b"".join([frequent.get(k) or rare(k) for k in keys]), np.int32)
        return ids, (plain or SPACE not in text) and (not self.wrong or self.wrong.isdisjoint(keys))


def same_bytes(ids: bytes, unit: str, p: Pieces) -> bool:
    """Whether ids (as bytes) decode to a unit as it is written."""
    return b"".join(map(p.bytes_of.__getitem__, array("i", ids))) == unit.encode("utf-8", "surrogatepass")


def decode_ids(ids: np.ndarray, p: Pieces) -> str:
    """The text of some ids; the space that was put in front goes."""
    raw = b"".join(map(p.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass").replace(SPACE, " ")
    return raw[1:]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece_ids, n_pieces, round_trip) for every row of `docs`, over its whole text.

    model: path of a SentencePiece file that driver and executors have. round_trip says whether the
    ids decode to the text; U+2581 in a text is read as a space, as by the model, and so not kept.
    Null and empty texts have no pieces. Repeated rows and null ids give a row each. The one shuffle is that
    of the units' counts."""
    p = load(model)
    spark = docs.sparkSession
    found = frequent_units(docs, p, text_col).toArrow()
    table = {}
    for batch in found.to_batches(max_chunksize=ARROW_ROWS):  # a few at a time as Python's lists
        for u, i in zip(batch.column("unit").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.array(i, np.int32).tobytes()
            if same_bytes(ids, u, p):
                table[_key(u)] = ids
    del found
    shared = spark.sparkContext.broadcast((p, table))
    arrow = to_arrow_schema(StructType.fromDDL(schema := f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece_ids array<int>, n_pieces int, round_trip boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, frequent = shared.value
        encoder = Encoder(pieces, frequent)
        for batch in batches:
            texts = texts_of(batch, text_col)
            ids, same = map(list, zip(*map(encoder, texts), strict=True)) if texts else ([], [])
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(list(map(len, ids)), out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), lists.cast(arrow.field(1).type), pa.array(np.diff(offsets)), pa.array(same, pa.bool_())], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """`encoded` with a column text: what its ids decode to; null for null ids. Rows are decoded alone."""
    p = load(model)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields]

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [None if i is None else decode_ids(np.array(i, np.int32), p) for i in batch.column(ids_col).to_pylist()]
        yield {**{c: batch.column(c) for c in batch.schema.names}, "text": texts}

    return over_batches(encoded, f, ", ".join([*kept, "text string"]))
