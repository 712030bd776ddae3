"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document is the set of its distinct word n-grams, as 64-bit hashes; equal sets are one row of the
matrix. Two rows link when their Jaccard similarity reaches `percent`. The product is taken column
by column over those columns alone that can hold a pair's first common n-gram: of a row with n
n-grams, ordered from rare to frequent, the first n - ceil(percent n) + 1. Sizes and places in that
order bound the overlap that a pair can still reach and discard pairs below what its sizes ask for;
for the others the overlap is accumulated exactly over the whole rows.

Components need a link between groups, not every link inside them. So the columns are multiplied
twice: first among rows that meet the same lead (their columns' first row of about their size) most
often, in units of bounded size, whose exact overlaps give groups; then between rows of different
groups only, in blocks of bounded size, where sketches that bound the overlap from above discard
nearly all pairs that don't link before they leave the task. Every pair of sets is thus in one group,
or has been tested, or has a bound on its overlap below what its sizes ask for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import over_batches, released, stored, texts_of
from .components import components
from .words import windows, word_hashes

#: Frequent n-grams kept for the order of columns, which affects speed only.
FREQUENT = 200_000
_LOCAL = 8
_BLOCK_ROWS = 2048
_BLOCK_COLUMNS = 8192
#: Sets in a unit of the first product.
_UNIT = 400
_BITS = 24


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; of fewer words, the whole sequence is the one."""
    h, at = word_hashes(texts)
    return [np.unique(windows(x, min(n, len(x)))) if len(x := h[at[i] : at[i + 1]]) else x for i in range(len(texts))]


def set_id(s: np.ndarray) -> int:
    """64 bits of a set's digest: among a billion different sets two agree with a chance of 3 %."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-size * percent // 100)


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every row, and (shingle, n_sets) of those frequent in a task."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id long, shingle long, n_sets long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def frequent() -> Iterator[pa.RecordBatch]:
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            u, c = u[c >= _LOCAL], c[c >= _LOCAL]
            held.clear()
            seen.clear()
            if len(u):
                none = [None] * len(u)
                yield pa.RecordBatch.from_pydict({"doc_id": none, "n_shingles": none, "set_id": none, "shingle": u.view(np.int64), "n_sets": c}, schema=arrow)

        size = 0
        for batch in batches:
            sets = sets_of(texts_of(batch), n)
            ids = [set_id(s) if len(s) else None for s in sets]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "set_id": ids, "shingle": none, "n_sets": none}, schema=arrow)
            for i, s in zip(ids, sets, strict=True):
                if i is not None and i not in seen:
                    seen.add(i)
                    held.append(s)
                    size += len(s)
            if size > 8_000_000:
                yield from frequent()
                size = 0
        yield from frequent()

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "sets")


def _columns(docs: DataFrame, n: int, percent: int, order) -> DataFrame:
    """(token, set_id, place): the columns in which each distinct set must meet others.
    place: size << 32 | position in the set's order."""
    schema = "token long, set_id long, place long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = order.value
        seen: set[int] = set()
        for batch in batches:
            token, ident, place = [], [], []
            for s in sets_of(texts_of(batch), n):
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(i)
                k = len(s) - int(_least_overlap(len(s), percent)) + 1
                at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                often = np.where(frequent[at] == s, count[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
                first = s[np.lexsort((s, often))[:k]]
                token.append(first)
                ident.append(np.full(k, i, np.int64))
                place.append(np.int64(len(s)) << 32 | np.arange(k))
            if token:
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(token).view(np.int64), "set_id": np.concatenate(ident), "place": np.concatenate(place)}, schema=arrow)

    return docs.select("text").mapInArrow(run, schema)


def _may_link(size_a, at_a, size_b, at_b, percent: int):
    """Whether sets whose first common n-gram stands at these places can have enough in common."""
    left = 1 + np.minimum(size_a - at_a - 1, size_b - at_b - 1)
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (left * (100 + percent) >= percent * (size_a + size_b))


def _lead(columns: DataFrame, percent: int) -> DataFrame:
    """The entries of columns with two sets or more, each with the column's first set of about its size.

    Entries come sorted by (token, size, set); only the current column's lead is carried on."""
    schema = "token long, set_id long, place long, lead long, lead_place long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the latest entry, and whether it has been given out; its lead
        for batch in batches:
            if not batch.num_rows:
                continue
            t, s, p = (batch.column(c).to_numpy() for c in ("token", "set_id", "place"))
            first = 0
            if last is not None:
                t, s, p = (np.concatenate(([a], b)) for a, b in zip(last[:3], (t, s, p), strict=True))
                first = 1
            again = np.zeros(len(t), bool)
            again[1:] = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
            given = np.zeros(len(t), bool)
            lead_s, lead_p = s.copy(), p.copy()
            if first:
                given[0], lead_s[0], lead_p[0] = last[3:]
            keep = np.flatnonzero(~again)
            t, s, p, given, lead_s, lead_p = (x[keep] for x in (t, s, p, given, lead_s, lead_p))
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            group = np.cumsum(new) - 1
            lead_s, lead_p = lead_s[new][group], lead_p[new][group]
            while len(far := np.flatnonzero(100 * (lead_p >> 32) < percent * (p >> 32))):
                # the first entry that is too large for its lead leads from there on
                _, begin, which = np.unique(group[far], return_index=True, return_inverse=True)
                lead_s[far], lead_p[far] = s[far[begin][which]], p[far[begin][which]]
            shared = ~new
            shared[:-1] |= ~new[1:]
            out = shared & ~given
            if out.any():
                yield pa.RecordBatch.from_pydict({"token": t[out], "set_id": s[out], "place": p[out], "lead": lead_s[out], "lead_place": lead_p[out]}, schema=arrow)
            last = (t[-1], s[-1], p[-1], bool(shared[-1] or given[-1]), lead_s[-1], lead_p[-1])

    return columns.repartition("token").sortWithinPartitions("token", "place", "set_id").mapInArrow(run, schema)


def _pack(s: np.ndarray) -> bytes:
    """The upper six bytes of each hash: enough within a pair (two n-grams of two sets of a thousand
    agree by chance once in 300 million pairs)."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _thinned(docs: DataFrame, firsts: DataFrame, n: int, name: str, of: Callable[[list[np.ndarray]], list[bytes]]) -> DataFrame:
    """(set_id, name): what `of` makes of each set. firsts: (doc_id), one document for each wanted set.

    The scan is thinned by a bit map of fixed size over the wanted ids; what passes by chance finds
    no partner later or is a second copy of a wanted set, so the map's size is a matter of speed alone."""
    bit = F.expr(f"pmod(xxhash64(doc_id), {1 << _BITS})")
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    wanted = firsts.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(one).alias("bits"))
    here = docs.select("doc_id", "text", bit.alias("bit")).join(F.broadcast(wanted), F.shiftright("bit", 6) == F.col("w")).filter(F.col("bits").bitwiseAND(one) != 0)

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = [s for s in sets_of(texts_of(batch), n) if len(s)]
        yield {"set_id": [set_id(s) for s in sets], name: of(sets)}

    return stored(over_batches(here.select("text"), f, f"set_id long, {name} binary"), name)


def _rows(docs: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """(set_id, row): packed sets, of the documents `firsts` (doc_id)."""
    return _thinned(docs, firsts, n, "row", lambda x: list(map(_pack, x)))


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose rows' overlap reaches the threshold, and the others: (a, b, linked)."""
    wide = pairs.join(rows.select(F.col("set_id").alias("a"), F.col("row").alias("row_a")), "a").join(rows.select(F.col("set_id").alias("b"), F.col("row").alias("row_b")), "b")

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        linked = []
        for x, y in zip(batch.column("row_a").to_pylist(), batch.column("row_b").to_pylist(), strict=True):
            both = np.concatenate((_unpack(x), _unpack(y)))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= percent * (len(both) - common))
        yield {"a": batch.column("a"), "b": batch.column("b"), "linked": linked}

    return stored(over_batches(wide.select("a", "b", "row_a", "row_b"), f, "a long, b long, linked boolean"), "links")


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the same sets as all links among `sets` do: pairs of places.

    Overlaps are a product of the sets' incidence matrix with its transpose, summed up over blocks
    of the columns that two sets or more have."""
    size = np.array([len(s) for s in sets])
    token, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    use = count[inv] > 1
    owner, column = owner[use], column[inv[use]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _BLOCK_COLUMNS):
        x, y = np.searchsorted(column, (at, at + _BLOCK_COLUMNS))
        block = np.zeros((len(sets), min(_BLOCK_COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        block[owner[x:y], column[x:y] - at] = 1
        overlap += block @ block.T
    linked = 100 * overlap >= percent * (size[:, None] + size[None, :] - overlap)
    left, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i], edge = False, [i]
        while edge:
            j = edge.pop()
            new = np.flatnonzero(linked[j] & left)
            left[new] = False
            out += [(j, int(k)) for k in new]
            edge += new.tolist()
    return out


def _forests(dealt: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside each unit of `dealt` (lead, unit, set_id)."""
    arrow = to_arrow_schema(StructType.fromDDL("a long, b long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids = list(held)
                pairs = forest([held[i] for i in ids], percent)
                yield pa.RecordBatch.from_pydict({"a": [min(ids[i], ids[j]) for i, j in pairs], "b": [max(ids[i], ids[j]) for i, j in pairs]}, schema=arrow)

        for batch in batches:
            for lead, part, i, row in zip(*(batch.column(c).to_pylist() for c in ("lead", "unit", "set_id", "row")), strict=True):
                if (lead, part) != key:
                    yield from out()
                    key, held = (lead, part), {}
                if i not in held:
                    held[i] = _unpack(row)
        yield from out()

    wide = dealt.join(rows, "set_id").select("lead", "unit", "set_id", "row")
    return stored(wide.repartition("lead", "unit").sortWithinPartitions("lead", "unit").mapInArrow(run, "a long, b long"), "inside")


def _inside(members: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of sets that have a lead in common: every two of them are in one component of
    labels or have been tested. members: (set_id, lead).

    A lead's sets are dealt to units of some _UNIT, and the lead goes to each. Of a lead with several
    units, the sets outside its largest component are then dealt to units again and each of these
    meets each of the first, so that no unit grows and no set meets its own component again."""
    unit = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    units = members.groupBy("lead").agg(F.ceil(F.count("*") / _UNIT).cast("int").alias("units"))
    dealt = stored(members.filter("set_id <> lead").join(units, "lead").select("lead", unit("units").alias("unit"), "set_id", "units"), "dealt")
    leads = units.select("lead", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.col("lead").alias("set_id"))
    first = _forests(dealt.drop("units").union(leads), rows, percent)
    labels = components(first)
    if not dealt.filter("units > 1").limit(1).count():
        released(dealt)
        return first, labels
    large = dealt.filter("units > 1").join(labels, F.col("set_id") == F.col("node"), "left").select("lead", "unit", "units", "set_id", F.coalesce("label", "set_id").alias("label"))
    main = large.groupBy("lead", "label").count().groupBy("lead").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
    apart = large.join(main, "lead").filter("label <> main")
    blocks = apart.groupBy("lead").agg(F.ceil(F.count("*") / _UNIT).cast("int").alias("blocks"))
    apart = apart.join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")).cast("int"))
    met = F.col("unit") * F.col("blocks") + F.col("block")
    here = large.join(blocks, "lead").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lead", met.alias("unit"), "set_id")
    there = apart.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).select("lead", met.alias("unit"), "set_id")
    both = stored(here.union(there), "dealt")
    if both.limit(1).count():
        first = first.unionByName(_forests(both, rows, percent))
        labels = components(first)
    released(dealt, both)
    return first, labels


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of a set's hashes by their low bits, in a power of two of some two bits a hash, at least 128.

    An element that only one of two sets has changes one bit of one sketch. Sketches that differ in k
    bits are thus of sets that differ in k elements or more."""
    bits = max(128, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def folded(x: np.ndarray, n_bytes: int) -> np.ndarray:
    """Sketches (rows of bytes) as the shorter ones of n_bytes, of which the same holds."""
    while x.shape[-1] > n_bytes:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _sketches(docs: DataFrame, firsts: DataFrame, uses: DataFrame, n: int) -> DataFrame:
    """(set_id, sketch) of the sets in `uses` (set_id, n_uses), folded so that all that is sent of a
    set, n_uses times its sketch, is some 32 bytes for each of its n-grams, or 64 bytes a time."""
    found = _thinned(docs, firsts, n, "sketch", lambda x: [sketch(s).tobytes() for s in x])

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        out = []
        for x, k in zip(batch.column("sketch").to_pylist(), batch.column("n_uses").to_pylist(), strict=True):
            most = max(64, 128 * len(x) // k)
            out.append(folded(np.frombuffer(x, np.uint8), 1 << (most.bit_length() - 1)).tobytes())
        yield {"set_id": batch.column("set_id"), "sketch": out}

    return over_batches(found.join(uses, "set_id").select("set_id", "sketch", "n_uses"), f, "set_id long, sketch binary")


def _near(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches, of these sizes together, can link."""
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (100 + percent) * (sizes - apart) >= 2 * percent * sizes


def _by_unit(mixed: DataFrame, columns: list[str], of_unit: Callable, schema: str) -> DataFrame:
    """of_unit(whether two blocks meet, own blocks, *columns) of each unit of `mixed` (token, blocks, set_id, ...).

    A column of many entries is cut into blocks, and each pair of blocks is a unit of bounded size."""
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    spread = mixed.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = spread.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *[c for c in columns if c != "token"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = batch if rest is None else (pa.concat_tables([rest, batch]) if batch is not None else rest)
            if table is None or not table.num_rows:
                continue
            t, i, j = (table.column(c).to_numpy() for c in ("token", "i", "j"))
            new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            stop = len(t) if batch is None else new[-1]
            some = table.slice(0, stop)
            values = [some.column(c).to_pylist() if c == "sketch" else some.column(c).to_numpy() for c in ("own", *columns)]
            bounds = np.append(new[new < stop], stop)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y - x > 1:
                    for found in of_unit(i[x] != j[x], *(c[x:y] for c in values)):
                        if len(found[0]):
                            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, found, strict=True)), schema=arrow)
            rest = table.slice(stop) if batch is not None else None

    return unit.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, schema)


def _meet(q, z, cross: bool, own, s, p, label, lead, percent: int) -> np.ndarray:
    """Whether this may be the first column that the entries q (a column of places) and z (a row) share, and nothing else
    forbids that their sets link: groups and leads differ, and sizes and places leave enough to have in common."""
    size, at = p >> 32, p & 0xFFFFFFFF
    ok = (s[q] != s[z]) & (label[q] != label[z]) & (lead[q] != lead[z]) & (lead[q] != s[z]) & (s[q] != lead[z]) & _may_link(size[q], at[q], size[z], at[z], percent)
    return ok & (own[q] != own[z]) if cross else ok


def _meeting(mixed: DataFrame, percent: int) -> DataFrame:
    """The entries of `mixed` that have one to meet in their column: at most as many rows as come in for each unit.

    Most of those that share a column by a common passage have none, so little is left to carry sketches."""
    columns = ["token", "set_id", "place", "label", "lead", "blocks"]

    def of_unit(cross: bool, own, token, s, p, label, lead, blocks) -> Iterator[tuple]:
        every, kept = np.arange(len(s)), np.zeros(len(s), bool)
        step = max(1, 2_000_000 // len(s))
        for r in range(0, len(s), step):
            kept[r : r + step] = _meet(every[r : r + step, None], every[None, :], cross, own, s, p, label, lead, percent).any(axis=1)
        yield tuple(c[kept] for c in (token, s, p, label, lead, blocks))

    return _by_unit(mixed, columns, of_unit, "token long, set_id long, place long, label long, lead long, blocks int").distinct()


def _across(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different groups that can still link: those of which a column may be the first that they
    share, and whose sketches bound the overlap by enough. entries: as from _meeting. Pairs that a common lead
    has brought together before are left out. Of sets that share much and don't link, few leave the task."""

    def of_unit(cross: bool, own, s, p, label, lead, raw: list[bytes]) -> Iterator[tuple]:
        size, length = p >> 32, np.array(list(map(len, raw)))
        classes = {k: np.flatnonzero(length == k) for k in np.unique(length).tolist()}
        bits = {k: np.frombuffer(b"".join([raw[i] for i in v]), np.uint8).reshape(-1, k) for k, v in classes.items()}
        for k, v in classes.items():
            for k2, v2 in classes.items():
                if k2 < k or 100 * size[v].max() < percent * size[v2].min() or 100 * size[v2].max() < percent * size[v].min():
                    continue
                x, y = bits[k].view(np.uint64), np.ascontiguousarray(folded(bits[k2], k)).view(np.uint64)
                step = max(1, 4_000_000 // k // len(v2))
                for r in range(0, len(v), step):
                    m, o = np.nonzero(_meet(v[r : r + step, None], v2[None, :], cross, own, s, p, label, lead, percent))
                    m += r
                    keep = _near(x[m], y[o], size[v[m]] + size[v2[o]], percent)
                    m, o = s[v[m[keep]]], s[v2[o[keep]]]
                    yield np.minimum(m, o), np.maximum(m, o)

    return _by_unit(entries.join(sketches, "set_id"), ["set_id", "place", "label", "lead", "sketch"], of_unit, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Words are lower-cased in A-Z. component_id is the least doc_id that links reach, its own
    included. Null, empty and blank texts have no n-grams, link with nothing and are their own
    component. Repeated rows give a row each, in one component; null ids give rows too and never
    name a component unless all its ids are null. Other columns are not read."""
    spark = docs.sparkSession
    survey = _survey(docs, n)
    meta = survey.filter("shingle is null").select("doc_id", "n_shingles", "set_id")
    often = survey.filter("shingle is not null").groupBy("shingle").agg(F.sum("n_sets").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    frequent, count = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    by_hash = np.argsort(frequent)
    order = spark.sparkContext.broadcast((frequent[by_hash], count[by_hash]))
    entries = stored(_lead(_columns(docs, n, percent, order), percent), "columns")

    distinct = meta.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    def test(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        used = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        rows = _rows(docs, distinct.join(used, "set_id"), n)
        out = _linked(pairs, rows, percent)
        released(pairs, rows)
        return out

    # of its columns' leads, each set goes with the one that it meets most often
    columns_of = F.expr(f"size - ceil({percent} * size / 100) + 1")
    members = stored(
        entries.filter("lead <> set_id")
        .groupBy("set_id", "lead")
        .agg(F.count("*").alias("n"), F.max(F.shiftright("place", 32)).alias("size"))
        .filter(5 * F.col("n") >= columns_of)
        .groupBy("set_id")
        .agg(F.max(F.struct("n", "lead"))["lead"].alias("lead")),
        "members",
    )
    used = members.select("set_id").union(members.select("lead")).distinct()
    rows = _rows(docs, distinct.join(used, "set_id"), n)
    first, labels = _inside(members, rows, percent)
    released(rows)
    # a set without a lead leads itself
    named = entries.select("token", "set_id", "place").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").join(members, "set_id", "left")
    labelled = named.select("token", "set_id", "place", F.coalesce("label", "set_id").alias("label"), F.coalesce("lead", "set_id").alias("lead"))
    several = labelled.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    mixed = stored(labelled.join(several.select("token", F.ceil(F.col("n") / _BLOCK_ROWS).cast("int").alias("blocks")), "token"), "mixed")
    released(entries, members)
    meeting = stored(_meeting(mixed, percent), "meeting")
    uses = stored(meeting.groupBy("set_id").agg(F.count("*").alias("n_uses")), "uses")
    second = test(_across(meeting, _sketches(docs, distinct.join(uses, "set_id"), uses, n), percent))
    released(mixed, meeting, uses)
    if second.filter("linked").limit(1).count():
        labels = components(first.unionByName(second.filter("linked").select("a", "b")))

    group = distinct.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("label", "set_id").alias("label"))
    least = group.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = group.join(least, "label").select("set_id", "component_id")
    return meta.join(named, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of each group of `docs`, that of the least doc_id, with all its columns.

    Rows equal in id and text are one. Rows without an id cannot be named by a group and all stay."""
    groups = similar_groups(docs, n, percent)
    named = groups.filter("doc_id = component_id").select("doc_id").distinct()
    first = docs.filter("doc_id is not null").join(named, docs["doc_id"] == named["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.filter("doc_id is null"))
