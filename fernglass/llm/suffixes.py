"""Removal of passages that an earlier document holds: every byte covered by a string of LENGTH bytes that also
starts in a document with a smaller id.

1. Each string has an anchor, the least hash among the GRAM-byte grams in it; equal strings have equal anchors. A run
   of neighbouring strings with one anchor is a context, LENGTH to LENGTH + GRAMS - 1 bytes long. Hashes only deal the
   work: an anchor that one document alone holds has nothing to be compared with, all others are shared.
2. Anchors are dealt to parts by value, which tell the holders of shared ones. A task first settles what it sees itself,
   so an anchor that a third of all documents hold is sent once per task.
3. Texts are dealt to chunks of about CHUNK_BYTES. Shared contexts are cut out there; those of a chunk that are equal (by
   a 64-bit hash of their bytes) are one, with their smallest id. They are dealt to shards by anchor, so all
   occurrences of a string meet in one shard. A shard builds a suffix array of its distinct contexts by Larsson and
   Sadakane's refinement (ranks of doubled length, only groups that are still unsorted), common prefixes by Kasai's rule
   that the next suffix shares at least one byte less, and takes the smallest id of each run of suffixes that share
   LENGTH bytes. It answers each chunk with a bit per string, in the order in which the chunk asked.
4. An anchor that more than SPLIT documents hold is dealt over several shards, so no task holds a whole hot anchor. Each
   of those gives out its distinct strings in suffix order, and the runs are merged by binary search. How many shards
   an anchor gets is the lesser of its entries in two tables of SLOTS numbers, whose size doesn't follow the corpus: an
   anchor that shares its slots with hot ones is merged as well, with the same result.

All rows between tasks are blobs of a chunk and a part or shard. Ids of null come after all others. Rows that repeat
an id don't remove each other's text. Defined results: null text is empty; texts shorter than LENGTH bytes lose
nothing; ties don't arise, as only smaller ids count; very long texts are handled one at a time; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import Rolling, blob_rows, mix, portions, stored, texts

LENGTH = 50
GRAM = 20
GRAMS = LENGTH - GRAM + 1
#: Bytes of text per part of the anchors, per chunk and per shard (whose contexts overlap, but are only the shared ones).
PART_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
#: Documents with one anchor that a shard takes; more are dealt over several.
SPLIT = 1024
SLOTS = 1 << 19
ALL = np.uint32(0xFFFFFFFF)
LAST = 2**63 - 1
SEPARATOR = 0xFF  # no byte of UTF-8
SPANS = "array<struct<start:long,end:long>>"


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every string of LENGTH bytes in a slice, its anchor, and whether it lies within one text."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, width = Rolling(data).windows(GRAM), 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: n], least[GRAMS - width : GRAMS - width + n])
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, np.maximum(off[:-1], off[1:] - LENGTH + 1), 1)
    np.add.at(marks, off[1:], -1)
    return mix(least[:n]), np.cumsum(marks[:n]) == 0


def runs(anchor: np.ndarray, ok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most GRAMS neighbouring strings of one text with one anchor: first string, end, row."""
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(anchor) + 1, bool)
    first[off[off <= len(anchor)]] = True
    change = np.concatenate(([True], anchor[1:] != anchor[:-1])) | first[:-1]
    start = np.flatnonzero(ok & (change | np.concatenate(([True], ~ok[:-1]))))
    stop = np.flatnonzero(ok & np.concatenate((change[1:] | ~ok[1:], [True]))) + 1
    if len(start) and (more := -(-(stop - start) // GRAMS)).max() > 1:  # a gram that repeats
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        start = np.repeat(start, more) + step * GRAMS
        stop = np.minimum(start + GRAMS, np.repeat(stop, more))
    return start, stop, np.searchsorted(off, start, side="right") - 1


# -- suffix arrays ---------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order. Contexts are distinct and end with a separator, so few rounds are needed."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | wide[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 8
    open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while len(open_):
        own = order[open_]
        group, then = rank[own], rank[np.minimum(own + h, n)]
        by = np.argsort((group << 31 if n < 1 << 31 else group * (n + 1)) + then + 1, kind="stable")
        own, group, then = own[by], group[by], then[by]
        order[open_] = own
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])))
        rank[own] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        open_ = open_[~(fresh & np.concatenate((fresh[1:], [True])))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Of each suffix in order, the bytes it shares with the one before, up to most. Kasai's rule runs along every
    piece [start, end) of the text at once: from one suffix to the next at most one shared byte is lost."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    padded = np.concatenate((text, np.zeros(most, np.uint8)))
    shared = np.zeros(n, np.int64)
    at, stop = start.copy(), end
    have = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        have = np.where(other >= 0, np.maximum(have - 1, 0), 0)
        live = np.flatnonzero((other >= 0) & (have < most))
        while len(live):
            a, b = at[live] + have[live], other[live] + have[live]
            live = live[(a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            have[live] += 1
            live = live[have[live] < most]
        shared[at] = have
        at = at + 1
        keep = at < stop
        at, stop, have = at[keep], stop[keep], have[keep]
    return shared[order]


def least_ids(contexts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every string of LENGTH bytes of the contexts, in suffix order: its context, its place there, the number
    of its class of equal strings, and the smallest id of that class."""
    size = np.array([len(c) for c in contexts], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text = np.frombuffer(b"".join(c + bytes([SEPARATOR]) for c in contexts), np.uint8)
    order = suffix_array(text)
    shared = common_prefixes(text, order, start, start + size)
    context = np.repeat(np.arange(len(size)), size + 1)[order]
    place = order - start[context]
    whole = place + LENGTH <= size[context]
    kind = np.cumsum(shared < LENGTH)[whole]
    context, place = context[whole], place[whole]
    if not len(kind):
        return context, place, kind, kind
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    least = np.minimum.reduceat(ids[context], np.flatnonzero(new))
    kind = np.cumsum(new) - 1
    return context, place, kind, least[kind]


def masks(context: np.ndarray, place: np.ndarray, gone: np.ndarray, n: int) -> np.ndarray:
    """Per context, a bit for each of its strings that goes."""
    out = np.zeros(n, np.int64)
    np.bitwise_or.at(out, context[gone], np.int64(1) << place[gone])
    return out


def _union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct strings with ids as one; the shorter is placed in the longer by binary search."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    same = a[0][np.minimum(at, len(a[0]) - 1)] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    ids = a[1].copy()
    ids[at[same]] = np.minimum(ids[at[same]], b[1][same])
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(ids, at[~same], b[1][~same])


def merged(strings: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted runs of distinct strings with ids: for each run, the smallest id that any run has for each of its
    strings. Runs are merged two by two, so the work grows with the strings times the logarithm of the runs."""
    level = list(zip(strings, ids, strict=True))
    while len(level) > 1:
        level = [_union(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return [level[0][1][np.searchsorted(level[0][0], own)] for own in strings]


# -- the operator ----------------------------------------------------------------------------------------------


def _blobs(group: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in group.column(column).to_pylist()]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted key."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return cut, np.diff(np.concatenate((cut, [len(key)])))


def _anchors_of(docs: DataFrame, parts: int) -> DataFrame:
    """Per task and part: anchors with a row that holds them and the number of rows that do; and rows with anchors that
    several ids of the task hold, dealt by id. Rows are places in a list of (id, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            ids, chunks = batch.column("k").to_numpy(), batch.column("chunk").to_numpy()
            found: list[list] = [[], []]
            for lo, _, data, off in texts(batch, "text"):
                anchor, ok = anchors(data, off)
                start, _, row = runs(anchor, ok, off)
                found[0].append(anchor[start])
                found[1].append(lo + row)
            if not found[0] or not sum(map(len, found[0])):
                continue
            h, row = (np.concatenate(x) for x in found)
            k = ids[row]
            by = np.lexsort((k, h))
            h, k, row = h[by], k[by], row[by]
            cut, n = _grouped(h)
            alone = np.minimum.reduceat(k, cut) == np.maximum.reduceat(k, cut)
            many = np.where(alone, 1, n)
            shared = np.repeat(~alone, n)
            parts_of = lambda x: (mix(x) % np.uint64(parts)).astype(np.int64)
            out = {}
            for name, part, cols in (("asked", parts_of(h[cut]), (h[cut], row[cut].astype(np.int32), many.astype(np.int32))), ("known", parts_of(k[shared].view(np.uint64)), (h[shared], row[shared].astype(np.int32)))):
                own, blobs = blob_rows(part, *cols)
                out[name] = dict(zip(own.tolist(), zip(*blobs, strict=True), strict=True))
            at = sorted(out["asked"].keys() | out["known"].keys())
            table = np.stack([ids, chunks.astype(np.int64)], 1)
            rows = []
            for p in at:
                asked, known = out["asked"].get(p, (b"",) * 3), out["known"].get(p, (b"",) * 2)
                own = np.unique(np.frombuffer(asked[1] + known[1], np.int32))
                place = lambda x, own=own: np.searchsorted(own, np.frombuffer(x, np.int32)).astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes()
                rows.append((p, 2 if len(ids) < 65536 else 4, asked[0], place(asked[1]), asked[2], known[0], place(known[1]), table[own].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *(pa.binary(),) * 6), strict=True)], ["part", "wide", "anchor", "row", "n", "known", "holder", "rows"])

    return docs.mapInArrow(run, "part int, wide int, anchor binary, row binary, n binary, known binary, holder binary, rows binary")


def _name(k: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """An id and an anchor as one number; two of one number only make a chunk ask for a context that it needn't."""
    return mix(k.view(np.uint64)) ^ anchor


def _judged(split: int):
    """A part: per chunk, names of ids with their shared anchors. Crowded anchors: their slot and number of shards."""

    def run(group: pa.Table) -> pa.Table:
        tables = [x.reshape(-1, 2) for x in _blobs(group, "rows", np.int64)]
        base = np.cumsum([0] + [len(x) for x in tables])
        rows = np.concatenate(tables)
        wide = group.column("wide").to_pylist()

        def places(column: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, f"u{w}").astype(np.int64) + b for x, w, b in zip(group.column(column).to_pylist(), wide, base, strict=False)])

        h, n = (np.concatenate(_blobs(group, c, t)) for c, t in (("anchor", np.uint64), ("n", np.int32)))
        row = places("row")
        by = np.argsort(h, kind="stable")
        h, n, row = h[by], n[by], row[by]
        k, (cut, m) = rows[row, 0], _grouped(h)
        told, slot, shares = np.zeros(len(h), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(h):
            most = np.maximum.reduceat(n, cut)
            shared = (np.minimum.reduceat(k, cut) != np.maximum.reduceat(k, cut)) | (most > 1)
            told = np.repeat(shared, m) & (n == 1)  # the others are known already
            total = np.add.reduceat(n.astype(np.int64), cut)
            crowded = shared & (total > split)
            slot, shares = _slots(h[cut][crowded]).reshape(-1), np.tile(-(-total[crowded] // split), 2)
        name = np.concatenate([h[told], *_blobs(group, "known", np.uint64)])
        row = np.concatenate([row[told], places("holder")])
        k, chunk = rows[row].T if len(row) else np.zeros((2, 0), np.int64)
        own, (blobs,) = blob_rows(chunk, _name(k, name))
        none = [None] * len(slot)
        return pa.table({"chunk": pa.array([*own.tolist(), *none], pa.int64()), "names": pa.array([*blobs, *none], pa.binary()), "slot": pa.array([None] * len(own) + slot.tolist(), pa.int64()), "shares": pa.array([None] * len(own) + shares.tolist(), pa.int64())})

    return run


def _slots(anchor: np.ndarray) -> np.ndarray:
    """An anchor's slots in both tables; those of the second follow those of the first."""
    return np.stack([mix(anchor ^ np.uint64(x)) % np.uint64(SLOTS) + np.uint64(t * SLOTS) for t, x in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C))]).astype(np.int64)


class _Crowd:
    """How many shards an anchor is dealt over: one, unless both of its slots have more."""

    def __init__(self, shares: dict[int, int]):
        self.slots = np.array(sorted(shares), np.int64)
        self.shares = np.array([shares[x] for x in self.slots.tolist()], np.uint64)

    def of(self, anchor: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.ones(len(anchor), np.uint64)
        own = _slots(anchor)
        at = np.minimum(np.searchsorted(self.slots, own), len(self.slots) - 1)
        return np.where(self.slots[at] == own, self.shares[at], np.uint64(1)).min(0)


class _Asked:
    """The shared contexts of a chunk's texts. slices: batch, first row, end row, bytes, offsets, and of each run its
    start and end. Of the runs of all slices: id and the place of its context in the list of distinct contexts. That
    list is in the order of shard, whether crowded, and hash, so it doesn't depend on the order of the texts."""

    def __init__(self, texts_: pa.Table, told: pa.Table, shards: int, crowd: _Crowd):
        names = np.unique(np.concatenate([np.zeros(0, np.uint64), *_blobs(told, "names", np.uint64)]))
        self.slices: list[tuple] = []
        cols: list[list] = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        for batch in texts_.combine_chunks().to_batches():
            ids = batch.column("k").to_numpy()
            for lo, hi, data, off in texts(batch, "text"):
                anchor, ok = anchors(data, off)
                start, stop, row = runs(anchor, ok, off)
                k = ids[lo + row]
                own = _name(k, anchor[start])
                hit = np.flatnonzero(names[np.minimum(np.searchsorted(names, own), len(names) - 1)] == own) if len(names) else np.zeros(0, np.int64)
                start, stop = start[hit], stop[hit]
                code = Rolling(data).ranges(start, stop + LENGTH - 1) if len(start) else np.zeros(0, np.uint64)
                for col, v in zip(cols, (anchor[start], code, k[hit], np.full(len(hit), len(self.slices)), start), strict=True):
                    col.append(v)
                self.slices.append((batch, lo, hi, data, off, start, stop))
        anchor, code, self.k, self.slice, self.start = (np.concatenate(x) for x in cols)
        by = np.lexsort((self.k, code))
        new = np.concatenate(([True], np.diff(code[by]) != 0)) if len(by) else np.zeros(0, bool)
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        first = by[new]
        self.shares = crowd.of(anchor[first])
        self.hot = self.shares > 1
        deal = np.where(self.hot, code[first] % self.shares + np.uint64(1), np.uint64(0))
        self.shard = (mix(anchor[first] + deal * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((code[first], self.hot, self.shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which = place[which]
        self.first, self.shares, self.hot, self.shard = first[order], self.shares[order], self.hot[order], self.shard[order]
        self.anchor, self.code, self.least = anchor[self.first], code[self.first], self.k[self.first]

    def dealt(self) -> Iterator[tuple[int, bool, int, int]]:
        """Shard, whether crowded, first and end place in the list."""
        key = self.shard * 2 + self.hot
        cut, n = _grouped(key)
        for a, m in zip(cut.tolist(), n.tolist(), strict=True):
            yield int(key[a]) >> 1, bool(key[a] & 1), a, a + m


CONTEXTS = "shard int, hot boolean, chunk long, code binary, id binary, size binary, context binary, anchor binary, shares binary"


def _contexts(shards: int, crowd: _Crowd):
    """A chunk: per shard its distinct shared contexts with their smallest ids. A crowded anchor's shard depends on the
    context, too."""
    schema = pa.schema([("shard", pa.int32()), ("hot", pa.bool_()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("code", "id", "size", "context", "anchor", "shares"))])

    def run(texts_: pa.Table, told: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return schema.empty_table()
        asked, out = _Asked(texts_, told, shards, crowd), []
        raw = [x[3].tobytes() for x in asked.slices]
        size = np.concatenate([np.zeros(0, np.int64), *(x[6] - x[5] for x in asked.slices)])[asked.first] + LENGTH - 1
        where = list(zip(asked.slice[asked.first].tolist(), asked.start[asked.first].tolist(), size.tolist(), strict=True))
        chunk = texts_.column("chunk")[0].as_py()
        for shard, hot, a, z in asked.dealt():
            text = b"".join([raw[s][p : p + n] for s, p, n in where[a:z]])
            out.append((shard, hot, chunk, asked.code[a:z].tobytes(), asked.least[a:z].tobytes(), size[a:z].astype(np.uint8).tobytes(), text, asked.anchor[a:z].tobytes() if hot else None, asked.shares[a:z].astype(np.uint32).tobytes() if hot else None))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


class _Shard:
    """The distinct contexts of a shard with their smallest ids, and which chunks ask for which."""

    def __init__(self, group: pa.Table):
        codes = _blobs(group, "code", np.uint64)
        self.chunk, self.ends = group.column("chunk").to_numpy(), np.cumsum([0] + [len(x) for x in codes])
        code, self.k, size = (np.concatenate(x) for x in (codes, _blobs(group, "id", np.int64), _blobs(group, "size", np.uint8)))
        by = np.lexsort((self.k, code))
        new = np.concatenate(([True], np.diff(code[by]) != 0))
        self.which = np.empty(len(by), np.int64)
        self.which[by] = np.cumsum(new) - 1
        self.own = by[new]
        self.code, self.least = code[self.own], self.k[self.own]
        at = np.cumsum(size, dtype=np.int64) - size
        raw = b"".join(group.column("context").to_pylist())
        self.contexts = [raw[p : p + n] for p, n in zip(at[self.own].tolist(), size[self.own].tolist(), strict=True)]


#: Shards of crowded anchors answer under numbers below zero.
ANSWER = "chunk long, shard int, mask binary"
SETTLED = "kind int, chunk long, shard int, mask binary, anchor long, class long, strings binary, least binary, which binary, own binary, code binary, place binary"
ANSWERED, STRINGS, ASKED = range(3)
_SHAPE = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("shard", pa.int32()), ("mask", pa.binary()), ("anchor", pa.int64()), ("class", pa.int64()), *((c, pa.binary()) for c in ("strings", "least", "which", "own", "code", "place"))])


def _shaped(kind: int, n: int, **cols) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in list(_SHAPE)[1:])], schema=_SHAPE)


def _settled(group: pa.Table) -> pa.Table:
    """A row for each chunk that asked, with what goes of each of its contexts: ALL where a smaller id has the context.

    Of a shard of crowded anchors instead a row per anchor and class, with the class's distinct strings in suffix order,
    their smallest ids, and the contexts and places that they are from; and per chunk which contexts it asks for, and
    whether a smaller id has them."""
    s = _Shard(group)
    context, place, kind, least = least_ids(s.contexts, s.least)
    spans = list(zip(s.ends, s.ends[1:], strict=False))
    lost, shard = s.k > s.least[s.which], group.column("shard")[0].as_py()
    if not group.column("hot")[0].as_py():
        mask = masks(context, place, least < s.least[context], len(s.contexts)).astype(np.uint32)
        answer = np.where(lost, ALL, mask[s.which])
        return _shaped(ANSWERED, len(spans), chunk=s.chunk, shard=[shard] * len(spans), mask=[answer[a:z].tobytes() for a, z in spans])
    asked = _shaped(ASKED, len(spans), chunk=s.chunk, shard=[shard] * len(spans), code=[s.code[s.which[a:z]].tobytes() for a, z in spans], mask=[lost[a:z].tobytes() for a, z in spans])
    anchor, shares = (np.concatenate(_blobs(group, c, t))[s.own] for c, t in (("anchor", np.uint64), ("shares", np.uint32)))
    text = np.frombuffer(b"".join(s.contexts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(c) for c in s.contexts])))[context] + place
    if not len(at):
        return asked
    raw, number = np.empty((len(at), LENGTH), np.uint8), np.zeros(len(at), np.uint64)
    for j in range(LENGTH):
        raw[:, j] = text[at + j]
        number = (number + raw[:, j]) * np.uint64(0xD6E8FEB86659FD93)
    strings = raw.view(f"S{LENGTH}").reshape(-1)
    class_ = (mix(number) % shares[context].astype(np.uint64)).astype(np.int64)
    by = np.lexsort((np.arange(len(strings)), class_, anchor[context]))
    key = anchor[context][by]
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (np.diff(class_[by]) != 0))))
    out: dict[str, list] = {c: [] for c in ("anchor", "class", "strings", "least", "which", "own", "code", "place")}
    for a, z in zip(cut, [*cut[1:], len(by)], strict=True):
        x = by[a:z]
        new = np.concatenate(([True], kind[x][1:] != kind[x][:-1]))  # equal strings are neighbours
        for name, v in (("strings", strings[x][new]), ("least", least[x][new]), ("which", (np.cumsum(new) - 1).astype(np.int32)), ("own", s.least[context[x]]), ("code", s.code[context[x]]), ("place", place[x])):
            out[name].append(v.tobytes())
        out["anchor"].append(int(anchor[context[x[0]]].view(np.int64)))
        out["class"].append(int(class_[x[0]]))
    return pa.concat_tables([asked, _shaped(STRINGS, len(out["anchor"]), shard=[shard] * len(out["anchor"]), **out)])


def _merge(group: pa.Table) -> pa.Table:
    """The runs of one anchor and class: for each run's shard the strings of its contexts that go."""
    found = merged(_blobs(group, "strings", f"S{LENGTH}"), _blobs(group, "least", np.int64))
    out: dict[str, list] = {"code": [], "mask": []}
    for least, *cols in zip(found, *(_blobs(group, c, t) for c, t in (("which", np.int32), ("own", np.int64), ("code", np.uint64), ("place", np.int64))), strict=True):
        which, own, code, place = cols
        codes, context = np.unique(code, return_inverse=True)
        out["code"].append(codes.tobytes())
        out["mask"].append(masks(context, place, least[which] < own, len(codes)).astype(np.uint32).tobytes())
    return pa.table({"shard": group.column("shard"), "code": pa.array(out["code"], pa.binary()), "mask": pa.array(out["mask"], pa.binary())})


def _answered(asks: pa.Table, found: pa.Table) -> pa.Table:
    """A shard of crowded anchors: its answers to the chunks, from what the merges found for its contexts."""
    code, mask = (np.concatenate([np.zeros(0, t), *_blobs(found, c, t)]) for c, t in (("code", np.uint64), ("mask", np.uint32)))
    by = np.argsort(code, kind="stable")
    cut, _ = _grouped(code[by])
    code, mask = code[by][cut], np.bitwise_or.reduceat(mask[by], cut) if len(cut) else mask
    out = []
    for own, lost in zip(_blobs(asks, "code", np.uint64), _blobs(asks, "mask", np.bool_), strict=True):
        at = np.searchsorted(code, own)
        if not (len(code) and (code[np.minimum(at, len(code) - 1)] == own).all()):
            raise ValueError("a context has no answer")
        out.append(np.where(lost, ALL, mask[at]).tobytes())
    return pa.table({"chunk": asks.column("chunk"), "shard": pa.array([-1 - x for x in asks.column("shard").to_pylist()], pa.int32()), "mask": pa.array(out, pa.binary())})


RESULT = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(shards: int, crowd: _Crowd):
    """A chunk's texts, the names of shared anchors and the answers to their contexts: what goes from each text."""

    def run(texts_: pa.Table, told: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return RESULT.empty_table()
        asked = _Asked(texts_, told.filter(pc.is_valid(told.column("names"))), shards, crowd)
        given = told.filter(pc.is_null(told.column("names")))
        by_shard = dict(zip(given.column("shard").to_pylist(), _blobs(given, "mask", np.uint32), strict=True))
        answer = np.zeros(len(asked.first), np.uint32)
        for shard, hot, a, z in asked.dealt():
            answer[a:z] = by_shard[-1 - shard if hot else shard]
        # where the smallest id has a context the mask says what goes; elsewhere all of it does
        bits = np.where(asked.k > asked.least[asked.which], ALL, answer[asked.which])
        out: list[tuple] = []
        seen = 0
        for batch, lo, hi, data, off, start, stop in asked.slices:
            own, seen = bits[seen : seen + len(start)], seen + len(start)
            whole = own == ALL
            marks = np.bincount(start[whole], minlength=len(data) + 1) - np.bincount(stop[whole] - 1 + LENGTH, minlength=len(data) + 1)
            some = np.flatnonzero(~whole & (own > 0))
            for j in range(GRAMS if len(some) else 0):
                w = start[some[(own[some] >> np.uint32(j) & np.uint32(1)) == 1]] + j
                np.add.at(marks, w, 1)
                np.add.at(marks, w + LENGTH, -1)
            covered = np.cumsum(marks[:-1]) > 0
            ids = batch.column("k").slice(lo, hi - lo).to_pylist()
            for i in range(hi - lo):
                c, text = covered[off[i] : off[i + 1]], data[off[i] : off[i + 1]]
                sha = hashlib.sha256(text).hexdigest()
                if not c.any():
                    out.append((ids[i], len(text), 0, 0, sha, sha, []))
                    continue
                spans = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0])))).reshape(-1, 2)
                out.append((ids[i], len(text), int(c.sum()), len(spans), hashlib.sha256(text[~c]).hexdigest(), sha, [{"start": a, "end": z} for a, z in spans.tolist()]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, text_sha256 (before), and the removed spans in bytes."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, shards, chunks = (max(1, -(-total // n)) for n in (part_bytes, shard_bytes, chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("k", "text"), F.lit(chunks)))

    judged = _anchors_of(rows, parts).groupBy("part").applyInArrow(_judged(split), "chunk long, names binary, slot long, shares long")
    judged = stored(judged, "repeats-judged")
    # at most SLOTS rows, whatever the corpus
    crowd = _Crowd({r.slot: r.shares for r in judged.filter("slot is not null").groupBy("slot").agg(F.max("shares").alias("shares")).collect()})
    told = judged.filter("names is not null").select("chunk", "names")

    by_chunk = rows.groupBy("chunk")
    asked = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_contexts(shards, crowd), CONTEXTS)
    settled = stored(asked.groupBy("shard", "hot").applyInArrow(_settled, SETTLED), "repeats-settled")
    answers = settled.filter(F.col("kind") == ANSWERED).select("chunk", "shard", "mask")
    if len(crowd.slots):
        strings = settled.filter(F.col("kind") == STRINGS).select("shard", "anchor", "class", "strings", "least", "which", "own", "code", "place")
        found = strings.groupBy("anchor", "class").applyInArrow(_merge, "shard int, code binary, mask binary")
        asks = settled.filter(F.col("kind") == ASKED).select("shard", "chunk", "code", "mask")
        answers = answers.unionByName(asks.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_answered, ANSWER))

    known = told.unionByName(answers, allowMissingColumns=True)
    done = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(_cut(shards, crowd), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, spans " + SPANS)
    return done.select(F.when(F.col("k") != LAST, F.col("k")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_sha256", "spans")
