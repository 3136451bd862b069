"""Jaccard join of documents on sets of word n-grams, with R-trees over count vectors.

A set's tokens (hashes of n-grams) are hashed into groups; the counts per group are a point. The sum over the
groups of the smaller count bounds the overlap of two sets, and with a node's greatest counts that of all sets below
it. Trees give the pairs that the bound allows; the sets of those are then compared exactly.

1. Equal sets are one vertex, labelled by a hash of the set.
2. Sets that overlap by the threshold share one of the first tokens of each, in any order that holds for all sets
   (prefix filtering). The order puts tokens first that are rare in a count sketch of fixed size over all documents,
   so that a passage which many documents hold seldom brings them together. A first token counts as shared if sets
   of fitting sizes have it; sets without one are done.
3. In each bucket of a shared first token a tree joins the sets that the bound allows. Only a spanning forest of a
   part's pairs leaves it; its connected components hold every link. Large sets go to buckets of tokens that many of
   them hold only; two that share no such token, of a and b tokens, a <= b, must share percent / (100 + percent) * (a + b)
   - percent / 100 * b + 1 first tokens (both rounded up), which are counted: up to the smaller of their last first
   tokens, one set has no others in common with the other.
4. Each such component is joined exactly, again by a tree, where pairs that are connected already are not compared.
   In a component above LIMIT sets all meet a few representatives first; large clusters that these connect aren't
   compared within, and their blocks meet those of the others.

Only who is connected counts, so no task emits more than a forest. Defined results: null, empty and blank texts have
an empty set, link with nothing and are their own component; with fewer words than n the whole sequence is one
token; repeated rows are equal sets; null ids come after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.common import LOWER, Rolling, blob_rows, mix, portions, salted_join, spent, stored, texts, words
from fernglass.llm.components import components

#: Slots of the sketch: one for so many bytes of text, so that what a slot holds besides a token doesn't hide how often
#: the token comes; and at least and at most so many, as every task has them all (a byte each). The order need not be
#: exact: past the most, tokens are told apart less well and more sets are compared.
SLOT_BYTES = 1 << 10
SKETCH, SKETCH_MOST = 1 << 18, 1 << 24
SEGMENT = 1 << 14
#: Tokens that a task counts before it passes the counts on; bytes of text whose counts one task adds up.
COUNTED = 1 << 22
SUMMED_BYTES = 64 << 30
LEAF = 32
#: Bytes of text per part of the first tokens; sets of a component, or of a bucket, and their tokens, that one task
#: joins.
PART_BYTES = 16 << 20
LIMIT = 2048
LIMIT_TOKENS = 1 << 20
#: Sets of one bucket that a task sends on. Of more, those whose sizes follow each other without a gap are taken as
#: candidates of each other, and only a few that step from the least to the greatest size are sent. What else comes with
#: their token, in sizes without a gap, is joined to them whatever the counts say, as it may link with one not sent.
CROWD = 256
#: Sets of so many tokens have first tokens in almost every part, and counts that grow as well: they would be sent about
#: as often as they have tokens. They are met by counting the first tokens that each two share. A token that more of them
#: hold than FAR_HOLDERS (FAR_OF_TASK of a task) brings them to a bucket, counts and all.
FAR = 384
FAR_HOLDERS = 16
FAR_OF_TASK = 4
LAST = 2**63 - 1
_FACTORS = np.random.default_rng(23).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sets:
    """The token sets of a slice of texts: tokens sorted by row and value, without repeats."""

    def __init__(self, data: np.ndarray, off: np.ndarray, n: int):
        rows = len(off) - 1
        low = LOWER[data]
        start, end, row = words(low, off)
        h = Rolling(low).ranges(start, end) if len(start) else np.zeros(0, np.uint64)
        count = np.bincount(row, minlength=rows)
        first = np.cumsum(count) - count
        if len(h) >= n:
            token = np.zeros(len(h) - n + 1, np.uint64)
            for j in range(n):
                token += h[j : len(h) - n + 1 + j] * _FACTORS[j]
            whole = row[: len(token)] == row[n - 1 :]
            token, owner = mix(token[whole]), row[: len(token)][whole]
        else:
            token, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            few = np.zeros(len(short), np.uint64)
            for j in range(n - 1):
                has = count[short] > j
                few[has] += h[first[short[has]] + j] * _FACTORS[j]
            token = np.concatenate((token, mix(few + _FACTORS[32 + count[short]])))
            owner = np.concatenate((owner, short))
        by = np.argsort(token, kind="stable")
        by = by[np.argsort(owner[by].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
        token, owner = token[by], owner[by]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, self.row = token[new], owner[new]
        self.size = np.bincount(self.row, minlength=rows)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        sums = np.zeros(rows, np.uint64)
        if len(self.token):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.token ^ _FACTORS[40]))))
            sums = total[self.at[1:]] - total[self.at[:-1]]
        #: A label of the set as a whole.
        self.code = mix(sums + self.size.astype(np.uint64) * _FACTORS[41]).view(np.int64)


def first_tokens(token: np.ndarray, row: np.ndarray, size: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the first tokens of each set in the common order, and their rows. A key holds a token's rarity,
    then bits of its hash, so keys sort as the order has it."""
    key = rarity[slots_of(token, len(rarity))].astype(np.uint64) << np.uint64(56) | token >> np.uint64(8)
    by = np.argsort(key, kind="stable")
    by = by[np.argsort(row[by].astype(np.uint16 if len(size) < 65536 else np.int64), kind="stable")]
    key, row = key[by], row[by]
    at = np.cumsum(size) - size
    keep = np.arange(len(key)) - at[row] < (size - (percent * size + 99) // 100 + 1)[row]
    return key[keep], row[keep]


def slots_of(token: np.ndarray, slots: int) -> np.ndarray:
    """A token's place in a sketch of so many slots, a power of two: the first bits of its hash."""
    return (token >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """A class for each count, an eighth of a power of two."""
    return np.clip(np.round(8 * np.log2(np.maximum(counts, 1))), 0, 255).astype(np.uint8)


def rarity_of(classes: np.ndarray) -> np.ndarray:
    """How far each slot's class is above the median slot's; rarer first."""
    return np.maximum(classes, usual := np.uint8(np.median(classes))) - usual


def enough(overlap, a, b, percent: int):
    """Whether overlap / (a + b - overlap) reaches percent / 100."""
    return (100 + percent) * overlap >= percent * (a + b)


def size_runs(sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Places of rising sizes in runs without a gap: sets of different runs can't link."""
    gap = np.flatnonzero(100 * sizes[:-1] < percent * sizes[1:]) + 1
    return np.split(np.arange(len(sizes)), gap) if len(sizes) else []


def stones(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Of a run of rising sizes, a few that still have no gap: whatever fits the size of one that is left out is in one
    run with the ones that stay."""
    stays, at = np.zeros(len(sizes), bool), 0
    while at < len(sizes):
        stays[at] = True
        # the greatest size that fits, or the next one
        at = max(at + 1, int(np.searchsorted(percent * sizes, 100 * sizes[at], side="right")) - 1)
    stays[-1:] = True
    return stays


class CountTree:
    """An R-tree over count vectors, packed bottom-up from points sorted by size, then by their fullest groups."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        slab = np.argsort(sizes, kind="stable")
        ranks = np.empty(len(sizes), np.int64)
        ranks[slab] = np.arange(len(sizes)) // (LEAF * 8)
        fullest = counts.argmax(1) if len(counts) else np.zeros(0, int)
        self.order = np.lexsort((counts[np.arange(len(counts)), fullest], fullest, ranks)) if len(counts) else slab
        self.counts, self.sizes = counts[self.order].astype(np.int32), sizes[self.order]
        self.levels = []  # of nodes: greatest counts, least and greatest size
        most, lo, hi = self.counts, self.sizes, self.sizes
        while len(most) > 1:
            cut = np.arange(0, len(most), LEAF)
            most, lo, hi = np.maximum.reduceat(most, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((most, lo, hi))

    def near(self, point: np.ndarray, size: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Points whose overlap with this one may suffice; wanted: those that matter, by their original place."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.counts))
        for k in range(len(self.levels) - 1, -1, -1):
            most, lo, hi = self.levels[k]
            fits = (100 * hi[at] >= self.percent * size) & (100 * size >= self.percent * lo[at])
            at = at[fits]
            at = at[enough(np.minimum(most[at], point).sum(1), size, lo[at], self.percent)]
            below = len(self.levels[k - 1][0]) if k else len(self.counts)
            at = (at[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            at = at[at < below]
        if wanted is not None:
            at = at[wanted[self.order[at]]]
        at = at[enough(np.minimum(self.counts[at], point).sum(1), size, self.sizes[at], self.percent)]
        return self.order[at]


def count_vectors(token: np.ndarray, row: np.ndarray, rows: int, groups: int) -> np.ndarray:
    return np.bincount(row * groups + (token & np.uint64(groups - 1)).astype(np.int64), minlength=rows * groups).reshape(rows, groups)


def groups_of(size: np.ndarray) -> np.ndarray:
    """How many groups a set of a size is counted in, so that a group holds about a dozen tokens: a power of two."""
    return (2 ** np.clip(np.ceil(np.log2(np.maximum(size, 1) / 12)), 4, 10)).astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts in fewer groups."""
    return counts.reshape(len(counts), -1, groups).sum(1)


def forest(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that link, as few as connect all that linked pairs connect. block: with two blocks, only pairs
    of one from each are looked for."""
    size = np.array([len(s) for s in sets], np.int64)
    groups = int(groups_of(size.max(initial=1)))
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(size)))
    counts = count_vectors(flat, row, len(sets), groups)
    tree, label, found = CountTree(counts, size, percent), np.arange(len(sets)), []
    for i in np.argsort(-size, kind="stable"):
        wanted = label != label[i]
        if block is not None:
            wanted &= block != block[i]
        if not wanted.any():
            continue
        near = tree.near(counts[i], size[i], wanted)
        # in steps: who gets connected on the way needs no comparison
        for step in range(0, len(near), 64):
            own = near[step : step + 64]
            own = own[label[own] != label[i]]
            if not len(own):
                continue
            n = size[own]
            tokens = flat[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            place = np.searchsorted(sets[i], tokens)
            hit = sets[i][np.minimum(place, len(sets[i]) - 1)] == tokens
            overlap = np.add.reduceat(hit, np.cumsum(n) - n)
            for j in own[enough(overlap, size[i], n, percent)]:
                if label[j] != label[i]:
                    found.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
    return found


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _scan(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """(k, t, code, size) of every text (segment null), t a hash of the text; and counts of the sketch by segment, a
    byte each (what is above 255 is common anyway), for each COUNTED tokens of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "t", "code", "size", "segment", "counts"]
        met: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            place = np.sort(np.concatenate(met))
            met.clear()
            cut = np.searchsorted(place, np.arange(0, slots + 1, SEGMENT))
            own = np.flatnonzero(np.diff(cut))
            blobs = [zlib.compress(np.minimum(np.bincount(place[cut[i] : cut[i + 1]] - i * SEGMENT, minlength=SEGMENT), 255).astype(np.uint8), 1) for i in own.tolist()]
            none = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names)

        for batch in batches:
            for lo, hi, data, off in texts(batch, "text"):
                s = Sets(data, off, n)
                met.append(slots_of(s.token, slots).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), batch.column("t").slice(lo, hi - lo), pa.array(s.code), pa.array(s.size.astype(np.int64)), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
                if sum(map(len, met)) >= COUNTED:
                    yield counted()
        if met:
            yield counted()

    return docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, "k long, t long, code long, size long, segment int, counts binary")


def _added(last: bool):
    """Counts of a segment added up, or at last their classes."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.int64)
        for x, width in zip(group.column("counts"), group.column("width").to_pylist(), strict=True):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8 if width == 1 else np.int64)
        blob = classes_of(total).tobytes() if last else zlib.compress(total, 1)
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int32()), "width": pa.array([8], pa.int32()), "counts": pa.array([blob], pa.binary())})

    return run


def _sketch_of(scan: DataFrame, slots: int, total: int) -> np.ndarray:
    """The classes of all slots, a byte each."""
    schema = "segment int, width int, counts binary"
    rows = scan.filter("segment is not null").select("segment", F.lit(1).alias("width"), "counts")
    if total > SUMMED_BYTES:
        salt = F.pmod(F.xxhash64("counts"), F.lit(-(-total // SUMMED_BYTES)))
        rows = rows.withColumn("salt", salt).groupBy("segment", "salt").applyInArrow(_added(False), schema)
    out = np.zeros(slots, np.uint8)
    for r in rows.groupBy("segment").applyInArrow(_added(True), schema).collect():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(bytes(r.counts), np.uint8)
    return out


def _first_tokens(docs: DataFrame, n: int, percent: int, rarity: np.ndarray, parts: int, far: int) -> DataFrame:
    """Per task and part: keys with a set below `far` tokens that has them, its size, and whether several sets of the
    task do; the (key, set, size) of larger sets and of those that fit them, one if too many sets of the task have the
    key; and the (key, set) pairs of keys that several have, or too many, dealt by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            found: list[list] = [[], [], []]
            for _, _, data, off in texts(batch, "text"):
                s = Sets(data, off, n)
                key, row = first_tokens(s.token, s.row, s.size, rarity, percent)
                for col, v in zip(found, (key, s.code[row], s.size[row]), strict=True):
                    col.append(v)
            if not found[0] or not sum(map(len, found[0])):
                continue
            key, code, size = (np.concatenate(x) for x in found)
            by = np.lexsort((code, key))
            key, code, size = key[by], code[by], size[by]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])))
            key, code, size = key[new], code[new], size[new]
            parts_of = lambda x: (mix(x) % np.uint64(parts)).astype(np.int64)
            out, known = {}, []
            for name, own, most in (("asked", size < far, 1), ("far", 100 * size >= percent * far, FAR_OF_TASK)):
                k, c, z = key[own], code[own], size[own].astype(np.int32)
                new_key = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
                many = np.diff(np.concatenate((np.flatnonzero(new_key), [len(k)]))) > most
                many = many[np.cumsum(new_key) - 1]
                known.append((k[many], c[many]))
                sent = new_key | ~many
                out[name] = (parts_of(k[sent]), (k[sent], c[sent], z[sent], many[sent]))
            known = [np.concatenate(x) for x in zip(*known, strict=True)]
            out["known"] = (parts_of(known[1].view(np.uint64)), known)
            for name, (part, cols) in out.items():
                own, blobs = blob_rows(part, *cols)
                out[name] = dict(zip(own.tolist(), zip(*blobs, strict=True), strict=True))
            rows = [(p, *out["asked"].get(p, (b"",) * 4), *out["far"].get(p, (b"",) * 4), *out["known"].get(p, (b"",) * 2)) for p in sorted(set().union(*out.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *(pa.binary(),) * 10), strict=True)], ["part", "key", "code", "size", "many", "far_key", "far_code", "far_size", "far_many", "known", "holder"])

    return docs.mapInArrow(run, "part int, key binary, code binary, size binary, many binary, far_key binary, far_code binary, far_size binary, far_many binary, known binary, holder binary")


def least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens sets of a and b tokens share at least if they link."""
    overlap = -(-percent * (a + b) // (100 + percent))
    return overlap + 1 - -(-percent * np.maximum(a, b) // 100)


def _met(percent: int, far: int):
    """A part: sets with those of their keys that a set of a fitting size has as well (other null); and pairs of sets, one
    of them large, with how many keys of the part they share (n) and must share in all (need)."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])

        def fitting(prefix: str) -> tuple[np.ndarray, ...]:
            """By key and size: key, set, size, whether a set of the key fits that its task didn't know, how many sets
            have the key, and whether a task has left some out."""
            key, code, size, many = read(f"{prefix}key", np.uint64), read(f"{prefix}code", np.int64), read(f"{prefix}size", np.int32).astype(np.int64), read(f"{prefix}many", np.bool_)
            if not len(key):
                return key, code, size, many, size, many
            by = np.lexsort((~many, code, size, key))
            key, code, size, many = key[by], code[by], size[by], many[by]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])))
            key, code, size, many = key[new], code[new], size[new], many[new]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.concatenate((cut, [len(key)])))
            # sizes rise within a key, so a set fits one of the others if it fits a neighbour
            near = (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])
            left = np.repeat(np.logical_or.reduceat(many, cut), n)
            n = np.repeat(n, n)
            fits = np.concatenate((near, [False])) | np.concatenate(([False], near)) | left & (n > 1)
            return key, code, size, fits & ~many, n, left  # of many sets those are known already

        key, code, _, fits, _, _ = fitting("")
        keys, codes = [key[fits], read("known", np.uint64)], [code[fits], read("holder", np.int64)]
        key, code, size, fits, n, left = fitting("far_")
        crowded = left | (n > FAR_HOLDERS)
        keys.append(key[fits & crowded])
        codes.append(code[fits & crowded])
        key, code, size = key[~crowded], code[~crowded], size[~crowded]
        pairs = []
        for d in range(1, min(FAR_HOLDERS, len(key))):
            i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] >= far) & (100 * size[:-d] >= percent * size[d:]))
            pairs.append(np.stack([np.minimum(code[i], code[i + d]), np.maximum(code[i], code[i + d]), least_shared(size[i], size[i + d], percent)]))
        pairs = np.concatenate(pairs, 1) if pairs else np.zeros((3, 0), np.int64)
        pairs = pairs[:, np.lexsort(pairs[1::-1])]
        cut = np.flatnonzero(np.concatenate(([True], (pairs[:2, 1:] != pairs[:2, :-1]).any(0)))) if pairs.shape[1] else np.zeros(0, np.int64)
        shared, pairs = np.diff(np.concatenate((cut, [pairs.shape[1]]))), pairs[:, cut]

        key, code = np.concatenate(keys), np.concatenate(codes)
        by = np.argsort(code, kind="stable")
        key, code = key[by], code[by]
        cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        blobs = [key[a:z].tobytes() for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(code)], strict=True)] if len(cut) else []
        one, two = len(cut), pairs.shape[1]
        none = lambda m, t: pa.nulls(m, t)
        return pa.table({
            "code": pa.array(np.concatenate((code[cut], pairs[0]))), "keys": pa.concat_arrays([pa.array(blobs, pa.binary()), none(two, pa.binary())]),
            "other": pa.concat_arrays([none(one, pa.int64()), pa.array(pairs[1])]), "n": pa.concat_arrays([none(one, pa.int32()), pa.array(shared, pa.int32())]), "need": pa.concat_arrays([none(one, pa.int32()), pa.array(pairs[2], pa.int32())]),
        })

    return run


def _buckets(rows: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """rows: (text, code, keys). Per task and part: its sets (code, size, counts) and which keys they have; and pairs
    of sets in crowded buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            want = batch.column("code").to_numpy()
            lists = batch.column("keys")
            found: list[list] = [[] for _ in range(5)]
            seen = 0
            for lo, hi, data, off in texts(batch, "text"):
                s = Sets(data, off, n)
                rows_ = np.flatnonzero(s.code == want[lo:hi])  # an id may be repeated with another text
                width = groups_of(s.size)
                at = np.cumsum(width) - width
                every = np.bincount(at[s.row] + (s.token & (width[s.row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(width.sum())).astype(np.uint16)
                counts = [every[at[i] : at[i] + width[i]].tobytes() for i in rows_]
                own = [np.unique(np.frombuffer(b"".join(lists[lo + int(i)].as_py()), np.uint64)) for i in rows_]
                for col, v in zip(found, (s.code[rows_], s.size[rows_].astype(np.int64), np.array(counts, object), np.concatenate(own) if own else np.zeros(0, np.uint64), np.repeat(np.arange(seen, seen + len(rows_)), [len(x) for x in own])), strict=True):
                    col.append(v)
                seen += len(rows_)
            if not seen:
                continue
            code, size, counts, key, row = (np.concatenate(c) for c in found)
            by = np.lexsort((row, key))
            key, row = key[by], row[by]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            m = np.diff(np.concatenate((cut, [len(key)])))
            crowded, stays, pairs = np.repeat(m > CROWD, m), np.ones(len(key), bool), []
            for x, n_ in zip(cut[m > CROWD].tolist(), m[m > CROWD].tolist(), strict=True):
                at = x + np.argsort(size[row[x : x + n_]], kind="stable")
                for run_ in size_runs(size[row[at]], percent):
                    own = at[run_]
                    stays[own] = stones(size[row[own]], percent)
                    pairs.append(np.stack([code[row[np.repeat(own[:1], len(own) - 1)]], code[row[own[1:]]]], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            key, row, crowded = key[stays], row[stays], crowded[stays]
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            key, row, crowded, part = key[by], row[by], crowded[by], part[by]
            # only the parts that have rows are visited, however many there are; pairs go with any of them
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            out: dict[str, list] = {c: [] for c in ("part", "code", "size", "counts", "key", "own", "crowded", "pairs")}
            for n_, (a, z) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)):
                own, at = np.unique(row[a:z], return_inverse=True)
                for c, v in (("code", code[own]), ("size", size[own]), ("key", key[a:z]), ("own", at.astype(np.int32)), ("crowded", crowded[a:z]), ("pairs", pairs[n_ :: len(cut)])):
                    out[c].append(v.tobytes())
                out["counts"].append(b"".join(counts[own]))
                out["part"].append(int(part[a]))
            if out["part"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("code", "size", "counts", "key", "own", "crowded", "pairs"))]))

    return rows.select("text", "code", "keys").mapInArrow(run, "part int, code binary, size binary, counts binary, key binary, own binary, crowded binary, pairs binary")


def _joined(percent: int):
    """A part: a forest of the pairs that share a key and that the bound allows, as (a, b)."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x, t) for x in group.column(c).to_pylist()]
        codes, owns = read("code", np.int64), read("own", np.int32)
        base = np.cumsum([0] + [len(x) for x in codes])
        code = np.concatenate(codes)
        own = np.concatenate([x + b for x, b in zip(owns, base, strict=False)]).astype(np.int64)
        size, key = np.concatenate(read("size", np.int64)), np.concatenate(read("key", np.uint64))
        counts = np.concatenate(read("counts", np.uint16))
        begin = np.cumsum(groups_of(size)) - groups_of(size)
        code, first, at = np.unique(code, return_index=True, return_inverse=True)
        size, begin, own = size[first], begin[first], at[own]
        width = groups_of(size)

        def vectors(which: np.ndarray, groups: int) -> np.ndarray:
            """Counts of some sets, all in so many groups."""
            out = np.zeros((len(which), groups), np.int32)
            for w in np.unique(width[which]):
                same = np.flatnonzero(width[which] == w)
                out[same] = folded(counts[begin[which[same], None] + np.arange(w)].astype(np.int32), groups)
            return out

        crowded = np.unique(key[np.concatenate(read("crowded", np.bool_))])
        by = np.lexsort((own, key))
        key, own = key[by], own[by]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, bool)
        key, own = key[new], own[new]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        n = np.diff(np.concatenate((cut, [len(key)])))
        hot = np.isin(key[cut], crowded)
        union, found = Union(len(code)), []

        def join(a: int, b: int) -> None:
            if union.join(a, b):
                found.append((a, b))

        for x in read("pairs", np.int64):
            for a, b in x.reshape(-1, 2).tolist():
                found.append((a, b))
        known, found = found, []
        two = cut[(n == 2) & ~hot]
        pairs = np.unique(own[two] * len(code) + own[two + 1])
        a, b = pairs // max(1, len(code)), pairs % max(1, len(code))
        sized = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[sized], b[sized]
        level = np.minimum(width[a], width[b])
        for groups in np.unique(level).tolist():
            at_level = np.flatnonzero(level == groups)
            step = (4 << 20) // groups
            for lo in range(0, len(at_level), step):
                i, j = a[at_level[lo : lo + step]], b[at_level[lo : lo + step]]
                ok = enough(np.minimum(vectors(i, groups), vectors(j, groups)).sum(1), size[i], size[j], percent)
                for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                    join(x, y)
        more = (n > 2) | (n == 2) & hot
        for start, m, every in zip(cut[more].tolist(), n[more].tolist(), hot[more].tolist(), strict=True):
            member = own[start : start + m]
            # sets of fitting sizes only: runs of rising sizes without a gap, each counted in its least width
            member = member[np.argsort(size[member], kind="stable")]
            for place in size_runs(size[member], percent):
                run_ = member[place]
                roots = np.array([union.root(x) for x in run_.tolist()])
                if (roots == roots[0]).all():
                    continue
                if every or len(run_) > LIMIT:  # still a superset of the links; the exact join tells them apart
                    for x in run_[1:].tolist():
                        join(int(run_[0]), x)
                    continue
                point = vectors(run_, int(width[run_].min()))
                tree = CountTree(point, size[run_], percent)
                for x in range(len(run_)):
                    for y in tree.near(point[x], size[run_[x]], np.arange(len(run_)) > x).tolist():
                        join(int(run_[x]), int(run_[y]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        known = np.array(known, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(np.concatenate((code[pairs[:, 0]], known[:, 0]))), "b": pa.array(np.concatenate((code[pairs[:, 1]], known[:, 1])))})

    return run


def _linked(percent: int):
    """A component, or two blocks of one: a forest of its links."""

    def run(group: pa.Table) -> pa.Table:
        code = group.column("code").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        x, y, side = (group.column(c).to_numpy() for c in ("x", "y", "side"))
        pairs = np.array(forest(sets, percent, side if len(x) and x[0] != y[0] else None), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(code[pairs[:, 0]], pa.int64()), "b": pa.array(code[pairs[:, 1]], pa.int64())})

    return run


def _tokens_of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted: (k, code, ...). Its rows with the tokens of the set, for each text of id k that has it."""
    more = [c for c in wanted.columns if c not in ("k", "code")]
    kinds = dict(wanted.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("code").to_numpy()
            for lo, hi, data, off in texts(batch, "text"):
                s = Sets(data, off, n)
                own = np.flatnonzero(s.code == want[lo:hi])  # an id may be repeated with another text
                at = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays([pa.array(s.code[own]), *(batch.column(c).take(at) for c in more), pa.array([s.token[s.at[i] : s.at[i + 1]].tobytes() for i in own], pa.binary())], ["code", *more, "tokens"])

    schema = ", ".join(["code long", *(f"`{c}` {kinds[c]}" for c in more), "tokens binary"])
    # wanted grows with the corpus, whatever the size of its compressed file promises: never broadcast
    return rows.join(wanted.hint("merge"), "k").select("text", "code", *more).mapInArrow(run, schema)


def _joins(rows: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """dealt: (label, code, k, x, y, side). The links that tasks (label, x, y) find: among all their sets if x = y, else
    between the sides."""
    held = _tokens_of(rows, dealt, n)
    return held.groupBy("label", "x", "y").applyInArrow(_linked(percent), "a long, b long")


def _tied(percent: int):
    """A block of a component and the component's representatives (side 1): the links between them."""

    def run(group: pa.Table) -> pa.Table:
        code, side = group.column("code").to_numpy(), group.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        found = []
        for r in np.flatnonzero(side == 1):
            for i in np.flatnonzero(side == 0):
                a, b = len(sets[r]), len(sets[i])
                if 100 * min(a, b) >= percent * max(a, b) and code[i] != code[r]:
                    at = np.minimum(np.searchsorted(sets[r], sets[i]), a - 1)
                    if enough(int((sets[r][at] == sets[i]).sum()), a, b, percent):
                        found.append((code[r], code[i]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


#: Sets of a large component that all others are compared with first, about so many.
REPRESENTATIVES = 8


def _crowd_links(rows: DataFrame, members: DataFrame, n: int, percent: int, limit: int) -> list[DataFrame]:
    """Links of components that are too large for a task. members: (label, code, k, size, n, all_tokens).

    First every set meets a few representatives. Sets that link with one are connected already, so clusters above
    `limit` sets needn't be compared within: their blocks meet those of other clusters and of the rest only. A group of
    near copies of any size is thus joined in steps as many as its blocks; only what links with no representative is
    met by all blocks.
    """
    chance = F.pmod(F.xxhash64("code", F.lit("representative")), F.col("n")) < REPRESENTATIVES
    blocks = F.greatest(F.ceil(F.col("n") / limit), F.ceil(F.col("all_tokens") / LIMIT_TOKENS)).cast("int")
    blocked = members.select("label", "code", "k", F.pmod(F.xxhash64("code"), blocks).cast("string").alias("x"), F.lit(0).alias("side"))
    chosen = members.filter(chance).select("label", "code", "k", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: i.cast("string"))).alias("x"), F.lit(1).alias("side"))
    met = _tokens_of(rows, blocked.unionByName(chosen), n).groupBy("label", "x").applyInArrow(_tied(percent), "a long, b long")
    tied = stored(met, "shingle-tied")
    clusters = components(tied).withColumnRenamed("node", "code").withColumnRenamed("label", "cluster")

    rows_ = members.select("label", "code", "k", "size").join(clusters, "code", "left")
    sizes = rows_.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("of_cluster"))
    rows_ = rows_.join(sizes, "cluster", "left")
    # part: a large cluster, or -1 for all the rest; a cluster is named by a set's hash, which may be any number
    part = F.when(F.col("of_cluster") > limit, F.concat(F.lit("c"), F.col("cluster").cast("string"))).otherwise(F.lit("-"))
    rows_ = stored(rows_.select("label", "code", "k", "size", part.alias("part")).withColumn("key", F.xxhash64("label", "part")), "shingle-parts")
    parts = rows_.groupBy("label", "part", "key").agg(F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum("size") / LIMIT_TOKENS)).cast("int").alias("blocks"))
    names = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.concat("part", F.lit(":"), i.cast("string")))
    every = parts.groupBy("label").agg(F.collect_list(F.struct("part", names.alias("names"))).alias("every"))
    foreign = F.flatten(F.transform(F.filter("every", lambda p: (p["part"] != F.col("part")) | (F.col("part") == "-")), lambda p: p["names"]))
    plan = parts.join(every, "label").select("key", F.col("blocks"), foreign.alias("foreign"))
    dealt = salted_join(rows_, plan, "key", ["code"])
    own = F.concat("part", F.lit(":"), F.pmod(F.xxhash64("code"), F.col("blocks")).cast("string"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode("foreign"))
    dealt = dealt.select("label", "code", "k", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return [tied, stored(_joins(rows, dealt, n, percent), "shingle-crowd-links")]


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, limit: int = LIMIT, part_bytes: int = PART_BYTES, far: int = FAR) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links, its own included), text_hash
    (xxhash64 of the text, to tell rows apart that repeat an id) and component (a number of the component; null for an
    empty set). Two rows link if their sets' overlap is percent / 100 of their union or more."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(SKETCH_MOST, max(SKETCH, 1 << (total // SLOT_BYTES).bit_length()))
    scan = stored(_scan(rows, n, slots), "shingle-sets")
    sets = scan.filter("segment is null").select("k", "t", "code", "size")
    rarity = rarity_of(_sketch_of(scan, slots, total))
    parts = max(1, -(-total // part_bytes))

    vertices = sets.filter("size > 0").groupBy("code", "size").agg(F.min("k").alias("least"))
    met = _first_tokens(rows, n, percent, rarity, parts, far).groupBy("part").applyInArrow(_met(percent, far), "code long, keys binary, other long, n int, need int")
    met = stored(met, "shingle-met")  # the shuffles up to here go before the next ones
    open_ = met.filter("other is null").groupBy("code").agg(F.collect_list("keys").alias("keys")).join(vertices.select("code", F.col("least").alias("k")), "code")
    crowded = _buckets(rows.join(open_.hint("merge"), "k"), n, percent, parts).groupBy("part").applyInArrow(_joined(percent), "a long, b long")
    counted = met.filter("other is not null").groupBy("code", "other").agg(F.sum("n").alias("n"), F.min("need").alias("need")).filter("n >= need")
    pairs = stored(crowded.unionByName(counted.select(F.col("code").alias("a"), F.col("other").alias("b"))), "shingle-pairs")
    spent(met)
    near = components(pairs)

    # exact join of each candidate component
    members = near.withColumnRenamed("node", "code").join(vertices.select("code", "size", F.col("least").alias("k")), "code")
    members = stored(members.select("label", "code", "k", "size"), "shingle-members")
    of_label = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("all_tokens"))
    crowds = of_label.filter((F.col("n") > limit) | (F.col("all_tokens") > LIMIT_TOKENS))
    crowds = stored(crowds, "shingle-crowds")
    parts_ = []
    if crowds.isEmpty():
        small = members
    else:
        small = members.join(crowds, "label", "left_anti")
        parts_ += _crowd_links(rows, members.join(crowds, "label"), n, percent, limit)
    whole = small.select("label", "code", "k", F.lit("").alias("x"), F.lit("").alias("y"), F.lit(0).alias("side"))
    links = stored(_joins(rows, whole, n, percent), "shingle-links")
    for other in parts_:
        links = links.unionByName(other)
    label = components(links).withColumnRenamed("node", "code")

    named = vertices.join(label, "code", "left").withColumn("label", F.coalesce("label", "code"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component"))
    by_code = named.join(lowest, "label").select("code", "component", "label")
    none = sets.filter("size = 0").withColumn("component", F.col("k")).withColumn("label", F.lit(None).cast("long"))
    out = sets.filter("size > 0").join(by_code, "code").unionByName(none)
    spent(pairs, members, crowds)
    back = lambda c: F.when(F.col(c) != LAST, F.col(c)).cast(kind)
    return out.select(back("k").alias(id_col), F.col("size").alias("n_shingles"), back("component").alias("component_id"), F.col("t").alias("text_hash"), F.col("label").alias("component"))
