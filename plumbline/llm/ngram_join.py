"""Documents whose word shingles are alike: a parity-sketch join.

Two documents link when the Jaccard similarity of their shingle sets is at least 3/4.
With sets of sizes a <= b that means: their symmetric difference is at most (a + b) / 7.

*Copies.* Documents with the same sequence of words (case aside) form a class; classes,
not documents, are joined. A class is known by 64 bits of a digest of its words.

*Sketches.* Shingles are hashed into K blocks, and a block is the XOR of the 64-bit hashes
of its shingles: a parity sketch, in which every shingle that only one of two sets has
disturbs one block. So the number of blocks that differ is a lower bound of the symmetric
difference, and sets that differ in at most D shingles agree in at least K - D blocks.

*Size bands.* Bands are so wide that a set can only link to sets of its own band and the
next. A band fixes D, from its largest size, and K = D + 1 + a fifth of D. A class is
sketched for its own band and for the next one.

*Pigeonhole join.* The blocks that hold something are grouped by (band, block, value): a
list of classes for each group. Of the K - D blocks that agree, at most as many are empty
as a class has empty ones, so a class shares ``need`` = K - D - (its empty blocks) lists
with everyone it links to. A class therefore leaves its ``need`` - 1 largest lists (or
all, if it has fewer than ``need``): of the lists that two linked classes share, the
smallest is left by neither. Passages that many documents quote make few large lists,
which drop out this way; nothing is capped. If so many blocks are empty that ``need`` is
not positive, the class also sends its prefix: its least shingles by hash, of which two
linked sets share at least ``shared_prefix`` ones.

*Sifting.* A class also has one small parity sketch of about two bits per shingle. Two
sketches of different length are folded to the shorter one. Pairs whose sizes or whose
Hamming distance rule a link out go no further; few others are no links.

*Clumps.* Lists of the same classes count once. The task that holds a list compares its
classes by size and sketch, and of the pairs that nothing rules out only a spanning forest
leaves it: at most one edge for each class. What the forests of all lists connect is a clump.
Every link is between two classes of one clump, so the text of a class travels once, to its
clump, and not once for every pair.

*Verification within clumps.* Within the task that holds a clump, classes not yet connected
are compared by their exact sets, the nearest sketches first, and only links that connect
something leave it: fewer than there are classes. What any other link would join is already
joined, so the components are the same as those of all links. A clump too large for a task
is dealt in blocks: each block for itself, then one class of every component so found, then,
where several are left, every class outside a clump's largest component against all others.

*Layout.* Map tasks hash whole Arrow batches, sort the blocks and send one compressed run
per bucket; a bucket merges its runs. The number of buckets follows the number of shingles.
Only blocks of one lane (band) can meet, so a lane has buckets of its own, or shares one with
other small lanes: the name of a class goes to the buckets of its two lanes, not to all.
A value that is hot within one map task is settled there: its list goes out in one piece,
and only its smallest class travels on, marked. The bucket writes a list with a marked class
under its own name, so that it and the piece are one; lists without are folded if equal.
Long lists are kept in parts. The size of a list without pieces is known to its bucket; only
those with pieces are put together, and counted, by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.llm.components import components, packed
from plumbline.llm.words import _GAP, mixed, shingles, text_bytes, words_of
from plumbline.sources.pinning import pin

#: A list of more classes leaves a map task in one piece.
HOT = 200
#: Blocks that a map task collects before it sorts and sends them.
RUN = 500_000
#: Blocks that a bucket is meant to merge.
BUCKET = 2_000_000
#: Rows (of three numbers) that may be broadcast; more are joined by shuffle.
BROADCAST = 200_000
#: Classes in one row of a list.
PART = 4096
#: Texts that are hashed together.
STEP = 200
#: Classes, and shingles, of a clump that one task is meant to compare with each other.
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
_LOW = np.uint64(2**40 - 1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- bands


def band_starts(most: int) -> list[int]:
    """Smallest sizes of the bands up to one that starts above ``most``.

    A set of band j links to none below band j - 1: 3/4 of a start reaches the band
    before it.
    """
    starts = [1]
    while starts[-1] <= most:
        low = starts[-1]
        starts.append(max(low + 1, 4 * (low - 1) // 3 + 1))
    return starts


def blocks_of(band: int, starts: list[int]) -> tuple[int, int]:
    """K and D of a band."""
    differ = 2 * (starts[band + 1] - 1) // 7
    return differ + 1 + -(-differ // 5), differ


def shared_prefix(band: int, starts: list[int]) -> int:
    """How many shingles the prefixes of two linked sets of a band share at least."""
    return 1 + 3 * starts[band] // 32


def _bands(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    starts = band_starts(int(sizes.max(initial=1)) * 2 + 8)
    return np.searchsorted(starts, sizes, side="right") - 1, starts


def sketched(hashes: np.ndarray, first: np.ndarray):
    """Blocks of all sets, given sorted hashes and where each set starts.

    Returns (set, band, value) of the blocks that hold something and, per set and role
    (own band, next band), how many are empty and how many may be.
    """
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    band, starts = _bands(sizes)
    plan = np.array([blocks_of(b, starts) for b in range(len(starts) - 1)], np.int64).reshape(-1, 2)
    scrambled = mixed(hashes ^ _SALT)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, empty, spare = [], [], []
    for role in (0, 1):
        used = np.maximum(band, 0) + role
        k = plan[used, 0]
        block = ((hashes >> np.uint64(32)) * k[owner].astype(np.uint64)) >> np.uint64(32)
        if len(hashes):
            fresh = np.concatenate(
                [[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]
            )
            at = np.flatnonzero(fresh)
            parity = np.bitwise_xor.reduceat(scrambled, at)
            who, where = owner[at], block[at]
        else:
            at = np.zeros(0, np.int64)
            parity, who, where = hashes, at, hashes
        lane = mixed(where * np.uint64(2**20) + used[who].astype(np.uint64))
        out.append((who, used[who], mixed(parity ^ lane)))
        full = np.bincount(who, minlength=len(sizes))
        empty.append(np.where(sizes > 0, k - full, 0))
        spare.append(k - plan[used, 1])
    # sets with too many empty blocks also send their prefix, in a lane of its own
    for role in (0, 1):
        used = np.maximum(band, 0) + role
        extra = np.array([shared_prefix(b, starts) for b in range(len(starts))], np.int64)[used]
        short = some[empty[role][some] >= spare[role][some]]
        length = np.minimum(sizes[short], sizes[short] - -(-3 * sizes[short] // 4) + extra[short])
        who = np.repeat(short, length)
        step = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length)
        value = hashes[first[who] + step] if len(who) else hashes[:0]
        lane = mixed(~used[who].astype(np.uint64))
        out.append((who, -1 - used[who], mixed(value ^ lane)))
    who, lanes, values = (np.concatenate([o[i] for o in out]) for i in range(3))
    return who, lanes, values, empty, spare, np.maximum(band, 0)


def small_sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """One parity sketch per set, of a power of two of bits, at least two per shingle."""
    sizes = np.diff(first)
    bits = 1 << np.ceil(np.log2(np.maximum(64, 2 * sizes))).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mixed(hashes ^ (_SALT + np.uint64(1))) & (bits[owner] - 1).astype(np.uint64)
    odd = np.bincount(place.astype(np.int64) + start[:-1][owner], minlength=int(start[-1])) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def apart(one: bytes, other: bytes) -> int:
    """Hamming distance of two sketches, folded to the same length."""
    if len(one) > len(other):
        one, other = other, one
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    if len(a) < len(b):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


# ---------------------------------------------------------------- classes


def _class_ids(column: pa.Array) -> np.ndarray:
    """64 bits of a digest of each text's words, 0 for texts without words."""
    out = []
    for value in column:
        words = (value.as_py() or "").encode("utf-8", "replace").lower().split()
        digest = hashlib.blake2b(b" ".join(words), digest_size=8).digest()
        out.append(int.from_bytes(digest, "little", signed=True) if words else 0)
    return np.array(out, np.int64)


_MEMBER = (
    "doc_id bigint, __file bigint, __row bigint, class bigint, n_shingles bigint, "
    "sketch binary, band int, need0 int, need1 int"
)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            text = part.column("text")
            hashes, first = shingles(*words_of(text))
            _, _, _, empty, spare, band = sketched(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("__file"), part.column("__row"),
                    pa.array(_class_ids(text)), pa.array(np.diff(first)),
                    pa.array(small_sketches(hashes, first), pa.binary()),
                    pa.array(band.astype(np.int32)),
                    *[pa.array((spare[r] - empty[r]).astype(np.int32)) for r in (0, 1)],
                ],
                [c.split()[0] for c in _MEMBER.split(", ")],
            )


# ---------------------------------------------------------------- groups

_RUNS = "bucket int, ids binary, keys binary, owners binary, lanes binary, leads binary"
_LISTS = "list bigint, lane int, times int, n int, members array<bigint>"


def _pack(values: np.ndarray) -> bytes:
    """Rising 40-bit numbers: their differences, byte plane by byte plane, compressed."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view("u1").reshape(-1, 8)[:, :5].T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), "u1")
    steps[:, :5] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack_short(values: np.ndarray) -> bytes:
    """16-bit numbers, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.compress(values.astype("<u2").view("u1").reshape(-1, 2).T.tobytes(), 1)


def _unpack_short(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(2, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _dealt(shingles_of: dict[int, int]) -> list[tuple[int, int]]:
    """First bucket of every band, and the power of two of its buckets.

    A class has blocks in its own band and in the next one, in either about a third as
    many as shingles.
    """
    plan: list[tuple[int, int]] = []
    unused = held = 0
    for band in range(max(shingles_of, default=0) + 2):
        size = shingles_of.get(band, 0) + shingles_of.get(band - 1, 0)
        bits = max(0, int(np.ceil(np.log2(max(1, size / (2 * BUCKET))))))
        if plan and not bits and not plan[-1][1] and held + size <= 2 * BUCKET:
            held += size
            plan.append(plan[-1])
        else:
            held = size
            plan.append((unused, bits))
            unused += 1 << bits
    return plan


class _Sender:
    """Collects the blocks of distinct classes and turns them into runs per bucket.

    ``buckets`` is what ``_dealt`` says, or a power of two for all bands.
    """

    def __init__(self, buckets: int | list[tuple[int, int]], hot: int) -> None:
        self.hot = hot
        plan = [(0, buckets.bit_length() - 1)] if isinstance(buckets, int) else buckets
        self.first, self.bits = np.array(plan, np.uint64).T
        self.buckets = plan[-1][0] + (1 << plan[-1][1])
        self.clear()

    def places(self, keys: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Bucket and, in the low 40 bits, key within the bucket."""
        band = np.minimum(np.where(lanes < 0, -1 - lanes, lanes), len(self.bits) - 1)
        bits = self.bits[band]
        bucket = self.first[band] + (keys >> np.uint64(1) >> (np.uint64(63) - bits))
        return bucket << np.uint64(40) | keys >> (np.uint64(24) - bits) & _LOW

    def clear(self) -> None:
        self.classes: dict[int, int] = {}
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, text: pa.Array, ids: np.ndarray) -> None:
        new = []
        for i, c in enumerate(ids.tolist()):
            if c and c not in self.classes:
                self.classes[c] = len(self.classes)
                new.append(i)
        if not new:
            return
        base = len(self.classes) - len(new)
        hashes, first = shingles(*words_of(text.take(pa.array(new))))
        who, lanes, values, *_ = sketched(hashes, first)
        self.parts.append(((who + base).astype("<u2"), lanes.astype("<i2"), values))
        self.held += len(who)

    def full(self) -> bool:
        return self.held >= RUN or len(self.classes) >= 60_000

    def runs(self) -> Iterator[tuple]:
        if not self.held:
            self.clear()
            return
        names = np.fromiter(self.classes, np.int64, len(self.classes))
        who, lanes, keys = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        self.clear()
        keys = self.places(keys, lanes)
        order = np.argsort(keys, kind="stable")
        keys, who, lanes = keys[order], who[order], lanes[order]
        del order
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edge)
        keep = np.ones(len(keys), bool)
        leads = np.zeros(len(keys), bool)
        for g in np.flatnonzero(sizes > self.hot).tolist():
            a, b = int(edge[g]), int(edge[g + 1])
            members = np.sort(names[who[a:b]])
            keep[a:b] = False
            lead = a + int(np.argmin(names[who[a:b]]))
            keep[lead] = leads[lead] = True
            # the whole list goes out at once, to some bucket
            yield (g % self.buckets, b"", keys[a : a + 1].tobytes(), members.tobytes(),
                   lanes[a : a + 1].tobytes(), b"")
        keys, who, lanes, leads = keys[keep], who[keep], lanes[keep], leads[keep]
        bucket = keys >> np.uint64(40)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            here, local = np.unique(who[a:z], return_inverse=True)
            yield (int(bucket[a]), names[here].tobytes(), _pack(keys[a:z] & _LOW), _pack_short(local),
                   _pack_short(lanes[a:z]), np.flatnonzero(leads[a:z]).astype("<u4").tobytes())


def _batch(found: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*found)) if found else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields]
    )


def _sender(buckets: int | list[tuple[int, int]], hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, hot)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sender.add(part.column("text"), part.column("class").to_numpy(zero_copy_only=False))
                if sender.full():
                    yield _batch(list(sender.runs()), _RUNS)
        if found := list(sender.runs()):
            yield _batch(found, _RUNS)

    return run


def _merged(found: pa.Table) -> pa.Table:
    """Lists of classes that share a block, from all runs of a bucket.

    ``times`` tells how many blocks of the bucket have exactly this list, ``n`` how many
    classes it holds. A list of which a map task has sent a piece stands for one block only,
    as its piece does, and has no ``n``.
    """
    keys, owners, lanes, leads = [], [], [], []
    lists: list[tuple] = []
    bucket = found.column("bucket")[0].as_py() if found.num_rows else 0
    for row in found.to_pylist():
        if not row["ids"]:
            name = int(np.frombuffer(row["keys"], "<i8")[0])
            lane = int(np.frombuffer(row["lanes"], "<i2")[0])
            members = np.frombuffer(row["owners"], "<i8")
            lists += [(name, lane, 1, None, members[at : at + PART]) for at in range(0, len(members), PART)]
            continue
        names = np.frombuffer(row["ids"], "<i8")
        keys.append(_unpack(row["keys"]))
        owners.append(names[_unpack_short(row["owners"], "<u2")])
        lanes.append(_unpack_short(row["lanes"], "<i2"))
        leads.append(np.zeros(len(lanes[-1]), bool))
        leads[-1][np.frombuffer(row["leads"], "<u4")] = True
    if keys:
        key, owner, lane, lead = map(np.concatenate, (keys, owners, lanes, leads))
        order = np.argsort(key, kind="stable")
        key, owner, lane, lead = key[order], owner[order], lane[order], lead[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        same: dict[tuple, list] = {}
        for g in np.flatnonzero(np.diff(edge) > 1).tolist():
            a, b = int(edge[g]), int(edge[g + 1])
            members = np.unique(owner[a:b])
            if len(members) > 1:
                name = bucket << 40 | int(key[a])
                mark = (int(lane[a]), members.tobytes(), name if lead[a:b].any() else None)
                same.setdefault(mark, [name, 0])[1] += 1
        for (where, members, piece), (name, times) in same.items():
            whole = np.frombuffer(members, "<i8")
            n = len(whole) if piece is None else None
            lists += [(name, where, times, n, whole[at : at + PART]) for at in range(0, len(whole), PART)]
    return pa.Table.from_batches([_batch(lists, _LISTS)])


# ---------------------------------------------------------------- verification


def _in_groups(work, keys: list[str]):
    """Runs ``work`` on all rows of a key at a time; rows come sorted by the keys.

    ``work`` takes a table and adds pairs (a, b) to a list.
    """

    def edges(part: pa.Table) -> np.ndarray:
        fresh = np.zeros(part.num_rows, bool)
        fresh[:1] = True
        for key in keys:
            column = part.column(key).to_numpy()
            fresh[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        open_parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            open_parts.append(batch)
            kept = pa.Table.from_batches([p.slice(p.num_rows - 1) for p in open_parts[-2:-1]] + [batch])
            if len(edges(kept)) == 1:
                continue  # the group goes on
            kept = pa.Table.from_batches(open_parts)
            starts = edges(kept).tolist()
            for at, end in zip(starts, starts[1:]):
                work(kept.slice(at, end - at), pairs)
                if len(pairs) >= 100_000:
                    yield _batch(pairs, _PAIRS)
                    pairs.clear()
            open_parts = kept.slice(starts[-1]).to_batches()
        if open_parts:
            work(pa.Table.from_batches(open_parts), pairs)
        yield _batch(pairs, _PAIRS)

    return run


_PAIRS = "a bigint, b bigint"


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches folded to the shortest of them, a row of words each."""
    width = min(map(len, sketches)) // 8
    return np.stack(
        [np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, width), axis=0) for x in sketches]
    )


def _likely(u: int, others: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The others that sizes and sketches do not rule out, and how far their sketches are."""
    others = others[(4 * size[others] >= 3 * size[u]) & (4 * size[u] >= 3 * size[others])]
    differ = np.bitwise_count(bits[others] ^ bits[u]).sum(axis=1, dtype=np.int64)
    near = differ <= (size[others] + size[u]) // 7
    return others[near], differ[near]


def _forest(part: pa.Table, pairs: list[tuple[int, int]]) -> None:
    """Edges that connect what the pairs of a list connect that nothing rules out."""
    names, size = part.column("class").to_numpy(), part.column("size").to_numpy()
    bits = _folded(part.column("sketch").to_pylist())
    clump = np.arange(len(names))
    for u in range(len(names) - 1):
        others = u + 1 + np.flatnonzero(clump[u + 1 :] != clump[u])
        if len(others):
            near, _ = _likely(u, others, size, bits)
            if len(near):
                clump[np.isin(clump, np.append(clump[near], clump[u]))] = clump[u]
    order = np.lexsort((names, clump))
    names, clump = names[order], clump[order]
    first = np.flatnonzero(np.concatenate([[True], clump[1:] != clump[:-1]]))
    low = np.repeat(names[first], np.diff(np.append(first, len(names))))
    pairs += zip(low[low != names].tolist(), names[low != names].tolist())


def _links(part: pa.Table, pairs: list[tuple[int, int]]) -> None:
    """Links that connect what all links of a cell connect, by exact sets.

    Classes of one component are not compared, nor, in a cell of two blocks, those of one.
    """
    n = part.num_rows
    sets, sketches, starts = [], [], [np.zeros(1, np.int64)]
    for at in range(0, n, STEP):
        hashes, first = shingles(*words_of(part.slice(at, STEP).column("text").combine_chunks()))
        sets.append(hashes)
        sketches += small_sketches(hashes, first)
        starts.append(first[1:] + starts[-1][-1])
    first = np.concatenate(starts)
    size = np.diff(first)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    del sets
    bits = _folded(sketches)
    names = part.column("class").to_numpy()
    _, group = np.unique(part.column("component").to_numpy(), return_inverse=True)
    block = part.column("block").to_numpy()
    crossed = part.column("low")[0].as_py() != part.column("high")[0].as_py()
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    for u in range(n - 1):
        others = u + 1 + np.flatnonzero(group[u + 1 :] != group[u])
        if crossed:
            others = others[block[others] != block[u]]
        if not len(others):
            continue
        near, differ = _likely(u, others, size, bits)
        near = near[np.argsort(differ, kind="stable")]
        own = ids[first[u] : first[u + 1]]
        marked[own] = True
        many = 1
        while len(near):
            some, near = near[:many], near[many:]
            held = np.concatenate([ids[first[v] : first[v + 1]] for v in some.tolist()])
            common = np.add.reduceat(marked[held], np.cumsum(size[some]) - size[some], dtype=np.int64)
            for v in some[100 * common >= 75 * (size[some] + size[u] - common)].tolist():
                if group[v] != group[u]:
                    pairs.append((int(names[u]), int(names[v])))
                    group[group == group[v]] = group[u]
            near = near[group[near] != group[u]]
            many = min(2 * many, 64)
        marked[own] = False


class _Join:
    def __init__(self, known: DataFrame, members: DataFrame) -> None:
        self.known = rows.pick(known, text="text", __file="__file", __row="__row")
        found = members.where("n_shingles > 0").groupBy("class").agg(
            F.min(F.struct("__file", "__row")).alias("at"),
            F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"),
        )
        self.sample = pin(found)

    def clumps(self, lists: DataFrame) -> DataFrame:
        """class and clump of all classes that a pair of a list may link."""
        known = self.sample.select("class", "size", "sketch")
        entries = lists.join(known, "class").select("list", "class", "size", "sketch")
        entries = entries.repartition("list").sortWithinPartitions("list")
        edges = entries.mapInArrow(_in_groups(_forest, ["list"]), _PAIRS).distinct()
        return components(edges).select(F.col("node").alias("class"), F.col("component").alias("clump"))

    def links(self, clumps: DataFrame) -> DataFrame:
        """Links that connect, within every clump, all that its links connect."""
        known = self.sample.select("class", "size", "at.__file", "at.__row")
        found = packed(clumps.join(known, "class").withColumn("component", F.col("class")), clumps.count())
        blocks = found.groupBy("clump").agg(
            F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        )
        found = found.join(blocks, "clump").withColumn("block", F.expr("pmod(hash(class, 1), blocks)"))
        alone = found.withColumns({"low": F.col("block"), "high": F.col("block")})
        links = pin(self._verified(alone))
        large = found.where("blocks > 1").drop("component", "block", "blocks")
        if large.isEmpty():
            return links
        large = pin(large)
        # one class of every component, then all classes of clumps with several components
        for every in (False, True):
            links = pin(links.unionByName(self._verified(_cells(large, components(links), every))))
        return links

    def _verified(self, cells: DataFrame) -> DataFrame:
        """Links of all cells (clump, low, high); one text for every class of a cell."""
        wanted = cells.select("__file", "__row", *_CELL)
        if cells.count() <= BROADCAST:
            wanted = F.broadcast(wanted)
        found = self.known.join(wanted, ["__file", "__row"]).select(*_CELL, "text")
        keys = ["clump", "low", "high"]
        found = found.repartition(*keys).sortWithinPartitions(*keys)
        return found.mapInArrow(_in_groups(_links, keys), _PAIRS)


_CELL = ["clump", "low", "high", "block", "class", "component"]


def _cells(classes: DataFrame, label: DataFrame, every: bool) -> DataFrame:
    """Classes of clumps with several components, dealt so that any two components meet.

    Of every component one class, or all of them; classes of a clump's largest component
    need not meet each other then.
    """
    label = label.select(F.col("node").alias("class"), "component")
    found = classes.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    if not every:
        found = found.groupBy("clump", "component").agg(
            F.min(F.struct("class", "size", "__file", "__row")).alias("one")
        ).select("clump", "component", "one.*")
    found = pin(found)
    sizes = found.groupBy("clump", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")
    )
    of_main = F.max(F.struct("n", "shingles", "component"))
    per_clump = sizes.groupBy("clump").agg(
        of_main.alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"),
        F.count(F.lit(1)).alias("components"),
    ).where("components > 1")
    blocks = lambda n, shingles: f"int(ceil(greatest({n} / {BLOCK}, {shingles} / {BLOCK_SHINGLES})))"
    per_clump = per_clump.select(
        "clump", F.col("main.component").alias("main"),
        F.expr(blocks("n", "shingles")).alias("all"),
        F.expr(blocks("(n - main.n)", "(shingles - main.shingles)")).alias("outer"),
        F.expr(blocks("main.n", "main.shingles")).alias("inner"),
    )
    found = found.join(per_clump, "clump")
    # a small clump is one cell; else blocks of other classes come before those of the largest component
    found = found.withColumn("block", F.expr(
        "CASE WHEN all = 1 THEN 0 WHEN component <> main THEN pmod(hash(class, 1), outer) "
        "ELSE outer + pmod(hash(class, 1), inner) END"
    ))
    found = found.withColumn("other", F.expr(
        "explode(CASE WHEN all = 1 THEN array(0) WHEN component <> main THEN sequence(0, outer + inner - 1) "
        "ELSE sequence(0, outer - 1) END)"
    ))
    return found.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def linked(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and its identity.

    Words are runs without white space, A-Z lower-cased; a text with fewer than five
    words is one shingle. NULL, empty and blank texts have no shingles and link with
    nothing. The component is the smallest id reachable by links (NULL ids are passed
    over; NULL if there is no other). Repeated rows link with each other. An empty table
    gives no rows. Extra columns are ignored.
    """
    known = rows.identified(docs)
    known = rows.pick(
        known, doc_id=id_column, text=text_column, __file="__file", __row="__row"
    ).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    members = pin(known.mapInArrow(_members, _MEMBER))
    # one row for every band, of which there are about four for each doubling of a set's size
    bands = members.where("n_shingles > 0").groupBy("band").agg(F.sum("n_shingles").alias("size"))
    buckets = _dealt({r["band"]: r["size"] for r in bands.collect()})
    lists = pin(_kept(_lists(known, buckets, hot), members))
    whole = _Join(known, members)

    return _labelled(members, components(whole.links(whole.clumps(lists))))


def _lists(known: DataFrame, buckets: list[tuple[int, int]], hot: int) -> DataFrame:
    def with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _sender(buckets, hot)

        def classed():
            for batch in batches:
                text = batch.column("text")
                yield pa.RecordBatch.from_arrays([text, pa.array(_class_ids(text))], ["text", "class"])

        yield from send(classed())

    runs = known.select("text").mapInArrow(with_class, _RUNS)
    return runs.groupBy("bucket").applyInArrow(_merged, _LISTS)


def _kept(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(list, class), each list once, without the lists that a class may leave; see *Pigeonhole join*.

    A list that a map task sent and the same list of a bucket have the same name. A class
    is in the lists of its own blocks only, so the window holds one class's blocks.
    """
    flat = pin(lists).select("list", "lane", "times", "n", F.explode("members").alias("class"))
    pieces = flat.where("n IS NULL").groupBy("list", "lane", "class").agg(F.max("times").alias("times"))
    sizes = pieces.groupBy("list").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    flat = flat.where("n IS NOT NULL").unionByName(pieces.join(sizes, "list"))
    shape = members.where("n_shingles > 0").groupBy("class").agg(
        *[F.first(c).alias(c) for c in ("band", "need0", "need1")]
    )
    starts = band_starts(1 << 40)
    prefixes = F.array(*[F.lit(shared_prefix(b, starts)) for b in range(len(starts))])
    need = F.when(F.col("lane") < 0, F.get(prefixes, -1 - F.col("lane"))).otherwise(
        F.when(F.col("lane") == F.col("band"), F.col("need0")).otherwise(F.col("need1"))
    )
    largest = Window.partitionBy("class", "lane").orderBy(F.desc("n"), F.desc("list"))
    found = flat.join(shape, "class").withColumn(
        "passed", F.sum("times").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    )
    kept = found.where(F.col("passed") >= need).select("list", "class")
    # lists are named by what they hold, so that equal ones are one; a name that two
    # others share by chance makes them one longer list
    named = kept.groupBy("list").agg(
        F.count(F.lit(1)).alias("left"), F.bit_xor(F.xxhash64("class")).alias("name")
    )
    kept = kept.join(named.where("left > 1"), "list")
    return kept.select(F.col("name").alias("list"), "class").distinct()


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    classes = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    joined = classes.join(label.withColumnRenamed("node", "class"), "class", "left")
    joined = joined.select("class", "low", F.coalesce("component", "class").alias("component"))
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = joined.join(lows, "component").select("class", "component_id")
    some = members.where("n_shingles > 0").join(by_class, "class")
    none = members.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id", "__file", "__row"]
    return some.select(*names).unionByName(none.select(*names))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component, the one with the smallest id.

    A row without an id stays only where no row of its component has one.
    """
    known = rows.identified(docs)
    found = linked(known)
    # repeated rows share the smallest id; the first of them in the files stays
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__row")).alias("best"))
    keep = best.select("best.__file", "best.__row")
    alone = found.where("n_shingles = 0 OR component_id IS NULL").select("__file", "__row")
    lost = found.join(keep.unionByName(alone), ["__file", "__row"], "left_anti")
    return rows.without(known, lost)
