"""Exact Jaccard join of word shingles by universe partition and the pigeonhole principle.

Two sets of sizes a and b with similarity num/den or more differ in at most D = floor((den-num)/(den+num) (a+b)) shingles.
Shingles are hashed into segments, more of them than D, so some segments of the two are equal. A document indexes the
subset of its shingles in each segment: in the partition of its own size band, and in the one below if a partner may be
there. A set with members in D segments at most may share only empty ones with a partner, which then has as few: such sets
also index the one-deletion neighbourhoods of their subsets, which allots two differences to each segment (one to a segment
of one member, which the partner may lack), and, where even that is not enough, their D + 1 least shingles, among which is
the least one that both have. What keys cost decides how a document is matched:

1. Every key's documents are compared with one of them, for a dear key with the one in most dear keys. Linked documents
   form components.
2. Keys that still join several components get all pairs across these, if few documents share them.
3. A key that many share is dear. A document with more than D cheap segments needs no dear key: a partner that agrees in
   none of its cheap segments would differ too often. One with fewer takes as many dear ones as it lacks, the first by value.
4. Dear keys of the others that still join several components are not paired: each of their sets is written down as its
   differences from the key's leader (see `_differences`). Sets that the leader is not linked with are far from it, so
   two linked ones must share about half of their differences: a prefix of these is the key. Groups of up to MANY such sets
   are compared in blocks, never gathered; larger ones get a leader of their own first, for some rounds. (One-deletion
   neighbourhoods are of no use there: a set one step off a common subset meets all that have it.)

All candidates are verified on the whole sets. Sets are of 64-bit hashes, and so are a set's id and a segment's key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import NARROW, WHITESPACE, cut, free_name, job, kept, mapped, rows_of, tidy

#: A key that more documents share is dear.
CHEAP = 24

#: Sets in a block of comparisons within groups, and bits of their parities there.
BLOCK, SHORT = 256, 1024

#: Groups of differences of up to so many sets are compared in blocks at once, larger ones get further rounds of leaders
#: first, up to so many.
MANY, ROUNDS = 1024, 4

#: Bits of the filter that tells which documents' sets are needed; a fixed size, however many there are.
FILTER_BITS = 1 << 24

#: Up to so many ids go to every executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Links that one task joins at most; more are joined by rounds over all executors.
FOREST = 2_000_000

#: Sets that a task remembers to have indexed, and bytes of text that it hashes at once.
SEEN, AT_ONCE = 200_000, 1 << 20

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte, A-Z alike a-z, and which bytes part words.
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
PARTS = np.isin(np.arange(256), np.frombuffer(WHITESPACE, np.uint8))


#: Powers of an odd number modulo 2**64 and their inverses. Longer words than that are hashed part by part.
BASE = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & (1 << 64) - 1, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


UP, DOWN = _powers(BASE, AT_ONCE), _powers(pow(BASE, -1, 1 << 64), AT_ONCE)


def _blocks(parts: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whether a word goes on) of blocks of AT_ONCE bytes at most, cut between words where there is a gap."""
    start, n = 0, len(parts)
    while start < n:
        stop = min(start + AT_ONCE, n)
        goes_on = False
        if stop < n and not edge[stop] and not parts[stop - 1] and not parts[stop]:
            gaps = np.flatnonzero(parts[start:stop] | edge[start + 1 : stop + 1])
            goes_on = not len(gaps)
            stop = stop if goes_on else start + int(gaps[-1]) + 1
        yield start, stop, goes_on
        start = stop


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all) of texts side by side; text k ends before ends[k].

    Each word is a polynomial of its bytes' numbers, read off running sums, so that a whole block is hashed at once. A word
    of more than AT_ONCE bytes is hashed in parts, whose hashes are mixed in a row.
    """
    n = len(raw)
    starts_of = np.concatenate([[0], ends[:-1]])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    parts = PARTS[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts_of] = edge[n] = True
    hashes, firsts = [], []
    begun: tuple[int, np.ndarray] | None = None  # first byte and mixed hash of a word that goes on in the next block
    for start, stop, goes_on in _blocks(parts, edge):
        gap = parts[start:stop]
        new = np.concatenate([[True], gap[:-1]]) | edge[start:stop]
        over = np.concatenate([gap[1:], [True]]) | edge[start + 1 : stop + 1]
        first, last = np.flatnonzero(~gap & new), np.flatnonzero(~gap & over)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw[start:stop]] * UP[: stop - start])])
        hashed = mix((total[last + 1] - total[first]) * DOWN[first] + (last - first).astype(np.uint64) * C1)
        first = first + start
        if begun:
            hashed[:1] = mix(begun[1] * C1 + hashed[:1])
            first[0] = begun[0]
        begun = None
        if goes_on:
            begun, hashed, first = (int(first[-1]), hashed[-1:]), hashed[:-1], first[:-1]
        hashes.append(hashed)
        firsts.append(first)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), np.append(np.searchsorted(first, starts_of), len(first))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; with fewer words the whole sequence is one, without any none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    h, at = word_hashes(raw, offsets[1:] - offsets[0])
    total = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for k in range(words if len(total) else 0):
        total = mix(total * C1 + h[k : k + len(total)])
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= words:
            row = np.sort(total[a : b - words + 1])
            out.append(row[np.concatenate([[True], row[1:] != row[:-1]])])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix(whole * C1 + h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(members: np.ndarray, bits: int | None = None) -> bytes:
    """A bit for each residue of the hashes modulo a power of two near the set's size: whether an odd number has it.

    Two sets differ in as many members at least as their bits do, so the bits alone can rule out a link.
    """
    bits = bits or 1 << max(6, len(members).bit_length())
    return np.packbits(np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def parity_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two parities differ, the longer one folded to the shorter's length."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_id(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), len(members)) - (1 << 63)


class Bands:
    """The segments of each size band, for similarities of num/den or more. Band j has sizes 2**j to 2**(j+1) - 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differences(self, a, b):
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def alike(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def segments(self, band: int) -> int:
        top = (2 << band) - 1
        needed = self.differences(top, top * self.den // self.num) + 1
        return needed + -(-needed // 4)

    def bands_of(self, n: int) -> list[int]:
        own = n.bit_length() - 1
        return [own, own - 1] if own and -(-n * self.num // self.den) < 1 << own else [own]

    def most_differences(self, n: int, band: int) -> int:
        """Between a set of n and any partner that indexes in the band: in its own band also larger ones of the next."""
        top = (2 << band) - 1
        return self.differences(n, n * self.den // self.num if n <= top else top)

    def keys(self, members: np.ndarray, band: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of each segment that has members, where its members begin, their sums before the last mixing)."""
        m = np.uint64(self.segments(band))
        segment = (members >> np.uint64(32)) * m >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums = np.add.reduceat(mix(members * C1), first)
        base = mix(segment[first] * C2 + np.uint64(band + 64 * salt + 1))
        return mix(sums ^ base), first, base

    def least(self, members: np.ndarray, band: int) -> np.ndarray:
        """Further keys of a set that has members in so few segments that a partner may share none of these: its segments'
        subsets, and those without one member. A partner that meets it in none of them differs twice in each segment, or
        once where the set has one member and the partner none. Where that may be, its least shingles are keys as well."""
        most = self.most_differences(len(members), band)
        whole, first, base = self.keys(members, band, 1)
        if len(first) > most:
            return members[:0]
        sizes = np.diff(np.append(first, len(members)))
        inside = np.repeat(np.arange(len(first)), sizes)
        hashed = mix(members * C1)
        without = mix((np.add.reduceat(hashed, first)[inside] - hashed) ^ base[inside])[sizes[inside] > 1]
        enough = np.minimum(sizes, 2).sum() > most
        return np.concatenate([whole, without, members[:0] if enough else mix(hashed[: most + 1] ^ mix(np.full(1, band + 129, np.uint64)))])


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, sid (the set's id; null for an empty one) and parity of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000, "text", AT_ONCE):
            sets = shingle_sets(batch.column("text"), words)
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "sid", "parity"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, sid long, parity binary")


def _index(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """key, sid, n, spare: the keys of each distinct set of a task; n is negative in the band below the set's own.

    spare: how many of the set's segments may have dear keys before the other ones don't suffice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows_of(batches, 1000, "text", AT_ONCE):
            keys, ids, sizes, spares = [], [], [], []
            for members in shingle_sets(batch.column("text"), words):
                sid = set_id(members) if len(members) else None
                if sid is None or sid in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(sid)
                for k, band in enumerate(bands.bands_of(len(members))):
                    own = bands.keys(members, band)[0]
                    spare = len(own) - bands.most_differences(len(members), band)
                    own = np.unique(np.concatenate([own, bands.least(members, band)]))
                    keys.append(own.view(np.int64))
                    ids.append(np.full(len(own), sid, np.int64))
                    sizes.append(np.full(len(own), -len(members) if k else len(members), np.int32))
                    spares.append(np.full(len(own), spare, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes, spares)], names=["key", "sid", "n", "spare"])

    return docs.select("text").mapInArrow(tidy(run), "key long, sid long, n int, spare int")


def _groups(index: DataFrame, bands: Bands) -> DataFrame:
    """key, sid, n, spare, leader, dear: rows of keys that several sets share, read as a stream in order of keys.

    leader is a cheap key's first set, null for dear keys and where sizes rule out a link with it. Keys of two sets are
    done with that one comparison: they give one row without a key.
    """
    names = ["key", "sid", "n", "spare", "leader", "dear"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]  # the last key's rows, which the next batch may go on with
        dear_key: int | None = None  # of a dear run under way

        def led(sid: np.ndarray, n: np.ndarray, leader: np.ndarray, leader_n: np.ndarray) -> pa.Array:
            fit = bands.sizes_fit(np.abs(n), np.abs(leader_n)) & ((n > 0) | (leader_n > 0)) & (sid != leader)
            return pa.array(leader, mask=~fit)

        def rows(key, sid: np.ndarray, n: np.ndarray, spare: np.ndarray, leaders, dear: bool) -> pa.RecordBatch:
            nothing = pa.nulls(len(sid), pa.int64())
            columns = [nothing if key is None else pa.array(key), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(spare.astype(np.int32)), nothing if leaders is None else leaders, pa.array(np.full(len(sid), dear))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def closed(*all_: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (all_[0][1:] != all_[0][:-1]) | (all_[1][1:] != all_[1][:-1])])
            key, sid, n, spare = (x[new] for x in all_)  # a set that several tasks indexed counts once
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(first, len(key)))
            start = np.repeat(first, sizes)
            for take, keyed, dear in ((np.repeat(sizes == 2, sizes), False, False), (np.repeat((sizes > 2) & (sizes <= CHEAP), sizes), True, False), (np.repeat(sizes > CHEAP, sizes), True, True)):
                if take.any():
                    leaders = None if dear else led(sid[take], n[take], sid[start[take]], n[start[take]])
                    made = rows(key[take] if keyed else None, sid[take], n[take], spare[take], leaders, dear)
                    yield made if keyed else made.filter(leaders.is_valid())

        for batch in batches:
            here = [batch.column(c).to_numpy() for c in names[:4]]
            if dear_key is not None:
                stop = int(np.searchsorted(here[0], dear_key, side="right"))
                if stop:
                    yield rows(*(x[:stop] for x in here), None, True)
                if stop == len(here[0]):
                    continue
                here, dear_key = [x[stop:] for x in here], None
            here = [np.concatenate(x) for x in zip(held, here, strict=True)]
            last = int(np.searchsorted(here[0], here[0][-1], side="left")) if len(here[0]) else 0
            if last:
                yield from closed(*(x[:last] for x in here))
            held = [x[last:] for x in here]
            if len(held[0]) and len(np.unique(held[1])) > CHEAP:
                dear_key = int(held[0][0])
                yield rows(*held, None, True)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from closed(*held)

    return mapped(index.repartition("key").sortWithinPartitions("key", "sid"), run, "key long, sid long, n int, spare int, leader long, dear boolean")


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    a, b = F.least(one, other), F.greatest(one, other)
    return rows.select(a.alias("a"), b.alias("b")).filter("a < b").groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


#: What a row of differences stands for: a set joined with the leader; one apart from it; one apart, for joined ones only.
JOINED, APART, PROBE = 0, 1, 2


def _across(groups: DataFrame, bands: Bands) -> DataFrame:
    """a, b of all pairs across components in groups of (key, sid, n, comp), of CHEAP sets at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made_a, made_b = [], []
            for group in batch.column("group"):
                sid, n, comp = (group.values.field(k).to_numpy() for k in range(3))
                for k in range(len(sid) - 1):
                    rest = slice(k + 1, None)
                    fit = (comp[rest] != comp[k]) & (sid[rest] != sid[k]) & ((n[rest] > 0) | (n[k] > 0)) & bands.sizes_fit(np.abs(n[rest]), abs(int(n[k])))
                    made_b.append(sid[rest][fit])
                    made_a.append(np.full(len(made_b[-1]), sid[k]))
            if made_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made_a)), pa.array(np.concatenate(made_b))], names=["x", "y"])

    listed = groups.groupBy("key").agg(F.collect_list(F.struct("sid", "n", "comp")).alias("group"))
    return _pairs(listed.select("group").mapInArrow(run, "x long, y long"), "x", "y")


def _contested(rows: DataFrame) -> DataFrame:
    """The rows (key, sid, n, comp, kind) of keys in which sets of several components meet, with rows: how many do so.

    Joined sets meet all others, sets apart meet each other too, probes meet joined sets alone and don't count.
    """
    count = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    meet = (count(APART) > 1) | ((count(JOINED) > 0) & (count(APART, PROBE) > 0))
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), meet.alias("meet"), count(JOINED, APART).alias("rows"))
    return rows.join(keys.filter("lo < hi and meet").select("key", "rows"), "key")


def _meetings(rows: DataFrame, bands: Bands) -> DataFrame:
    """a, b of all pairs across components that meet in one of the keys, of CHEAP rows besides probes each."""
    one, two = (rows.select("key", *(F.col(c).alias(f"{c}{k}") for c in ("sid", "n", "comp", "kind"))) for k in (1, 2))
    n, m = F.col("n1"), F.col("n2")
    fit = F.lit(bands.den) * F.least(n, m) >= F.lit(bands.num) * F.greatest(n, m)
    # Each pair meets once: joined sets stand on the right; two sets apart stand in the order of their ids.
    apart = (F.col("kind1") == APART) & (F.col("kind2") == APART) & (F.col("sid1") < F.col("sid2"))
    meet = apart | ((F.col("kind1") != JOINED) & (F.col("kind2") == JOINED))
    return _pairs(one.join(two.filter(F.col("kind2") != PROBE), "key").filter((F.col("comp1") != F.col("comp2")) & fit & meet), "sid1", "sid2")


def _best(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.max("lead").alias("lead"))


def _led(groups: DataFrame, often: DataFrame) -> DataFrame:
    """key, leader: of each key's sets the one in most dear keys (often: sid, often), which is the least changed one of a
    group of near copies."""
    lead = _best(groups.select("key", "sid").join(often, "sid").select("key", F.struct("often", "sid").alias("lead")), "key")
    return lead.select("key", F.col("lead.sid").alias("leader"))


def _dear(shared: DataFrame) -> DataFrame:
    """sid, n, key, often, leader: the dear keys that sets take, in how many a set is, and the key's leader.

    Sets with cheap keys enough need no dear ones; the others add as many, in the order of the keys, as they lack. Of two
    linked sets the one whose last such key is the smaller has an equal key among its own, which the other has then as well.
    A key's leader is the best one, by how many dear keys it is in, that the key's sets have in any of their keys, so that
    the keys of a group of near copies have one leader in common; it need not have the key itself. Each of the joins gives as
    many rows as there are dear keys of sets.
    """
    listed = shared.filter("dear").groupBy("sid", "n").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.max("spare").alias("spare"))
    taken = F.slice("keys", F.lit(1), F.size("keys") - F.col("spare") + 1)
    listed = listed.filter("size(keys) >= spare").groupBy("sid").agg(F.collect_list(F.struct("n", taken.alias("keys"))).alias("bands"))
    often = F.aggregate("bands", F.lit(0), lambda sum_, band: sum_ + F.size(band["keys"]))
    dear = kept(listed.select("sid", often.alias("often"), F.inline("bands")).select("sid", "n", F.explode("keys").alias("key"), "often"))
    lead = _best(dear.select("key", F.struct("often", "sid").alias("lead")), "key")
    lead = _best(dear.select("key", "sid").join(lead, "key"), "sid")
    lead = _best(dear.select("key", "sid").join(lead, "sid"), "key")
    return kept(dear.join(lead.select("key", F.col("lead.sid").alias("leader")), "key"))


def _differences(scope: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """key, sid, n, comp, kind: the differences of sets from their leaders that serve as keys, from rows (leader, sid,
    comp, apart: whether the leader is in another component).

    X and Y are the differences of sets x and y from the leader c, as shingles gained and lost: x and y differ in
    |X| + |Y| - 2 |X and Y| shingles, at most D(x, y) if they are linked. c is not linked with a set x apart, so
    |X| > D(x, c). Hence y shares at least (|Y| + 1 + D(x, c) - D(x, y)) / 2 of its differences with any linked set apart,
    where D(x, y) - D(x, c) exceeds 0 by (den-num)/(den+num) (|y| - |c|) at most, rounded up; and x apart shares at
    least |X| - D(x, y) with any linked y, since it can share |Y| at most. Of two sets that share so many differences the
    first ones in a common order, all but that number less one, have one in common. The order is: gained shingles first,
    which few others gain, by their hashes. Joined sets need no key for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for k, (leader, sid, comp, apart) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leader", "sid", "comp", "apart")), strict=True)):
                x, c = (np.frombuffer(batch.column(m)[k].as_buffer(), np.uint64) for m in ("members", "center"))
                gained = x[c[np.minimum(np.searchsorted(c, x), len(c) - 1)] != x]
                lost = c[x[np.minimum(np.searchsorted(x, c), len(x) - 1)] != c]
                all_ = np.concatenate([mix(gained * C1), mix(lost * C2 + C3)])
                n, more = len(x), max(0, len(x) - len(c))
                beyond = -(-(bands.den - bands.num) * more // (bands.den + bands.num))
                first = len(all_) + 1 - max(1, (len(all_) + 2 - beyond) // 2)
                last = len(all_) + 1 - max(1, len(all_) - bands.differences(n, n * bands.den // bands.num)) if apart else first
                keys = mix(all_[: max(first, last)] ^ mix(np.full(1, leader, np.int64).view(np.uint64)))
                kind = np.where(np.arange(len(keys)) < first, APART if apart else JOINED, PROBE).astype(np.int32)
                out.append([keys.view(np.int64), np.full(len(keys), sid), np.full(len(keys), n), np.full(len(keys), comp), kind])
                if sum(len(o[0]) for o in out) > 100_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "sid", "n", "comp", "kind"])

    whole = scope.join(sets, "sid").join(sets.select(F.col("sid").alias("leader"), F.col("members").alias("center")), "leader")
    return mapped(whole.select("leader", "sid", "comp", "apart", "members", "center"), run, "key long, sid long, n long, comp long, kind int")


def _in_blocks(groups: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """a, b: links that join the components which groups (key, sid, comp) still hold, each block of about BLOCK sets of a
    key compared with each other block of it: exact, whatever the group is like, and no task holds more than two blocks."""
    shape = groups.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = groups.join(shape, "key").withColumn("at", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("key", "sid", "comp", "at", other.alias("other")).select("key", "sid", "comp", F.least("at", "other").alias("r"), F.greatest("at", "other").alias("c"))

    def run(group: pa.Table) -> pa.Table:
        sid, comp = group["sid"].to_numpy(), group["comp"].to_numpy().copy()
        members = [np.frombuffer(m.as_buffer(), np.uint64) for m in group["members"]]
        bits = np.stack([np.frombuffer(parity(m, SHORT), np.uint64) for m in members])
        n = np.array([len(m) for m in members])
        links = []
        for x in range(len(sid) - 1):
            rest = x + 1 + np.flatnonzero((comp[x + 1 :] != comp[x]) & bands.sizes_fit(n[x + 1 :], n[x]))
            rest = rest[np.bitwise_count(bits[rest] ^ bits[x]).sum(1) <= bands.differences(n[rest], n[x])]
            for y in rest:
                if comp[y] != comp[x] and bands.alike(len(np.intersect1d(members[x], members[y], assume_unique=True)), n[x], n[y]):
                    links.append((sid[x], sid[y]))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.join(sets, "sid").groupBy("key", "r", "c").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """sid, members (sorted hashes) of the wanted sids: those that a filter of FILTER_BITS lets through, then exactly."""
    bit = F.pmod("sid", F.lit(FILTER_BITS))
    cells = wanted.select(F.floor(bit / 64).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows_of(batches, 1000, "text", AT_ONCE):
            made = []
            for members in shingle_sets(batch.column("text"), words):
                if not len(members) or (sid := set_id(members)) in seen or not int(sent.value[sid % FILTER_BITS // 64]) >> (sid % FILTER_BITS % 64) & 1:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(sid)
                made.append((sid, members.tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["sid", "members"])

    found = docs.select("text").mapInArrow(tidy(run), "sid long, members binary")
    return found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs a, b whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                keep.append(bool(bands.alike(int((both[1:] == both[:-1]).sum()), len(p), len(q))))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
    return mapped(joined.select("a", "b", "x", "y"), run, "a long, b long")


def _possible(pairs: DataFrame, parities: DataFrame, bands: Bands) -> DataFrame:
    """The pairs a, b that sizes and parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                keep.append(bool(bands.sizes_fit(n, m)) and parity_distance(p, q) <= bands.differences(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    one, two = (parities.select(F.col("sid").alias(s), F.col("n_shingles").alias(n), F.col("parity").alias(p)) for s, n, p in (("a", "n", "x"), ("b", "m", "y")))
    return mapped(pairs.join(two, "b").join(one, "a").select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def _forest(links: DataFrame, roots: bool) -> DataFrame:
    """u, v: each partition's links as a spanning forest, a row (node, least node of its tree) for each node but roots;
    with `roots` for these too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(parent) if (r := root(x)) != x or roots]
        for k in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 100_000], strict=True)], names=["u", "v"])

    return mapped(links, run, "u long, v long")


def components(links: DataFrame, most: int = FOREST) -> DataFrame:
    """node, root (the least node of its component) of every node of links (a, b).

    Each partition first reduces its links to a forest. If those have `most` rows at most, one task joins them; else
    large-star and small-star rounds move each node's neighbours to the least of them until nothing changes. A node with
    very many neighbours is summed before the shuffle and joined, never gathered.
    """
    edges = kept(_forest(links.select("a", "b"), False))
    if edges.count() <= most:
        return kept(_forest(edges.coalesce(1), True)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = kept(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_sets(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(set_rows, components of linked sets: node, root) of docs (doc_id, text); sets without links have no component."""
    return _near_sets(docs, words, Bands(num, den))


def _near_sets(docs: DataFrame, words: int, bands: Bands) -> tuple[DataFrame, DataFrame]:
    rows = kept(set_rows(docs, words))
    parities = kept(rows.filter("sid is not null").select("sid", "n_shingles", "parity").dropDuplicates(["sid"]))
    shared = kept(_groups(_index(docs, words, bands), bands), NARROW)
    dear = _dear(shared)
    first = kept(_pairs(shared.filter("leader is not null").select("leader", "sid").unionByName(dear.select("leader", "sid").distinct()), "leader", "sid"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The alike ones among pairs, with the sets read from the texts."""
        pairs = kept(_possible(pairs, parities, bands))
        wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        return kept(_verified(pairs, kept(_sets(docs, words, wanted)), bands))

    links = linked(first)
    joined = components(links)

    def opened(found: DataFrame) -> DataFrame:
        """Rows of keys that more than one component shares, with the components."""
        comp = kept(found.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root"))
        several = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return comp.join(several, "key", "left_semi")

    def joined_by(more: DataFrame) -> bool:
        """Takes up links that were found, if there are any."""
        nonlocal links, joined
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        joined = components(links)
        return True

    second = kept(_across(opened(shared.filter("key is not null and not dear")), bands).join(first, ["a", "b"], "left_anti"))
    joined_by(linked(second))
    groups = kept(opened(dear))
    if not groups.isEmpty():
        often = dear.select("sid", "often").distinct()
        wanted = groups.select("sid").unionByName(groups.select(F.col("leader").alias("sid"))).distinct()
        sets = kept(_sets(docs, words, wanted))
        known = lambda pairs: kept(_verified(_possible(pairs, parities, bands), sets, bands))
    for k in itertools.count():
        if groups.isEmpty():
            break
        scope = kept((groups.join(_led(groups, often), "key") if k else groups).select("leader", "sid").distinct())
        if k:  # pairs of the first leaders are among the first ones
            joined_by(known(_pairs(scope, "leader", "sid").join(first, ["a", "b"], "left_anti")))
        node = lambda name, comp: joined.select(F.col("node").alias(name), F.col("root").alias(comp))
        comps = scope.join(node("sid", "comp"), "sid", "left").join(node("leader", "leads"), "leader", "left")
        comps = comps.select("leader", "sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("leads", "leader").alias("leads"))
        comps = comps.withColumn("apart", F.col("comp") != F.col("leads")).drop("leads")
        several = comps.filter("apart").select("leader").distinct()
        found = kept(_contested(kept(_differences(comps.join(several, "leader", "left_semi"), sets, bands))))
        joined_by(known(_meetings(found.filter(f"rows <= {CHEAP}"), bands)))
        large = kept(opened(found.filter(f"rows > {CHEAP}").select("key", "sid", "n", "rows").distinct()))
        joined_by(kept(_in_blocks(large if k == ROUNDS else large.filter(f"rows <= {MANY}"), sets, bands)))
        if k == ROUNDS:
            break
        groups = kept(opened(large.filter(f"rows > {MANY}").select("key", "sid", "n")))
    return rows.drop("parity"), joined


def near_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. Rows without words link with nothing, not even each other;
    null texts have no words; rows of the same set are linked; null ids count only where a component has no other.
    """
    with job():
        rows, joined = near_sets(docs.select("doc_id", "text"), words, num, den)
        least = rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
        least = least.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
        classes = kept(least.join(roots, "root").select("sid", "component_id"))
        found = rows.join(classes, "sid", "left")
        return kept(found.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), NARROW, stay=True)


def near_filter(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that no other stands for, all columns as they are: one of each component, of its smallest doc_id
    (a null id is larger than any), and all rows without words.

    Rows whose id is null or repeated get a key of their own, and are kept by that; all others by their id.
    """
    with job():
        rows, joined = near_sets(docs.select("doc_id", "text"), words, num, den)
        first = lambda *columns: F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *columns)).alias("keep")
        least = rows.filter("sid is not null").groupBy("sid").agg(first()).select("sid", "keep.doc_id")
        least = least.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        roots = least.groupBy("root").agg(first("sid")).select("root", F.col("keep.doc_id").alias("keep_id"), F.col("keep.sid").alias("keep_sid"))
        classes = kept(least.join(roots, "root").select("sid", "keep_id", "keep_sid"))
        twice = kept(rows.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 or doc_id is null").select("doc_id"))
        gone = rows.join(classes, "sid").filter("doc_id <> keep_id").select("doc_id").unionByName(twice)
        name = free_name(docs.columns)
        gone = kept(gone.filter("doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), stay=True)
        if gone.count() <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        single = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
        if twice.isEmpty():
            return single
        part = docs.join(twice.select(F.col("doc_id").alias(name)), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
        part = cut(part.withColumn(name, F.monotonically_increasing_id()))
        sets = set_rows(part.select(F.col(name).alias("doc_id"), "text"), words).select(F.col("doc_id").alias("key"), "sid")
        sets = kept(sets.join(part.select(F.col(name).alias("key"), F.col("doc_id").cast("long").alias("doc_id")), "key"))
        one = sets.join(classes, "sid").filter("sid = keep_sid and doc_id <=> keep_id").groupBy("sid").agg(F.min("key").alias("key")).select("key")
        stay = kept(one.unionByName(sets.filter("sid is null").select("key")), stay=True).withColumnRenamed("key", name)
        return single.filter(F.col("doc_id").isNotNull()).union(part.join(stay, name, "left_semi").select(docs.columns))
