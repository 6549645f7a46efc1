"""Best-fit packing by exact-complement hashing.

Sequences hold `capacity` tokens. The plan is made from the counts of piece lengths alone, at most `capacity` numbers
however large the corpus, so it fits the driver by a proven bound; pieces then find their places by their rank among
pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import NARROW, job, kept, mapped, rows_of
from foliate.llm.tokens import BATCH_BYTES, worker_encoder

CAPACITY = 2048

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first piece takes what full ones leave."""
    head = n % capacity or capacity
    return [(0, min(head, n)), *((s, capacity) for s in range(head, n, capacity))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row for each piece of each document (null text: empty): its ids end with `end`.

    part: the task that made it; nth: how many pieces of the same length that task had made before.
    """
    last = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        try:
            for batch in rows_of(batches, 1000, "text", BATCH_BYTES):
                made: list[tuple] = []
                flat, at = encode(batch.column("text").to_pylist())
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    ids = np.append(flat[a:b], last)
                    for k, (s, n) in enumerate(cut_lengths(len(ids), capacity)):
                        made.append((doc_id, k, s, n, zlib.crc32(ids[s : s + n]), part, seen[n]))
                        seen[n] += 1
                columns = list(zip(*made, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        finally:  # loading takes a tenth of a second; each of the workers that take turns would hold 80 MB or so
            worker_encoder.cache_clear()

    return mapped(docs.select("doc_id", "text"), run, PIECE_SCHEMA)


class Complements:
    """Available lengths, and single, pair and triple sums of them that fill a gap exactly."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()  # counts[n]: pieces of length n that have no place yet

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.counts[: gap - 1])[::-1]:
            if 3 * a < gap:  # the largest of three is a third at least
                return None
            if rest := self.pair(gap - int(a), int(a)):
                return (int(a), *rest)
        return None

    def pair(self, gap: int, used: int = 0) -> tuple[int, int] | None:
        """The pair with the largest member, that member no larger than `used` if that is given."""
        low = np.arange(1, gap // 2 + 1)
        have = self.counts.copy()
        if used:
            have[used] -= 1
        fits = (have[low] > 0) & (have[gap - low] > 0)
        if gap % 2 == 0 and len(low) and have[gap // 2] < 2:
            fits[-1] = False
        at = np.flatnonzero(fits)
        return (gap - int(low[at[0]]), int(low[at[0]])) if len(at) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap < len(self.counts) and self.counts[gap] > 0:
            return (gap,)
        return (self.pair(gap) or self.triple(gap)) if gap > 1 else None

    def take(self, pattern: tuple[int, ...]) -> int:
        """Consumes the pattern as often as the counts allow."""
        lengths, times = np.unique(pattern, return_counts=True)
        n = int((self.counts[lengths] // times).min())
        self.counts[lengths] -= n * times
        return n


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) patterns that place every piece; counts[n] pieces have length n.

    From the longest length down, each is completed by one, two or three lengths that fill its gap exactly. Every such
    pattern uses up a length, so there are at most `capacity` of them. What no sum completes goes into the fullest open
    sequence that it fits, longest first, equal sequences together.
    """
    free = Complements(counts)
    out: list[tuple[tuple[int, ...], int]] = []
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while free.counts[length] > 0:
            gap = capacity - length
            free.counts[length] -= 1
            found = () if gap == 0 else free.exact(gap)
            free.counts[length] += 1
            if found is None:
                rest[length] += free.counts[length]
                free.counts[length] = 0
            else:
                out.append(((length, *found), free.take((length, *found))))
    opened: dict[int, dict[tuple[int, ...], int]] = {}  # by gap: patterns and how many sequences have each
    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            gap = min((g for g in opened if g >= length), default=capacity)
            fit = gap // length
            pattern, n = opened[gap].popitem() if gap in opened else ((), left)
            used, times = (min(n, left // fit), fit) if left >= fit else (1, left)
            if gap in opened and used < n:
                opened[gap][pattern] = n - used
            if gap in opened and not opened[gap]:
                del opened[gap]
            left -= used * times
            fuller = opened.setdefault(gap - length * times, {})
            fuller[pattern + (length,) * times] = fuller.get(pattern + (length,) * times, 0) + used
    out += [item for bins in opened.values() for item in bins.items()]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), sorted by first rank. Rank first rank + k goes to sequence
    first sequence + k."""
    made: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            made.setdefault(length, []).append((rank, sequence, offset))
            next_rank[length] = rank + n
            offset += length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in made.items()}


@job()
def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Packs all rows of docs (doc_id, text) into sequences of at most `capacity` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the
    end token alone; repeated rows and ids are packed one by one; an empty table gives an empty result. The rows are
    computed at once and stay in the shared folder until the driver ends.
    """
    spark = docs.sparkSession
    pieces = kept(tokenized_pieces(docs, tokenizer, capacity, end))
    by_part = kept(pieces.groupBy("length", "part").count(), NARROW)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        counts[length] = n
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # at most a few rows for each length

    # The first rank of each (length, part): one row for each task and length, so that no length is hot.
    first = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("length", "part", F.coalesce(first, F.lit(0)).alias("first_rank"))
    ranked = pieces.join(starts, ["length", "part"]).select(*PLACED[:5], (F.col("first_rank") + F.col("nth")).alias("rank"))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return kept(mapped(ranked, _placer(places), placed), NARROW, stay=True)


PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _placer(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, table = np.flatnonzero(length == n), places.value[int(n)]
                at = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                sequence[rows], offset[rows] = at[:, 1] + rank[rows] - at[:, 0], at[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACED[:5]), pa.array(sequence), pa.array(offset)], names=list(PLACED))

    return run
