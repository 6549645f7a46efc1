"""Token ids in files coded by a static range asymmetric numeral system.

A file holds documents in ascending order of their ids. One frequency table serves all its blocks; a block holds whole
documents, is coded by `LANES` interleaved coders, and can be decoded alone. Inside a block, checkpoints give all
coders' states and the place in the stream, so its segments too can be decoded side by side; a checksum covers each.

    file:   MAGIC, scale bits u32, lanes u32, table size u32, table (zlib: u32 frequency of each id), blocks
    block:  header (u32: ids, documents, segments, index size), index (zlib: i64 doc ids, u32 lengths, u8 null flags),
            segments' table (u32: words, crc32 of the ids), segments' states (u64 for each lane), words (u32)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import cut, file_system, new_folder, rows_of, tidy, write_file
from foliate.llm.tokens import BATCH_BYTES, worker_encoder

MAGIC = b"RANSIDS1"
SCALE_BITS = 20
LANES = 2048
SEGMENT_STEPS = 256  # ids in a segment: so many for each lane
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 23
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << SCALE_BITS) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE_BITS, at least 1 for every id that occurs."""
    present = np.count_nonzero(counts)
    if present > 1 << (SCALE_BITS - 1):
        raise ValueError(f"{present} different ids are too many for {SCALE_BITS} bits")
    total, room = int(counts.sum()), (1 << SCALE_BITS) - present
    scaled = np.where(counts > 0, 1 + (counts.astype(np.float64) * room / max(total, 1)).astype(np.int64), 0)
    if present:
        scaled[int(np.argmax(scaled))] += (1 << SCALE_BITS) - int(scaled.sum())
    return scaled.astype(np.uint64)


class Table:
    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.frequency)[:-1]]).astype(np.uint64)
        self.limit = ((LOW >> np.uint64(SCALE_BITS)) << WORD) * self.frequency

    def packed(self) -> bytes:
        return zlib.compress(self.frequency.astype("<u4").tobytes(), 6)

    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


def encode_segment(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) from which decode_segment gets the ids back."""
    state = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    frequency, limit, first = table.frequency[ids], table.limit[ids], table.first[ids]
    for start in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f = frequency[start : start + lanes]
        x = state[: len(f)]
        over = x >= limit[start : start + lanes]
        chunks.append(x[over].astype(np.uint32))
        x = np.where(over, x >> WORD, x)
        q = x // f
        state[: len(f)] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + first[start : start + lanes]
    return state, np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)


def decode_segment(n: int, state: np.ndarray, words: np.ndarray, table: Table, by_slot: np.ndarray) -> np.ndarray:
    state, lanes, at = state.copy(), len(state), 0
    out = np.empty(n, np.uint32)
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        slot = x & MASK
        row = by_slot[slot.astype(np.int64)]
        out[start : start + len(row)] = row
        x = table.frequency[row] * (x >> np.uint64(SCALE_BITS)) + slot - table.first[row]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | words[at : at + len(low)].astype(np.uint64)
        at += len(low)
        state[: len(row)] = x
    return out


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray], table: Table, lanes: int = LANES) -> bytes:
    flat = np.concatenate(ids)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(x) for x in ids], "<u4").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    index = zlib.compress(index, 6)
    step = lanes * SEGMENT_STEPS
    parts = [encode_segment(flat[s : s + step], table, lanes) for s in range(0, len(flat), step)]
    sums = [zlib.crc32(flat[s : s + step].astype("<u4").tobytes()) for s in range(0, len(flat), step)]
    about = b"".join(struct.pack("<II", len(words), crc) for (_, words), crc in zip(parts, sums, strict=True))
    return b"".join([struct.pack("<IIII", len(flat), len(doc_ids), len(parts), len(index)), index, about, *(s.astype("<u8").tobytes() for s, _ in parts), *(w.astype("<u4").tobytes() for _, w in parts)])


def decode_block(block: bytes, table: Table, by_slot: np.ndarray, lanes: int = LANES) -> tuple[list[int | None], list[np.ndarray]]:
    """(document ids, their token ids); raises ValueError where a checksum doesn't agree."""
    n, docs, segments, size = struct.unpack_from("<IIII", block)
    index = zlib.decompress(block[16 : 16 + size])
    doc_ids, lengths, nulls = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u4", docs, 8 * docs), np.frombuffer(index, "u1", docs, 12 * docs)
    about = np.frombuffer(block, "<u4", 2 * segments, 16 + size).reshape(-1, 2)
    at = 16 + size + 8 * segments
    states = np.frombuffer(block, "<u8", segments * lanes, at).reshape(segments, lanes)
    words, step = np.frombuffer(block, "<u4", offset=at + 8 * segments * lanes), lanes * SEGMENT_STEPS
    flat = np.empty(n, np.uint32)
    begin = 0
    for k, (count, crc) in enumerate(about.tolist()):
        part = decode_segment(min(step, n - k * step), states[k], words[begin : begin + count], table, by_slot)
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError(f"segment {k} is damaged: its checksum doesn't agree")
        flat[k * step : k * step + len(part)] = part
        begin += count
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], np.split(flat, np.cumsum(lengths)[:-1])


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray], block_ids: int = BLOCK_IDS, lanes: int = LANES) -> tuple[bytes, list[bytes], list[tuple[int, int]]]:
    """(header, blocks, (ids, documents) of each block). The table is made from these very ids."""
    table = Table(frequencies(np.bincount(np.concatenate(ids), minlength=1)))
    packed = table.packed()
    blocks, sizes, start, held = [], [], 0, 0
    for k, x in enumerate(ids):
        held += len(x)
        if held >= block_ids or k == len(ids) - 1:
            blocks.append(encode_block(doc_ids[start : k + 1], ids[start : k + 1], table, lanes))
            sizes.append((held, k + 1 - start))
            start, held = k + 1, 0
    return MAGIC + struct.pack("<III", SCALE_BITS, lanes, len(packed)) + packed, blocks, sizes


def read_table(stream) -> tuple[Table, int]:
    """(table, lanes) from a file's first bytes."""
    head = stream.read(20)
    if head[:8] != MAGIC:
        raise ValueError("not a file of coded ids")
    bits, lanes, size = struct.unpack("<III", head[8:])
    if bits != SCALE_BITS:
        raise ValueError(f"{bits} bits of scale; {SCALE_BITS} are known")
    return Table(np.frombuffer(zlib.decompress(stream.read(size)), "<u4")), lanes


MANIFEST = "part int, file string, file_no int, block int, at long, size long, n_ids long, n_docs long"


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end: int = 0) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order, to files in folder; returns a row for each block.

    A null text is empty; each document ends with the id `end`. Rows with null ids come first; repeated rows stay.
    """
    last = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        held_docs: list[int | None] = []
        held_ids: list[np.ndarray] = []
        held, number = 0, 0

        def flush() -> pa.RecordBatch:
            header, blocks, sizes = encode_file(held_docs, held_ids)
            file = write_file(folder, f"part-{part:06d}-{number:04d}.rans", [header, *blocks])
            at = np.cumsum([len(header), *map(len, blocks)])
            rows = [(part, file, number, k, int(at[k]), len(b), *sizes[k]) for k, b in enumerate(blocks)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in rows_of(batches, 1000, "text", BATCH_BYTES):
            flat, at = encode(batch.column("text").to_pylist())
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                held_docs.append(doc_id)
                held_ids.append(np.append(flat[a:b], last))
                held += len(held_ids[-1])
            if held >= FILE_IDS:
                yield flush()
                held_docs, held_ids, held, number = [], [], 0, number + 1
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(tidy(run, keep=True), MANIFEST))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Reads the files of write_ids back, each block by itself: doc_id, start, ids (little-endian u32), in no order.

    start: how many ids stand in all files before the document's first one.
    """
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each task that wrote
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    inside = manifest.withColumn("in_part", before(Window.partitionBy("part").orderBy("file_no", "block")))
    blocks = inside.join(parts, "part").select("file", "at", "size", (F.col("part_start") + F.col("in_part")).alias("start"))
    spark = manifest.sparkSession
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism + manifest.count() // 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of: tuple = (None, None)
        for row in (r for batch in batches for r in batch.to_pylist()):
            system, path = file_system(row["file"])
            with system.open_input_file(path) as stream:
                if table_of[0] != row["file"]:
                    table, lanes = read_table(stream)
                    table_of = (row["file"], (table, table.by_slot(), lanes))
                stream.seek(row["at"])
                block = stream.read(row["size"])
            doc_ids, ids = decode_block(block, *table_of[1])
            starts = row["start"] + np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")


def coded_ids(docs: DataFrame, tokenizer: str, end: int = 0, folder: str | None = None) -> DataFrame:
    """write_ids to a new folder in the shared one (or to `folder`), then read_ids: a row for each row of docs (doc_id, text).

    Null and empty texts are the end id alone, texts of any length are coded whole; repeated rows stay, null ids come
    first; other columns are left out; an empty table writes nothing and gives an empty result.
    """
    return read_ids(write_ids(docs, tokenizer, folder or new_folder(docs.sparkSession, "token-ids"), end))
