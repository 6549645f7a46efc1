"""Byte-level BPE by a minimal acyclic transducer of frequent pieces, and exact merging of the rest.

The lexicon maps a piece's bytes to its ids. Equal suffixes share states, and ids stand as far to the front of a path
as they can (a subsequential transducer), so that tails without ids of their own fall together. It is one file, sent
to each executor once and memory-mapped by its workers. Which pieces it holds has no influence on any result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import cut, most_frequent, rows_of, tidy
from foliate.llm.tokens import BatchEncoder, PieceCutter, library_tokenizer, special_tokens

#: Pieces in the lexicon, and counters that a task keeps while it looks for them.
LEXICON_PIECES = 1 << 16

#: Bytes of the longest piece that the lexicon may hold.
LONGEST = 64

#: Pieces of up to so many bytes merge by scanning all pairs again; longer ones by a heap, in n log n steps.
SCANNED = 40


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


NO_PAIR = 1 << 40


class Merges:
    """The vocabulary's bytes and merge ranks, read from a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        vocab, letters = about["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(about["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        self.made = np.zeros(len(about["model"]["merges"]), np.int64)
        for rank, new in self.pairs.values():
            self.made[rank] = new
        self.byte_array = np.array(self.byte_ids, np.int64)
        texts = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in about["added_tokens"]}
        self.token_bytes = [b""] * (max(texts) + 1)
        for i, t in texts.items():
            self.token_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the pair of least rank merges first, of equal ones the leftmost."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > SCANNED:
            return self._merge_long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best = min((found[0], k, found[1]) if (found := pairs.get(pair)) else (1 << 60, 0, 0) for k, pair in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of many pieces at once: in each round every piece merges its pair of least rank, side by side."""
        out: list[list[int]] = [[]] * len(pieces)
        number = [k for k, p in enumerate(pieces) if 0 < len(p) <= SCANNED]
        for k, p in enumerate(pieces):
            if len(p) > SCANNED:
                out[k] = self.merge(p)
        if not number:
            return out
        word = np.array(number)
        sizes = np.fromiter((len(pieces[k]) for k in number), np.int64, len(number))
        ids = self.byte_array[np.frombuffer(b"".join(pieces[k] for k in number), np.uint8)]
        rank = self._ranks(ids[:-1], ids[1:], append=True)
        while len(word):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank[ends - 1] = NO_PAIR  # no pair reaches into the next piece
            place = np.arange(len(ids)) - np.repeat(starts, sizes)
            best = np.minimum.reduceat(rank * 64 + place, starts)
            merging = best < NO_PAIR * 64
            if not merging.all():
                for k in np.flatnonzero(~merging):
                    out[word[k]] = ids[starts[k] : ends[k]].tolist()
                stay = np.repeat(merging, sizes)
                ids, rank, word, sizes, best = ids[stay], rank[stay], word[merging], sizes[merging], best[merging]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            at = starts + best % 64
            ids[at] = self.made[best // 64]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank, sizes = ids[stay], rank[stay], sizes - 1
            at -= np.arange(len(at))  # each piece before has lost one id
            after = np.minimum(at + 1, len(ids) - 1)
            rank[at] = self._ranks(ids[at], ids[after])
            left = np.maximum(at - 1, 0)
            rank[left] = self._ranks(ids[left], ids[np.minimum(left + 1, len(ids) - 1)])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray, append: bool = False) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.where(self.keys[at] == key, self.key_ranks[at], NO_PAIR)
        return np.append(found, NO_PAIR) if append else found

    def _merge_long(self, ids: list[int]) -> list[int]:
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        queue = [(found[0], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (found := self.pairs.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            n = after[k]
            if n < 0 or ids[k] != a or ids[n] != b:
                continue  # one of the two has merged since
            ids[k], ids[n] = self.pairs[a, b][1], -1
            after[k] = m = after[n]
            if m >= 0:
                before[m] = k
            for left, right in ((before[k], k), (k, m)):
                if left >= 0 and right >= 0 and (found := self.pairs.get((ids[left], ids[right]))):
                    heapq.heappush(queue, (found[0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class _State:
    __slots__ = ("arcs", "end")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # label: [target, output]
        self.end: tuple[int, ...] | None = None  # output at the end of a word, None if none ends here


def build(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal transducer of distinct (word, ids) pairs, as the bytes of a lexicon file."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    path = [_State()]
    previous = b""

    def freeze(state: _State) -> int:
        key = (state.end, tuple((label, *arc) for label, arc in sorted(state.arcs.items())))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            number = freeze(path.pop())
            path[-1].arcs[previous[len(path) - 1]][0] = number

    for word, ids in sorted(words):
        same = len(os.path.commonprefix([word, previous]))
        close(same)
        rest = ids
        for k in range(same):  # what this word's ids don't share moves from the path's arcs to the states behind them
            arc = path[k].arcs[word[k]]
            shared = len(os.path.commonprefix([arc[1], rest]))
            moved, arc[1], rest = arc[1][shared:], arc[1][:shared], rest[shared:]
            if moved:
                for other in path[k + 1].arcs.values():
                    other[1] = moved + other[1]
                if path[k + 1].end is not None:
                    path[k + 1].end = moved + path[k + 1].end
        for k in range(same, len(word)):
            path[k].arcs[word[k]] = [-1, rest if k == same else ()]
            path.append(_State())
        path[-1].end = ()
        previous = word
    close(0)
    root = freeze(path[0])

    outputs: dict[tuple[int, ...], int] = {(): 0}
    keys, targets, arc_outputs, ends = [], [], [], []
    for number, (end, arcs) in enumerate(states):
        ends.append(-1 if end is None else outputs.setdefault(end, len(outputs)))
        for label, target, output in arcs:
            keys.append(number << 8 | label)
            targets.append(target)
            arc_outputs.append(outputs.setdefault(output, len(outputs)))
    flat = [i for o in outputs for i in o]
    firsts = np.cumsum([0, *map(len, outputs)])
    arrays = {"keys": np.array(keys, "<u8"), "targets": np.array(targets, "<u4"), "outputs": np.array(arc_outputs, "<u4"), "ends": np.array(ends, "<i4"), "firsts": firsts.astype("<u4"), "flat": np.array(flat, "<u4")}
    head = json.dumps({"root": root, "arrays": {k: [str(v.dtype.str), len(v)] for k, v in arrays.items()}}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())


class Lexicon:
    """A lexicon file, memory-mapped. All workers on a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(data[:8], "little")
        about, at = json.loads(data[8 : 8 + size]), 8 + size
        self.root = about["root"]
        for name, (kind, n) in about["arrays"].items():
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    def __call__(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for those that the lexicon hasn't got. All words walk side by side."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        lengths = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        state = np.full(n, self.root, np.int64)
        given: dict[int, list[int]] = {}
        active = np.arange(n)
        for step in range(int(lengths[0])):
            active = active[: np.searchsorted(-lengths[active], -step, side="left")]  # longer ones stand in front
            if not len(active):
                break
            key = (state[active] << 8 | flat[starts[active] + step]).astype(np.uint64)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[active[~hit]] = -1
            active, arc = active[hit], arc[hit]
            state[active] = self.targets[arc]
            output = self.outputs[arc]
            for k in np.flatnonzero(output):
                given.setdefault(int(active[k]), []).append(int(output[k]))
        end = np.where(state >= 0, self.ends[np.maximum(state, 0)], -1)
        out: list[list[int] | None] = [None] * n
        for k in np.flatnonzero(end >= 0):
            out[order[k]] = [i for o in (*given.get(int(k), ()), int(end[k])) for i in self.flat[self.firsts[o] : self.firsts[o + 1]].tolist()]
        return out


def frequent_pieces(docs: DataFrame, tokenizer: str, most: int = LEXICON_PIECES) -> list[str]:
    """Up to `most` pieces that are frequent in all texts, by Misra-Gries summaries that merge by adding.

    Each task keeps `most` counters at a time; a piece that fills more than one in `most` of a task's pieces is never lost.
    Pieces of more than LONGEST bytes are left to the merges, so what reaches the driver is bounded in bytes too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = PieceCutter(library_tokenizer(tokenizer)), Counter()
        for batch in rows_of(batches, 1000, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(cutter(text) if text else ())
                if len(counts) > 4 * most:
                    least = heapq.nlargest(most + 1, counts.values())[-1]
                    counts = Counter({p: n - least for p, n in counts.items() if n > least})
        top = [(p, n) for p, n in counts.most_common(most) if len(p) <= LONGEST and len(p.encode()) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    summed = docs.select("text").mapInArrow(tidy(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in most_frequent(cut(summed.filter("n > 1")), most).orderBy(F.desc("n"), "piece").collect()]


def compile_lexicon(pieces: list[str], tokenizer: str) -> bytes:
    merges = Merges(tokenizer)
    special = special_tokens(library_tokenizer(tokenizer))
    return build((raw, tuple(merges.merge(raw))) for raw in {p.encode() for p in pieces if p and p not in special})


class LexiconEncoder:
    """piece_ids of a BatchEncoder: the lexicon first, then exact merges."""

    def __init__(self, lexicon: Lexicon, merges: Merges, special: dict[str, int]):
        self.lexicon, self.merges, self.special = lexicon, merges, special

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        found = self.lexicon(raw)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.merges.merge_all([raw[k] for k in unseen]), strict=True):
            found[k] = ids
        made = [[self.special[p]] if p in self.special else ids for p, ids in zip(pieces, found, strict=True)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(counts.sum())), counts


def _sent(spark, data: bytes) -> str:
    """Sends the file to every executor, those that come later too; returns the name to ask SparkFiles for."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    if not any(name in f for f in spark.sparkContext.listFiles):
        path = f"{spark.sparkContext._temp_dir}/{name}"  # on the driver, which serves the file; goes when the session stops
        with open(path, "wb") as file:
            file.write(data)
        spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, tokenizer: str, pieces: list[str] | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text, of any length; null and empty texts have no ids, repeated rows
    stay, other columns are left out, and an empty table gives an empty result.

    The lexicon holds `pieces`, or the frequent pieces of docs if none are given; an empty one works too.
    """
    spark = docs.sparkSession
    pieces = frequent_pieces(docs, tokenizer) if pieces is None else pieces
    name = _sent(spark, compile_lexicon(pieces, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        library = library_tokenizer(tokenizer)
        encoder = BatchEncoder(library, LexiconEncoder(Lexicon(SparkFiles.get(name)), Merges(tokenizer), special_tokens(library)))
        for batch in rows_of(batches, 500, "text", 2 << 20):
            ids, at = encoder(batch.column("text").to_pylist())
            made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows (doc_id, ids, ...) with `text` behind them: what the ids say, special tokens included; null ids say nothing.

    A column of rows that is called text is left out, all others stay.
    Bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary raise ValueError.
    """

    rows = rows.select([c for c in rows.columns if c.lower() != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Merges(tokenizer).token_bytes
        for batch in rows_of(batches, 500):
            column = batch.column("ids").fill_null([])
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            if len(flat) and (flat.min() < 0 or flat.max() >= len(table)):
                raise ValueError("an id is outside the vocabulary")
            texts = [b"".join(map(table.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("text", "string")]))
