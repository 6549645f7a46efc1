"""Token ids of whole texts by the tokenizers library, with every distinct piece of a batch encoded once.

A byte-level BPE cuts a text into pieces by a pattern and merges inside each piece alone, so the ids of a text are the
ids of its pieces in a row. Pieces recur, texts don't: the library sees each distinct piece of a batch once. Texts of
Latin-1 are cut side by side in numpy, and their pieces of up to 16 bytes are looked up as two integers each, which hold
the very bytes; other texts and longer pieces are looked up as strings.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import regex

from foliate.llm.shared import FORGET

#: The pattern of byte-level BPE, a fixed value of the vocabulary's public pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Characters that newer Unicode tables class in another way than the library's, and more around them: texts with one
#: are cut by the library itself.
NEWER = regex.compile("[՘֋֌࢏౜೜₏₝-₟꟎-ꟿ꭬꭭\U00010000-\U0001efff\U00020000-\U0010ffff]")

#: The same pattern for texts of Latin-1 alone, its letters, numbers and spaces spelt out: much faster.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PIECES = re.compile(f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

#: Which of these each character of Latin-1 is: 0 a space, 1 a letter, 2 a number, 3 anything else.
KINDS = bytes(next((k for k, part in enumerate((SPACES, LETTERS, NUMBERS)) if re.match(f"[{part}]", chr(c))), 3) for c in range(256))

#: What keeps the first 0 to 8 bytes of a little-endian integer.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Once a worker knows the ids of pieces of more bytes, overhead included (of a string, of two integers), it forgets those
#: that its last batch hadn't got.
KEPT_BYTES, OVERHEAD, PACKED = 32 << 20, 200, 96

#: Pieces of Latin-1 that are looked up at once.
AT_ONCE = 1 << 16

#: Bytes of text in a batch, for what a batch needs beside its ids: about ten times as much.
BATCH_BYTES = 1 << 20


def library_tokenizer(path: str):
    """The tokenizer in a file, without truncation and padding, on one thread: Spark runs a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_tokens(tokenizer) -> dict[str, int]:
    """Strings that the library takes out of a text before any other step."""
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def token_bytes(tokenizer) -> np.ndarray:
    """How many bytes of text each id stands for: a sign each in a byte-level vocabulary; special tokens stand for themselves."""
    out = np.zeros(tokenizer.get_vocab_size(True) + 1, np.int64)
    special = special_tokens(tokenizer)
    for token, i in tokenizer.get_vocab(True).items():
        if i >= len(out):
            out = np.concatenate([out, np.zeros(i + 1, np.int64)])
        out[i] = len(token.encode()) if token in special else len(token)
    return out


def for_pieces(tokenizer):
    """A copy of a byte-level tokenizer that takes pieces as they are, without looking for cuts in each again; the tokenizer
    itself where its pieces aren't made by the plain byte-level step."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    made = json.loads(tokenizer.to_str())
    step = made["pre_tokenizer"] or {}
    if made["normalizer"] or (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) != ("ByteLevel", False, True):
        return tokenizer
    copy = Tokenizer.from_str(tokenizer.to_str())
    copy.no_truncation()
    copy.no_padding()
    copy.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return copy


class PieceCutter:
    """Cuts texts into pieces and special tokens as the library does."""

    def __init__(self, tokenizer):
        self.library = tokenizer.pre_tokenizer
        self.special = special_tokens(tokenizer)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __call__(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.special):
            return [piece for part in self.split.split(text) for piece in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    def latin(self, text: str | None) -> bytes | None:
        """The text in Latin-1, for piece_starts; None where it isn't of Latin-1 or has what piece_starts doesn't know."""
        try:
            raw = (text or "").encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if b"\0" in raw or any(s in text for s in self.special if raw) else raw

    def plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN_PIECES.findall(text)
        except UnicodeEncodeError:
            pass
        if NEWER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return PIECES.findall(text)


def piece_starts(raw: bytes, begins: np.ndarray) -> np.ndarray:
    """Where LATIN_PIECES begins a piece in texts of Latin-1 that stand side by side, of which none is empty."""
    data, kind, n = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KINDS), np.uint8), len(raw)
    edge = np.zeros(n + 1, bool)
    edge[begins] = edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:n])  # the last of some spaces stands alone,
    start[last] = True
    start[last[data[last] == 32] + 1] = False  # or in front of what follows
    mark = np.flatnonzero(data == 39)
    mark = mark[start[mark] & ~edge[mark + 1]]
    one, two = data[mark + 1], np.where(edge[mark + 2], 0, data[np.minimum(mark + 2, n - 1)])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    start[after[after < n]] = True
    return np.flatnonzero(start)


class PackedPieces:
    """Numbers of pieces of up to 16 bytes, none of them 0, by open addressing, for whole arrays at a time.

    A piece is two integers of its first 8 bytes and of the others, zeros behind: no two pieces have the same ones.
    """

    def __init__(self, room: int = 1 << 15):
        self.bits, self.used = max(16, (2 * room).bit_length()), 0
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xD1342543DE82EF95)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those without."""
        slot = self._slots(low, high)
        out = self.number[slot].astype(np.int64)
        other = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(other):
            slot[other] = at = (slot[other] + 1) & ((1 << self.bits) - 1)
            out[other] = self.number[at]
            other = other[(out[other] >= 0) & ((self.low[at] != low[other]) | (self.high[at] != high[other]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Different pieces that have no number yet."""
        if 2 * (self.used + len(low)) > 1 << self.bits:
            (a, b, c), room = self.items(), self.used + len(low)
            self.__init__(room)
            self.add(a, b, c)
        self.used += len(low)
        slot = self._slots(low, high)
        while len(slot):
            free = self.number[slot] < 0
            self.number[slot[free]] = number[free]  # of several for a slot one gets it
            won = self.number[slot] == number
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            low, high, number, slot = low[~won], high[~won], number[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.number >= 0)
        return self.low[at], self.high[at], self.number[at]


class BatchEncoder:
    """Whole texts to ids. piece_ids(distinct pieces) -> (all their ids in a row, how many each has)."""

    def __init__(self, tokenizer, piece_ids=None):
        self.tokenizer, self.cut = tokenizer, PieceCutter(tokenizer)
        self.piece_ids = piece_ids or self.library_ids
        self.token_bytes: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        self._number({}, PackedPieces(), 0)
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _number(self, strings: dict[str, int], packed: PackedPieces, known: int) -> None:
        """From now on these pieces are known, by these numbers; others get the next ones, as they are first looked up."""
        self.next = count(known)
        self.strings, self.packed = defaultdict(self.next.__next__, strings), packed
        self.held = OVERHEAD * len(strings) + sum(map(len, strings)) + PACKED * packed.used

    def library_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids without the places it would look up for each: a piece's tokens have as many bytes as the piece."""
        if self.token_bytes is None:
            self.token_bytes, self.whole_pieces = token_bytes(self.tokenizer), for_pieces(self.tokenizer)
        [encoding] = self.whole_pieces.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoding.ids, np.uint32)
        upto = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, pieces if "".join(pieces).isascii() else map(str.encode, pieces)), np.int64, len(pieces)))
        stops = np.searchsorted(upto, ends) + 1
        if len(upto) and upto[-1] == ends[-1] and np.array_equal(upto[stops - 1], ends):
            return ids, np.diff(stops, prepend=0)
        encoding = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)  # not one byte for each of a token's signs
        return np.array(encoding.ids, np.uint32), np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(pieces))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, where each text's begin, with the end last); a null text has none."""
        raw = [self.cut.latin(t) for t in texts]
        latin = np.array([r is not None for r in raw], bool)
        known, sizes = self.packed.used + len(self.strings), np.zeros(len(texts), np.int64)
        row, sizes[latin], fresh = self._latin([r for r in raw if r is not None])
        others = [t for t, r in zip(texts, raw, strict=True) if r is None]
        more: list[int] = []

        def cut() -> Iterator[list[str]]:  # text by text, so that a text's pieces are looked up while they are in the processor's cache
            for text in others:
                pieces = self.cut(text) if text else []
                more.append(len(pieces))
                yield pieces

        strings = np.fromiter(map(self.strings.__getitem__, chain.from_iterable(cut())), np.int64)
        sizes[~latin] = more
        if len(strings):
            which, first = np.repeat(latin, sizes), row
            row = np.empty(len(which), np.int64)
            row[which], row[~which] = first, strings
        if new := self.packed.used + len(self.strings) - known - len(fresh):
            strung = list(islice(reversed(self.strings), new))[::-1]
            self.held += OVERHEAD * new + sum(map(len, strung))
            fresh += strung
        if fresh:
            self._learn(known, *self.piece_ids(fresh))
        ids, counts = self._ids(row)
        if self.held > KEPT_BYTES:
            self._keep(row)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]

    def _latin(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(the numbers of all pieces of texts in Latin-1, how many each text has, the new pieces among the short ones)."""
        flat = b"".join(raws)
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(raws), np.int64), []
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))])
        starts = piece_starts(flat, bounds[bounds < len(flat)])
        sizes = np.diff(np.searchsorted(starts, bounds))
        lengths = np.diff(np.append(starts, len(flat)))
        eight = np.ndarray(len(flat) + 9, "<u8", flat + bytes(16), strides=(1,))  # from each place on
        row, fresh = np.zeros(len(starts), np.int64), []
        for k in range(0, len(starts), AT_ONCE):
            row[k : k + AT_ONCE] = self._packed(flat, eight, starts[k : k + AT_ONCE], lengths[k : k + AT_ONCE], fresh)
        large = np.flatnonzero(lengths > 16)
        row[large] = [self.strings[flat[a : a + n].decode("latin-1")] for a, n in zip(starts[large].tolist(), lengths[large].tolist(), strict=True)]
        return row, sizes, fresh

    def _packed(self, flat: bytes, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fresh: list[str]) -> np.ndarray:
        """The numbers of the short ones of these pieces, 0 for others; new ones are appended to fresh."""
        low, high = eight[starts] & FIRST_BYTES[np.minimum(lengths, 8)], np.zeros(len(starts), np.uint64)
        longer = np.flatnonzero(lengths > 8)
        high[longer] = eight[starts[longer] + 8] & FIRST_BYTES[np.minimum(lengths[longer] - 8, 8)]
        row = self.packed.find(low, high)
        row[lengths > 16] = 0
        new = np.flatnonzero(row < 0)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            first = np.concatenate([[True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])])
            one = new[first]
            fresh += [flat[a : a + n].decode("latin-1") for a, n in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)]
            numbers = np.fromiter(islice(self.next, len(one)), np.int64, len(one))
            self.packed.add(low[one], high[one], numbers)
            self.held += PACKED * len(one)
            row[new] = numbers[np.cumsum(first) - 1]
        return row

    def _ids(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the pieces of these numbers in a row, how many each has)."""
        begins = self.ends[row - 1] * (row > 0)
        counts = self.ends[row] - begins
        stops = np.cumsum(counts)
        return self.flat[np.repeat(begins - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)], counts

    def _keep(self, row: np.ndarray) -> None:
        """Forgets all pieces but those of these numbers."""
        kept = np.unique(row)
        number = np.full(self.packed.used + len(self.strings), -1, np.int64)
        number[kept] = np.arange(len(kept))
        low, high, old = self.packed.items()
        strings = {p: int(number[k]) for p, k in self.strings.items() if number[k] >= 0}
        stay, (ids, counts) = number[old] >= 0, self._ids(kept)
        self.forget()
        packed = PackedPieces(int(stay.sum()))
        packed.add(low[stay], high[stay], number[old[stay]])
        self._number(strings, packed, len(kept))
        self._learn(0, ids, counts)

    def _learn(self, known: int, ids: np.ndarray, counts: np.ndarray) -> None:
        used = int(self.ends[known - 1]) if known else 0
        while len(self.flat) < used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < known + len(counts):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[known : known + len(counts)] = used + np.cumsum(counts)


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> BatchEncoder:
    """The encoder that a worker keeps from task to task, with the pieces that it knows."""
    return BatchEncoder(library_tokenizer(path))


FORGET.append(worker_encoder.cache_clear)
