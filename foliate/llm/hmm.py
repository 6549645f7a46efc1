"""A hidden Markov language model: Baum-Welch counts from all partitions, exact likelihood by the scaled forward recursion.

Words are lower-cased runs of anything but space and 0x09 to 0x0D; each text ends with an end token. A state emits a
symbol: the word itself if it is one of the LEXICON most frequent, else the class of words with the same last three
bytes. P(word | class) is the word's count over the class's count plus its number of words; a word never seen counts
as one. So P(word | state) = P(symbol | state) P(word | class), and the second factor leaves the recursion: it is
looked up once for each rare word of a text, by a join with the counts of all words, which nothing has to hold.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import about, cut, most_frequent, rows_of, tidy

STATES = 10
LEXICON = 1 << 16
CLASSES = 1 << 12

#: Documents, about so many by their hash and of so many bytes at most, on which the driver makes the first guess, and how
#: often it refines it.
SEED_DOCS, SEED_BYTES, SEED_ROUNDS = 1_000, 1 << 15, 12

#: Rounds of Baum-Welch over all documents to learn from: so many at most, and none after one that raises the log likelihood
#: by less than GAIN of itself.
ROUNDS, GAIN = 3, 0.005

#: Weight of the prior: so many emissions from each state follow the symbols' overall frequencies.
PRIOR = 200.0

#: Words that a task counts before it hands on what it has; tokens that run through the recursion side by side.
COUNTED, TOGETHER, BUFFERED = 400_000, 1 << 19, 1 << 22


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return text.encode().lower().split() if text else []


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct words of texts, the number there of each word in a row, where each text's words begin, with the end
    last); the words are those of words_of, found without an object for each."""
    # copied, since a slice keeps its place in the bytes of the whole column when cast, and ascii_lower writes to a buffer of
    # the slice alone but leaves the places as they are: its texts would be whatever lies behind that buffer
    whole = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    encoded = lists.flatten().dictionary_encode()
    words, numbers = encoded.dictionary.cast(pa.large_binary()).cast(pa.binary()), encoded.indices.to_numpy()
    begins = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    blank = pc.index(words, pa.scalar(b"", pa.binary())).as_py()  # what stands before leading white space
    if blank >= 0:
        kept = numbers != blank
        begins = np.concatenate([[0], np.cumsum(kept)])[begins]
        numbers = numbers[kept]
    return words, numbers, begins


#: The steps of zlib.crc32, by byte.
CRC = np.array([functools.reduce(lambda x, _: x >> 1 ^ 0xEDB88320 * (x & 1), range(8), b) for b in range(256)], np.uint32)


def ends_crc32(words: pa.Array) -> np.ndarray:
    """zlib.crc32 of the last three bytes of each of an array of words (binary)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        some = np.flatnonzero(offsets[1:] - offsets[:-1] >= back)
        was = crc[some]
        crc[some] = CRC[(was ^ raw[offsets[1:][some] - back]) & 0xFF] ^ was >> 8
    return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


class Symbols(dict):
    """word -> symbol: frequent words by a number of their own, others by their class. `end` is the end token's."""

    def __init__(self, lexicon: Iterable[bytes]):
        super().__init__((w, k) for k, w in enumerate(lexicon))
        self.first_class = len(self)
        self.end = self.first_class + CLASSES
        self.size = self.end + 1
        self.lexicon: pa.Array | None = None

    def __missing__(self, word: bytes) -> int:
        return self.first_class + zlib.crc32(word[-3:]) % CLASSES

    def row(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(out < 0)
        out[rare] = [self.first_class + zlib.crc32(words[k][-3:]) % CLASSES for k in rare.tolist()]
        return out

    def __reduce__(self):
        return Symbols, (list(self),)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.append(self.row(words), np.int32(self.end))

    def found(self, words: pa.Array) -> np.ndarray:
        """`row` for an array of words."""
        if self.lexicon is None:
            self.lexicon = pa.array(list(self), pa.binary())
        out = pc.index_in(words, self.lexicon).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = np.flatnonzero(out < 0)
        out[rare] = self.first_class + ends_crc32(words.take(pa.array(rare))) % CLASSES
        return out

    def rows(self, found: np.ndarray, numbers: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """`of` for each text, of numbers and beginnings by distinct_words and the symbols found for its words."""
        flat = np.insert(found[numbers], begins[1:], np.int32(self.end))
        return np.split(flat, begins[1:-1] + np.arange(1, len(begins) - 1)) if len(begins) > 1 else []


@dataclass
class Chain:
    """start (K), move (K, K), emit (symbols, K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Sheet:
    """Sequences laid out step by step, longest first: at step t stand the symbols of all that are longer than t."""

    def __init__(self, rows: list[np.ndarray]):
        lengths = np.array([len(r) for r in rows])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # rows longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(rows)), lengths)
        step = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(rank), np.int32)
        self.symbols[self.at[step] + rank] = np.concatenate([rows[k] for k in self.order])

    def forward(self, chain: Chain, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(natural log likelihood of each row in the order given, scaled alphas, scales, emissions)."""
        emitted = chain.emit[self.symbols] if keep else None
        scales = np.empty(len(self.symbols), chain.emit.dtype)
        alphas = np.empty_like(emitted) if keep else None
        alpha = np.broadcast_to(chain.start, (self.active[0], len(chain.start)))
        ones = np.ones(len(chain.start), chain.emit.dtype)
        starts = self.at.tolist()
        for t, n in enumerate(self.active.tolist()):
            a, b = starts[t], starts[t + 1]
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ chain.move) * (emitted[a:b] if keep else chain.emit[self.symbols[a:b]])
            scale = alpha @ ones
            scales[a:b] = scale
            alpha /= scale[:, None]
            if keep:
                alphas[a:b] = alpha
        row = np.arange(len(scales)) - np.repeat(self.at[:-1], self.active)
        total = np.bincount(row, np.log(scales.astype(np.float64)), len(self.order))
        out = np.empty(len(total))
        out[self.order] = total
        return out, alphas, scales, emitted

    def expect(self, chain: Chain, counts: Chain) -> float:
        """Adds the expected numbers of starts, moves and emissions to counts; returns the log likelihood."""
        single = Chain(*(x.astype(np.float32) for x in (chain.start, chain.move, chain.emit)))  # enough for expected counts
        total, alphas, scales, later = self.forward(single, keep=True)
        later /= scales[:, None]  # emissions over scales, in time multiplied by beta
        gammas = alphas.copy()
        back = np.ascontiguousarray(single.move.T)
        for t in range(len(self.active) - 2, -1, -1):
            n = self.active[t + 1]
            beta = later[self.at[t + 1] : self.at[t + 2]] @ back
            here = slice(self.at[t], self.at[t] + n)
            gammas[here] *= beta
            later[here] *= beta
        counts.start += gammas[: self.active[0]].sum(0)
        if len(self.active) > 1:
            now = np.concatenate([np.arange(a, a + n) for a, n in zip(self.at, self.active[1:])])
            counts.move += chain.move * (alphas[now].T @ later[self.at[1] :])
        for k in range(len(chain.start)):  # sums by symbol
            counts.emit[:, k] += np.bincount(self.symbols, gammas[:, k], len(counts.emit))
        return float(total.sum())


def sheets(rows: list[np.ndarray], together: int = TOGETHER) -> Iterator[tuple[list[int], Sheet]]:
    """(numbers of rows, sheet), rows of about one length together."""
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    group: list[int] = []
    size = 0
    for k in order:
        if group and size + len(rows[k]) > together:
            yield group, Sheet([rows[g] for g in group])
            group, size = [], 0
        group.append(k)
        size += len(rows[k])
    if group:
        yield group, Sheet([rows[g] for g in group])


def no_counts(size: int) -> Chain:
    return Chain(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES)))


def maximize(counts: Chain, overall: np.ndarray) -> Chain:
    emit = counts.emit + PRIOR * overall[:, None]
    start, move = counts.start + 1.0, counts.move + 1.0
    return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_guess(rows: list[np.ndarray], overall: np.ndarray) -> Chain:
    """Sticky states with emissions shaken by a fixed generator, then refined on a few rows."""
    shaken = overall[:, None] * np.random.default_rng(7).uniform(0.2, 1.8, (len(overall), STATES))
    move = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1)) + np.eye(STATES) * (0.9 - 0.1 / max(STATES - 1, 1))
    chain = Chain(np.full(STATES, 1 / STATES), move, shaken / shaken.sum(0))
    for _ in range(SEED_ROUNDS if rows else 0):
        counts = no_counts(len(overall))
        for _, sheet in sheets(rows):
            sheet.expect(chain, counts)
        chain = maximize(counts, overall)
    return chain


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n over all texts. Tasks hand on sums, so no word is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            made = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": made["word"], "n": made["n_sum"]})

        for batch in rows_of(batches, 1000, "text"):
            words, numbers, _ = distinct_words(batch.column("text"))
            n = np.bincount(numbers, minlength=len(words))
            held.append(pa.table({"word": words, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
            if sum(map(len, held)) > 2 * COUNTED:
                held = [merged()]
                if len(held[0]) > COUNTED:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    return texts.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    symbols: Symbols
    chain: Chain | None  # None: nothing to learn from
    lexicon_counts: np.ndarray  # of the frequent words
    class_logs: np.ndarray  # log10 of count + number of words, by class
    tokens: int  # N, end tokens included
    types: int  # V
    ends: int  # documents learnt from
    counts: DataFrame  # word, n: of all words
    likelihoods: tuple[float, ...] = ()  # natural log likelihood of all texts before each round over them


def fit(docs: DataFrame, learn: Column, rounds: int = ROUNDS) -> LanguageModel:
    """Learns from the rows of docs (doc_id, text) for which `learn` holds; null texts are empty ones, repeated rows count
    as often as they are there, texts of any length are read whole, and without rows there is no chain.

    Word counts and Baum-Welch's expected counts cover all of these rows; only the first guess comes from a sample.
    """
    spark = docs.sparkSession
    texts = docs.filter(learn).select("doc_id", "text")
    counts = cut(word_counts(texts))
    ends = texts.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, LEXICON).orderBy(F.desc("n"), "word").collect()  # at most LEXICON rows
    symbols = Symbols(bytes(r.word) for r in top)
    lexicon_counts = np.array([r.n for r in top], np.int64)
    classes = np.zeros((CLASSES, 2))
    spread = spark.sparkContext.broadcast(symbols)
    for k, c, t in _class_counts(counts, spread).collect():  # at most CLASSES rows
        classes[k] = c, t
    model = LanguageModel(symbols, None, lexicon_counts, np.log10(np.maximum(classes.sum(1), 1)), total.n + ends, total.v + (ends > 0), ends, counts)
    if ends:
        overall = np.concatenate([lexicon_counts, classes[:, 0], [ends]]) + 1e-3
        overall /= overall.sum()
        short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SEED_BYTES
        seed = texts.filter(about(F.col("doc_id"), SEED_DOCS, ends) & short).limit(2 * SEED_DOCS).collect()
        chain = first_guess([symbols.of(words_of(r.text)) for r in seed], overall)
        for _ in range(rounds):
            counts, likelihood = _expected(texts, spread, chain, symbols.size)
            chain = maximize(counts, overall)
            model.likelihoods += (likelihood,)
            if len(model.likelihoods) > 1 and likelihood - model.likelihoods[-2] < GAIN * abs(likelihood):
                break
        model.chain = chain
    return model


def _class_counts(counts: DataFrame, spread) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((CLASSES, 2), np.int64)
        symbols = spread.value
        for batch in batches:
            at = symbols.row(batch.column("word").to_pylist()) - symbols.first_class
            rare = at >= 0
            made[:, 0] += np.bincount(at[rare], batch.column("n").to_numpy()[rare], CLASSES).astype(np.int64)
            made[:, 1] += np.bincount(at[rare], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(made[:, 0]), pa.array(made[:, 1])], names=["class", "n", "types"])

    return counts.mapInArrow(run, "class long, n long, types long").groupBy("class").agg(F.sum("n"), F.sum("types"))


def _buffered(batches: Iterator[pa.RecordBatch], symbols: Symbols) -> Iterator[tuple[list, list[np.ndarray], np.ndarray, pa.StructArray]]:
    """(doc_ids, symbols, distinct rare words of each row, these words, how often each stands there and their classes) of so
    many rows at a time that they hold about BUFFERED tokens."""
    kept: list = []
    rows: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    rare: list[pa.StructArray] = []
    size = 0
    for batch in rows_of(batches, 1000, "text"):
        words, numbers, begins = distinct_words(batch.column("text"))
        kept += batch.column("doc_id").to_pylist()
        found = symbols.found(words)
        rows += symbols.rows(found, numbers, begins)
        size += len(numbers) + batch.num_rows
        text = np.repeat(np.arange(batch.num_rows), np.diff(begins))
        here = found[numbers] >= symbols.first_class
        pairs, n = np.unique(text[here] * max(1, len(words)) + numbers[here], return_counts=True)
        text, at = np.divmod(pairs, max(1, len(words)))
        sizes.append(np.bincount(text, minlength=batch.num_rows))
        rare.append(pa.StructArray.from_arrays([words.take(pa.array(at)), pa.array(n, pa.int32()), pa.array(found[at] - symbols.first_class, pa.int32())], names=["word", "n", "class"]))
        if size > BUFFERED // 4:
            yield kept, rows, np.concatenate(sizes), pa.concat_arrays(rare)
            kept, rows, sizes, rare, size = [], [], [], [], 0
    if rows:
        yield kept, rows, np.concatenate(sizes), pa.concat_arrays(rare)


def _expected(texts: DataFrame, spread, chain: Chain, size: int) -> tuple[Chain, float]:
    """Baum-Welch's expected counts over all texts, and their natural log likelihood. Tasks hand on a row for each symbol
    that they met, and a few more."""
    sent = texts.sparkSession.sparkContext.broadcast(chain)
    names = [f"c{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = no_counts(size)
        rows: list[np.ndarray] = []
        held, likelihood = 0, np.zeros(STATES)

        def learn() -> None:
            for _, sheet in sheets(rows):
                likelihood[0] += sheet.expect(sent.value, counts)

        for batch in rows_of(batches, 1000, "text"):
            words, numbers, begins = distinct_words(batch.column("text"))
            rows += spread.value.rows(spread.value.found(words), numbers, begins)
            held += len(numbers) + batch.num_rows
            if held > BUFFERED:
                learn()
                rows, held = [], 0
        if rows:
            learn()
        met = np.flatnonzero(counts.emit.any(1))
        at = np.concatenate([met, -1 - np.arange(STATES + 2)])
        values = np.concatenate([counts.emit[met], counts.move, counts.start[None], likelihood[None]])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(STATES))], names=["at", *names])

    schema = "at long, " + ", ".join(f"{n} double" for n in names)
    summed = texts.select("text").mapInArrow(tidy(run), schema).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # at most `size` rows and a few
    at, values = summed["at"].to_numpy(), np.stack([summed[n].to_numpy() for n in names], 1)
    counts = no_counts(size)
    counts.emit[at[at >= 0]] = values[at >= 0]
    few = {-1 - int(k): row for k, row in zip(at[at < 0], values[at < 0], strict=True)}
    for k in range(STATES):
        counts.move[k] = few[k]
    counts.start[:] = few[STATES]
    return counts, float(few[STATES + 1][0])


SCORED = "doc_id long, key long, n_tokens long, n_known long, base_sum double, chain_log double, rare array<struct<word:binary,n:int,class:int>>"


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of each row's whole text.

    base_score: add-one unigrams. score: the chain's exact likelihood. Null texts are the end token alone; repeated
    rows are scored one by one, texts of any length whole; other columns of docs are left out, whatever their names; an
    empty table gives an empty result. Where nothing was learnt, both scores are the same.
    """
    spark = docs.sparkSession
    spread = spark.sparkContext.broadcast((model.symbols, model.chain, np.log10(np.append(model.lexicon_counts, 0) + 1.0), model.class_logs, model.ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        symbols, chain, logs, _, ends = spread.value
        key = TaskContext.get().partitionId() << 40
        for doc_ids, rows, sizes, rare_words in _buffered(batches, symbols):
            chain_logs = np.zeros(len(rows))
            for numbers, sheet in sheets(rows, BUFFERED) if chain is not None else ():
                chain_logs[numbers] = sheet.forward(chain)[0]
            known, sums = [], []
            for row in rows:
                frequent = row[row < symbols.first_class]
                known.append(len(frequent) + (ends > 0))
                sums.append(float(logs[frequent].sum()) + math.log10(ends + 1))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rare_words)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(np.arange(key, key + len(rows))), pa.array([len(r) for r in rows], pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(chain_logs / math.log(10)), rare]
            key += len(rows)
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    scored = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCORED))
    rare = scored.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.n", F.col("r.class").alias("class"))
    found = rare.join(model.counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    table = spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.class_logs)], "class int, log double")  # CLASSES rows
    found = found.join(F.broadcast(table), "class")
    sums = found.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_base"),
        F.sum(F.col("n") * (F.log10(F.greatest("c", F.lit(1))) - F.col("log"))).alias("rare_log"),
    )
    whole = scored.drop("rare").join(sums, "key", "left")
    each = math.log10(model.tokens + model.types + 1)
    base = F.col("base_sum") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * each
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("chain_log") + F.coalesce("rare_log", F.lit(0.0)) if model.chain is not None else base).alias("score"),
    )
