"""Byte-pair encoding, coded files and packing, against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.llm.lexicon import Lexicon, Merges, build, compile_lexicon, decode, encode, frequent_pieces
from foliate.llm.packing import cut_lengths, pack, plan, slots
from foliate.llm.queries import byte_bpe
from foliate.llm.rans import LANES, Table, coded_ids, decode_block, encode_block, encode_file, frequencies, read_ids, write_ids
from foliate.llm.tokens import BatchEncoder, library_tokenizer

TEXTS = [
    None, "", " ", "plain words, and some more", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext", "Größe  \n\n\t x\r\n", "it's I'll WE'VE ''s",
    "漢字 かな 한국어 🎉🏽 ẞ", "\U00010940 new script ՘", "x" * 5000, " " * 300 + "y", "ab" * 700 + "\x00\x1f\x85\xa0z", "1²3¾ ª º", "%%% &&& ***",
]


@pytest.fixture(scope="module")
def library():
    return library_tokenizer(byte_bpe())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def split(flat, at):
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_batches_equal_the_library(library):
    encoder = BatchEncoder(library)
    for _ in range(2):
        assert split(*encoder(TEXTS)) == [expected(library, t) for t in TEXTS]
    assert split(*encoder([])) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), max_size=4))
def test_any_text(texts):
    library = library_tokenizer(byte_bpe())
    assert split(*BatchEncoder(library)(texts)) == [expected(library, t) for t in texts]


def test_transducer_is_exact_and_small(tmp_path):
    merges = Merges(byte_bpe())
    rng = random.Random(3)
    words = {"".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)}
    data = build((w, tuple(merges.merge(w))) for w in words)
    (tmp_path / "lexicon").write_bytes(data)
    lexicon = Lexicon(str(tmp_path / "lexicon"))
    found = lexicon([*words, b"zzz", b"aeinorstaeinorst", b""])
    assert found[: len(words)] == [merges.merge(w) for w in words] and found[-3:] == [None] * 3
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(lexicon.ends) < len(prefixes) / 2  # suffixes are shared
    (tmp_path / "none").write_bytes(build([]))
    assert Lexicon(str(tmp_path / "none"))([b"a"]) == [None]


def test_merging_many_equals_merging_one_by_one():
    merges = Merges(byte_bpe())
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randint(0, 60))) for _ in range(500)] + [b"a" * 300]
    assert merges.merge_all(pieces) == [merges.merge(p) for p in pieces]


@pytest.mark.parametrize("pieces", [None, [], [" and", "words"]])
def test_encode_and_decode(spark, library, pieces):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, "again", 2)], "doc_id long, text string, ids int")
    rows = decode(encode(docs, byte_bpe(), pieces), byte_bpe()).collect()
    made = sorted((r.doc_id, r.ids, r.text) for r in rows)
    assert made == sorted((k, ids := expected(library, t), library.decode(ids, skip_special_tokens=False)) for k, t in [*enumerate(TEXTS), (3, "again")])


def test_decode_and_counts_on_odd_input(spark):
    rows = spark.createDataFrame([(1, [255, 128]), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    assert [r.text for r in decode(rows, byte_bpe()).orderBy("doc_id").collect()][1:] == ["", "<|endoftext|>"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, byte_bpe()).collect() == [] and frequent_pieces(empty, byte_bpe()) == []
    docs = spark.createDataFrame([(1, "b a a a a c c")], "doc_id long, text string")
    assert frequent_pieces(docs, byte_bpe(), 2) == [" a", " c"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=200), min_size=1, max_size=6), st.sampled_from([1, 4, 64]))
def test_coded_blocks_round_trip(rows, lanes):
    rows = [np.array([*r, 0], np.uint32) for r in rows]
    ids = [None, *range(len(rows) - 1)]
    header, blocks, sizes = encode_file(ids, rows, block_ids=150, lanes=lanes)
    counts = np.bincount(np.concatenate(rows))
    table = Table(frequencies(counts))
    made_ids, made = [], []
    for b in blocks:
        x, y = decode_block(b, table, table.by_slot(), lanes)
        made_ids += x
        made += [r.tolist() for r in y]
    assert made_ids == ids and made == [r.tolist() for r in rows] and sum(n for n, _ in sizes) == sum(map(len, rows))


def test_many_segments_and_damage():
    rng = np.random.default_rng(1)
    row = rng.zipf(1.3, 3 * LANES * 256 + 17).clip(0, 50000).astype(np.uint32)
    table = Table(frequencies(np.bincount(row)))
    block = encode_block([5], [row], table)
    assert (decode_block(block, table, table.by_slot())[1][0] == row).all()
    assert len(block) < 2 * len(row)
    broken = bytearray(block)
    broken[-10] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(broken), table, table.by_slot())


def test_pieces_and_their_ids_without_places(library):
    rng, encoder = random.Random(8), BatchEncoder(library)
    special = list(encoder.cut.special)[:2]
    pieces = list(dict.fromkeys([*special, " ", "\n\n", " \u6f22\u5b57", "\U0001f600", "\x00", "\u0130"] + ["".join(rng.choice("abcXYZ\xe9\u4e2d1!") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]))
    whole = library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
    ids, counts = encoder.library_ids(pieces)
    assert ids.tolist() == whole.ids and counts.tolist() == np.bincount(whole.word_ids, minlength=len(pieces)).tolist()
    assert encoder.whole_pieces is not library
    encoder.tokenizer = None  # nothing is left for the slower way
    assert encoder.library_ids(pieces)[0].tolist() == whole.ids


def test_files_hold_all_ids_in_order(spark, library, tmp_path):
    texts = [(k * 7 % 31 - 3, t) for k, t in enumerate([*TEXTS, *(f"text {k} " * k for k in range(14))])] + [(2, "twice"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = write_ids(docs, byte_bpe(), str(tmp_path / "files"))
    rows = read_ids(manifest).orderBy("start").collect()
    start = 0
    for r in rows:
        assert r.start == start
        start += len(r.ids) // 4
    assert [r.doc_id for r in rows] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d))
    want = sorted(zlib.crc32(np.array([*expected(library, t), 0], "<u4").tobytes()) for _, t in texts)
    assert sorted(zlib.crc32(r.ids) for r in rows) == want
    assert coded_ids(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).collect() == []


def fits(patterns, counts, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for pattern, n in patterns:
        assert sum(pattern) <= capacity and n > 0
        for length in pattern:
            used[length] += n
    assert (used == counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 50)), max_size=30))
def test_plans_place_every_piece(rows):
    counts = np.zeros(61, np.int64)
    for length, n in rows:
        counts[length] += n
    patterns = plan(counts, 60)
    fits(patterns, counts, 60)
    for length, places in slots(patterns).items():
        assert places[0, 0] == 0 and (np.diff(places[:, 0]) > 0).all() and counts[length] > places[-1, 0]


def test_plans_use_exact_complements():
    counts = np.zeros(2049, np.int64)
    counts[[2000, 48, 1500, 500, 30, 18]] = [10, 6, 7, 7, 7, 7]
    patterns = plan(counts)
    assert sum(n for p, n in patterns if sum(p) == 2048) >= 13
    rng = np.random.default_rng(2)
    lengths = rng.lognormal(5.5, 0.9, 20000).clip(1, 2048).astype(int)
    counts = np.bincount(lengths, minlength=2049)
    patterns = plan(counts)
    fits(patterns, counts, 2048)
    assert sum(n for _, n in patterns) <= 1.003 * -(-lengths.sum() // 2048)


def test_packing_is_gapless(spark, library):
    texts = [(k, "word " * (k * 37 % 900)) for k in range(60)] + [(100, "long text " * 6000), (101, None), (101, "")]
    rows = pack(spark.createDataFrame(texts, "doc_id long, text string"), byte_bpe()).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {d: np.array([*expected(library, t), 0], "<u4") for d, t in texts if d != 101}
    for r in rows:
        want = ids[r.doc_id][r.start : r.start + r.length] if r.doc_id in ids else np.zeros(1, "<u4")
        assert len(want) == r.length and r.ids_crc32 == zlib.crc32(want.tobytes())
    for d, row in ids.items():  # the pieces of a document follow each other without a gap
        own = sorted(pieces[d])
        assert [k for k, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(row)
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:])) and own[0][1] == 0
    long = sorted(pieces[100])
    assert all(n == 2048 for _, _, n in long[1:]) and long[0][2] <= 2048 and sum(n for _, _, n in long) == len(expected(library, texts[60][1])) + 1
    assert len(pieces[101]) == 2
    assert cut_lengths(2048, 2048) == [(0, 2048)] and cut_lengths(1, 2048) == [(0, 1)] and cut_lengths(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).collect() == []


def test_clashing_columns_and_long_texts(spark, library):
    long = "Lang ist dieser Text, und er wiederholt sich. " * 30_000
    schema = "doc_id long, text string, ids int, start int, length int, part int, nth int, piece int, rank int, file string, at int"
    docs = spark.createDataFrame([(1, long, *[7] * 7, "f", 9), (2, None, *[7] * 7, "f", 9), (1, "twice", *[7] * 7, "f", 9)], schema)
    want = sorted([expected(library, long), [], expected(library, "twice")])
    assert sorted(r.ids for r in encode(docs, byte_bpe(), ["und", " und"]).collect()) == want
    assert sorted(np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in coded_ids(docs, byte_bpe()).collect()) == want
    assert sum(r.length for r in pack(docs, byte_bpe()).collect()) == sum(map(len, want)) + 3
    again = decode(encode(docs, byte_bpe()).withColumns({"text": F.lit(5), "other": F.lit(6)}), byte_bpe())
    assert again.columns == ["doc_id", "ids", "other", "text"] and sorted(r.text for r in again.collect()) == sorted([long, "", "twice"])


def test_pieces_of_latin_1_are_cut_in_numpy():
    from foliate.llm.tokens import LATIN_PIECES, piece_starts

    rng = random.Random(3)
    signs = ["'", "'", " ", " ", "\n", "\t", "\x85", "\xa0", "\x1c", "\x7f", *"stmdrevlS", "é", "×", "÷", "ß", "ª", "²", "7", "!", ","]
    for _ in range(3000):
        texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        begins = np.cumsum([0, *map(len, texts)])
        starts = piece_starts("".join(texts).encode("latin-1"), begins[:-1])
        assert starts.tolist() == [int(b) + m.start() for b, t in zip(begins, texts) for m in LATIN_PIECES.finditer(t)], texts


def test_packed_pieces_keep_their_numbers():
    from foliate.llm.tokens import PackedPieces

    rng, table = np.random.default_rng(5), PackedPieces(1)
    low, high = rng.integers(1, 1 << 63, 200_000, dtype=np.uint64), rng.integers(0, 3, 200_000, dtype=np.uint64)
    low[1::2], high[1::2] = low[::2], high[::2] + np.uint64(5)  # alike in their first bytes
    for k in range(0, len(low), 30_000):
        assert (table.find(low[k:], high[k:]) == -1).all()
        table.add(low[k : k + 30_000], high[k : k + 30_000], np.arange(k, min(k + 30_000, len(low))))
        assert (table.find(low[: k + 30_000], high[: k + 30_000]) == np.arange(min(k + 30_000, len(low)))).all()


def test_no_piece_of_latin_1_is_cut_by_itself(library, monkeypatch):
    """cutting and looking up each piece as a string took most of op7_rans_ids's time."""
    from foliate.llm import tokens

    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    monkeypatch.setattr(tokens.PieceCutter, "plain", lambda *_: pytest.fail("cut by itself"))
    encoder = tokens.BatchEncoder(library)
    texts = ["Größe  \n\n\t x\r\n", None, "it's I'll WE'VE ''s 'sx 'rest '", "", "1²3¾ ª º", "an extraordinarilylongword sixteen_and more" * 3, "x" * 100, "' '", "'r", "'l", "\x1f\x85\xa0z  "]
    for _ in range(2):
        assert split(*encoder(texts)) == [expected(library, t) for t in texts]


def test_pieces_kept_and_forgotten_in_mixed_batches(library, monkeypatch):
    from foliate.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_BYTES", 3000)
    rng, encoder = random.Random(4), tokens.BatchEncoder(library)
    for _ in range(12):
        texts = [rng.choice(["", "Größe", "漢字 ", "a\0b\0", "<|endoftext|>", "pneumonoultramicroscopic" * 2]) + f" {rng.choice('abc')}{rng.randint(0, 30)} ẞ"[: rng.randint(0, 9)] for _ in range(30)]
        assert split(*encoder(texts)) == [expected(library, t) for t in texts]


def test_batches_of_the_encoder_are_bounded_in_bytes(monkeypatch, tmp_path):
    """packing's workers held what 4 MB of text need beside the ids; an executor took 3,010 MB."""
    from foliate.llm import packing, rans, tokens

    most, bound = tokens.BATCH_BYTES, []
    for module in (packing, rans):
        monkeypatch.setattr(module, "rows_of", lambda batches, rows, weight, heavy=4 << 20: bound.append(heavy) or iter(()))
    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})
    for run in (lambda d: packing.tokenized_pieces(d, byte_bpe()), lambda d: rans.write_ids(d, byte_bpe(), str(tmp_path))):
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
        frame = _Runs(docs)
        monkeypatch.setattr(rans, "cut", lambda f: f)
        run(frame)
    assert bound == [most, most] and most <= 1 << 20


class _Runs:
    """Stands for a table: runs what mapInArrow gets on one batch, here and now."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    repartitionByRange = sortWithinPartitions = select  # noqa: N815

    def mapInArrow(self, run, _):  # noqa: N802
        list(run(iter([self.batch])))
        return self


def test_few_kept_pieces_change_nothing(library, monkeypatch):
    from foliate.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_BYTES", 1000)
    encoder = tokens.BatchEncoder(library)
    for k in range(5):
        texts = [f"some words {j} and more {j * k} words" for j in range(40)]
        flat, at = encoder(texts)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [expected(library, t) for t in texts]


def test_packing_leaves_no_encoder_in_its_worker(monkeypatch):
    from foliate.llm import packing, tokens

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    packing.tokenized_pieces(_Runs(pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})), byte_bpe())
    assert tokens.worker_encoder.cache_info().currsize == 0
