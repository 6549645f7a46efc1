import gc
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from foliate.llm import jaccard
from foliate.llm import shared as llm_shared
from foliate.llm.jaccard import Bands, components, near_classes, near_filter, shingle_sets
from foliate.llm.shared import job, kept, mapped

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def brute(rows, words, num, den):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.append((doc_id, s))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(k)]) for k, (doc_id, s) in enumerate(sets))


def near_copies(seed, groups=12, size=9, length=(3, 120)):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randint(*length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(copy)))
    return rows


def check(spark, rows, words=4, num=85, den=100):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_classes(docs, words, num, den).collect())
    assert got == brute(rows, words, num, den)


def test_against_brute_force(spark):
    rows = near_copies(1)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one"), (9005, "one two three"), (9006, rows[0][1].upper()), (9006, rows[0][1])]
    check(spark, rows)
    check(spark, rows, 5, 80, 100)


def test_large_group_of_near_copies_and_common_passage(spark):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = near_copies(3, groups=1, size=150, length=(110, 110))
    rows += [(5000 + k, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(12)])) for k in range(120)]
    check(spark, rows)


def test_empty_table_and_filter(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, sid int")
    assert near_filter(docs).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e f", 2), (3, "x", 3)], "doc_id long, text string, sid int")
    assert sorted(r.doc_id for r in near_filter(docs).collect()) == [1, 3]
    assert near_filter(docs).columns == ["doc_id", "text", "sid"]


def test_components_by_rounds_and_in_one_task(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    frame = spark.createDataFrame(links, "a long, b long")
    one = {r.node: r.root for r in components(frame).collect()}
    many = {r.node: r.root for r in components(frame, most=0).collect()}
    loops = {a for a, b in links if a == b}
    assert all(many[n] == r for n, r in one.items() if n in many) and set(one) - set(many) <= loops
    assert one[60] == 0 and one[1099] == 1000


def test_hot_group_of_short_texts_and_one_more_word(spark):
    rng, rows = random.Random(7), []
    for base in range(12):
        words = [f"b{base}x{k}" for k in range(9 + base % 5)]
        rows += [(1000 * base + k, " ".join(words + [f"w{rng.randrange(10**9)}"] * (k > 0))) for k in range(60)]
    check(spark, rows)


def test_hot_group_and_a_copy_in_the_band_below(spark):
    rng, rows, bands, hub = random.Random(8), [], Bands(85, 100), 0
    while len(rows) < 2 * 130:
        hub += 1
        words = [f"h{hub}x{k}" for k in range(37)]
        one, other = (bands.keys(s, 4)[0] for s in shingle_sets(pa.array([" ".join(words), " ".join(words[:32])]), 4))
        if len(set(other.tolist()) - set(one.tolist())) < 5:  # segments in which the copy differs
            continue
        rows += [(1000 * hub, " ".join(words)), (1000 * hub + 1, " ".join(words[:32]))]
        for k in range(2, 130):
            at = rng.randrange(4, 29)
            rows.append((1000 * hub + k, " ".join(words[:at] + [f"w{rng.randrange(10**9)}"] + words[at + 1 :])))
    check(spark, rows)


def test_pairs_of_few_shingles(spark):
    rng, rows = random.Random(9), []
    for pair in range(500):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9 + pair % 2)]
        rows += [(2 * pair, " ".join(words[:-1])), (2 * pair + 1, " ".join(words))]
    check(spark, rows, 5, 80, 100)


def test_sets_in_few_segments_share_a_key():
    rng, bands, seen = np.random.default_rng(10), Bands(85, 100), 0
    for _ in range(20_000):
        larger = np.sort(rng.integers(0, 1 << 64, 8, dtype=np.uint64, endpoint=False))
        for n in (7, 8):
            b = larger[:n]
            a = np.delete(b, rng.integers(n))
            for band in set(bands.bands_of(len(a))) & set(bands.bands_of(len(b))):
                one, other = (bands.keys(s, band)[0] for s in (a, b))
                if not np.isin(one, other).any():
                    seen += 1
                    assert np.isin(bands.least(a, band), bands.least(b, band)).any()
    assert seen


def test_filter_of_repeated_and_null_ids(spark):
    same, other, null = "a b c d e f", "p q r s t u", "n u l l i d"
    rows = [(1, same, 1), (1, same, 2), (2, same, 3), (2, other, 4), (None, same, 5), (None, null, 6), (None, null, 7), (None, "", 8), (None, "", 9), (3, "x", 10), (4, other, 11), (5, None, 12), (5, None, 13)]
    kept = [tuple(r) for r in near_filter(spark.createDataFrame(rows, "doc_id long, text string, sid int")).collect()]
    assert sorted(str(r[:2]) for r in kept) == sorted(map(str, [(1, same), (2, other), (None, null), (None, ""), (None, ""), (3, "x"), (5, None), (5, None)]))
    assert set(kept) <= set(rows) and len(set(kept)) == len(kept)


def spread(seed, copies, base, changes):
    """A base text and copies with words replaced at random, many of which are unlike the base and each other."""
    rng = random.Random(seed)
    words = [f"s{seed}x{k}" for k in range(base)]
    rows = [(1, " ".join(words))]
    for k in range(copies):
        copy = list(words)
        for at in rng.sample(range(base), rng.choice(changes)):
            copy[at] = f"n{rng.randrange(300)}"
        rows.append((2 + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("setting", [(4, 85, 100), (5, 80, 100)])
def test_large_group_around_the_threshold(spark, setting):
    check(spark, spread(1, 250, 100, (1, 2, 3, 4, 5, 6, 8, 12)), *setting)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_families_and_cut_copies_in_a_large_group(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "MANY", 30 if rounds else 1024)
    rng, rows = random.Random(3), []
    words = [f"base{k}" for k in range(120)]
    for family in range(4):
        own = list(words)
        for at in rng.sample(range(120), 5 * family):
            own[at] = f"f{family}x{at}"
        for _ in range(60):
            copy = list(own)
            for at in rng.sample(range(120), rng.randrange(6)):
                copy[at] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + k, " ".join(words[: rng.randrange(80, 121)])) for k in range(80)]
    check(spark, rows)


def rows_of_joins(spark, on):
    """Rows that all inner joins on `on` have made in this session."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        nodes, values = store.planGraph(runs.apply(k).executionId()).allNodes(), store.executionMetrics(runs.apply(k).executionId())
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and f"[{on}], [{on}], Inner" in re.sub(r"#\d+L?", "", node.desc()):
                for metric in map(node.metrics().apply, range(node.metrics().size())):
                    if metric.name() == "number of output rows" and (value := values.get(metric.accumulatorId())).isDefined():
                        total += int(value.get().replace(",", ""))
    return total


def test_few_joins_of_dear_keys(spark, monkeypatch):
    made, dear = [], jaccard._dear
    monkeypatch.setattr(jaccard, "_dear", lambda shared: made.append(dear(shared)) or made[0])
    before = rows_of_joins(spark, "key")
    check(spark, spread(1, 250, 100, (1, 2, 3, 4, 5, 6, 8, 12)))
    rows = made[0].count()
    assert rows > 500 and made[0].select("key", "leader").distinct().count() == made[0].select("key").distinct().count()
    assert rows_of_joins(spark, "key") - before < 4 * rows


def test_singletons_and_empty_segments_with_many_sharers(spark):
    rng, rows, bands, bases = random.Random(17), [], Bands(85, 100), 0
    while bases < 2:  # a base whose shingles leave a segment empty, and copies whose one more shingle falls into that
        base = [f"b{rng.randrange(10**6)}" for _ in range(9)]
        segments = lambda text: set((shingle_sets(pa.array([text]), 4)[0].astype(object) * bands.segments(2) >> 64).tolist())
        empty = set(range(bands.segments(2))) - segments(" ".join(base))
        if len(empty) != 1:
            continue
        rows.append((1000 * bases, " ".join(base)))
        while len(rows) < 61 * (bases + 1):
            text = " ".join([*base, f"w{rng.randrange(10**9)}"])
            if segments(text) > segments(" ".join(base)):
                rows.append((1000 * bases + len(rows), text))
        bases += 1
    check(spark, rows)
    check(spark, rows, 5, 80, 100)


@pytest.mark.parametrize("seed", range(3))
def test_random_short_texts_with_many_sharers(spark, seed):
    rng, rows = random.Random(100 + seed), []
    for base in range(20):
        words = [f"r{base}x{k}" for k in range(rng.randrange(4, 24))]
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy.insert(rng.choice([0, len(copy), rng.randrange(len(copy) + 1)]), f"w{rng.randrange(10**9)}")
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.randrange(2)])))
    check(spark, rows)
    check(spark, rows, 5, 80, 100)


def test_long_texts_and_words_are_hashed_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("q" * rng.randrange(1, 40) for _ in range(rng.randrange(30))) + "\t" * rng.randrange(3) for _ in range(40)] + ["", None, "x" * 200]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts), 4)]
    monkeypatch.setattr(jaccard, "AT_ONCE", 64)
    parts = [s.tolist() for s in shingle_sets(pa.array(texts), 4)]
    assert parts[:42] == whole[:42] and len(parts[42]) == 1
    long = "y" * 150
    one, two = (shingle_sets(pa.array([t]), 1)[0] for t in (f"{long} a {long}", f"b {long}"))
    assert len(one) == 2 and np.isin(one, two).sum() == 1
    monkeypatch.undo()
    text = " ".join(f"l{k}" for k in range(200_000))
    check(spark, [(1, text), (2, text + " more"), (3, "z" * 3_000_000), (4, "z" * 3_000_000), (5, "z" * 2_999_999)])


def test_clashing_columns(spark):
    schema = "doc_id long, text string, gone_ int, sid int, key_ int, twice_ int, comp int"
    rows = [(1, "a b c d e f", 1, 1, 1, 1, 1), (2, "a b c d e f", 2, 2, 2, 2, 2), (3, None, 3, 3, 3, 3, 3), (3, "g h i j k", 4, 4, 4, 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.gone_ for r in near_filter(docs).collect()) == [1, 3, 4]
    assert near_filter(docs).columns == docs.columns
    assert near_classes(docs).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(llm_shared, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    return tmp_path / "shared"


@pytest.mark.parametrize("near", [near_classes, near_filter])
def test_workers_write_all_tables(spark, monkeypatch, shared, near):
    """Spark's writers start chmod for each file, for a moment with all memory of the JVM, which so counts twice."""
    called = []
    for kind, name in ((type(spark.range(1)), "checkpoint"), (DataFrameWriter, "parquet")):
        monkeypatch.setattr(kind, name, lambda self, *args, f=getattr(kind, name), name=name, **named: called.append(name) or f(self, *args, **named))
    rows = spread(1, 250, 100, (1, 2, 3, 4, 5, 6, 8, 12))
    found = near(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    gc.collect()
    assert not called and len(list(shared.iterdir())) == 1  # of the tables only the last one stays
    least = {r[0]: r[2] for r in brute(rows, 4, 85, 100)}
    assert sorted(r.doc_id for r in found.collect()) == sorted(least if near is near_classes else set(least.values()))


def test_kept_tables(spark, shared):
    rows = [(None if k % 7 == 0 else k, f"t{k}", bytes([k % 256]), k % 2 == 0, [k, None], k / 3, (k, "x")) for k in range(300)]
    frame = spark.createDataFrame(rows, "a long, b string, c binary, d boolean, e array<int>, f double, g struct<x: int, y: string>")
    with job():
        one, none, last = kept(frame.repartition(3)), kept(frame.filter("b = ''")), kept(frame, stay=True)
        made = kept(mapped(frame.select("a"), lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows] * 200_000)], names=["n"]) for b in batches), "n long"))
        assert len(list(shared.iterdir())) == 4
    assert sorted(one.collect(), key=str) == sorted(frame.collect(), key=str) == sorted(last.collect(), key=str)
    assert none.count() == 0 and none.schema == frame.schema and made.count() % 200_000 == 0 < made.count()
    del one, none, made
    gc.collect()
    assert len(list(shared.iterdir())) == 1 and last.count() == 300


def test_failed_task_leaves_no_rows(spark, shared):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(200_000))], names=["n"])
            raise ValueError(batch.num_rows)

    with pytest.raises(Exception, match="ValueError"):
        kept(mapped(spark.range(10), run, "n long"))
    assert [f.name for f in shared.rglob("*") if f.is_file()] == []
