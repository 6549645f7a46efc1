"""Quality rules, toxicity, language model and pipeline."""

import gc
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from foliate.llm import hmm as M
from foliate.llm import quality as Q
from foliate.llm import shared as llm_shared
from foliate.llm import toxicity as X
from foliate.llm.shared import remainder

RNG = random.Random(9)
COMMON = [a + b for a in ("lo", "ra", "mi", "ten", "su", "ba") for b in ("na", "ti", "ron", "", "s", "vel")]


def prose(n, words=COMMON):
    return " ".join(RNG.choice(words) for _ in range(n)) + "."


def slow_counts(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "a b c", "a b c a b c", "x x x x", "é\x1f\x85 b # | <\n\ny\ny\n \n", prose(300) * 2, "a b c d a b e a b c"])
def test_counts(text):
    assert Q.count_text(text)[:6] == slow_counts(text)


def test_verdicts_follow_each_group(spark):
    rows = [(k, prose(120), "en", f"s{k % 3}") for k in range(90)] + [(100 + k, " ".join(f"{w} %%%{j}" for j, w in enumerate(prose(60).split())), "en", "s0") for k in range(4)]
    rows += [(200, prose(20), "en", "s0"), (201, prose(20) * 9, "en", "s1"), (202, None, None, None), (203, prose(80), None, None), (204, prose(90).upper(), "en", "s2"), (0, prose(100), "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash"))
    report = {r.doc_id: r for r in Q.quality_report(docs).collect()}
    assert all(report[k].kept for k in range(90)) and not any(report[k].kept for k in range(100, 104))
    assert report[200].base_failed and report[201].base_failed and report[202].base_failed and not report[204].kept and report[203].kept
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if report[r[0]].kept)
    assert Q.quality_report(docs.limit(0)).collect() == [] and Q.quality_filter(docs.limit(0)).collect() == []
    told = {(r.lang, r.source): r for r in Q.rejections(Q.quality_report(docs)).collect()}
    assert told["en", "s0"].rejected_symbols == 4 and told["en", "s2"].rejected_capitals == 1 and told["en", "s1"].base_failed == 1
    assert all(r.level_symbols in (None, 1, 2) for r in told.values())


def slow_fences(values, jump):
    """The fence of a list of values, from sorted values instead of sketches (all below 64, so that buckets are exact)."""
    values, n = sorted(values), len(values)
    steps = [values[-(-p * n // 100) - 1] for p in range(Q.LOWEST, Q.HIGHEST + 1)]
    for low, high in zip(steps, steps[1:]):
        if high - low >= jump and high >= Q.TIMES * low:
            return (low + high) // 2
    return steps[-1] + max(steps[-1], jump)


def test_fences_against_sorted_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEATURES", {"symbols": ("x", 10), "capitals": ("x", 30)})
    rng, groups = random.Random(6), {}
    for lang, source, n in (("a", "p", 150), ("a", "q", 99), ("a", None, 20), ("b", "p", 30), (None, "p", 3), ("c", "r", 1000)):
        groups[lang, source] = [rng.choice([0, 0, 1, 2, 5]) if rng.random() < 0.93 else rng.randrange(20, 63) for _ in range(n)]
    rows = [(lang, source, f, v) for (lang, source), values in groups.items() for v in values for f in Q.FEATURES]
    sketches = spark.createDataFrame(rows, "lang string, source string, feature string, bucket int").groupBy("lang", "source", "feature", "bucket").count()
    made = {(r.lang, r.source): r for r in Q.thresholds(sketches).collect()}
    assert set(made) == set(groups)
    for (lang, source), values in groups.items():
        language = [v for g, more in groups.items() if g[0] == lang for v in more]
        level, of = (0, values) if len(values) >= Q.LEAST_ROWS else (1, language) if len(language) >= Q.LEAST_ROWS else (2, [v for more in groups.values() for v in more])
        row = made[lang, source]
        assert (row.level_symbols, row.t_symbols, row.t_capitals) == (level, slow_fences(of, 10), slow_fences(of, 30))


def test_buckets(spark):
    values = [*range(200), 999, 1000, 1001, 4095, 4096, 10**6]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.bucket(F.col("v")).alias("b")).withColumn("least", Q.bucket_value(F.col("b"))).orderBy("v").collect()
    assert all(r.least <= r.v and r.v - r.least <= r.v / Q.STEPS for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows) and all(r.least == r.v for r in rows if r.v < 64)


def votes_of(rng, n, rates, prior=0.3):
    y = rng.random(n) < prior
    return y, np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in rates], 1)


def test_label_model_recovers_accuracies_and_pairs():
    rng = np.random.default_rng(3)
    y, fires = votes_of(rng, 40000, ((0.9, 0.05), (0.8, 0.1), (0.6, 0.2), (0.5, 0.5)))
    fires = np.hstack([fires, fires[:, :1] ^ (rng.random((len(y), 1)) < 0.02)])  # a near copy of the first voter
    patterns = (fires @ (1 << np.arange(5))).astype(int)
    counts = {int(p): int(n) for p, n in zip(*np.unique(patterns[1000:], return_counts=True), strict=True)}
    labelled = Counter((int(p), int(v)) for p, v in zip(patterns[:1000], y[:1000], strict=True))
    model = X.fit_label_model(counts, dict(labelled), 5)
    assert (4, 0) in model.pairs and model.accuracy[0] + model.accuracy[4] > model.accuracy[2] > abs(model.accuracy[3])
    for p in counts:
        if counts[p] > 500:
            assert abs(model.posterior[p] - y[patterns == p].mean()) < 0.15


def test_label_model_without_labels():
    y, fires = votes_of(np.random.default_rng(4), 30000, ((0.9, 0.02), (0.8, 0.05), (0.7, 0.1), (0.6, 0.05)))
    patterns = (fires @ (1 << np.arange(4))).astype(int)
    model = X.fit_label_model({int(p): int(n) for p, n in zip(*np.unique(patterns, return_counts=True), strict=True)}, {}, 4)
    assert ((model.posterior[patterns] > 0.5) == y).mean() > 0.95 and model.accuracy[0] > model.accuracy[3] > 0.3


def test_posterior_against_all_joint_probabilities():
    rng = np.random.default_rng(5)
    y, fires = votes_of(rng, 3000, ((0.8, 0.1), (0.7, 0.2), (0.6, 0.1)))
    patterns = (fires @ (1 << np.arange(3))).astype(int)
    model = X.fit_label_model(dict(Counter(patterns.tolist())), dict(Counter(zip(patterns[:200].tolist(), y[:200].astype(int).tolist()))), 3)

    def weight(label, pattern):
        v = [pattern >> k & 1 for k in range(3)]
        total = model.prior * label + sum(v[k] * (model.accuracy[k] * label + model.propensity[k]) for k in range(3))
        return math.exp(total + sum(d * v[i] * v[j] for (i, j), d in zip(model.pairs, model.correlation, strict=True)))

    for pattern in range(8):
        assert math.isclose(model.posterior[pattern], weight(1, pattern) / (weight(1, pattern) + weight(-1, pattern)), rel_tol=1e-9)


def slow_score(model, text):
    """A score from the model's numbers, token by token."""
    re = __import__("re")
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    stems = Counter(w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k)
    tokens = words | {"^" + x for x in stems} | {"+" + x for x, n in stems.items() if n > 1}
    z = sum(w for t, w in zip(model.tokens, model.weights, strict=False) if t in tokens)
    strong = model.lexicons.strong & tokens
    plain, families = [t for t in strong if t[0] not in "^+"], [t for t in strong if t[0] == "+"]
    weak = [t for t in model.lexicons.ranked if t in tokens and t not in model.lexicons.strong]
    by_hand = [len(words & x) for x in (X.PERSONS, X.CONTEMPT, X.THREATS)]
    votes = [*map(bool, by_hand), sum(by_hand) > 1, *(bool(third & words) for third in model.lexicons.thirds), any(t[0] == "^" for t in strong), bool(families)]
    votes += [100 * (len(plain) + len(families)) >= max(1, len(text or "") // 8), len(weak) > 2]
    votes += [bool(re.search(p, text or "")) for p in (r"[A-Z]{3,}[^a-z]{12,}", "!!", r"\w[*#@$]{1,3}\w")]
    dense = [1, math.log(1 + len(plain)), math.log(1 + len(families)), math.log(1 + len(weak)), *votes]
    return 1 / (1 + math.exp(-(z + sum(a * b for a, b in zip(dense, model.weights[len(model.tokens) :], strict=True)))))


def test_scores_against_brute_force(spark):
    docs, labels = toxic_corpus(spark, 400)
    extra = [(9000, "You idiot, you worthless CLOWN THAT IS ALL IN CAPITALS!! f**k"), (9001, "grobble " * 300_000), (9002, "Dummkopf, snarkt zubfenig zubfena")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    model = X.fit(docs, labels, F.lit(True))
    made = X.score(docs.withColumn("predicted", F.lit("clash")), model).collect()
    assert len(made) == docs.count() and all(math.isclose(r.score, slow_score(model, r.text), rel_tol=1e-6) for r in made)


def toxic_corpus(spark, n=1200):
    rows, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        words = prose(60).split()
        if toxic:
            for _ in range(4):
                words[RNG.randrange(len(words))] = RNG.choice(["grobble", "snarkt", "zubfen" + RNG.choice(["a", "en", "ig", "ost"])])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "grobble snarkt"), (0, "again")]
    labels += [(5000, None), (None, 1), (77777, 1), (3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    made = X.score(docs, X.fit(docs, labels, ~held)).withColumn("held", held).collect()
    assert len(made) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made)
    tested = [r for r in made if r.held and r.doc_id < 1200 and r.text != "again"]
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in tested) >= 0.99 * len(tested) > 200
    kept = X.toxicity_filter(docs, labels, ~held)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in made)


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_lexicons_come_from_all_labelled_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(X, "BROADCAST_ROWS", sent, raising=False)
    docs, labels = toxic_corpus(spark)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit(" zzgrunk"))).otherwise(F.col("text")))
    model = X.fit(docs, labels, F.lit(True), 100)
    assert "zzgrunk" in model.lexicons.ranked


def test_toxicity_without_anything_to_learn(spark):
    docs, labels = toxic_corpus(spark, 20)
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in X.score(docs, X.fit(docs, none, F.lit(True))).collect()} == {0.0}
    assert X.score(docs.limit(0), X.fit(docs.limit(0), labels, F.lit(True))).collect() == []


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    k, v = M.STATES, 7
    chain = M.Chain(*(x / x.sum(-1, keepdims=True) for x in (rng.random(k), rng.random((k, k)))), (lambda e: e / e.sum(0))(rng.random((v, k))))
    rows = [rng.integers(0, v, n).astype(np.int32) for n in (1, 3, 4, 4, 9)]
    got, *_ = M.Sheet(rows).forward(chain)
    counts = M.no_counts(v)
    M.Sheet(rows).expect(chain, counts)
    for row, value in zip(rows, got, strict=True):
        alpha = chain.start * chain.emit[row[0]]
        for w in row[1:]:
            alpha = (alpha @ chain.move) * chain.emit[w]
        assert math.isclose(value, math.log(alpha.sum()), rel_tol=1e-9)
    assert math.isclose(counts.start.sum(), 5, rel_tol=1e-4) and math.isclose(counts.emit.sum(), sum(map(len, rows)), rel_tol=1e-4)
    assert math.isclose(counts.move.sum(), sum(len(r) - 1 for r in rows), rel_tol=1e-4)
    better = M.maximize(counts, np.full(v, 1e-9))
    assert M.Sheet(rows).forward(better)[0].sum() > got.sum() - 1


def test_language_model(spark):
    other = ["qua" + w for w in COMMON]
    rows = [(k, prose(RNG.randint(0, 80), COMMON if k % 2 else other)) for k in range(300)] + [(900, None), (901, ""), (902, "unseen words Here"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    made = M.score(docs, M.fit(docs, ~held)).collect()
    learnt = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in M.words_of(t))
    n, v = sum(counts.values()) + len(learnt), len(counts) + 1
    expected = Counter()
    for d, t in rows:
        w = M.words_of(t)
        expected[d, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learnt) + 1) / (n + v + 1)), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in made) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in made)
    unseen = [r for r in made if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    nothing = M.fit(docs, F.lit(False))
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in M.score(docs, nothing).collect())
    assert M.score(docs.limit(0), nothing).collect() == []


def test_model_scores_against_brute_force(spark):
    rows = [(k, prose(RNG.randint(0, 40)) + (" rare%d" % k) * (k % 3)) for k in range(120)] + [(500, None), (501, "rare1 never Seen"), (502, "lona " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "score": F.lit(2)})
    model = M.fit(docs.filter("doc_id < 400"), F.lit(True), rounds=2)
    counts = Counter(w for d, t in rows if d < 400 for w in M.words_of(t))
    by_class = Counter()
    for w, n in counts.items():
        if w not in model.symbols:
            by_class[zlib.crc32(w[-3:]) % M.CLASSES] += n + 1
    made = {r.doc_id: r for r in M.score(docs, model).collect()}
    for d, t in rows:
        if d == 502:
            continue
        words = M.words_of(t)
        alpha, total = None, 0.0
        for symbol in [*(model.symbols[w] for w in words), model.symbols.end]:
            alpha = (model.chain.start if alpha is None else alpha @ model.chain.move) * model.chain.emit[symbol]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        for w in words:
            if w not in model.symbols:
                total += math.log10(max(counts[w], 1) / max(by_class[zlib.crc32(w[-3:]) % M.CLASSES], 1))
        assert math.isclose(made[d].score, total, rel_tol=1e-9, abs_tol=1e-9)
    assert made[502].n_tokens == 200_001 and math.isfinite(made[502].score)
    assert len(model.likelihoods) == 2 and model.likelihoods[1] > model.likelihoods[0]


def test_words_and_symbols_of_whole_columns():
    rng = random.Random(5)
    texts = [None, "", " ", "\t a", "a ", " A B\x85c  d  E\u0130K ", "\x00x\x1cy \x1f"] + ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1c\xa0 \xc4z") for _ in range(rng.randrange(40))) for _ in range(500)]
    symbols = M.Symbols([b"a", b"b", b"az", "\xc4".encode()])
    for column in (pa.array(texts), pa.array(texts).slice(4, 20), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        words, numbers, begins = M.distinct_words(column)
        listed = words.to_pylist()
        assert [[listed[k] for k in numbers[a:b]] for a, b in zip(begins, begins[1:], strict=False)] == [M.words_of(t) for t in column.to_pylist()]
        rows = symbols.rows(symbols.found(words), numbers, begins)
        assert [r.tolist() for r in rows] == [symbols.of(M.words_of(t)).tolist() for t in column.to_pylist()]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("start", [0, 1, 30])
def test_words_of_slices_without_nulls(kind, start):
    texts = pa.array([prose(RNG.randint(1, 20)) + " \u00c4B" for _ in range(60)], kind).slice(start, 25)
    words, numbers, begins = M.distinct_words(texts)
    listed = words.to_pylist()
    assert [[listed[k] for k in numbers[a:b]] for a, b in zip(begins, begins[1:], strict=False)] == [M.words_of(t) for t in texts.to_pylist()]


def test_language_model_of_batches_too_large_for_one_step(spark):
    """Batches over 4 MB are cut, and what is cut off after the first row has its own words too."""
    rows = [(k, " ".join(f"W{RNG.randrange(40_000)}" for _ in range(12_000))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    made = M.score(docs, M.fit(docs, remainder(F.col("doc_id"), 7) != 2, rounds=1)).collect()
    learnt = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in M.words_of(t))
    n, v = sum(counts.values()) + len(learnt), len(counts) + 1
    expected = {}
    for d, t in rows:
        w = M.words_of(t)
        expected[d] = len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learnt) + 1) / (n + v + 1))
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in made} == {d: e[:3] for d, e in expected.items()}
    assert all(math.isclose(r.base_score, expected[r.doc_id][3], rel_tol=1e-9) for r in made)


def test_symbols():
    symbols = M.Symbols([b"a", b"b"])
    assert symbols[b"a"] == 0 and symbols[b"zzabc"] == symbols[b"abc"] >= symbols.first_class and symbols.size == symbols.end + 1
    again = __import__("pickle").loads(__import__("pickle").dumps(symbols))
    assert again == symbols and again.end == symbols.end


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() keeps the very documents that each stage's rule keeps, one by one, and places the very ids of these."""
    duckdb = pytest.importorskip("duckdb")
    pipeline = pytest.importorskip("corpus_pipeline")
    from foliate.llm.queries import OP10_SQL, byte_bpe
    from foliate.llm.tokens import library_tokenizer

    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = source.collect()
    rng = random.Random(12)
    more = []
    for k, r in enumerate(x for x in base if x.text and 80 < len(x.text.split()) < 400):
        words = r.text.split()
        words[rng.randrange(len(words))] = "changed"
        more.append(r.asDict() | {"doc_id": 10_000 + k, "text": " ".join(words)})
        if k == 40:
            break
    long = " ".join(f"unique{k} word{k * 7 % 1000}" for k in range(3_000))
    more += [base[0].asDict() | {"doc_id": 20_000, "text": None}, base[0].asDict() | {"doc_id": 20_001, "text": long, "lang": None, "source": None}]
    docs = source.unionByName(spark.createDataFrame([tuple(m[c] for c in source.columns) for m in more], source.schema))
    docs = docs.withColumns({"sid": F.lit(1), "n_words": F.lit(2), "score": F.lit(3), "length": F.lit(4), "key": F.lit(5)})  # clashes
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    left = {d for d, kept in connection.execute(f"SELECT doc_id, kept FROM ({OP10_SQL})").fetchall() if kept}
    texts = {r.doc_id: r.text for r in docs.collect()}
    learn = ~F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = X.fit(docs.filter(F.col("doc_id").isin(left)), spark.read.parquet(f"{tmp_path}/labels.parquet"), learn)
    left = sorted(d for d in left if slow_score(model, texts[d]) < 0.3)
    assert 20_001 in left
    sets = {}
    for d in left:
        words = texts[d].encode().lower().split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    group = {d: d for d in left}
    for a in left:
        for b in left:
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    left = {d for d, g in group.items() if d == g}
    assert {r.doc_id for r in rows} == left and 100 < len(left) < len(base)

    library, places = library_tokenizer(byte_bpe()), {}
    for d in left:
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert sum(n for _, _, n, _ in own) == len(ids) and len(own) == -(-len(ids) // 2048)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in own)
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_leave_writing_to_workers(spark, monkeypatch, tmp_path):
    """Spark's writers start chmod for each file, for a moment with all memory of the JVM, which so counts twice."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(llm_shared, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    rows = [(k, prose(80) + (" vile scum" if k % 4 == 0 else ""), "en", "s0") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    called = []
    for kind, name in ((type(spark.range(1)), "checkpoint"), (DataFrameWriter, "parquet")):
        monkeypatch.setattr(kind, name, lambda self, *args, name=name, **named: called.append(name) or pytest.fail(name))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() > 0
    assert not called
    gc.collect()
    tables = list((tmp_path / "shared").iterdir())
    assert len(tables) == 3  # fences, duplicates and places: what the results read
