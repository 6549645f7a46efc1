"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters fire or don't: lexicons written by hand and patterns, which need no label, and lexicons mined from labelled rows,
three of them from a third of these rows each, so that they err apart. Their vote patterns are counted over all documents
that may be learnt from, labelled or not, at most 2**len(VOTERS) counts. The label model has an accuracy and a propensity
for each voter and a correlation for pairs that agree more than the label explains; its partition function is summed
exactly over all vote patterns. It maximises the likelihood of those votes alone; labelled rows only say where it starts,
and a small penalty holds it near there, so that its label keeps its meaning. The classifier is fitted to the posteriors of a
bounded sample of all documents that may be learnt from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import NARROW, about, job, kept, rows_of, tidy

#: Documents, about so many by their hash, that the classifier is fitted on; lexicons and vote counts come from all.
SAMPLE_ROWS = 20_000

#: Up to so many labels go to every executor; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Tokens that the lexicons may hold, those with most evidence.
LEXICON_TOKENS = 4_000

#: Tokens that have a weight of their own in the classifier.
CLASSIFIER_TOKENS = 400

#: A token needs so many labelled positive documents to enter a lexicon.
LEAST_DOCS = 4

#: Tokens that a task counts before it hands on what it has.
COUNTED = 400_000

THRESHOLD = 0.3

#: Labelled documents that hold a token: negative and positive ones of each third.
COUNTS = ("n0", "p0", "n1", "p1", "n2", "p2")

WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[A-Z]{3,}[^a-z]{12,}")
EXCLAIM = re.compile(r"!{2,}")
MASKED = re.compile(r"\w[*#@$]{1,3}\w")

STEMS = (4, 5, 6, 7)

#: Words of abuse for persons, words of contempt and words of threat, by hand, in the languages at hand.
PERSONS = frozenset(
    "idiot idiots moron morons imbecile fool fools clown scum loser losers dunce dimwit halfwit jerk creep coward liar vermin filth "
    "dummkopf trottel depp blödmann abschaum versager schwachkopf lügner feigling idiotin "
    "imbécile crétin abruti ordure racaille raté lâche menteur idiote bouffon "
    "idiota imbécil tonto escoria payaso perdedor cobarde mentiroso cretino".split()
)
CONTEMPT = frozenset(
    "stupid pathetic worthless useless disgusting dumb ignorant trash garbage despicable repulsive brainless "
    "dumm wertlos erbärmlich nutzlos ekelhaft widerlich jämmerlich müll stupide minable pathétique nul débile dégoûtant inutile "
    "estúpido estúpida patético patética inútil basura asqueroso despreciable".split()
)
THREATS = frozenset("kill die hate destroy crush hurt töten stirb hasse vernichten tuer crève déteste détruire matar muere odio destruir".split())

VOTERS = ("persons", "contempt", "threats", "insults", "third_0", "third_1", "third_2", "stems", "families", "dense", "weak_words", "shouting", "exclaiming", "masked")

#: How strongly the label model is held to where labelled rows let it start.
HELD = 0.03


def tokens_of(text: str | None, known: tuple[frozenset[str], frozenset[str]] | None = None) -> set[str]:
    """Distinct lower-case words of a text, their stems (first four to seven letters) with a leading ^, and stems that
    two different words share with a leading +. known: words and stems (bare) to look for, instead of all."""
    words = set(WORD.findall((text or "").lower()))
    if known is None:
        stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    else:
        stems = Counter(s for w in words for k in STEMS if len(w) > k and (s := w[:k]) in known[1])
        words &= known[0]
    return words | {f"^{s}" for s in stems} | {f"+{s}" for s, n in stems.items() if n > 1}


@dataclass
class Lexicons:
    """Tokens that toxic documents have and others lack, those with most evidence first; `strong` ones hardly ever err.

    thirds: the strong words by the evidence of each third of the labelled rows alone."""

    ranked: list[str] = field(default_factory=list)
    strong: set[str] = field(default_factory=set)
    thirds: list[set[str]] = field(default_factory=lambda: [set(), set(), set()])

    def __post_init__(self):
        self.weak = set(self.ranked) - self.strong
        self.known = frozenset(t for t in self.ranked if t[0] not in "^+") | PERSONS | CONTEMPT | THREATS, frozenset(t[1:] for t in self.ranked if t[0] in "^+")

    def votes(self, text: str | None, tokens: set[str]) -> int:
        """The voters that fire, as bits; tokens: tokens_of(text, self.known)."""
        text = text or ""
        strong = self.strong & tokens
        words = [t for t in strong if t[0] not in "^+"]
        stems = [t for t in strong if t[0] in "^+"]
        families = [t for t in stems if t[0] == "+"]
        by_hand = [len(tokens & lexicon) for lexicon in (PERSONS, CONTEMPT, THREATS)]
        fired = [*by_hand, sum(by_hand) >= 2, *(not third.isdisjoint(tokens) for third in self.thirds)]
        fired += [any(t[0] == "^" for t in stems), bool(families)]
        fired += [100 * len(words) + 100 * len(families) >= max(1, len(text) // 8), len(self.weak & tokens) >= 3]
        fired += [SHOUT.search(text), EXCLAIM.search(text), MASKED.search(text)]
        return sum(1 << k for k, f in enumerate(fired) if f)


@dataclass
class LabelModel:
    """P(label | votes) for every vote pattern, with the parameters it comes from."""

    posterior: np.ndarray
    prior: float
    accuracy: np.ndarray
    propensity: np.ndarray
    pairs: list[tuple[int, int]]
    correlation: np.ndarray


def fit_label_model(counts: dict[int, int], labelled: dict[tuple[int, int], int], voters: int = len(VOTERS), rounds: int = 400) -> LabelModel:
    """Maximum likelihood of the vote patterns' counts, by gradient ascent from where the labelled rows' counts lie.

    p(y, v) is proportional to exp(b y + sum a_i v_i y + sum c_i v_i + sum d_ij v_i v_j), y in {-1, 1}, v_i in {0, 1}.
    labelled: counts of (vote pattern, label 0 or 1); without any, every voter starts as one that speaks for the label.
    """
    patterns = np.arange(1 << voters)
    v = (patterns[:, None] >> np.arange(voters) & 1).astype(np.float64)
    seen, known = np.zeros(len(patterns)), np.zeros((2, len(patterns)))
    for p, n in counts.items():
        seen[p] = n
    for (p, y), n in labelled.items():
        known[y, p] = n
    seen, known = seen / max(seen.sum(), 1), known / max(known.sum(), 1)

    def fit(seen: np.ndarray, known: np.ndarray, pairs: list[tuple[int, int]], start: np.ndarray, held: float) -> tuple[np.ndarray, np.ndarray]:
        both = np.stack([v[:, i] * v[:, j] for i, j in pairs], 1) if pairs else np.zeros((len(v), 0))
        x = {y: np.hstack([np.full((len(v), 1), y), y * v, v, both]) for y in (-1, 1)}
        start = np.append(start, np.zeros(x[1].shape[1] - len(start)))
        theta = start.copy()
        first, second = np.zeros_like(theta), np.zeros_like(theta)

        def distribution() -> np.ndarray:
            energy = np.stack([x[-1] @ theta, x[1] @ theta])
            joint = np.exp(energy - energy.max())
            return joint / joint.sum()

        for step in range(1, rounds + 1):
            joint = distribution()
            given = joint / np.maximum(joint.sum(0), 1e-300)
            want = given * seen + known - joint * (seen.sum() + known.sum())
            slope = want[0] @ x[-1] + want[1] @ x[1] - held * (theta - start)
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        return theta, distribution()

    none = np.zeros(len(patterns))
    start = np.concatenate([[-1.0], np.ones(voters), -np.ones(voters)])
    # Pairs are looked for where the label's part is known: without pairs, the votes' own fit would take a doubled voter for it.
    start, joint = fit(none, known, [], start, 1e-3) if known.any() else fit(seen, 0 * known, [], start, HELD)
    excess = np.abs(v.T @ (v * (seen - joint.sum(0))[:, None]))
    found = sorted(((excess[i, j], i, j) for i in range(voters) for j in range(i)), reverse=True)[: 2 * voters]
    pairs = [(i, j) for e, i, j in found if e > 0.002]
    if known.any():
        start, _ = fit(none, known, pairs, start, 1e-3)
    theta, joint = fit(seen, 0 * known, pairs, start, HELD)
    posterior = joint[1] / np.maximum(joint.sum(0), 1e-300)
    return LabelModel(posterior, float(theta[0]), theta[1 : 1 + voters], theta[1 + voters : 1 + 2 * voters], pairs, theta[1 + 2 * voters :])


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    labels: LabelModel | None
    tokens: list[str]
    weights: np.ndarray

    def __post_init__(self):
        self.at = {t: k for k, t in enumerate(self.tokens)}

    def features(self, text: str | None) -> tuple[list[int], np.ndarray, int]:
        """(numbers of the tokens present, further features: counts of lexicon tokens and votes)."""
        tokens = tokens_of(text, self.lexicons.known)
        strong, votes = self.lexicons.strong & tokens, self.lexicons.votes(text, tokens)
        words, families = sum(t[0] not in "^+" for t in strong), sum(t[0] == "+" for t in strong)
        dense = [1.0, math.log1p(words), math.log1p(families), math.log1p(len(self.lexicons.weak & tokens)), *(float(votes >> k & 1) for k in range(len(VOTERS)))]
        return [self.at[t] for t in self.at.keys() & tokens], np.array(dense), votes

    def score(self, text: str | None) -> float:
        """0 to 1, higher where a toxic label is likelier; null and empty texts get one too."""
        if not len(self.weights):
            return 0.0
        present, dense, _ = self.features(text)
        z = float(self.weights[present].sum() + dense @ self.weights[len(self.tokens) :])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft targets, by accelerated gradient steps with a small ridge."""
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    scale = np.sqrt(np.maximum((x * x).mean(0), 1e-4))
    x = x / scale
    step = 4.0 / max(float(np.linalg.eigvalsh((x.T @ x) / len(x))[-1]), 1e-6)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500)))
        new = ahead - step * (x.T @ (p - target) / len(x) + 1e-5 * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w / scale


@job()
def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from docs (doc_id, text) for which `learn`, a condition on doc_id, holds, and from labels (doc_id, toxic).

    Labels without an id or a value, or of documents that are not there, count for nothing; of several for a document
    the largest holds, and repeated documents count as often as they are there. Without a positive and a negative label,
    as with empty tables, the model scores 0 everywhere. Null texts are empty, texts of any length are read whole, and
    other columns of both tables are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter(learn & F.col("doc_id").isNotNull())
    labels = labels.select("doc_id", "toxic").filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = kept(labels, NARROW)
    sent = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels

    lexicons = _mine(docs.join(sent, "doc_id"))
    spread = spark.sparkContext.broadcast(lexicons)
    voted = _vote_counts(docs.join(sent, "doc_id", "left").select("text", "toxic"), spread, "toxic").collect()  # at most 3 * 2**len(VOTERS) rows
    counts, labelled = Counter(), {(r.votes, r.toxic): r.n for r in voted if r.toxic is not None}
    for r in voted:
        counts[r.votes] += r.n
    if len({y for _, y in labelled}) < 2:
        return ToxicityModel(lexicons, None, [], np.zeros(0))
    label_model = fit_label_model(counts, labelled)
    model = ToxicityModel(lexicons, label_model, lexicons.ranked[:CLASSIFIER_TOKENS], np.zeros(1))
    sample = docs.filter(about(F.col("doc_id"), rows, sum(counts.values()))).select("text")
    x, target = _matrix(sample, model)
    if len(x):
        model.weights = fit_linear(x, target)
    return model


def _mine(labelled: DataFrame) -> Lexicons:
    """Lexicons from all rows of labelled (doc_id, text, toxic). A row's third follows from the checksum of its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def made() -> pa.RecordBatch:
            columns = list(zip(*counts.values(), strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["token", *COUNTS])

        for batch in rows_of(batches, 1000, "text"):
            for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                at = 2 * (zlib.crc32(str(doc_id).encode()) // 4 % 3) + (toxic > 0)
                for token in ("", *tokens_of(text)):
                    counts.setdefault(token, [0] * 6)[at] += 1
            if len(counts) > COUNTED:
                yield made()
                counts.clear()
        yield made()

    summed = labelled.mapInArrow(tidy(run), "token string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("token").agg(*(F.sum(c).alias(c) for c in COUNTS))
    pos, neg = F.expr("p0 + p1 + p2"), F.expr("n0 + n1 + n2")
    summed = kept(summed.withColumns({"pos": pos, "neg": neg}))
    total = summed.filter("token = ''").first()
    if total is None or not total.pos or not total.neg:
        return Lexicons()

    def odds(pos: str, neg: str) -> Column:
        return F.log((F.col(pos) + 0.5) / (total[pos] + 1.0)) - F.log((F.col(neg) + 0.5) / (total[neg] + 1.0))

    def strong(row, pos: str, neg: str) -> bool:
        return row[pos] >= 2 and row[f"odds_{pos}"] >= 4 and row[neg] * 20 <= row[pos]

    made = {f"odds_{p}": odds(p, n) for p, n in (("pos", "neg"), ("p0", "n0"), ("p1", "n1"), ("p2", "n2"))}
    likely = summed.filter((F.col("token") != "") & (F.col("pos") >= LEAST_DOCS)).withColumns(made).filter("odds_pos >= 2.5")
    found = likely.orderBy(F.desc(F.col("odds_pos") * F.log("pos")), "token").limit(LEXICON_TOKENS).collect()
    thirds = [{r.token for r in found if r.token[0] not in "^+" and strong(r, f"p{k}", f"n{k}")} for k in range(3)]
    return Lexicons([r.token for r in found], {r.token for r in found if strong(r, "pos", "neg")}, thirds)


def _vote_counts(rows: DataFrame, spread, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows_of(batches, 1000, "text"):
            votes = (spread.value.votes(t, tokens_of(t, spread.value.known)) for t in batch.column("text").to_pylist())
            counts.update(zip(votes, *(batch.column(k).to_pylist() for k in keep), strict=True))
        columns = list(zip(*(k for k in counts), strict=True)) or [()] * (1 + len(keep))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(list(counts.values()), pa.int64())], names=["votes", *keep, "n"])

    schema = "votes int, " + "".join(f"{k} int, " for k in keep) + "n long"
    return rows.mapInArrow(tidy(run), schema).groupBy("votes", *keep).agg(F.sum("n").alias("n"))


def _matrix(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's input for the bounded sample, and the label model's posteriors."""
    spread = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000, "text"):
            made = [spread.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1].tolist() for m in made], pa.list_(pa.float64())), pa.array([m[2] for m in made], pa.int32())], names=["present", "dense", "votes"])

    rows = sample.select("text").mapInArrow(run, "present array<int>, dense array<double>, votes int").toArrow()
    x = np.zeros((rows.num_rows, len(model.tokens) + 4 + len(VOTERS)), np.float32)
    for k, present in enumerate(rows["present"].to_pylist()):
        x[k, present] = 1
    x[:, len(model.tokens) :] = np.array(rows["dense"].to_pylist(), np.float32).reshape(rows.num_rows, -1)
    return x, model.labels.posterior[rows["votes"].to_numpy()]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on) behind all their columns; every row gets both.

    Columns of docs with these two names are left out, all others stay. Null and empty texts get the score of a text
    without tokens; repeated rows are scored one by one, texts of any length whole; an empty table gives an empty result.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000, text):
            made = np.array([spread.value.score(t) for t in batch.column(text).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made), pa.array((made >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    kept = docs.select([c for c in docs.columns if c.lower() not in ("score", "predicted")])
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    return kept.mapInArrow(tidy(run), StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def toxicity_filter(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns as they are."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{k}_" for k in range(len(columns))))  # no name can clash with those that are added
    kept = score(plain, fit(docs, labels, learn), f"c{columns.index('text')}_").filter("predicted = 0")
    return kept.select(*(F.col(f"c{k}_").alias(c) for k, c in enumerate(columns)))
