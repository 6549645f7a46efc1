"""Quality rules with adaptive thresholds: mergeable quantile sketches for each language and source.

Fences stand where a group's own percentiles jump; small groups take those of the sketches merged by language, or of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliate.llm.shared import WHITESPACE, cut, kept, rows_of, step_of, tidy

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: The sketched features: (name, SQL for an integer of 0 or more, least jump between neighbouring quantiles that parts two
#: populations). Thousandths keep all arithmetic in integers, so two engines agree to the last bit.
FEATURES = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 350),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300),
    "capitals": ("n_upper * 1000 div greatest(n_letters, 1)", 200),
}

#: The sketch's buckets hold 32 steps for each power of two: quantiles are right to 1/32 of their value.
STEPS = 32

#: The percentiles that a fence is looked for between, from the first to the last.
LOWEST, HIGHEST = 50, 99

#: A jump between neighbouring percentiles also has to lead to so many times the lower one.
TIMES = 3

#: A group of fewer rows takes the fences of its language, and that, if it has fewer, those of all rows.
LEAST_ROWS = 100

#: Up to so many threshold rows go to every executor with the plan; more are joined by shuffle.
BROADCAST_ROWS = 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    bare = raw.translate(None, WHITESPACE)
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper = len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = len(bare) - len(bare.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (len(words), len(text or "") - (len(raw) - len(bare)), symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), upper, upper + small)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three words that occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = row[:-1] * len(ids) + row[1:]
    if len(ids) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + row[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    if not hit.any():
        return 0
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs, all its columns and the text itself, with COUNTS behind them (named with prefix)."""
    schema = StructType([*docs.schema.fields, *(StructField(prefix + name, LongType()) for name in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1000, text):
            made = np.array([count_text(t.as_py()) for t in batch.column(text)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, k]) for k in range(len(COUNTS)))], names=[*batch.schema.names, *(prefix + c for c in COUNTS)])

    return docs.mapInArrow(tidy(run), schema)


def base_failed(words: Column, repeats: Column) -> Column:
    """The fixed rules: fewer than 50 words, or more than half of the words in repeated windows."""
    return (words < 50) | (100 * repeats > 50 * words)


def bucket(value: Column) -> Column:
    """The sketch's bucket of an integer of 0 or more."""
    return step_of(value, STEPS)


def bucket_value(number: Column) -> Column:
    """The least value that falls into a bucket."""
    shift = F.greatest(F.floor(number / F.lit(STEPS)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (number - shift * STEPS).cast("long"), shift)


def sketch(counted: DataFrame) -> DataFrame:
    """One row for each lang, source, feature and bucket, with a count, over the rows that pass the base rules.

    Sketches merge by adding counts, so partial ones are summed before the shuffle and a source with a third of all rows
    costs no more than any other."""
    values = F.array(*(F.struct(F.lit(name).alias("feature"), F.expr(f"cast({sql} as long)").alias("value")) for name, (sql, _) in FEATURES.items()))
    rows = counted.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("lang", "source", F.explode(values).alias("x"))
    return rows.select("lang", "source", "x.feature", bucket(F.col("x.value")).alias("bucket")).groupBy("lang", "source", "feature", "bucket").count()


def merged(sketches: DataFrame) -> DataFrame:
    """level, lang, source, feature, bucket, count: the sketches (level 0), those of whole languages (1) and of all (2)."""
    to = [("lang", "source"), ("lang", None), (None, None)]
    levels = [
        sketches.groupBy(F.lit(k).alias("level"), *((F.col(c) if c else F.lit(None).cast("string")).alias(n) for c, n in zip(by, ("lang", "source"), strict=True)), "feature", "bucket").agg(F.sum("count").alias("count"))
        for k, by in enumerate(to)
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def fences(sketches: DataFrame) -> DataFrame:
    """level, lang, source, feature, rows, fence: the largest value that is not an outlier, from merged sketches.

    Where neighbouring percentiles from LOWEST to HIGHEST first jump, by the feature's least jump and to TIMES the lower
    one or more, two populations part: the fence stands half-way. Without a jump it stands beyond HIGHEST, as far again,
    or by the least jump if that is more.
    """
    from pyspark.sql import Window

    group = ["level", "lang", "source", "feature"]
    upto, whole = F.sum("count").over(Window.partitionBy(group).orderBy("bucket")), F.sum("count").over(Window.partitionBy(group))
    at = sketches.select(*group, "bucket", "count", upto.alias("upto"), whole.alias("rows"))
    first = F.greatest(F.floor(100 * (F.col("upto") - F.col("count")) / F.col("rows")) + 1, F.lit(LOWEST))
    last = F.least(F.floor(100 * F.col("upto") / F.col("rows")), F.lit(HIGHEST))
    steps = at.filter(first <= last).select(*group, "rows", "bucket", bucket_value(F.col("bucket")).alias("value"))  # buckets in which a percentile falls
    steps = steps.withColumn("before", F.lag("value").over(Window.partitionBy(group).orderBy("bucket")))
    least = F.coalesce(*(F.when(F.col("feature") == name, F.lit(jump)) for name, (_, jump) in FEATURES.items()))
    jump = (F.col("value") - F.col("before") >= least) & (F.col("value") >= TIMES * F.col("before"))
    middle = F.min(F.when(jump, F.struct("value", F.expr("(value + before) div 2").alias("fence"))))["fence"]
    top = F.max("value")
    return steps.groupBy(group).agg(F.max("rows").alias("rows"), F.coalesce(middle, top + F.greatest(top, F.max(least))).alias("fence"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source, t_<feature> and level_<feature> for every feature: the fence, and whose it is (0: the group's own, 1:
    its language's, 2: that of all rows), for each group in the sketches."""
    made = fences(merged(sketches))
    own = made.filter("level = 0").drop("level")
    lang = made.filter("level = 1").select(F.col("lang").alias("l"), F.col("feature").alias("g"), F.col("rows").alias("rows1"), F.col("fence").alias("fence1"))
    every = made.filter("level = 2").select(F.col("feature").alias("h"), F.col("fence").alias("fence2"))
    whole = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("feature") == F.col("g"))).join(every, F.col("feature") == F.col("h"))
    level = F.when(F.col("rows") >= LEAST_ROWS, 0).when(F.col("rows1") >= LEAST_ROWS, 1).otherwise(2)
    whole = whole.select("lang", "source", "feature", level.alias("level"), F.coalesce(F.when(level == 0, F.col("fence")), F.when(level == 1, F.col("fence1")), "fence2").alias("fence"))
    of = lambda name, column: F.max(F.when(F.col("feature") == name, F.col(column)))
    return whole.groupBy("lang", "source").agg(*(of(n, "fence").alias(f"t_{n}") for n in FEATURES), *(of(n, "level").alias(f"level_{n}") for n in FEATURES))


def beyond(name: str) -> Column:
    """Whether a feature is above its fence; a group without one (all of it fails the base rules) rejects nothing more."""
    return F.coalesce(F.expr(f"cast({FEATURES[name][0]} as long)") > F.col(f"t_{name}"), F.lit(False))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed, t_<feature>, level_<feature> and kept."""
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counted.join(limits, counted.lang.eqNullSafe(limits._lang) & counted.source.eqNullSafe(limits._source), "left").drop("_lang", "_source")
    outside = F.lit(False)
    for name in FEATURES:
        outside = outside | beyond(name)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~outside})


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): its counts, base_failed, the fences and kept.

    The thresholds come from all rows that pass the base rules. Null and empty texts have no words and fail them; null
    languages and sources are groups of their own; repeated rows are judged one by one; texts of any length are counted
    whole; an empty table gives an empty result. Other columns of docs are left out, whatever their names.
    """
    counted = cut(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    limits = cut(thresholds(sketch(counted)))
    return judge(counted, limits)


def rejections(report: DataFrame) -> DataFrame:
    """lang, source, rows, base_failed and, for each feature, its fence, whose it is, and how many rows that pass the base
    rules it rejects, from the rows of quality_report."""
    count = lambda c: F.count(F.when(c, 1))
    each = [x for n in FEATURES for x in (F.max(f"t_{n}").alias(f"fence_{n}"), F.max(f"level_{n}").alias(f"level_{n}"), count(~F.col("base_failed") & beyond(n)).alias(f"rejected_{n}"))]
    return report.groupBy("lang", "source").agg(F.count("*").alias("rows"), count(F.col("base_failed")).alias("base_failed"), *each)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_report keeps, with all their columns as they are, whatever their names.

    Texts are counted once for the sketches and once more for the verdicts: to keep the counts would take a second copy of
    the texts in the shared folder, as rows have no key to join them by.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{k}_" for k in range(len(columns))))  # no name can clash with those that are added
    name = {c: f"c{k}_" for k, c in enumerate(columns)}
    groups = {"lang": F.col(name["lang"]), "source": F.col(name["source"])}
    limits = kept(thresholds(sketch(with_counts(docs.select("text", "lang", "source")).drop("text"))), stay=True)
    passed = judge(with_counts(plain, name["text"]).withColumns(groups), limits).filter("kept")
    return passed.select(*(F.col(name[c]).alias(c) for c in columns))
