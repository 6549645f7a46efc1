"""Page classification by the text layer, and what follows from it: routing, page counts and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.functions.geometry import covered_share


@dataclass(frozen=True)
class DetectionConfig:
    force_mode: str | None = None
    text_quality_threshold: float = 0.7
    min_text_chars: int = 20
    formula_font_patterns: tuple[str, ...] = ("CMMI", "CMBX", "Cambria Math", "STIXGeneral")
    most_invalid: float = 0.05
    most_images: float = 0.3


def percent(value: Column, places: int) -> Column:
    """A share as a rounded percentage, halves away from zero."""
    scaled = F.round(value * 10 ** (2 + places)).cast("long")
    if not places:
        return F.concat(scaled.cast("string"), F.lit("%"))
    return F.concat((scaled / 10**places).cast("long").cast("string"), F.lit("."), F.lpad((scaled % 10**places).cast("string"), places, "0"), F.lit("%"))


def spread(pages: DataFrame) -> DataFrame:
    """pages over all cores, where a scan has fewer parts than that (a few small files): costly columns follow. Streams, and
    plans that shuffle anyway, stay as they are; large inputs have parts enough and don't move."""
    if pages.isStreaming:
        return pages
    planned = pages._jdf.queryExecution()
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if planned.executedPlan().nodeName().startswith("Adaptive") or planned.toRdd().getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores)


def image_ratio(regions: DataFrame, page_area: float, *keys: str) -> DataFrame:
    """has_images and image_ratio of each page that has pictures among its regions (block_type, bbox)."""
    return regions.filter("block_type = 'image'").groupBy(*keys).agg((F.count("*") > 0).alias("has_images"), covered_share(F.col("bbox"), page_area).alias("image_ratio"))


def text_coverage(regions: DataFrame, page_area: float, *keys: str) -> DataFrame:
    """The share of each page that its text regions cover."""
    return regions.filter("block_type = 'text'").groupBy(*keys).agg(covered_share(F.col("bbox"), page_area).alias("coverage"))


def text_metrics(pages: DataFrame) -> DataFrame:
    """pages (text, spans, ...) with the features of their text layer; one pass, and no shuffle of large inputs."""
    pages = spread(pages)
    named = F.filter("spans", lambda s: F.length(s["text"]) > 0)
    widths = F.transform(named, lambda s: (s["x2"] - s["x1"]) / F.length(s["text"]))
    made = pages.withColumns({
        "char_count": F.length(T.strip(F.col("text"))), "invalid_ratio": T.invalid_ratio(F.col("text")), "cjk_ratio": T.cjk_ratio(F.col("text")),
        "font_count": T.font_count(F.transform("spans", lambda s: s["font"])), "width_variance": T.width_variance(widths), "coherence": T.coherence(F.col("text")),
    })
    return made.withColumn("quality_score", T.quality_score(F.col("invalid_ratio"), F.col("font_count"), F.col("width_variance"), F.col("coherence")))


#: The wording of reasons is fixed: a page's reason is part of the result.
def classify(pages: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """text_metrics with page_type, reason and has_formula; the first rule that fits decides."""
    made = text_metrics(pages).withColumn("has_formula", T.has_formula_font(F.transform("spans", lambda s: s["font"]), config.formula_font_patterns))
    if config.force_mode:
        return made.withColumns({"page_type": F.lit(config.force_mode), "reason": F.lit(f"forced mode: {config.force_mode}")})
    few = F.col("char_count") < config.min_text_chars
    invalid = F.col("invalid_ratio") > config.most_invalid
    low = F.col("quality_score") < config.text_quality_threshold
    images = F.col("image_ratio") > config.most_images
    parts = F.array(F.when(images, F.concat(F.lit("image area "), percent(F.col("image_ratio"), 0))), F.when(F.col("has_formula"), F.lit("formula fonts detected")))
    reason = (
        F.when(few, F.concat(F.lit("too few chars ("), F.col("char_count").cast("string"), F.lit(f" < {config.min_text_chars})")))
        .when(invalid, F.concat(F.lit("high invalid char ratio ("), percent(F.col("invalid_ratio"), 2), F.lit(")")))
        .when(low, F.concat(F.lit("low quality score ("), T.decimals(T.rounded(F.col("quality_score"), 2), 2), F.lit(")")))
        .when(images | F.col("has_formula"), F.array_join(F.array_compact(parts), "; "))
        .otherwise("good text layer")
    )
    kind = F.when(few | invalid | low, "scanned").when(images | F.col("has_formula"), "mixed").otherwise("native")
    return made.withColumns({"page_type": kind, "reason": reason})


def route_pages(classified: DataFrame) -> DataFrame:
    """A row for each page and branch that treats it: native text, scan, and fallback beside the scan for mixed pages."""
    branches = F.when(F.col("page_type") == "native", F.array(F.lit("native"))).when(F.col("page_type") == "mixed", F.array(F.lit("scan"), F.lit("fallback"))).otherwise(F.array(F.lit("scan")))
    return classified.withColumn("branch", F.explode(branches))


def page_types(classified: DataFrame, *keys: str) -> DataFrame:
    """Pages of each type."""
    return classified.groupBy(*keys, "page_type").agg(F.count("*").alias("pages"))


def estimate(classified: DataFrame, *keys: str, max_regions: int = 5) -> DataFrame:
    """Calls, cost (in thousandths, then rounded) and time of converting: six regions a page that is not native."""
    scanned = F.sum(F.when(F.col("page_type").isin("scanned", "mixed"), 1).otherwise(0)).cast("long")
    made = classified.groupBy(*keys).agg(
        F.count("*").alias("total_pages"), scanned.alias("scanned"),
        F.sum(F.when(F.col("page_type") == "native", 1).otherwise(0)).cast("long").alias("native"),
        F.sum(F.when(F.col("page_type") == "mixed", 1).otherwise(0)).cast("long").alias("mixed"),
    )
    calls = F.floor(F.col("scanned") * 6 / max_regions).cast("long")
    made = made.withColumn("api_calls", calls)
    return made.withColumns({"cost": F.round(F.col("api_calls") * 35 / F.lit(1000.0), 2), "seconds": F.round((F.col("api_calls") * 8 + F.col("total_pages") * 3) / F.lit(10.0), 1)})


def within_budget(estimates: DataFrame, budget: float | None) -> DataFrame:
    """Estimates with `allowed`: whether the cost keeps to the budget; without one all do."""
    return estimates.withColumn("allowed", F.lit(True) if budget is None else F.col("cost") <= budget)
