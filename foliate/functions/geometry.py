"""Boxes as Column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    parts = [F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v) for v in (x1, y1, x2, y2)]
    return F.struct(*(p.cast("int").alias(n) for p, n in zip(parts, ("x1", "y1", "x2", "y2"), strict=True)))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Shared area; 0 for boxes that are apart or only touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    common, least = intersection(a, b), F.least(area(a), area(b))
    return F.when((common > 0) & (least > 0), common / least).otherwise(F.lit(0.0))


def scale(b: Column, ratio: Column | float) -> Column:
    """Coordinates times ratio, cut towards zero."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return box(*((b[k] * r) for k in ("x1", "y1", "x2", "y2")))


def unscale(b: Column, ratio: Column | float) -> Column:
    """Coordinates over ratio, cut towards zero; ratios of 1 or more change nothing."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.when(r < 1.0, box(*((b[k] / r) for k in ("x1", "y1", "x2", "y2")))).otherwise(b)


def expand(b: Column, block_type: Column, confidence: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """A box grown by up to 10 pixels for low confidence, 15 at least for tables and 8 for formulas, clamped to the page."""
    e = (F.lit(10.0) * (F.lit(1.0) - confidence)).cast("int")
    e = F.when(block_type == "table", F.greatest(e, F.lit(15))).when(block_type == "formula", F.greatest(e, F.lit(8))).otherwise(e)

    def upper(value: Column, bound: Column | None) -> Column:
        return value if bound is None else F.when(bound > 0, F.least(value, bound)).otherwise(value)

    return box(F.greatest(F.lit(0), b["x1"] - e), F.greatest(F.lit(0), b["y1"] - e), upper(b["x2"] + e, width), upper(b["y2"] + e, height))


def padded(b: Column, width: Column, height: Column, padding: int = 8) -> Column:
    """A crop box with padding, clamped to the image."""
    return box(F.greatest(F.lit(0), b["x1"] - padding), F.greatest(F.lit(0), b["y1"] - padding), F.least(width, b["x2"] + padding), F.least(height, b["y2"] + padding))


def rendered(points: Column, dpi: int = 300) -> Column:
    """Pixels that so many points take."""
    return (points * F.lit(dpi / 72.0)).cast("int")


def splits(height: Column, most: int = 4000, part: int = 3200, overlap: int = 200) -> Column:
    """(split_index, y1, y2) of each crop of an over-tall page; other pages are one piece. Crops end with the page."""
    step = part - overlap
    last = F.when(height > most, F.greatest(F.lit(0), F.ceil((height - part) / F.lit(step)))).otherwise(F.lit(0)).cast("int")
    piece = lambda k: F.struct(k.alias("split_index"), (k * step).alias("y1"), F.when(height > most, F.least(k * step + part, height)).otherwise(height).cast("int").alias("y2"))
    return F.transform(F.sequence(F.lit(0), last), piece)


def downsampled(size: Column, ratio: float = 0.7) -> Column:
    """A picture's width or height after scaling down, cut towards zero; ratios of 1 or more change nothing."""
    return (size * F.lit(float(ratio))).cast("int") if ratio < 1 else size


def known_size(size: Column, default: int) -> Column:
    """A width or height, or the default where it is missing or 0."""
    return F.coalesce(F.nullif(size, F.lit(0)), F.lit(default))


def covered_share(boxes: Column, page_area: float) -> Column:
    """The share of a page that boxes cover, each counted whole; an aggregate. 0 for pages without an area."""
    return F.sum(area(boxes)) / F.lit(float(page_area)) if page_area > 0 else F.lit(0.0)
