"""Text-layer features and the quality score as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, as str.strip() and str.split() know it; Spark's trim() removes blanks alone.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: The same characters, for functions that trim.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

INVALID = r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\n\r\t ]]"
UNASSIGNED = r"[\p{Co}\p{Cn}]"

#: Code-point ranges of Chinese, Japanese and Korean ideographs. Fixed values.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(BLANKS))


def lstrip(t: Column) -> Column:
    return F.ltrim(t, F.lit(BLANKS))


def rstrip(t: Column) -> Column:
    return F.rtrim(t, F.lit(BLANKS))


def share(t: Column, pattern: str) -> Column:
    """Share of a text's characters that match a character class; 0 for an empty text."""
    n = F.length(t)
    return F.when(n > 0, (n - F.length(F.regexp_replace(t, pattern, ""))) / n).otherwise(F.lit(0.0))


def invalid_ratio(t: Column) -> Column:
    return share(t, INVALID)


def cjk_ratio(t: Column) -> Column:
    return share(t, CJK)


def coherence(t: Column) -> Column:
    """Runs of letters, digits and underscores for each token between white space, 1 at most.

    Each run becomes one letter, then each token: no list of matches is made, and the second pass is over a short text.
    """
    marked = F.regexp_replace(t, r"[\p{L}\p{N}_]+", "a")
    tokens = F.greatest(_letters(F.regexp_replace(marked, f"[^{WS}]+", "a")), F.lit(1))
    return F.least(_letters(marked) / tokens, F.lit(1.0))


def _letters(t: Column) -> Column:
    return F.length(t) - F.length(F.translate(t, "a", ""))


def decimals(value: Column, places: int) -> Column:
    """A number with so many decimals as printf writes them: of the binary value itself, halves to the even digit.
    Spark's format_string rounds the shortest decimal form of a number up."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places if places else "0"))


def rounded(value: Column, places: int) -> Column:
    """A number rounded as SQL engines do it with doubles: scaled, rounded to a whole number, halves away from zero, and scaled
    back. Spark's round() takes the shortest decimal form instead, so that 0.575 (a little less, in binary) becomes 0.58."""
    scale = F.lit(float(10**places))
    return F.round(value * scale) / scale


def text_md5(t: Column) -> Column:
    """MD5 of a text's UTF-8 bytes, or of binary data, in hexadecimal digits."""
    return F.md5(t.cast("binary"))


def base64_line(t: Column) -> Column:
    """Base64 of a text's UTF-8 bytes, or of binary data, without line ends."""
    return F.regexp_replace(F.base64(t.cast("binary")), "[\r\n]", "")


def font_count(fonts: Column) -> Column:
    """Distinct fonts; a missing one counts as the empty name."""
    return F.size(F.array_distinct(F.transform(fonts, lambda f: F.coalesce(f, F.lit("")))))


def width_variance(widths: Column) -> Column:
    """Population variance of an array of mean character widths; 0 for one or none."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, w: Column) -> Column:  # running mean and squares: one pass, nothing is computed anew for each element
        n = a["n"] + 1.0
        mean = a["mean"] + (w - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (w - a["mean"]) * (w - mean)).alias("m2"))

    return F.aggregate(widths, start, add, lambda a: F.when(a["n"] > 1, a["m2"] / a["n"]).otherwise(F.lit(0.0)))


def quality_score(invalid: Column, fonts: Column, variance: Column, coherent: Column) -> Column:
    score = F.lit(1.0) - invalid * 5.0
    score = score - F.when(fonts > 20, 0.2).otherwise(0.0) - F.when(variance > 50, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * coherent))


def has_formula_font(fonts: Column, patterns: tuple[str, ...]) -> Column:
    found = lambda f: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(f), F.lower(p)))
    return F.coalesce(F.exists(fonts, found), F.lit(False))


def page_list(spec: Column) -> Column:
    """'1-5,8,10' as sorted distinct page numbers; a range that runs backwards is empty."""

    def pages(part: Column) -> Column:
        low = F.trim(F.substring_index(part, "-", 1)).cast("int")
        high = F.trim(F.substring_index(part, "-", -1)).cast("int")
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages))))


def select_pages(pages: Column, total: Column) -> Column:
    """0-based indices of the asked pages that exist, in the order asked; none asked means all."""
    everything = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    asked = F.transform(F.filter(pages, lambda p: (p >= 1) & (p <= total)), lambda p: (p - 1).cast("int"))
    return F.when(pages.isNull() | (F.size(pages) == 0), everything).otherwise(asked)
