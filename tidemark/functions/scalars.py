"""Scalar expressions used across the operators (survey group H)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
POSITIVE = 4.0


def strip(c: Column) -> Column:
    """White space off both ends, not spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def title_year(title: Column) -> Column:
    """Year of a trailing '(YYYY)', null without one."""
    return F.regexp_extract(title, r"\((\d{4})\)\s*$", 1).try_cast("bigint")


def genre_list(c: Column) -> Column:
    return F.when(c.isNull() | (c == "(no genres listed)"), F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))


def day_of(ts: Column) -> Column:
    return F.floor(ts / DAY_SECONDS).cast("bigint")


def gap_bucket(seconds: Column) -> Column:
    """1 for a first event (null gap), else 2 + floor(log2(gap + 1)), at most 32."""
    return F.when(seconds.isNull(), 1).otherwise(F.least(F.lit(32), 2 + F.floor(F.log2(F.greatest(seconds, F.lit(0)) + 1)))).cast("int")


def year_bucket(year: Column) -> Column:
    """Five-year steps since 1870, 0 for no year."""
    return F.coalesce(F.floor(F.greatest(F.lit(0), year - 1870) / 5) + 1, F.lit(0)).cast("int")


def label_bucket(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that the value doesn't exceed, the last label above all."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= edge, label).otherwise(out)
    return out


def tie_key(user: Column, item: Column) -> Column:
    """A stable order for events of one second that doesn't follow item ids."""
    return F.md5(F.concat_ws("-", user.cast("string"), item.cast("string")))


def unit(*parts) -> Column:
    """A steady number in [0, 1) from columns and constants."""
    text = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def multi_hot(values: Column, vocabulary: list[str]) -> list[Column]:
    return [F.array_contains(values, v).cast("int").alias(f"is_{v}") for v in vocabulary]


def log_inclusion(share: Column, positives: int, random: int, items: int) -> Column:
    """Log probability that an item is among ``positives`` draws by share or ``random`` uniform ones."""
    return F.log(-F.expm1(positives * F.log1p(-share) + F.lit(random) * F.log1p(F.lit(-1.0 / items))))


def smoothed(num: Column, den: Column, prior: float, weight: float) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(num.cast("double"), zero) + prior * weight) / (F.coalesce(den.cast("double"), zero) + weight)
