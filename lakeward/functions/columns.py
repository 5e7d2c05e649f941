"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def stable_id(*parts: Column) -> Column:
    """A 60-bit key: the first 15 hex digits of the SHA-256 of the joined parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    """SHA-256 of a text with every run of blanks as one space."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def decade(value: Column) -> Column:
    return (F.floor(value / 10) * 10).cast("int")


def band(value: Column, edges: list[float], labels: list[str], missing: str = "unknown") -> Column:
    """The label of the half-open interval [edge, next edge); an error below the first."""
    out = F.when(value.isNull(), missing)
    for edge, label in sorted(zip(edges, labels, strict=True), reverse=True):
        out = out.when(value >= edge, label)
    return out.otherwise(F.raise_error(F.lit("value below the first band")))


def known_key(key: Column, missing: str = "unknown") -> Column:
    """A concept id as text, with 0 and null as ``missing``."""
    return F.coalesce(F.nullif(key, F.lit(0)).cast("string"), F.lit(missing))


def first_present(**fields: Column) -> tuple[Column, Column]:
    """The first non-null of the fields in order, and the name of the field it is from."""
    name = reduce(lambda out, item: out.when(item[1].isNotNull(), item[0]), fields.items(), F.when(F.lit(False), ""))
    return F.coalesce(*fields.values()), name


def cell_text(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula, with a quote before it."""
    return F.when(value.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), value)).otherwise(value)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share, within [0, 1]."""
    n = n.cast("double")
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(values: Column) -> Column:
    return F.sqrt(dot(values, values))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(total(F.transform(logits, lambda x: F.exp(x - top))))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / total(powers))


def argmax(values: Column) -> Column:
    """The 1-based place of the largest value, the earliest of equals."""
    return F.array_position(values, F.array_max(values)).cast("int")


def hash_share(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the keys: a draw that reruns the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0
