"""Column builders for vector arithmetic, bit-equal to a sequential float32 loop.

sqrt and division of floats give doubles in Spark, hence the casts after each of them. Arrays of unequal length give
NULL (zip_with pads with NULL), a NULL array gives NULL, an empty pair gives l2 0, inner product 0 and cosine 1. Cosine
with a zero vector is 1. NaN stays NaN, and sorts last.
"""
from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointlake.types import Metric

_ZERO = lambda: F.lit(0.0).cast("float")


def _sum(a: Column) -> Column:
    return F.aggregate(a, _ZERO(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b)).cast("float")


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x))).cast("float")


def inner_product(a: Column, b: Column) -> Column:
    """The negated dot product; adding zero turns -0.0 into 0.0."""
    return -dot(a, b) + _ZERO()


def cosine(a: Column, b: Column) -> Column:
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(1.0).cast("float")).otherwise((F.lit(1.0).cast("float") - (dot(a, b) / den).cast("float")).cast("float"))


_BUILDERS = {Metric.L2: l2, Metric.L2_SQUARED: l2_squared, Metric.INNER_PRODUCT: inner_product, Metric.COSINE: cosine}


def distance(a: Column, b: Column, metric: Metric | str) -> Column:
    return _BUILDERS[Metric(metric)](a, b)


def vector_lit(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector]) if vector else F.array().cast("array<float>")


def normalized(a: Column) -> Column:
    """a / |a|; a norm of 0 raises, as normalising collections refuse such vectors."""
    n = norm(a)
    return F.when(n == 0, F.raise_error(F.lit("a vector of norm 0 can't be normalized")).cast("array<float>")).otherwise(F.transform(a, lambda x: (x / n).cast("float")))


def usable(a: Column, dimension: Column | int) -> Column:
    """Whether a vector can be compared: the right length, all components finite, not all zero. Never NULL."""
    dim = F.lit(dimension) if isinstance(dimension, int) else dimension
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")).cast("float")))
    return F.coalesce((F.size(a) == dim) & (F.size(a) > 0) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def _nfc(ids: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(ids), min_count=0).as_py() is not False:
        return ids
    d = ids.dictionary_encode()  # pyarrow's own utf8_normalize(form="NFC") leaves text decomposed
    return pa.array([x and unicodedata.normalize("NFC", x) for x in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def nfc(a: Column) -> Column:
    """Ids that are canonically equivalent become equal strings. Each different id of an Arrow batch is normalised once, ASCII batches not at all."""
    return F.arrow_udf(_nfc, "string")(a)


def crc32(a: Column) -> Column:
    return F.crc32(a.cast("binary"))


def byte_length(a: Column) -> Column:
    return F.octet_length(a)


def valid_id(a: Column) -> Column:
    """1 to 512 UTF-8 bytes; NULL is invalid."""
    return F.coalesce(F.octet_length(a).between(1, 512), F.lit(False))
