"""Column functions: scalar statistics, special functions and vector arithmetic, all JVM-side.

Where SQL has the same spelling in other engines, the text is a plain string function so that it can be reused verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two numbers."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def normal_pdf_sql(z: str) -> str:
    """SQL text of the standard normal density."""
    return f"(exp(-0.5 * ({z}) * ({z})) * 0.3989422804014327)"


def normal_cdf_sql(z: str) -> str:
    """SQL text of the standard normal distribution function, by Hart's rational approximation (error below 1e-7).

    Neither Spark nor most SQL engines have erf; the text is the same for both.
    """
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    series = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"({normal_pdf_sql(z)} * ({series}))"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = normal_pdf(z) * series
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) * 0.3989422804014327


def total(array: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(array, F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tanimoto_bits(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two arrays of set bits; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(ratio(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def dice_bits(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(2.0 * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine_distance}
BIT_SIMILARITIES = {"tanimoto": tanimoto_bits, "dice": dice_bits}


def set_bits(values: Column) -> Column:
    """Places of the positive values of an array."""
    return F.filter(F.transform(values, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def sali(similarity: Column, change: Column) -> Column:
    """Structure-activity landscape index: change over dissimilarity, 0 for equal structures."""
    return F.when(similarity >= 1, F.lit(0.0)).otherwise(ratio(F.abs(change), 1 - similarity))


def hill(x: Column, bottom: float, top: float, ic50: float, slope: float) -> Column:
    """Four-parameter dose-response curve."""
    return bottom + (top - bottom) / (1 + F.pow(x / ic50, F.lit(slope)))


def steps(x: Column, ladder: list[tuple[float, float]], otherwise: float) -> Column:
    """The value of the first rung whose bound x doesn't exceed."""
    out = F.lit(otherwise)
    for bound, value in reversed(ladder):
        out = F.when(x <= bound, F.lit(value)).otherwise(out)
    return out
