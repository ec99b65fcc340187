"""Column functions whose rounding, NaN and median rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_number(text: Column) -> Column:
    """The number that a text holds, null if it holds none."""
    return text.try_cast("double")


def lower_median(values: Column) -> Column:
    """The middle of an array, the lower of two middles; null for an empty array. Nulls are left out."""
    own = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(own) > 0, F.element_at(own, F.floor((F.size(own) - 1) / 2).cast("int") + 1))


def half_even(x: Column) -> Column:
    """The nearest whole number as a double, the even one of two as near."""
    return F.rint(x)


def floor_half(x: Column) -> Column:
    """x / 2 rounded down, for negative x too."""
    return F.floor(x / F.lit(2.0)).cast("int")


def all_at_least(values: Column, least: float) -> Column:
    """Whether no entry is null or NaN and the smallest is at least `least`; false for a null array."""
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(sound & (F.array_min(values) >= least), F.lit(False))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x held between low and high; NaN and null stay as they are."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def times(a: Column, b: Column, n: int = 4) -> Column:
    """Product of two n x n matrices given as arrays of rows."""
    cell = lambda i, j: sum((a[i][k] * b[k][j] for k in range(n)), F.lit(0.0))
    return F.array(*(F.array(*(cell(i, j) for j in range(n))) for i in range(n)))


def shift(*by: Column) -> Column:
    """The 4 x 4 matrix that moves a voxel by these three steps."""
    rows = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] + [by[i].cast("double")] for i in range(3)]
    return F.array(*(F.array(*r) for r in rows), F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))


def column_norms(affine: Column) -> Column:
    """Lengths of the first three columns of a 4 x 4 matrix: the spacing of voxels."""
    return F.array(*(F.sqrt(sum((affine[i][j] * affine[i][j] for i in range(3)), F.lit(0.0))) for j in range(3)))


def run_mask(lengths: Column) -> Column:
    """Booleans of runs of the given lengths, false first."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i % 2 == 1, n.cast("int"))))


def digest10(document: Column) -> Column:
    """The first ten hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(document, 256), 1, 10)


def field(document: Column, path: str, default=None, kind: str = "string") -> Column:
    """What a JSON document (a variant) has at a path like $.a.b[0], as a type; the default where there is nothing, null or
    something of another type. Objects and lists as text are their JSON."""
    found = F.try_variant_get(document, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def canonical(document: Column) -> Column:
    """A struct, map or variant as JSON with the keys of every object in ascending order and nulls stated: equal documents
    are equal texts, whatever order their keys came in. Numbers lose zeros at the end of their fraction."""
    return F.to_json(F.parse_json(F.to_json(document, {"ignoreNullFields": "false"})))
