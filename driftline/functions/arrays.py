"""Array and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term(params: Column, component: Column | int, j: Column | int, terms: Column | int) -> Column:
    """Parameter j of a component in a flat array of components times terms."""
    at = [F.lit(x) if isinstance(x, int) else x for x in (component, j, terms)]
    return F.get(params, (at[0] * at[2] + at[1]).cast("int"))


def by_component(params: Column, terms: Column | int) -> Column:
    """The flat array as an array of its components."""
    k = F.lit(terms) if isinstance(terms, int) else terms
    n = (F.size(params) / k).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(params, i * k + 1, k))


def array_length(values: Column) -> Column:
    """R2: the length, null for an empty array."""
    return F.nullif(F.size(values), F.lit(0))


def zipped(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row for each pair of two arrays' entries, in columns of the arrays' names."""
    pairs = F.explode(F.arrays_zip(F.col(first), F.col(second))).alias("pair")
    kept = [c for c in rows.columns if c not in (first, second)]
    return rows.select(*kept, pairs).select(*kept, f"pair.{first}", f"pair.{second}")


def all_entries(rows: DataFrame, column: str) -> DataFrame:
    """The distinct entries of all arrays."""
    return rows.select(F.explode(column).alias(column)).distinct()


def as_json(*columns: str) -> Column:
    """The columns as a JSON object."""
    return F.to_json(F.struct(*columns))
