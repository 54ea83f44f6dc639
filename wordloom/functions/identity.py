"""Fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from wordloom.functions.text import slugify


def sorted_names(value: Column, kind: DataType) -> Column:
    """`value` with the fields of its structs and the keys of its maps in the order of their names, at every depth."""
    if isinstance(kind, StructType):
        inner = [sorted_names(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_names(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_names(e["value"], kind.valueType).alias("value"))))
    return value


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object with sorted names (H1); nulls are kept, as null. Of fields that are structs or
    maps themselves, see fingerprint."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def fingerprint(df: DataFrame, *columns: str) -> Column:
    """stable_hash of columns of `df`, nested names sorted too (H1)."""
    return stable_hash(**{c: sorted_names(F.col(c), df.schema[c].dataType) for c in columns})


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes (H2)."""
    return F.sha2(content, 256)


def job_id(title: Column, fingerprint: Column) -> Column:
    """A slug and the first 12 digits of a fingerprint (H3)."""
    return F.concat_ws("-", slugify(title), F.left(fingerprint, F.lit(12)))
