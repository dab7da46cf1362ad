"""JSON functions over text columns, on Spark's VARIANT type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(text: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), path, "variant")


def parse(text: Column) -> Column:
    """The VARIANT value; null for malformed text."""
    return F.try_parse_json(text)


def stringify(value: Column) -> Column:
    """Compact JSON text of a VARIANT."""
    return F.to_json(value)


def extract(text: Column, path: str) -> Column:
    """JSON text of the value at a path; null if the text is malformed or nothing is there."""
    return F.to_json(_at(text, path))


def valid(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def type_of(text: Column, path: str = "$") -> Column:
    """object, array, text, real, boolean or null; SQL null where nothing is there."""
    v = _at(text, path)
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("real")
    )


def array_length(text: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(text, path)).cast("bigint")


def object_keys(text: Column, path: str = "$") -> Column:
    """JSON array text of an object's keys, sorted; null for anything else."""
    return F.to_json(F.sort_array(F.json_object_keys(F.get_json_object(text, path))))


class Number(str):
    """A number as it is written; a string to Python, so tell it apart first."""


def _loader():
    def constant(name: str):
        raise ValueError(name)  # NaN and infinities are not JSON

    return json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=constant).decode


def _load(text: str):
    return _loader()(text)


def _dump(value) -> str:
    """Compact JSON text; numbers as they were written."""
    quoted = json.encoder.encode_basestring
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join([f"{quoted(k)}:{_dump(v)}" for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value)


def _holds(value, needle: str) -> bool:
    if isinstance(value, dict):
        return any(needle in k or _holds(v, needle) for k, v in value.items())
    if isinstance(value, list):
        return any(_holds(v, needle) for v in value)
    if isinstance(value, str):  # numbers too
        return needle in value
    return needle == json.dumps(value)


def contains(text: Column, needle: str) -> Column:
    """True if a key, string or number (as written) holds the needle, or it is a literal's name; malformed text holds nothing.

    Rows whose raw text cannot hold it are settled in the JVM; only the rest,
    where punctuation or escapes could mislead, are parsed.
    """

    @F.pandas_udf("boolean")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s):
            try:
                return s is not None and _holds(_load(s), needle)
            except (ValueError, RecursionError):
                return False

        for b in batches:
            yield b.map(one).astype(bool)

    may = F.contains(text, F.lit(needle)) | F.contains(text, F.lit("\\"))
    return F.coalesce(parsed(F.when(may, text)), F.lit(False))


def _put(root, steps: list, new):
    """``root`` with ``new`` at the path; unchanged where the path leads through something else."""
    if not steps:
        return new
    at = root
    for i, step in enumerate(steps[:-1]):
        if isinstance(at, dict) and isinstance(step, str):
            if step not in at and all(isinstance(s, str) for s in steps[i + 1 :]):
                at[step] = {}
            at = at.get(step)
        elif isinstance(at, list) and isinstance(step, int) and step < len(at):
            at = at[step]
        else:
            return root
    last = steps[-1]
    if isinstance(at, dict) and isinstance(last, str):
        at[last] = new
    elif isinstance(at, list) and isinstance(last, int) and last < len(at):
        at[last] = new
    elif isinstance(at, list) and isinstance(last, int) and last == len(at):
        at.append(new)
    return root


def set_value(text: Column, path: str, value: Column) -> Column:
    """The text with the value (JSON text) put at a path of keys and indexes; null if either is malformed.

    A missing key is added, with the objects on the way to it; an index
    replaces a member or appends behind the last one.  A path that leads
    through anything else leaves the document as it is.  Numbers keep their
    digits.
    """
    return set_values(text, (path, value))


def set_values(text: Column, *changes: tuple[str, Column]) -> Column:
    """Several changes of (path, value), one after the other, as calls of ``set_value`` around each other would make them.

    A call within a call has a Python worker of its own in every task; here one
    worker makes all changes, and those of other columns of the row too.
    """
    paths = [[int(p[1:-1]) if p.startswith("[") else p for p in _steps(path)] for path, _ in changes]

    @F.arrow_udf("string")
    def put(texts: pa.Array, *values: pa.Array) -> pa.Array:
        load = _loader()  # one a batch

        def one(s, *new):
            try:
                root = load(s)
                for steps, v in zip(paths, new, strict=True):
                    root = _put(root, steps, load(v))
                return _dump(root)
            except (TypeError, ValueError, RecursionError):
                return None

        return pa.array(map(one, *(c.to_pylist() for c in (texts, *values))), pa.string())

    return put(text, *[value for _, value in changes])


def _steps(path: str) -> list[str]:
    import re

    if not re.fullmatch(r"\$(\.[^.\[\]]+|\[\d+\])*", path):
        raise ValueError(f"bad path {path}")
    return [p.lstrip(".") for p in re.findall(r"\.[^.\[\]]+|\[\d+\]", path)]
