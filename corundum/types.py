"""The four storage types and a few more, and schemas with constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: SQL type names (upper case) to Spark types.  INTEGER and REAL are 64 bits wide.
TYPES: dict[str, T.DataType] = {
    "INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(),
    "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(),
    "TEXT": T.StringType(), "STRING": T.StringType(), "VARCHAR": T.StringType(), "JSON": T.StringType(),
    "BLOB": T.BinaryType(), "BINARY": T.BinaryType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(),
}


class UnknownType(ValueError):
    """A type name that the dialect does not have."""


def spark_type(name: str) -> T.DataType:
    base, _, rest = name.upper().partition("(")
    if base.strip() == "DECIMAL":
        p, _, s = rest.rstrip(") ").partition(",")
        return T.DecimalType(int(p or 10), int(s or 0))
    try:
        return TYPES[base.strip()]
    except KeyError:
        raise UnknownType(name) from None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    primary: bool = False
    unique: bool = False
    required: bool = False
    encrypted: bool = False
    default: str | None = None
    check: str | None = None

    def field(self) -> T.StructField:
        meta = {k: v for k, v in (("pk", self.primary), ("unique", self.unique), ("encrypted", self.encrypted), ("default", self.default), ("check", self.check)) if v}
        return T.StructField(self.name, self.type, not (self.required or self.primary), meta)


def schema_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([c.field() for c in columns])


def required(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not f.nullable]


def unique_keys(schema: T.StructType) -> list[list[str]]:
    """The primary key (its columns together) and each unique column."""
    primary = [f.name for f in schema if f.metadata.get("pk")]
    return ([primary] if primary else []) + [[f.name] for f in schema if f.metadata.get("unique")]


def encrypted(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if f.metadata.get("encrypted")]


def checks(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata["check"] for f in schema if "check" in f.metadata}


def stored_name(field: T.StructField) -> str:
    """The column's name in the files, which a renamed or replaced column keeps."""
    return field.metadata.get("stored", field.name)


def stored(schema: T.StructType) -> T.StructType:
    """What lies in the files: encrypted columns are binary, nothing is declared required.

    Files older than a column that was added with a default lack it; Spark's
    reader then gives what EXISTS_DEFAULT says.
    """
    old = lambda f: {"EXISTS_DEFAULT": f.metadata["existing"]} if "existing" in f.metadata else {}
    return T.StructType([T.StructField(stored_name(f), T.BinaryType() if f.metadata.get("encrypted") else f.dataType, True, old(f)) for f in schema])
