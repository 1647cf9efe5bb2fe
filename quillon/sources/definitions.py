"""Schema definition files: line 1 the number of columns, line 2 the bytes of a row, then ``name type range key bytes``.

The range of an INTEGER or REAL column is the exclusive bound of its values, that of a STRING column its
exact length. Key kinds are PK, FK and NK. All of it is kept in the metadata of the schema's fields.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from quillon.plans.spec import QueryError

TYPES = {"INTEGER": T.IntegerType(), "REAL": T.FloatType(), "STRING": T.StringType()}
KEYS = ("PK", "FK", "NK")


def parse_definition(lines: Iterable[str]) -> T.StructType:
    rows = [line.split() for line in lines if line.strip()]
    if len(rows) < 2 or len(rows[0]) != 1 or len(rows[1]) != 1:
        raise QueryError("a definition begins with the number of columns and the bytes of a row")
    try:
        columns, row_bytes = int(rows[0][0]), int(rows[1][0])
    except ValueError:
        raise QueryError("the number of columns and the bytes of a row are integers") from None
    fields = []
    for row in rows[2:]:
        if len(row) != 5 or row[1] not in TYPES or row[3] not in KEYS or not (row[2].isdigit() and row[4].isdigit()):
            raise QueryError(f"not a column definition: {' '.join(row)}")
        name, kind, bound, key, size = row
        fields.append(T.StructField(name, TYPES[kind], False, {"type": kind, "range": int(bound), "key": key, "bytes": int(size)}))
    if len(fields) != columns:
        raise QueryError(f"{columns} columns announced, {len(fields)} defined")
    if sum(f.metadata["bytes"] for f in fields) != row_bytes:
        raise QueryError(f"the columns don't add up to {row_bytes} bytes")
    return T.StructType(fields)


def definition_rows(schema: T.StructType) -> list[tuple[str, str, int, str, int]]:
    return [(f.name, f.metadata["type"], f.metadata["range"], f.metadata["key"], f.metadata["bytes"]) for f in schema.fields]
