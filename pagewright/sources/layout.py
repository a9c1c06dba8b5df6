"""Columns of a relation as the files hold them: lengths, alignments, Spark types."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from pagewright.functions.decode import OIDS, TYPES

#: PostgreSQL types whose values become native Spark types; all others come as canonical text.
NATIVE = {"bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "oid": T.LongType(), "xid": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(), "bytea": T.BinaryType(), "tinyint": T.ByteType()}
ALIGNS = {"c": 1, "s": 2, "i": 4, "d": 8}


@dataclass(frozen=True)
class ColumnLayout:
    name: str
    kind: str
    length: int
    align: int
    dropped: bool = False
    virtual: bool = False
    text: bool = False

    @property
    def spark_type(self) -> T.DataType:
        if self.text:
            return T.StringType()
        if self.kind in ("date", "timestamp"):  # infinities and far years have no Spark value: NULL, unless read as text
            return T.DateType() if self.kind == "date" else T.TimestampNTZType()
        return NATIVE.get(self.kind, T.StringType())


def parse_columns(text: str) -> list[ColumnLayout]:
    """Columns from `name type, name type, ...` or from JSON rows with name, type (name or oid), len, align, dropped, virtual."""
    if text.lstrip().startswith("["):
        out = []
        for c in json.loads(text):
            kind = OIDS.get(c["type"], str(c["type"])) if isinstance(c["type"], int) else c["type"]
            length, align, _ = TYPES.get(kind, (c.get("len", -1), 4, None))
            align = ALIGNS.get(c.get("align"), c.get("align", align)) if c.get("align") is not None else align
            out.append(ColumnLayout(c["name"], kind, c.get("len", length), align, bool(c.get("dropped")), bool(c.get("virtual"))))
        return out
    out = []
    for part in text.split(","):
        name, kind = part.split()
        length, align, _ = TYPES.get(kind, (-1, 4, None))
        out.append(ColumnLayout(name, kind, length, align))
    return out


def dump_columns(columns: list[ColumnLayout]) -> str:
    return json.dumps([{"name": c.name, "type": c.kind, "len": c.length, "align": c.align, "dropped": c.dropped, "virtual": c.virtual} for c in columns])
