"""`pgclog`: commit-log segments as rows (xid, status)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses of one segment: 2 bits each in 256 KiB.
XIDS_PER_SEGMENT = 1 << 20
#: Statuses read by one task.
XIDS_PER_TASK = 1 << 18


@dataclass
class Stretch(InputPartition):
    file: str
    first_xid: int
    offset: int


class ClogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        folder = options["path"].removeprefix("file://")
        self.next_xid = int(options.get("nextxid", 2**32))
        self.parts: list[InputPartition] = []
        for name in sorted(os.listdir(folder)):
            if re.fullmatch(r"[0-9A-F]{4,5}", name):
                file = os.path.join(folder, name)
                first = int(name, 16) * XIDS_PER_SEGMENT
                for at in range(0, os.path.getsize(file), XIDS_PER_TASK // 4):
                    if first + at * 4 < self.next_xid:
                        self.parts.append(Stretch(file, first + at * 4, at))

    def partitions(self) -> list[InputPartition]:
        return self.parts or [Stretch("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Stretch)
        if not partition.file:
            return
        with open(partition.file, "rb") as f:
            f.seek(partition.offset)
            raw = np.frombuffer(f.read(XIDS_PER_TASK // 4), dtype=np.uint8)
        status = (raw[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3).reshape(-1)
        xid = partition.first_xid + np.arange(len(status))
        keep = (xid >= 3) & (xid < self.next_xid)
        yield pa.RecordBatch.from_arrays([pa.array(xid[keep]), pa.array(status[keep].astype(np.int32))], names=["xid", "status"])


class ClogDataSource(DataSource):
    """Options: path (the folder of segments), nextXid (xids from here on have no status)."""

    @classmethod
    def name(cls) -> str:
        return "pgclog"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("xid", T.LongType()), T.StructField("status", T.IntegerType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ClogReader({k.lower(): v for k, v in dict(self.options).items()})
