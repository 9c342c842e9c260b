"""Fixed-size binary change records: encoding, decoding, and a quarantine for malformed ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layout of a record, little-endian and packed.
RECORD = np.dtype([
    ("etype", "u1"), ("dev_id", "<u4"), ("inode", "<u8"), ("parent_inode", "<u8"), ("seq", "<u8"), ("ts_ns", "<u8"),
    ("off", "<u8"), ("len", "<u8"), ("generation", "<u4"), ("flags", "<u4"), ("name", "S64"), ("new_name", "S64"),
])
RENAMES = (7, 23)
_NUMBERS = [n for n in RECORD.names if n not in ("name", "new_name")]
SCHEMA = ", ".join(f"{n} long" for n in _NUMBERS) + ", name string, new_name string"


def encode(events: DataFrame) -> DataFrame:
    """(record) of events with the layout's columns; absent ones are zero or empty."""
    have = [n for n in RECORD.names if n in events.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=RECORD)
            for n in have:
                column = batch.column(n).to_pylist()
                out[n] = [(x or "").encode()[:64] for x in column] if n in ("name", "new_name") else [x or 0 for x in column]
            data = out.tobytes()
            size = RECORD.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())], names=["record"])

    return events.select(*have).mapInArrow(run, "record binary")


def malformed(records: DataFrame) -> DataFrame:
    """Records of another length than the layout's, for the quarantine."""
    return records.filter(F.octet_length("record") != RECORD.itemsize)


def decode(records: DataFrame) -> DataFrame:
    """Records as columns, whole batches at a time; names end at a NUL, only renames have a new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("record").to_pylist()), dtype=RECORD)
            text = lambda n: [x.decode("utf-8", "replace") for x in rows[n].tolist()]  # noqa: E731, B023
            renamed = np.isin(rows["etype"], RENAMES).tolist()
            columns = [pa.array(rows[n].astype(np.int64)) for n in _NUMBERS]
            columns += [pa.array(text("name"), pa.string()), pa.array([x if r else None for x, r in zip(text("new_name"), renamed, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NUMBERS, "name", "new_name"])

    return records.filter(F.octet_length("record") == RECORD.itemsize).mapInArrow(run, SCHEMA)
