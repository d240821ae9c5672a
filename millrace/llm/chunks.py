"""Files of arrays in the shared folder, and small packed rows that chunks of texts exchange."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa

from millrace.llm.arrays import list_parts
from millrace.llm.seekable import opened


def saved(folder: str, name: str, columns: dict[str, pa.Array]) -> str:
    """Write arrays of any lengths to a file of the shared folder."""
    fs, inner = opened(folder)
    fs.create_dir(inner, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}.arrow"
    row = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays([0, len(v)], v) for v in columns.values()], list(columns))
    with fs.open_output_stream(f"{inner}/{file}", compression=None) as stream:
        with pa.ipc.new_file(stream, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write(row)
    return f"{folder}/{file}"


def loaded(uri: str) -> dict[str, pa.Array]:
    fs, inner = opened(uri)
    with fs.open_input_file(inner) as file:
        row = pa.ipc.open_file(file).get_batch(0)
    return {name: list_parts(row.column(name))[0] for name in row.schema.names}


def range_cuts(top: np.ndarray, values: int, buckets: int) -> np.ndarray:
    """Cuts of sorted numbers below ``values`` into equal ranges, one for each bucket."""
    edges = np.array([k * values // buckets for k in range(1, buckets)], top.dtype)
    return np.concatenate([[0], np.searchsorted(top, edges), [len(top)]]).astype(np.int64)


def steps(values: np.ndarray) -> np.ndarray:
    """The first of sorted values and the rises from each to the next."""
    return np.diff(values, prepend=values[:1] * 0)


def rows_of(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """A batch of these rows."""
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds.values())], list(kinds))
