"""Shuffles of packed columns: a group of documents sends one row per bucket instead of one per value.

Spark moves and groups a few thousand binary rows where it would else move hundreds of millions of small ones, and
numpy sorts their contents. Buckets are hash ranges and grow in number with the input, so a bucket's content has a
fixed expected size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SENT = "bucket int, gid int, n long, blob binary"


def sending_order(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """The order in which values are sent: by bucket, then as they were; small numbers sort by radix."""
    return np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")


def scattered(gid: int, bucket: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> tuple[pa.Table, np.ndarray]:
    """The rows that carry `columns` to their buckets, and the order of the values as they were sent."""
    order = sending_order(bucket, n_buckets)
    counts = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    sent = [c[order] for c in columns]
    blobs = [b"".join(c[ends[b] - counts[b] : ends[b]].tobytes() for c in sent) for b in full.tolist()]
    rows = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), gid, np.int32)), pa.array(counts[full].astype(np.int64)), pa.array(blobs, pa.binary())]
    return pa.table(rows, ["bucket", "gid", "n", "blob"]), order


def gathered(table: pa.Table, dtypes: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(gid of each row, n of each row, columns joined over the rows) of one bucket, in order of gid."""
    table = table.sort_by("gid")
    counts = table.column("n").to_numpy()
    columns: list[list[np.ndarray]] = [[] for _ in dtypes]
    for n, blob in zip(counts.tolist(), table.column("blob"), strict=True):
        data, at = blob.as_buffer(), 0
        for k, kind in enumerate(dtypes):
            columns[k].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return table.column("gid").to_numpy(), counts, [np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(columns, dtypes, strict=True)]


def replies(bucket: int, gids: np.ndarray, counts: np.ndarray, values: np.ndarray) -> pa.Table:
    """The rows that carry one value per value sent back to the groups: bits for booleans, else the array's bytes."""
    ends = np.cumsum(counts)
    parts = [values[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    blobs = [(np.packbits(p) if p.dtype == bool else p).tobytes() for p in parts]
    return pa.table([pa.array(np.full(len(gids), bucket, np.int32)), pa.array(gids.astype(np.int32)), pa.array(counts.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "gid", "n", "blob"])


def answered(table: pa.Table, order: np.ndarray, dtype: str) -> np.ndarray:
    """The replies to a group, each value in the place of the value that was sent."""
    table = table.sort_by("bucket")
    parts = []
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob"), strict=True):
        data = blob.as_buffer()
        parts.append(np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool) if dtype == "bool" else np.frombuffer(data, dtype))
    out = np.empty(len(order), dtype)
    out[order] = np.concatenate(parts) if parts else np.empty(0, dtype)
    return out
