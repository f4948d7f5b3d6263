"""Many narrow rows of long numbers in a shuffle, packed into few binary rows.

A row holds what one load of a task sends to one part: columns of longs, the
first ascending and held as differences.  Bytes of equal weight lie together,
those that are zero throughout are left out.  Numbers of parts follow the
input, so a part fits a task whatever the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_NUMBERS, LEAST_PARTS = 1 << 21, 64
LOAD_NUMBERS = 1 << 20

PACKED = "part long, kind int, numbers binary"


def parts_for(numbers: int) -> int:
    return max(LEAST_PARTS, -(-numbers // PART_NUMBERS))


def part_of(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of each hash of so many bits; it ascends with the hashes."""
    return ((hashes.view(np.uint64) >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def loads(found: Iterable[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Columns put together until a load is full."""
    held, count = [], 0
    for columns in found:
        held.append(columns)
        count += len(columns[0])
        if count >= LOAD_NUMBERS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, count = [], 0
    if count:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def pack(columns: list[np.ndarray]) -> bytes:
    n = len(columns[0])
    masks, planes = [], []
    for column in [np.diff(columns[0], prepend=columns[0][:1]), *columns[1:]]:
        octets = np.ascontiguousarray(column, "<i8").view(np.uint8).reshape(n, 8)
        used = octets.any(axis=0)
        masks.append(np.packbits(used).tobytes())
        planes.append(octets.T[used].tobytes())
    return b"".join([np.array([n, columns[0][0]], "<i8").tobytes(), *masks, *planes])


def unpack(data: bytes, width: int) -> list[np.ndarray]:
    n, first = np.frombuffer(data, "<i8", 2).tolist()
    masks = np.unpackbits(np.frombuffer(data, np.uint8, width, 16)).reshape(width, 8).astype(bool)
    at, columns = 16 + width, []
    for used in masks:
        octets = np.zeros((n, 8), np.uint8)
        size = n * int(used.sum())
        octets[:, used] = np.frombuffer(data, np.uint8, size, at).reshape(-1, n).T
        columns.append(octets.view("<i8").ravel())
        at += size
    columns[0] = np.cumsum(columns[0]) + first
    return columns


def dealt(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part; rows come sorted by part and first column."""
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    ends = np.append(cuts, len(part))[1:]
    rows = [pack([c[a:b] for c in columns]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    arrays = [pa.array(part[cuts], pa.int64()), pa.array([kind] * len(cuts), pa.int32()), pa.array(rows, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "numbers"])


def gathered(table: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The columns of all rows of a kind."""
    rows = table["numbers"].filter(pc.equal(table["kind"], kind)).to_pylist()
    if not rows:
        return [np.zeros(0, np.int64)] * width
    return [np.concatenate(c) for c in zip(*(unpack(r, width) for r in rows), strict=True)]
