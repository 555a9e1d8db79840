"""Counting in blocks, and sorted arrays in the shared folder that workers memory-map.

A task counts with numpy and packs its sorted keys per target partition; a reducer merges the blocks of its
partition. A distinct key of a task so costs a few shuffled bytes, and no key is hot: each task sends it once.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame

from larkspur.llm import _text as X
from larkspur.llm._spark import local_path

#: Distinct keys that a task counts before it sends its blocks.
HOLD = 1 << 21


# --- arrays in the shared folder ----------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def write_array(uri: str, values: np.ndarray) -> None:
    """Whole or not at all: a task that is run again replaces the array by the same."""
    system, path = _filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{os.urandom(6).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).view(np.uint8).data if len(values) else b"")
    system.move(draft, path)


@lru_cache(maxsize=1)
def _copies() -> str:
    folder = tempfile.mkdtemp(prefix="larkspur-model-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def map_array(uri: str, dtype: type) -> np.ndarray:
    """The array, memory-mapped: in place where workers see the shared folder, else from a copy of this worker's."""
    path = local_path(uri)
    if path is None:
        system, source = fs.FileSystem.from_uri(uri)
        path = os.path.join(_copies(), uri.replace("/", "_"))
        with system.open_input_stream(source) as src, open(path, "wb") as dst:
            shutil.copyfileobj(src, dst, 1 << 20)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


# --- blocks ------------------------------------------------------------------------------------------------

BLOCK = "p int, keys binary, counts binary"
SCHEMA = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def pack(values: np.ndarray, sorted_keys: bool) -> bytes:
    """Byte planes of the differences (for sorted keys) or of the numbers, compressed."""
    values = values.astype(np.uint64)
    if sorted_keys:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, sorted_keys: bool) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values) if sorted_keys else values


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts (rows of counts)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at, axis=0)


def blocks(parts: Iterator[tuple[np.ndarray, np.ndarray]], target: Callable[[np.ndarray], np.ndarray], hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """Sums (keys, counts) and yields blocks per target partition; counts: one column or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = base = 0

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = held[0]
        p = target(keys)
        order = np.argsort(p, kind="stable")
        keys, counts, p = keys[order], counts[order], p[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])), len(p))
        rows = [(int(p[a]), pack(keys[a:b], True), b"".join(len(c).to_bytes(4, "little") + c for c in (pack(counts[a:b, k], False) for k in range(counts.shape[1])))) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    for keys, counts in parts:
        held.append((keys, counts.reshape(len(keys), -1)))
        size += len(keys)
        if size > base + hold:
            held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            base = size = len(held[0][0])
            if size > hold:
                yield from out()
                held, size, base = [], 0, 0
    if held:
        held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
        if len(held[0][0]):
            yield from out()


def _counts(data: bytes) -> np.ndarray:
    columns, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        columns.append(unpack(data[at + 4 : at + 4 + n], False))
        at += 4 + n
    return np.stack(columns, 1).astype(np.int64)


def merged(batches: Iterator[pa.RecordBatch], hold: int = HOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, keys, counts) of rows in order of partition."""
    now, held, size, base = None, [], 0, 0
    for batch in batches:
        for p, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if p != now and held:
                yield now, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, size, base = [], 0, 0
            now = p
            held.append((unpack(keys, True), _counts(counts)))
            size += len(held[-1][0])
            if size > base + hold:
                held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                size = base = len(held[0][0])
    if held:
        yield now, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def by_range(parts: int) -> Callable[[np.ndarray], np.ndarray]:
    """Partitions that follow the order of 64-bit hashes."""
    return lambda keys: ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def by_hash(parts: int) -> Callable[[np.ndarray], np.ndarray]:
    ranges = by_range(parts)
    return lambda keys: ranges(X.mix(keys))


def ensure(uri: str, dtype: type) -> None:
    """An empty array where no task had anything to write."""
    system, path = _filesystem(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        write_array(uri, np.empty(0, dtype))


def gathered(df: DataFrame, parts: int) -> DataFrame:
    """Blocks of each partition together, in order."""
    return df.repartition(parts, "p").sortWithinPartitions("p")
