"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Everything here runs inside Python workers on plain numpy arrays, half a MB of
text at a time, so that memory stays bounded whatever a partition holds.
Texts longer than ``PIECE`` are hashed piece by piece, cut at white space.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
SHINGLE = 5

#: A word is a run of bytes other than space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: glibc's release of free heap; null elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (multiply-xorshift), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit values and a seed."""
    h = mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * (1.0 / (1 << 52))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty. What earlier batches used goes back to the system first:
    workers serve stage after stage, and would else hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def small(batches, name: str = "text", limit: int = 1 << 22):
    """Batches cut, without a copy, into runs of rows of about ``limit`` bytes of text, or one row; empty ones stay."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_numpy(zero_copy_only=False)
        place = (np.cumsum(sizes) - sizes) // limit
        cuts = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(sizes)]
        for first, last in zip(cuts, cuts[1:]) if len(sizes) else ((0, 0),):
            yield batch.slice(first, last - first)


def groups(texts: list[bytes], limit: int = PIECE):
    """Ranges of consecutive texts of ``limit`` bytes or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes, limit: int = PIECE):
    """Cut a text after white space into pieces of about ``limit`` bytes."""
    start = 0
    while len(text) - start > limit:
        end = start + limit
        window = np.frombuffer(text, np.uint8, end - start, start)
        found = np.flatnonzero(WHITE[window[-65536:]])
        if len(found):
            end = end - len(window[-65536:]) + int(found[-1]) + 1
        else:
            while end < len(text) and not WHITE[text[end]]:
                end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def word_bounds(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE):
    """Starts and ends of words in texts that lie end to end, and the words of each text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = np.ones(n + 2, bool)
    gap[1:-1] = white[data]
    inside = ~gap[1:-1]
    starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _hash_joined(joined: bytes, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(joined, np.uint8)
    if lower:
        data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), counts


def hashed_words(texts: list[bytes], lower: bool = True):
    """Yield (first, last, hashes, counts): 64-bit word hashes of ``texts[first:last]`` end to end."""
    for first, last in groups(texts):
        if last - first == 1 and len(texts[first]) > PIECE:
            parts = [_hash_joined(p, np.array([0, len(p)]), lower)[0] for p in pieces(texts[first])]
            words = np.concatenate(parts)
            yield first, last, words, np.array([len(words)])
            continue
        offsets = np.zeros(last - first + 1, np.int64)
        np.cumsum([len(t) for t in texts[first:last]], out=offsets[1:])
        words, counts = _hash_joined(b"".join(texts[first:last]), offsets, lower)
        yield first, last, words, counts


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text; a shorter text is one run, none has none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = mix(out + words[j : len(words) - width + 1 + j])
    return out


def of_each(texts: list[bytes], lower: bool = True):
    """Word hashes of each text in turn."""
    for _, _, words, counts in hashed_words(texts, lower):
        yield from np.split(words, np.cumsum(counts)[:-1])


def shared_path(spark, name: str) -> str:
    """A fresh path in the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark) -> str:
    """The folder named in ``spark.checkpoint.dir``. In local mode alone, one in the temporary folder stands in."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir()
    if not isinstance(named, str):
        named = named.get() if named.isDefined() else None
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def kept(df, name: str = "kept"):
    """``df`` written to the shared folder and read again: its lineage is cut and survives lost executors."""
    return _written(df, shared_path(df.sparkSession, name))


def _written(df, path: str):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables kept while an operator works; when it ends, all but its result are deleted."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, df, name: str = "kept"):
        self.paths.append(shared_path(self.spark, name))
        return _written(df, self.paths[-1])

    def result(self, df, name: str = "result"):
        """What the operator returns: written as well, and left."""
        return kept(df, name)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []
