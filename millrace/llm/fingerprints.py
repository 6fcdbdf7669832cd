"""Bottom-k sketches of shingle hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import Scratch, of_each, shingles, small, texts_of

#: Hashes kept by a sketch, and hex digits of each (48 bits).
K, DIGITS = 64, 12
_SPACE = float(1 << 4 * DIGITS)
#: Bytes of text that a range of neighbours holds, and what stands for a null id in their order.
RANGE_BYTES, _FIRST = 16 << 20, -(1 << 63)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct 48-bit hashes, ascending."""
    low = hashes >> np.uint64(64 - 4 * DIGITS)
    if len(low) > 4 * k:
        bound = np.partition(low, 2 * k)[2 * k]
        some = np.unique(low[low <= bound])
        if len(some) >= k:
            return some[:k]
    return np.unique(low)[:k]


def encode(values: np.ndarray) -> str:
    """Fixed-width lowercase hex, ascending; empty for no shingle."""
    return values.astype(">u8").tobytes().hex() if DIGITS == 16 else "".join(x[16 - DIGITS :] for x in _hex16(values))


def _hex16(values: np.ndarray) -> list[str]:
    whole = values.astype(">u8").tobytes().hex()
    return [whole[i : i + 16] for i in range(0, len(whole), 16)]


def decode(text: str | None) -> np.ndarray:
    text = text or ""
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what was sketched; equal to the sketch of all shingles together."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct(values: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(values)) if len(values) < k else (k - 1) / ((float(values[k - 1]) + 1) / _SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact if the union has at most ``k`` shingles. Two empty ones are alike."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return float(min(1.0, both / max(distinct(a, k), 1.0)))


def fingerprint_texts(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    return [sketch(shingles(words), k) for words in of_each(texts)]


def fingerprint(docs: DataFrame, ids: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint, n_shingles): a bottom-k sketch of the five-word shingles of each whole text.

    Words are runs without white space, A-Z lower-cased. A text of fewer than five words is one shingle; a null or empty
    one has none, and its fingerprint is empty. n_shingles is the estimated number of distinct shingles. Map only; null
    ids, repeated rows and other columns need no care; equal texts have equal fingerprints.
    """
    kind = dict(docs.select(ids).dtypes)[ids]

    def run(batches):
        for batch in small(batches):
            found = fingerprint_texts(texts_of(batch, "text"), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())], names=[ids, "fingerprint", "n_shingles"])

    return docs.select(ids, docs[text].alias("text")).mapInArrow(run, f"`{ids}` {kind}, fingerprint string, n_shingles double")


def merge_fingerprints(df: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint per group, as of all the group's texts together. A group's hashes are ranked after a partial
    ranking in each task, so no task sees more than ``k`` hashes of a group from each other task."""
    from pyspark.sql import Window

    width = F.lit(DIGITS)
    each = df.select(*by, F.explode(F.expr(f"transform(sequence(0, greatest(length(fingerprint) div {DIGITS}, 1) - 1), i -> substr(fingerprint, i * {DIGITS} + 1, {DIGITS}))")).alias("hash")).filter(F.length("hash") == width)
    ranked = each.groupBy(*by, "hash").agg(F.lit(1).alias("one")).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("rank") <= k)
    return df.select(*by).distinct().join(ranked.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("merged")), by, "left").select(*by, F.coalesce("merged", F.lit("")).alias("fingerprint"))


def range_heads(docs: DataFrame, rows_per_range: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, text hashes): the first row of each range of about ``rows_per_range`` rows in the order of (id, hash), null
    ids first. Only ids and hashes are sorted; two numbers a range come to the driver."""
    with Scratch(docs.sparkSession) as scratch:
        keys = scratch.keep(docs.select("id", "hash"), "keys")
        ordered = scratch.keep(keys.sort(F.col("id").asc_nulls_first(), "hash").withColumn("at", F.monotonically_increasing_id()), "ordered")
        place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # in its task; every task begins a range
        heads = ordered.filter(place % rows_per_range == 0).select("id", "hash").distinct().toArrow()
        found = [heads[c].combine_chunks().fill_null(_FIRST).to_numpy(zero_copy_only=False) for c in ("id", "hash")]
    order = np.lexsort(found[::-1])
    return found[0][order], found[1][order]


def _places(ids: np.ndarray, hashes: np.ndarray, heads: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of each row: that of the last head that is not above it."""
    low, high = (np.searchsorted(heads[0], ids, side) for side in ("left", "right"))
    place = low - 1
    some = np.flatnonzero(high > low)
    for id_ in np.unique(ids[some]):
        own = some[ids[some] == id_]
        place[own] = low[own[0]] - 1 + np.searchsorted(heads[1][low[own[0]] : high[own[0]]], hashes[own], "right")
    return place


def neighbours(docs: DataFrame, ids: str = "doc_id", text: str = "text", rows_per_range: int | None = None) -> DataFrame:
    """The whole texts dealt into ranges of ascending ids, sorted within each partition, each range followed by a copy of
    the first row of the next one (of the first range after the last), marked ``ahead``.

    Ranges hold about RANGE_BYTES of text, or fewer where the cluster has more cores than ranges; their number grows
    with the table, and each has a partition of its own. Null ids come first. Rows of one id are ordered by a hash of
    their texts and split by it, so that an id of any share of the rows fills many ranges.
    """
    rows = docs.select(F.col(ids).cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("hash"), "text")
    if rows_per_range is None:
        total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        ranges = max(size // RANGE_BYTES, min(rows.sparkSession.sparkContext.defaultParallelism, total // 1000), 1)
        rows_per_range = -(-total // ranges) or 1
    heads = range_heads(rows, rows_per_range)
    n = len(heads[0])
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # 16 bytes a range

    def deal(batches):
        for batch in batches:
            own, hashes = (batch.column(i).fill_null(_FIRST).to_numpy(zero_copy_only=False) for i in (0, 1))
            place = _places(own, hashes, shared.value)
            first = np.flatnonzero((shared.value[0][place] == own) & (shared.value[1][place] == hashes))
            for rows_, at, ahead in ((batch, place, False), (batch.take(pa.array(first)), (place[first] - 1) % n, True)):
                yield pa.RecordBatch.from_arrays([rows_.column(0), rows_.column(1), pa.array(at.astype(np.int64)), rows_.column(2), pa.array(np.full(len(at), ahead))], names=["id", "hash", "range", "text", "ahead"])

    dealt = rows.mapInArrow(deal, "id long, hash long, range long, text string, ahead boolean")
    return dealt.repartitionById(max(1, n), F.col("range").cast("int")).sortWithinPartitions("range", "ahead", F.col("id").asc_nulls_first(), "hash").drop("hash")


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_edited double"


def edited_neighbours(docs: DataFrame, ids: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text, of the text whose last quarter is replaced by the first code points of the next
    document (as many, or all it has; ascending ids, after the last the first), and the likeness of both and of the next;
    then the estimated number of the text's distinct shingles and the share of them that the edited text holds.

    Repeated ids stand side by side in an order fixed by their texts; null ids come first; a single document is its own
    next. Rows equal in id and text stay in one range.
    """

    def run(batches):
        last, waiting = None, None  # the row that still waits for its next one

        def finish(rows):
            own = [r[1].encode() for r in rows]
            edited = [r[1][: len(r[1]) - len(r[1]) // 4] + r[3][: len(r[1]) // 4] for r in rows]
            raw = [t.encode() for t in edited]
            found = fingerprint_texts(own + raw, k)
            nexts = found[1 : len(rows)] + fingerprint_texts([rows[-1][3].encode()], k) if rows else []
            for i in range(len(rows) - 1):
                if rows[i][3] is not rows[i + 1][1] and rows[i][3] != rows[i + 1][1]:
                    nexts[i] = fingerprint_texts([rows[i][3].encode()], k)[0]
            a, b = found[: len(rows)], found[len(rows) :]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()), pa.array([encode(x) for x in a], pa.string()), pa.array([encode(x) for x in b], pa.string()), pa.array([resemblance(x, y, k) for x, y in zip(a, b)], pa.float64()), pa.array([resemblance(x, y, k) for x, y in zip(a, nexts)], pa.float64()), pa.array([distinct(x, k) for x in a], pa.float64()), pa.array([containment(x, y, k) for x, y in zip(a, b)], pa.float64())], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained_edited"])

        for batch in small(batches):
            rows, size = [], 0
            for id_, range_, text_, ahead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if waiting is not None and last == range_:
                    rows.append((*waiting, text_))
                    size += len(text_)
                waiting, last = (None if ahead else (id_, text_, range_)), range_
                if size > 4_000_000:
                    yield finish(rows)
                    rows, size = [], 0
            if rows:
                yield finish(rows)

    return neighbours(docs, ids, text).select("id", "range", "text", "ahead").mapInArrow(run, EDIT_SCHEMA)
