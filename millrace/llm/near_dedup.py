"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._text import Scratch, kept, mix, of_each, shingles, small, texts_of

#: 2^BUCKETS hashed document frequencies: a bound on what is broadcast.
BUCKETS, SLICES = 20, 64
#: A shingle in more than this share of all documents is common and weighs less.
COMMON = 0.01
#: Bands of rows: 168 samples. Texts of similarity 0.8 meet in no band with a chance of 0.0002, of 0.3 with one of 0.98.
BANDS, ROWS = 28, 6
THRESHOLD = 0.8
#: Rounds of sampling in which elements are dealt to samples, before the rest is drawn from all elements.
DEALS = 8
#: Buckets up to this size are compared in pairs, larger ones in blocks of BLOCK texts or BLOCK_BYTES of shingles.
SMALL, BLOCK, BLOCK_BYTES = 16, 256, 4 << 20
#: Ids up to this number are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
_GOLD, _STEP = 0xA24BAED4963EE407, np.uint64(0x9FB21C651E98DF25)


def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each stands."""
    return np.unique(shingles(words), return_counts=True)


def text_hash(words: np.ndarray) -> int:
    """A signed 64-bit hash of a text's words in order."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return int(mix(mix(words + place + np.uint64(1)).sum(keepdims=True)).view(np.int64)[0])


def idf(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(keys >> np.uint64(64 - BUCKETS)).astype(np.int64)]


def idf_table(frequency: np.ndarray, n: int) -> np.ndarray:
    """1 + half the log of inverse document frequency, normalised and cut at a share of ``COMMON``: 1.5 for whatever
    stands in fewer documents, down to 1 for what stands in all.

    Cutting there lets groups of copies keep their similarity, and shares of documents, unlike counts, do not move with
    the corpus. Other shingles that a bucket has taken in are the same load everywhere, the median, and are taken off."""
    own = np.maximum(frequency - np.median(frequency), 0)
    return (1 + 0.5 * np.minimum(1, np.log((n + 1) / (np.minimum(own, n) + 1)) / -np.log(COMMON))).astype(np.float32)


def consistent_samples(keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` samples of each of several weighted sets that lie end to end, as rows; two sets agree on one with about
    their weighted Jaccard similarity.

    Rounds deal the elements to samples by a hash, as in fast similarity sketching; a sample takes the element with the
    smallest value under improved consistent weighted sampling, in the first round that brings it one. What is then
    still empty is drawn from all elements of its set. A sample is the element and its quantised weight; those of an
    empty set are 0.
    """
    sets, logs = np.repeat(np.arange(len(sizes)), sizes), np.log(weights)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out, empty = np.zeros(len(sizes) * k, np.uint64), np.repeat(np.asarray(sizes) > 0, k)
    best = np.full(len(out), np.inf)

    def take(own: np.ndarray, slots: np.ndarray, seeds) -> None:
        step, value = _icws(keys[own], logs[own], seeds)
        np.minimum.at(best, slots, value)
        won = np.flatnonzero(value == best[slots])[::-1]  # of equals the smallest element, written last
        out[slots[won]] = mix(keys[own[won]] + step[won].astype(np.int64).view(np.uint64) * _STEP)
        empty[slots] = False

    for i in range(DEALS):
        slots = sets * k + (mix(keys + np.uint64((_GOLD * (i + 1)) & (2**64 - 1))) % np.uint64(k)).astype(np.int64)
        own = np.flatnonzero(empty[slots])
        if len(own):
            take(own, slots[own], np.uint64(i))
    left = np.flatnonzero(empty)
    each = np.asarray(sizes)[left // k] if len(left) else left
    for first in range(0, len(left), 1 << 9):
        some, n = left[first : first + (1 << 9)], each[first : first + (1 << 9)]
        slots = np.repeat(some, n)
        own = np.arange(len(slots)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some // k], n)
        take(own, slots, (slots % k + 100).astype(np.uint64))
    return out.reshape(len(sizes), k)


def _icws(keys: np.ndarray, logs: np.ndarray, seeds) -> tuple[np.ndarray, np.ndarray]:
    """Ioffe's scheme: (quantised log weight, value) of each element; r and c are Gamma(2, 1), beta is uniform."""
    half = lambda h: ((h >> np.uint64(32)).astype(np.float64) + 0.5, (h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5)
    with np.errstate(over="ignore"):
        base = mix(keys + np.uint64(0x632BE59BD9B4E019) + seeds * np.uint64(0xD1342543DE82EF95))
    (a, b), (c, d), (e, _) = half(base), half(mix(base + np.uint64(1))), half(mix(base + np.uint64(2)))
    r = -np.log(a * b * 2.0**-64)
    step = np.floor(logs / r + e * 2.0**-32)
    return step, np.log(-np.log(c * d * 2.0**-64)) - r * (step - e * 2.0**-32) - r  # its log orders alike


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of each row of samples."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), 1))
    for j in range(ROWS):
        out = mix(out + parts[:, :, j])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> float:
    """Jaccard similarity under TF-IDF weights."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float((np.minimum(a[1][i], b[1][j]) * idf(both, table)).sum())
    total = float((a[1] * idf(a[0], table)).sum() + (b[1] * idf(b[0], table)).sum()) - common
    return common / total if total > 0 else 0.0


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many texts hold a shingle of each of 2^BUCKETS hash buckets. Tasks send whole slices, summed in two steps."""
    width = (1 << BUCKETS) // SLICES

    def count(batches):
        from pyspark import TaskContext

        table, seen = np.zeros(1 << BUCKETS, np.int64), False
        for batch in small(batches):
            seen = True
            for words in of_each(texts_of(batch, "text")):
                if len(words):
                    table[np.unique(shingles(words) >> np.uint64(64 - BUCKETS)).astype(np.int64)] += 1
        if seen:
            task = TaskContext.get().partitionId() // 256
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES), pa.int64()), pa.array(np.full(SLICES, task), pa.int64()), pa.array([table[i * width : (i + 1) * width].astype("<i8").tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "part", "data"])

    def add(batch: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in batch["data"])
        return pa.table({"slice": batch["slice"][:1], "part": pa.array([0], pa.int64()), "data": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "slice long, part long, data binary"
    parts = docs.select(docs[text].alias("text")).mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema)
    rows = parts.groupBy("slice").applyInArrow(add, schema).toArrow().sort_by("slice")  # 2^BUCKETS numbers
    return np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows["data"]]) if len(rows) else np.zeros(1 << BUCKETS, np.int64)


def within(df: DataFrame, ids: DataFrame, on: str, how: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """``df`` joined with ids (left, semi or anti), which are broadcast up to a bound and else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids, on, how)


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(keys, np.uint64)
    return own, np.frombuffer(counts, "<u4").astype(np.float64) if counts else np.ones(len(own))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that edges (node, other) lead to, by minima of neighbours and shortcuts."""
    both = scratch.keep(edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        far = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", "old", F.least("label", "top").alias("label"))
        new = scratch.keep(far, "labels")
        if not new.filter("label <> old").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def _elements(sets: list, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight): sets with every repeat of a shingle as an element of its own, so that what two sets
    have in common is a plain intersection."""
    rows, keys, weights = [], [], []
    for i, (own, n) in enumerate(sets):
        n = n.astype(np.int64)
        at = np.repeat(np.arange(len(own)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        keys.append(own[at] + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        weights.append(idf(own, table)[at])
        rows.append(np.full(len(at), i, np.int64))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)


def block_links(a: list, b: list | None, labels_a: np.ndarray, labels_b: np.ndarray, skip: np.ndarray, table: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) between two blocks of sets, or within one if ``b`` is None, enough to join all labels that any
    link of the blocks joins. ``skip`` marks pairs that need no look.

    Common weights of all pairs are products of matrices, a range of elements at a time; those near the threshold are
    computed again in double precision."""
    (rows_a, keys_a, weights_a), other = _elements(a, table), b if b is not None else a
    rows_b, keys_b, weights_b = _elements(b, table) if b is not None else (rows_a, keys_a, weights_a)
    total_a, total_b = (np.bincount(r, w, n) for r, w, n in ((rows_a, weights_a, len(a)), (rows_b, weights_b, len(other))))
    if b is None:
        shared, times = np.unique(keys_a, return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(keys_a, keys_b)
    common = np.zeros((len(a), len(other)), np.float32)

    def placed(rows, keys, weights):
        at = np.searchsorted(shared, keys)
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == keys) if len(shared) else np.zeros(len(keys), bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order], weights[ok][order]

    at_a, own_a, weight_a = placed(rows_a, keys_a, weights_a)
    at_b, own_b, _ = placed(rows_b, keys_b, weights_b)
    width = 2048
    for first in range(0, len(shared), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(other), width), np.float32)
        i, j = np.searchsorted(at_a, (first, first + width)), np.searchsorted(at_b, (first, first + width))
        x[own_a[i[0] : i[1]], at_a[i[0] : i[1]] - first] = weight_a[i[0] : i[1]]
        y[own_b[j[0] : j[1]], at_b[j[0] : j[1]] - first] = 1
        common += x @ y.T
    alike = common / np.maximum(total_a[:, None] + total_b[None, :] - common, 1e-9)
    alike[skip | (labels_a[:, None] == labels_b[None, :])] = 0
    found = np.argwhere(alike >= threshold - 1e-3)
    found = found[np.argsort(-alike[tuple(found.T)], kind="stable")]
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    links = []
    for i, j in found.tolist():
        x, y = root(int(labels_a[i])), root(int(labels_b[j]))
        if x != y and (alike[i, j] >= threshold + 1e-3 or similarity(a[i], other[j], table) >= threshold):
            top[x] = y
            links.append((i, j))
    return links


def blocks_of(members: DataFrame, stored: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Rows (key, g1, p1, g2, p2, first, node, label, open, keys, counts): the texts of each pair of blocks of each bucket, from
    members (key, node, label) and stored (node, keys, counts).

    Members of a label that is at least half a block have blocks (label, part) of their own, which do not meet each
    other; the others share blocks, which also meet themselves. A text goes to as many places as its bucket has
    blocks of other labels. ``open`` are all buckets of a text: a pair is looked at in the first that both are in."""
    sized = members.join(stored.select("node", (F.length("keys") + F.length("counts")).alias("bytes")), "node")
    own = sized.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    large = (F.col("n") * 2 >= block) | (F.col("bytes") * 2 >= block_bytes)
    parts = own.groupBy("key", F.when(large, F.col("label")).alias("big")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = parts.select("key", "big", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).alias("parts"))
    buckets = members.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("open"))
    named = members.join(own.filter(large).select("key", "label", F.lit(True).alias("is_big")), ["key", "label"], "left")
    named = named.withColumn("big", F.when(F.col("is_big"), F.col("label"))).drop("is_big")
    mine = parts.select(F.col("key").alias("k"), F.col("big").alias("b"), "parts")
    placed = named.join(mine, (F.col("key") == F.col("k")) & F.col("big").eqNullSafe(F.col("b"))).select("key", "node", "label", "big", F.pmod(F.xxhash64("node", "key"), "parts").alias("part"))
    full = placed.join(buckets, "node").join(stored.select("node", "keys", "counts"), "node")
    others = parts.select("key", F.col("big").alias("big2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part2"))
    met = full.join(others, "key").filter(F.col("big").isNull() & F.col("big2").isNull() | ~F.col("big").eqNullSafe(F.col("big2")))
    pooled = F.lit(-(2**63)).cast("long")
    one, two = (F.struct(F.coalesce(b, pooled).alias("g"), F.col(p).alias("p")) for b, p in (("big", "part"), ("big2", "part2")))
    met = met.withColumn("one", F.least(one, two)).withColumn("two", F.greatest(one, two)).withColumn("first", F.col("one") == one)
    return met.select("key", F.col("one.g").alias("g1"), F.col("one.p").alias("p1"), F.col("two.g").alias("g2"), F.col("two.p").alias("p2"), "first", "node", "label", "open", "keys", "counts")


def compare_blocks(table, threshold: float):
    """A function of one pair of blocks: the links (node, other) that ``block_links`` finds."""

    def compare(batch: pa.Table) -> pa.Table:
        key, alone = batch["key"][0].as_py(), batch["g1"][0].as_py() == batch["g2"][0].as_py() and batch["p1"][0].as_py() == batch["p2"][0].as_py()
        side = np.asarray(batch["first"].to_pylist(), bool)
        nodes, labels = (batch[c].to_numpy() for c in ("node", "label"))
        earlier = [[k for k in own if k < key] for own in batch["open"].to_pylist()]
        sets = [unpack(k, n) for k, n in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist())]
        i = np.flatnonzero(side)
        j = i if alone else np.flatnonzero(~side)
        if not len(i) or not len(j) or (labels[i[0]] == labels[i]).all() and (labels[j] == labels[i[0]]).all():
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        marks: dict[int, int] = {k: n for n, k in enumerate({k for own in earlier for k in own})}
        hot = np.zeros((len(sets), max(1, len(marks))), np.float32)
        for row, own in enumerate(earlier):
            hot[row, [marks[k] for k in own]] = 1
        skip = hot[i] @ hot[j].T > 0
        if alone:
            skip |= np.tri(len(i), dtype=bool)
        links = [] if skip.all() else block_links([sets[x] for x in i], None if alone else [sets[x] for x in j], labels[i], labels[j], skip, table.value, threshold)
        return pa.table({"node": pa.array([nodes[i[x]] for x, _ in links], pa.int64()), "other": pa.array([nodes[j[y]] for _, y in links], pa.int64())})

    return compare


def with_hashes(rows: DataFrame, table=None) -> DataFrame:
    """(id, node) of rows (id, text), and (bands) if a table of IDF is given. ``node`` is null for a text without words."""

    def sample(batches):
        for batch in small(batches):
            nodes, bands, sets, at = [], [], [], []

            def flush():
                if sets:
                    keys, weights = (np.concatenate(x) for x in zip(*sets))
                    for i, own in zip(at, band_keys(consistent_samples(keys, weights, np.array([len(k) for k, _ in sets]))).view(np.int64)):
                        bands[i] = own
                sets.clear(), at.clear()

            held = 0
            for words in of_each(texts_of(batch, "text")):
                nodes.append(text_hash(words) if len(words) else None), bands.append(None)
                if len(words) and table is not None:
                    keys, n = counted(words)
                    sets.append((keys, n * idf(keys, table.value).astype(np.float64))), at.append(len(nodes) - 1)
                    held += len(keys)
                    if held >= 1 << 16:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "node", "bands"])

    return rows.select("id", "text").mapInArrow(sample, "id long, node long, bands array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, keys, counts) of rows (id, text): the shingles of each text as packed numbers; counts of 1 are left out."""

    def sets(batches):
        for batch in small(batches):
            nodes, keys, counts = [], [], []
            for words in of_each(texts_of(batch, "text")):
                if len(words):
                    k, n = counted(words)
                    nodes.append(text_hash(words)), keys.append(k.tobytes())
                    counts.append(n.astype("<u4").tobytes() if n.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["node", "keys", "counts"])

    return rows.select("id", "text").mapInArrow(sets, "node long, keys binary, counts binary")


def duplicate_nodes(docs: DataFrame, threshold: float = THRESHOLD, ids: str = "doc_id", text: str = "text", small: int = SMALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, node, label): one row per input row; ``node`` is a hash of its text's words, ``label`` names its class.

    Texts of the same words (white space and the case of A-Z aside) are one node at once. Nodes are linked if the
    TF-IDF weighted Jaccard similarity of their five-word shingles is ``threshold`` or more; classes are the components
    of links. A text of fewer than five words is one shingle. Candidates are all pairs that meet in a band of weighted
    samples, so a pair of similarity s is missed with a chance of (1 - s^6)^28, unless others join it.

    Every member of a bucket first meets the bucket's leader, the text with the most neighbours, which joins groups of
    copies cheaply. Buckets whose members are then of several labels are searched for the rest: small ones in pairs,
    larger ones in blocks whose pairs are compared in one place each, without leaving any out. Texts without words, and
    null ones, have neither node nor label: each is a class of its own. Texts are told apart by 64-bit hashes. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[ids].cast("long").alias("id"), docs[text].alias("text"))
    shared = spark.sparkContext.broadcast(idf_table(document_frequencies(rows), rows.count()))
    with Scratch(spark) as scratch:
        keep = scratch.keep
        sampled = keep(with_hashes(rows, shared), "samples")
        nodes = sampled.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands"))
        banded = keep(nodes.select("node", "least", F.explode("bands").alias("key")), "bands")
        sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        members = keep(banded.join(sizes, "key"), "members")
        labels = None
        if members.take(1):
            found = keep(members.select("node", "least").distinct(), "found")
            wanted = within(rows.filter("id is not null"), found.select(F.col("least").alias("id")).filter("id is not null").distinct(), "id", "left_semi", broadcast_ids)
            read = shingle_sets(wanted.unionByName(rows.filter("id is null")))
            stored = keep(within(read, found.select("node"), "node", "left_semi", broadcast_ids).dropDuplicates(["node"]), "sets")

            def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
                def verify(batches):
                    for batch in batches:
                        own = [batch.column(i).to_pylist() for i in range(2, 6)]
                        ok = pa.array([similarity(unpack(a, b), unpack(c, d), shared.value) >= threshold for a, b, c, d in zip(*own)], pa.bool_())
                        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["node", "other"])

                both = pairs.join(sets.select(F.col("node").alias("other"), F.col("keys").alias("k2"), F.col("counts").alias("n2")), "other").join(sets, "node")
                return keep(both.select("node", "other", "keys", "counts", "k2", "n2").mapInArrow(verify, "node long, other long"), "links")

            central = members.groupBy("node").agg(F.sum("size").alias("central"))
            leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
            led = keep(members.select("key", "node", "size").join(leaders, "key"), "led")
            pairs = led.filter("node <> leader").select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("other")).distinct()
            labels = components(verified(pairs, stored), scratch)

            def joined(links: DataFrame) -> DataFrame:
                """Labels after further links: those so far are links to the text that they name."""
                more = links.unionByName(labels.filter("node <> label").select("node", F.col("label").alias("other")))
                return components(more, scratch) if links.take(1) else labels

            def apart(some: DataFrame) -> DataFrame:
                """Members, with labels, of buckets that hold several."""
                named = some.join(labels, "node", "left").select("key", "node", "leader", F.coalesce("label", "node").alias("label"))
                several = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
                return keep(named.join(several, "key"), "apart")

            few = apart(led.filter((F.col("size") > 2) & (F.col("size") <= small))).filter("node <> leader")
            pairs = few.select("key", "node", "label").join(few.select("key", F.col("node").alias("other"), F.col("label").alias("label2")), "key")
            pairs = keep(pairs.filter("node > other and label <> label2").select("node", "other").distinct(), "pairs")
            if pairs.take(1):
                ends = pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()
                labels = joined(verified(pairs, within(stored, ends, "node", "left_semi", broadcast_ids)))
            many = apart(led.filter(F.col("size") > small)).select("key", "node", "label")
            if many.take(1):
                met = blocks_of(many, within(stored, many.select("node").distinct(), "node", "left_semi", broadcast_ids), block, block_bytes)
                labels = joined(keep(met.groupBy("key", "g1", "p1", "g2", "p2").applyInArrow(compare_blocks(shared, threshold), "node long, other long"), "links"))
        if labels is None:
            return kept(sampled.select("id", "node", F.col("node").alias("label")), "classes")
        return kept(sampled.select("id", "node").join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("label")), "classes")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, ids: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS, **sizes) -> DataFrame:
    """(id, class_id): one row per input row; class_id is the smallest id of its class as ``duplicate_nodes`` finds it.

    Rows with a null id get their class's smallest id, or null if it has none. Texts without words are classes of their
    own. Different texts of one id are different documents that share a name."""
    with Scratch(docs.sparkSession) as scratch:
        nodes = duplicate_nodes(docs, threshold, ids, text, broadcast_ids=broadcast_ids, **sizes)
        least = nodes.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
        named = within(nodes, scratch.keep(least.select("label", "least"), "least"), "label", "left", broadcast_ids)
        return kept(named.select(F.col("id").alias(ids), F.coalesce("least", "id").alias("class_id")), "classes")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, ids: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS, **sizes) -> DataFrame:
    """One document of each class, with all columns: the row with the smallest id, and of several texts under that id,
    or of rows without an id, the one with the smallest hash. Equal texts of one id stay once; texts without words stay.

    A row whose id stands once is kept or dropped by its id; only the others need their text's hash again."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, body = f"c{names.index(ids)}", f"c{names.index(text)}"
    with Scratch(docs.sparkSession) as scratch:
        nodes = duplicate_nodes(docs, threshold, ids, text, broadcast_ids=broadcast_ids, **sizes)
        worded = nodes.filter("label is not null").groupBy("id", "node", "label").agg(F.count("*").alias("rows"))
        first = worded.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")).select("label", F.col("first.id").alias("first_id"), F.col("first.node").alias("first_node"))
        decided = worded.join(first, "label").select("id", "node", (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node"))).alias("stays"))
        decided = scratch.keep(decided, "decided")
        several = scratch.keep(nodes.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias(at)), "several")
        gone = decided.filter("id is not null and not stays").select(F.col("id").alias(at)).distinct()
        known = own.filter(F.col(at).isNotNull())
        once = within(within(known, several, at, "left_anti", broadcast_ids), gone, at, "left_anti", broadcast_ids)
        rest = own.filter(F.col(at).isNull()).unionByName(within(known, several, at, "left_semi", broadcast_ids))
        rest = scratch.keep(_with_node(rest, body), "rest")
        stay = decided.filter("stays").select(F.col("id").alias("stay_id"), F.col("node").alias("node"))
        rest = rest.filter("node is null").unionByName(rest.join(stay, "node").filter(F.col(at).cast("long").eqNullSafe(F.col("stay_id"))).select(rest.columns).dropDuplicates([at, "node"]))
        return kept(once.unionByName(rest.select(own.columns)).toDF(*names), "stay")


def _with_node(rows: DataFrame, text: str) -> DataFrame:
    def add(batches):
        for batch in small(batches, text):
            nodes = [text_hash(words) if len(words) else None for words in of_each(texts_of(batch, text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("node", T.LongType())]))
