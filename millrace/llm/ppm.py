"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import PIECE, groups, hashed_words, kept, mix, small, texts_of

#: Context bytes of the trie's deepest nodes.
ORDER = 5
#: Rows of the lookup tables up to which they are broadcast (12 bytes each); beyond, blocks of text fetch theirs.
BROADCAST_ROWS = 6_000_000
#: Text bytes of a block on that other path.
BLOCK_BYTES = 8 << 20
#: Entries a task holds before it passes counts on.
HELD = 2_000_000
#: Marks the beginning (as context) and the end (as symbol); no byte of UTF-8.
EDGE = 0xFF
ALPHABET = 256
WORD, GRAM = 0, 1


class Ppm:
    """A byte-context trie with escape method C and symbol exclusion, one symbol at a time.

    ``code(text, learn=True)`` is the adaptive log10 probability; after ``learn`` of a corpus, ``code(text)`` is the
    pretrained one, which ``score_texts`` computes for whole tables.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def _step(self, context: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k :])
            if not node:
                continue
            own = {s: c for s, c in node.items() if s not in excluded}
            mass = sum(own.values()) + len(own)
            if symbol in own:
                return total + math.log10(own[symbol] / mass)
            if mass:
                total += math.log10(len(own) / mass)
            excluded |= node.keys()
        return total - math.log10(ALPHABET - len(excluded))

    def _add(self, context: bytes, symbol: int):
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def code(self, text: bytes, learn: bool = False) -> float:
        padded, total = bytes([EDGE]) * self.order + text + bytes([EDGE]), 0.0
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            total += self._step(context, padded[i])
            if learn:
                self._add(context, padded[i])
        return total

    def learn(self, text: bytes):
        padded = bytes([EDGE]) * self.order + text + bytes([EDGE])
        for i in range(self.order, len(padded)):
            self._add(padded[i - self.order : i], padded[i])


def symbol_keys(texts: list[bytes], order: int):
    """Yield (first, last, keys, counts): for every byte and end of ``texts[first:last]`` its context and itself as one
    number. A long text comes in several turns."""
    edge = bytes([EDGE])

    def keys_of(data: bytes) -> np.ndarray:
        symbols = np.frombuffer(data, np.uint8).astype(np.uint64)
        keys = symbols[order:].copy()
        for j in range(1, order + 1):
            keys |= symbols[order - j : len(symbols) - j] << np.uint64(8 * j)
        return keys

    for first, last in groups(texts):
        if last - first == 1 and len(texts[first]) > PIECE:
            text = edge * order + texts[first] + edge
            for at in range(order, len(text), PIECE):
                keys = keys_of(text[at - order : at + PIECE])
                yield first, last, keys, np.array([len(keys)])
            continue
        keys = keys_of(b"".join([edge * order + t + edge for t in texts[first:last]]))
        counts = np.array([len(t) + 1 for t in texts[first:last]], np.int64)
        keep = np.ones(len(keys), bool)
        ends = np.cumsum(counts + order)
        for j in range(order):
            keep[ends[:-1] - order + j] = False
        yield first, last, keys[keep], counts


class Counter:
    """Counts of 64-bit keys with bounded memory: what exceeds it is passed on and summed elsewhere."""

    def __init__(self, kind: int, held: int = 0):
        self.kind, self.held, self.parts, self.size = kind, held, [], 0

    def add(self, keys: np.ndarray, weight: int = 1):
        if len(keys):
            keys, counts = np.unique(keys, return_counts=True)
            self.parts.append((keys, counts * weight))
            self.size += len(keys)

    def merge(self):
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[at], np.add.reduceat(counts, at))]
            self.size = len(at)

    def drain(self, final: bool):
        if self.size > 2 * HELD or final:
            self.merge()
            if self.parts and (final or self.size > HELD):
                keys, counts = self.parts[0]
                self.parts, self.size = [], 0
                for i in range(0, len(keys), 1 << 19):
                    own = keys[i : i + (1 << 19)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), self.kind, np.int32)), pa.array(own.view(np.int64)), pa.array(counts[i : i + (1 << 19)].astype(np.int64)), pa.array(np.full(len(own), self.held, np.int32))], names=["kind", "key", "n", "held"])


class Lookup:
    """Values of sorted, evenly spread 64-bit keys; ``missing`` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], [np.uint64(0xFFFFFFFFFFFFFFFF)]])
        self.values, self.missing = np.concatenate([values[order], [missing]]), missing
        self.bits = max(1, min(24, int(len(keys)).bit_length()))
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        at = self.start[wanted >> np.uint64(64 - self.bits)]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        found = self.values[at]
        return np.where(self.keys[at] == wanted, found, self.missing) if len(self.values) > 1 else np.full(len(wanted), self.missing)


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)]) if len(values) < 1 else None
    if sums is not None or (counts == 0).any():
        out = np.zeros(len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(values, np.cumsum(counts)[some] - counts[some])
        return out
    return np.add.reduceat(values, np.cumsum(counts) - counts)


def score_texts(texts: list[bytes], learnt: np.ndarray, words: Lookup, grams: Lookup, totals: dict, order: int):
    """(tokens, known tokens, base score, score) of each text; words that are missing stand once if it was learnt, else never."""
    n, known, base, score = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    mass = totals["tokens"] + 0.5 * (totals["distinct"] + 1)
    for first, last, hashes, counts in hashed_words(texts):
        seen = words.get(hashes)
        seen = np.where(seen < 0, np.repeat(learnt[first:last], counts), seen)
        n[first:last] += counts
        known[first:last] += _sum_by((seen > 0).astype(float), counts).astype(np.int64)
        base[first:last] += _sum_by(np.log10((seen + 0.5) / mass), counts)
    known += totals["texts"] > 0
    base += math.log10((totals["texts"] + 0.5) / mass)
    for first, last, keys, counts in symbol_keys(texts, order):
        score[first:last] += _sum_by(grams.get(mix(keys)), counts)
    return n, known, base, score


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 probability of every symbol after its context that occurs, from (key, n) with n training counts.

    Lower orders are suffix sums. After an escape, the symbols of the longer context are excluded; as they are a subset
    of the shorter context's, it suffices to know their number and their mass there, one sum per context.
    """
    levels = {order: kept(counts.filter("n > 0").select("key", "n"), "grams")}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy((F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).alias("key")).agg(F.sum("n").alias("n"))
        levels[k] = kept(levels[k], "grams")

    def small(k: int, df: DataFrame) -> DataFrame:  # at most 2^16 keys of two bytes
        return F.broadcast(df) if k <= 2 else df

    stats = {}
    for k in range(order + 1):
        own = levels[k].withColumn("context", F.shiftright("key", 8))
        if k:
            lower = small(k, levels[k - 1].select(F.col("key").alias("low"), F.col("n").alias("m")))
            own = own.join(lower, F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("low"))
        else:
            own = own.withColumn("m", F.lit(0).cast("long"))
        stats[k] = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("m").alias("below"))
    first = stats[order]
    seen = levels[order].withColumn("context", F.shiftright("key", 8)).join(first.select("context", "total", "kinds"), "context")
    seen = seen.select("key", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))
    left = counts.filter("n = 0").select("key", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("mass"), F.lit(0).cast("long").alias("kinds_out"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        low = (1 << 8 * (k + 1)) - 1
        table = small(k, stats[k].select(F.col("context").alias("c"), "total", "kinds", "below"))
        left = left.join(table, F.shiftright(F.col("key").bitwiseAND(F.lit(low)), 8) == F.col("c"), "left")
        if k < order:
            left = left.join(small(k + 1, levels[k].select(F.col("key").alias("g"), "n")), F.col("key").bitwiseAND(F.lit(low)) == F.col("g"), "left")
        else:
            left = left.withColumn("n", F.lit(None).cast("long")).withColumn("g", F.lit(None))
        total, kinds = F.col("total") - F.col("mass"), F.col("kinds") - F.col("kinds_out")
        here = ~F.col("done") & F.col("total").isNotNull()
        hit, room = here & F.col("n").isNotNull(), kinds > 0
        step = F.when(hit, F.log10(F.col("n") / (total + kinds))).when(here & room, F.log10(kinds / (total + kinds))).otherwise(0.0)
        left = left.select("key", (F.col("value") + step).alias("value"), F.when(here, F.col("below")).otherwise(F.col("mass")).alias("mass"), F.when(here, F.col("kinds")).otherwise(F.col("kinds_out")).alias("kinds_out"), (F.col("done") | hit).alias("done"))
    # 256 symbols less those that the empty context knows
    unseen = left.select("key", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - F.log10(F.lit(float(ALPHABET)) - F.col("kinds_out"))).alias("value"))
    return seen.unionByName(unseen)


SCHEMA = "n_tokens long, n_known long, base_score double, score double"


def score_corpus(docs: DataFrame, train: Column, order: int = ORDER, ids: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score whole texts by the rows for which ``train`` holds.

    Returns one row per input row: the id, held_out (train does not hold; a row for which it is null is learnt from), n_tokens,
    n_known, train_tokens, base_score (word unigrams, add 0.5, A-Z lower-cased, with an end token) and score (log10
    probability of the bytes and the end under PPM of ``order`` context bytes, method C with exclusion).

    A first pass counts words and byte contexts of all rows in each task and sums them by key. Contexts that only scored
    rows have get a count of 0, so that every key's probability is known before the second pass. That pass looks keys up
    in broadcast tables if these have at most ``broadcast_rows`` rows; else texts are dealt into blocks by ids and texts, and
    each block is joined with the values of its own distinct keys. Words are told apart by 64-bit hashes.

    Null and empty texts are the end alone; without training rows every symbol has 1/256; null ids and repeated rows are
    rows as any; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(ids).dtypes)[ids]
    rows = docs.select(docs[ids], docs[text].alias("text"), F.coalesce(train, F.lit(True)).alias("train"))

    def count(batches):
        words, others, grams = Counter(WORD), Counter(WORD, 1), Counter(GRAM)
        for batch in small(batches):
            texts, learns = texts_of(batch, "text"), batch.column(2).to_pylist()
            for wanted in (True, False):
                own = [t for t, yes in zip(texts, learns) if yes == wanted]
                tally = words if wanted else others
                for _, _, hashes, _ in hashed_words(own):
                    tally.add(hashes, int(wanted))
                    yield from tally.drain(False)
                for _, _, keys, _ in symbol_keys(own, order):
                    grams.add(keys, int(wanted))
                    yield from grams.drain(False)
        for tally in (words, others, grams):
            yield from tally.drain(True)

    counted = kept(rows.select(ids, "text", "train").mapInArrow(count, "kind int, key long, n long, held int").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("held").alias("held")), "counts")
    learnt = counted.filter(f"kind = {WORD} and n > 0")
    # a word of a training row that isn't here stands once, one of a held row never
    words = learnt.filter("n > 1 or held = 1").select("key", F.col("n").cast("double").alias("value"))
    sums = learnt.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train = rows.filter("train").count()
    totals = {"texts": n_train, "tokens": sums[1] + n_train, "distinct": sums[0] + (n_train > 0)}
    # rounded here, so that both ways of looking up add the same values
    grams = kept(gram_scores(counted.filter(f"kind = {GRAM}").select("key", "n"), order).select("key", F.col("value").cast("float").alias("value")), "gram-scores")
    names = [ids, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{ids}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(batch: pa.RecordBatch, own: Lookup, own_grams: Lookup) -> pa.RecordBatch:
        learnt = np.array(batch.column(batch.schema.get_field_index("train")).to_pylist(), bool)
        n, known, base, score = score_texts(texts_of(batch, "text"), learnt, own, own_grams, totals, order)
        held = ~learnt
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), totals["tokens"], np.int64)), pa.array(base), pa.array(score)], names=names)

    n_rows = words.count() + grams.count()
    if n_rows <= broadcast_rows:
        arrays = []
        for table in (words, grams):
            whole = table.withColumn("value", F.col("value").cast("float" if table is grams else "int" if sums[1] < 1 << 31 else "double")).toArrow()
            arrays += [whole["key"].to_numpy().view(np.uint64), whole["value"].to_numpy()]
            del whole
        arrays[2] = mix(arrays[2])
        shared = spark.sparkContext.broadcast(arrays)
        del arrays

        def score(batches):
            own = Lookup(shared.value[0], shared.value[1], -1.0)
            own_grams = Lookup(shared.value[2], shared.value[3], 0.0)
            for batch in small(batches):
                yield scored(batch, own, own_grams)

        return rows.mapInArrow(score, schema)

    blocks = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(ids, "text"), F.lit(blocks)))

    def wanted(block: pa.Table) -> pa.Table:
        found = []
        for batch in block.combine_chunks().to_batches():
            texts = texts_of(batch, "text")
            found += [(WORD, np.unique(h)) for _, _, h, _ in hashed_words(texts)] + [(GRAM, np.unique(k)) for _, _, k, _ in symbol_keys(texts, order)]
        out = []
        for which in (WORD, GRAM):
            keys = np.unique(np.concatenate([k for w, k in found if w == which] or [np.zeros(0, np.uint64)]))
            out.append(pa.table({"block": np.full(len(keys), block["block"][0].as_py(), np.int64), "kind": np.full(len(keys), which, np.int32), "key": keys.view(np.int64)}))
        return pa.concat_tables(out)

    values = words.withColumn("kind", F.lit(WORD)).unionByName(grams.withColumn("kind", F.lit(GRAM)))
    asked = dealt.groupBy("block").applyInArrow(wanted, "block long, kind int, key long").join(values, ["kind", "key"])

    def answer(block: pa.Table, answers: pa.Table) -> pa.Table:
        which, keys, found = answers["kind"].to_numpy(), answers["key"].to_numpy().view(np.uint64), answers["value"].to_numpy()
        own = Lookup(keys[which == WORD], found[which == WORD], -1.0)
        own_grams = Lookup(mix(keys[which == GRAM]), found[which == GRAM], 0.0)
        out = [scored(b, own, own_grams) for b in block.combine_chunks().to_batches()]
        return pa.Table.from_batches(out) if out else pa.table({n: [] for n in names})

    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(answer, schema)
