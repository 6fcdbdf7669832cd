"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import kept

#: Units that one reduction task rounds together.
BLOCK = 4096
#: Sources up to this number are broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, size).

    Sources in code point order, null last, take the weights in turn. The budget, ``share`` times all sizes, is
    dealt by weight; what exceeds ``most`` times a source's size is dealt again by weight among the others, until
    none is above. Each round of that is one aggregate over the table of sources.
    """
    spark = sizes.sparkSession
    sources = kept(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows")), "sources")
    # the rank without a single task: ranges, then ranks inside each, then the ranges' offsets
    parts = max(1, min(1000, sources.count() // 10_000))
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")) if parts > 1 else sources.coalesce(1)
    ranged = kept(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    per_part = {r[0]: r[1] for r in ranged.groupBy("part").count().collect()}  # one row for each of 1000 ranges at most
    before = {p: sum(n for q, n in per_part.items() if q < p) for p in per_part}
    offset = F.create_map(*[F.lit(x) for item in before.items() for x in item]) if before else F.create_map().cast("map<int,int>")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.coalesce(F.try_element_at(offset, F.col("part")), F.lit(0))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = kept(ranged.select("source", "source_size", "source_rows", F.get(pattern, (place % len(weights)).cast("int")).alias("weight")), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, cap = share * total, 0.0, most * F.col("source_size")
    while total:
        full = F.lit(level) * F.col("weight") >= cap
        used, open_weight = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (budget - used) / open_weight <= level * (1 + 1e-12):
            break
        level = (budget - used) / open_weight
    return weighed.select("source", "source_size", "source_rows", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _settle(x: float) -> float:
    return round(x) if abs(x - round(x)) < 1e-9 else x


def round_chances(chance: list[float], size: list[float], draws) -> list[float]:
    """Round all but at most one of the chances, the largest units first; expectations and total mass are kept.

    The largest open unit is paired with the next smaller ones. A draw decides which way mass (size times chance) goes:
    the partners fill it to 1 or take all it has, each in proportion to what it can bear both ways. Where the smaller
    units together cannot bear that, two units transfer at random until one of them is integral.
    """
    n, first = len(chance), 0
    for i in range(n):
        p, s = chance[i], size[i]
        if not 0 < p < 1:
            continue
        partners, need = [], s
        for j in range(i + 1, n):
            if 0 < chance[j] < 1:
                bear = min(chance[j] * size[j] / (1 - p), (1 - chance[j]) * size[j] / p, need)
                partners.append((j, bear))
                need -= bear
                if need <= s * 1e-12:
                    break
        if need > s * 1e-12:
            first = i
            break
        up = draws[i] < p
        chance[i] = 1.0 if up else 0.0
        for j, bear in partners:
            chance[j] = _settle(chance[j] - (1 - p) * bear / size[j] if up else chance[j] + p * bear / size[j])
    else:
        return chance
    a = -1
    for b in range(first, n):
        if not 0 < chance[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        has_a, has_b = chance[a] * size[a], chance[b] * size[b]
        room_a, room_b = size[a] - has_a, size[b] - has_b
        give, take = min(has_a, room_b), min(room_a, has_b)
        moved = -give if draws[b] * (give + take) < take else take
        chance[a], chance[b] = _settle((has_a + moved) / size[a]), _settle((has_b - moved) / size[b])
        a = a if 0 < chance[a] < 1 else b if 0 < chance[b] < 1 else -1
    return chance


def round_block(frame: pa.Table, seed: str) -> pa.Table:
    """One block of one source; draws depend on the seed, the source and the block alone."""
    frame = frame.take(pc.sort_indices(frame, [("size", "descending"), ("doc_id", "ascending"), ("unit", "ascending")], null_placement="at_start"))
    key = "|".join(str(x) for x in (seed, *(frame[c][0].as_py() for c in ("source", "level", "block"))))
    draws = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little")).random(len(frame))
    chance = round_chances(frame["chance"].to_pylist(), frame["size"].to_pylist(), draws.tolist())
    return frame.set_column(frame.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64()))


def numbered(rows: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``rows`` with ``unit``: 0, 1, ... among equal rows. They are counted before they are dealt, and made again from
    the counts, a chunk at a time, so that a row repeated any number of times is spread over the cluster."""
    counts = kept(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "counts")
    once = counts.filter("n = 1").select(*rows.columns, F.lit(0).cast("long").alias("unit"))
    several = counts.filter("n > 1")
    if not several.take(1):
        return once
    chunks = several.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    spread = chunks.repartition(*rows.columns, "first")
    return once.unionByName(spread.select(*rows.columns, F.explode(F.sequence("first", F.least(F.col("first") + chunk, F.col("n")) - 1)).alias("unit")))


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = "mix", block: int = BLOCK, ids: str = "doc_id") -> DataFrame:
    """Copies of each document so that sources reach their target words.

    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns are ignored. Returns one row per input row:
    doc_id, source, size (words), source_size, target (of its source), copies (0 to ``most``), taken (copies times size).

    Every row of a positive size expects target / source_size copies. The whole part is given; the fraction is rounded by the pivotal
    method within blocks of ``block`` units of one source, the one open unit of each block goes on to the next level of
    a reduction tree, and the tree's root is rounded by a last draw. So a source's words miss its target by less than
    the size of the one unit that stays open at the root, the largest document of the source at most. Blocks are dealt
    by a hash of id, size and place among equal rows: a source, an id or a row of any share of the table is split evenly.

    Null text has size 0 and takes nothing; a null source is a source, the last; null ids and repeated rows are units of
    their own (equal rows are interchangeable); an empty table gives no rows. Reruns agree for any partitioning.
    """
    sized = kept(numbered(docs.select(F.col(ids).alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))), "sized")
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    n_sources = targets.count()
    small = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    sized, targets_of = sized.alias("a"), small.alias("b")
    joined = sized.join(targets_of, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.doc_id", "a.source", "a.size", "a.unit", F.coalesce("b.source_size", F.lit(0)).alias("source_size"), F.coalesce("b.target", F.lit(0.0)).alias("target"), "b.source_rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.col("size") > 0, rate).otherwise(0.0)
    near = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    units = joined.withColumn("whole", F.floor(near)).withColumn("chance", near - F.col("whole"))
    blocks = -(-(targets.agg(F.max("source_rows")).first()[0] or 1) // block)
    spread = F.pmod(F.xxhash64("doc_id", "size", "unit", F.lit(seed)), F.ceil(F.col("source_rows") / block).cast("long"))
    columns = "doc_id {0}, source string, size long, source_size long, target double, whole long, chance double, level int, block long, unit long".format(dict(docs.select(ids).dtypes)[ids])
    units = units.select("doc_id", "source", "size", "source_size", "target", "whole", "chance", F.lit(0).alias("level"), spread.alias("block"), "unit")
    settled, level = [units.filter("chance = 0")], 0
    rows = units.filter("chance > 0")
    fan = max(2, block // 16)
    while True:
        rounded = kept(rows.groupBy("source", "block").applyInArrow(lambda f: round_block(f, seed), columns), "rounded")
        settled.append(rounded.filter("chance <= 0 or chance >= 1"))
        rest, level = rounded.filter("chance > 0 and chance < 1"), level + 1
        if blocks == 1:
            last = F.pmod(F.xxhash64("doc_id", "size", F.lit(f"{seed}|root")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("chance")
            settled.append(rest.withColumn("chance", last.cast("double")))
            break
        blocks = -(-blocks // fan)
        rows = rest.withColumn("unit", F.col("block")).withColumn("block", F.floor(F.col("block") / fan)).withColumn("level", F.lit(level))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("chance")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
