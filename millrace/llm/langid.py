"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import LOWER, PIECE, pieces, small, texts_of

#: Hashed byte n-grams: 2^BITS features for each language.
BITS = 18
#: Rows (about) that the classifier learns from; all rows are scored.
SAMPLE_ROWS = 20_000
#: Nats that a change of language within a text costs.
SWITCH = 12.0
#: Nats that a language whose scripts a word does not use costs.
FOREIGN = 60.0
UNKNOWN = "und"

#: Script ranges by code points, fixed values: (first, last), one bit each.
SCRIPTS = [(0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0x980, 0x9FF), (0xB80, 0xBFF), (0xE00, 0xE7F), (0x10A0, 0x10FF), (0x1E00, 0x1EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)]
LATIN = 1


def _script_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    single = np.zeros(256, np.uint32)
    single[65:91] = single[97:123] = LATIN
    pairs = np.zeros(1 << 16, np.uint32)
    for bit, (first, last) in enumerate(SCRIPTS):
        for point in range(max(first, 0x80) & ~0x3F, last + 1, 0x40):  # the last byte holds six bits
            data = chr(max(point, 0x80)).encode() if not 0xD800 <= point <= 0xDFFF else b""
            if len(data) == 2:
                for low in range(0x80, 0xC0):
                    pairs[data[0] << 8 | low] |= 1 << bit
            elif len(data) == 3:
                pairs[data[0] << 8 | data[1]] |= 1 << bit
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    pairs[0xC397] = pairs[0xC3B7] = pairs[0xC2 << 8 : 0xC3 << 8] = 0
    return single, pairs, letter


SINGLE, PAIRS, LETTER = _script_tables()


def features(joined: bytes, offsets: np.ndarray):
    """Words (runs of letters) of texts that are joined by one space each: (starts, ends, words of each text, script bits
    of each word, feature buckets of both kinds by letter byte, first letter byte of each word)."""
    data = np.frombuffer(b" " + joined + b"  ", np.uint8)
    is_letter = LETTER[data]
    inside = is_letter[1:-2]
    low = np.where(is_letter, LOWER[data], np.uint8(32)).astype(np.uint32)
    starts = np.flatnonzero(inside & ~is_letter[:-3])
    ends = np.flatnonzero(inside & ~is_letter[2:-1]) + 1
    at = np.flatnonzero(inside) + 1
    three = low[at - 1] << np.uint32(16) | low[at] << np.uint32(8) | low[at + 1]
    four = three << np.uint32(8) | np.where(is_letter[at + 1], low[at + 2], np.uint32(32))
    shift = np.uint32(32 - BITS)
    one, two = (three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA6B) ^ (four >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift
    first = np.searchsorted(at, starts + 1)
    bits = SINGLE[data[at]] | np.where(data[at] >= 0xC2, PAIRS[data[at].astype(np.uint32) << np.uint32(8) | data[at + 1]], np.uint32(0))
    scripts = np.bitwise_or.reduceat(bits, first) if len(starts) else np.zeros(0, np.uint32)
    return starts, ends, np.diff(np.searchsorted(starts, offsets)), scripts, one, two, first


def joined_groups(texts: list[bytes], limit: int = PIECE):
    """Yield (row indices, joined text, offsets); long texts come in several pieces of the same row."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text) if len(text) > limit else (text,):
            if size and size + len(piece) > limit:
                yield np.array(rows), b" ".join(parts), np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(piece)
            size += len(piece) + 1
    if rows:
        yield np.array(rows), b" ".join(parts), np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word: texts side by side, longest first, one step per word."""
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    base = (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t
    best = scores[base[: alive[0]]].astype(np.float64)
    back = np.empty((len(scores), scores.shape[1]), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, lengths[0]):
        n = alive[t]
        value = best[:n]
        top = value.argmax(1)
        jump = value[np.arange(n), top] - switch
        stay = value >= jump[:, None]
        back[base[:n] + t] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, value, jump[:, None]) + scores[base[:n] + t]
    state = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        out[base[:n] + t] = state[:n]
        if t:
            state[:n] = back[base[:n] + t, state[:n]]
    return out


#: Labels that a model can hold.
MAX_LANGUAGES = 200


class Model:
    """Log probabilities of feature buckets for each language, and the scripts that each uses."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts

    def word_scores(self, scripts, one, two, first) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32)
        scores = np.add.reduceat(self.table[one] + self.table[two], first, axis=0) * np.float32(0.5)
        fits = (scripts[:, None] & self.scripts[None, :]) != 0
        scores[~fits & fits.any(1)[:, None]] -= np.float32(FOREIGN)
        scores[~fits.any(1)] = 0  # no language uses its script: it tells nothing
        return scores

    def label(self, texts: list[bytes], switch: float):
        """Yield (lang, score, spans) of each text; spans are (first byte, last byte + 1, lang)."""
        n = len(texts)
        if not self.langs:
            yield from [(UNKNOWN, 0.0, [])] * n
            return
        held = {"rows": [], "scores": [], "starts": [], "ends": [], "size": 0}

        def flush(last: int):
            nonlocal done
            rows = np.concatenate(held["rows"]) if held["rows"] else np.zeros(0, np.int64)
            counts = np.bincount(rows - done, minlength=last - done) if len(rows) else np.zeros(last - done, np.int64)
            scores = np.concatenate(held["scores"]) if held["scores"] else np.zeros((0, len(self.langs)))
            starts, ends = (np.concatenate(held[k]) if held[k] else np.zeros(0, np.int64) for k in ("starts", "ends"))
            labels = viterbi(scores, counts, switch)
            for text, (a, b) in zip(texts[done:last], zip(np.cumsum(counts) - counts, np.cumsum(counts))):
                yield self._result(text, labels[a:b], starts[a:b], ends[a:b])
            held.update(rows=[], scores=[], starts=[], ends=[], size=0)
            done = last

        done, at = 0, {}
        for rows, joined, offsets in joined_groups(texts):
            if held["size"] > 12 * PIECE and at.get("last") != rows[0]:  # never within a long text
                yield from flush(int(rows[0]))
            starts, ends, counts, *rest = features(joined, offsets)
            shift = np.repeat(offsets[:-1], counts)
            skipped = np.repeat([at.get("bytes", 0) if i == 0 and at.get("last") == rows[0] else 0 for i in range(len(rows))], counts)
            held["rows"].append(np.repeat(rows, counts))
            held["scores"].append(self.word_scores(*rest))
            held["starts"].append(starts - shift + skipped)
            held["ends"].append(ends - shift + skipped)
            held["size"] += len(joined)
            before = at.get("bytes", 0) if at.get("last") == rows[-1] and len(rows) == 1 else 0
            at = {"last": int(rows[-1]), "bytes": before + int(offsets[-1] - offsets[-2] - 1)}
        yield from flush(n)

    def _result(self, text: bytes, labels, starts, ends):
        if not len(labels) or not self.langs:
            return UNKNOWN, 0.0, []
        if not any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) and not any(c.isalpha() for c in text.decode()):
            return UNKNOWN, 0.0, []
        weight = np.bincount(labels, ends - starts, len(self.langs))
        top = int(weight.argmax())
        cut = np.flatnonzero(np.diff(labels)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]]) - 1
        spans = [(a, b, self.langs[k]) for a, b, k in zip(starts[first].tolist(), ends[last].tolist(), labels[first].tolist())]
        return self.langs[top], float(weight[top] / weight.sum()), spans


def learn(docs: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS, ids: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit the model on about ``sample_rows`` of the labelled training rows, chosen by a hash of ids and texts.
    More than MAX_LANGUAGES labels are an error, since each takes 2^BITS numbers wherever the model goes.

    Features are counted where the rows are and summed by Spark; the driver gets at most 2^BITS numbers a language.
    """
    rows = docs.select(docs[ids].alias("id"), docs[text].alias("text"), docs[lang].cast("string").alias("lang")).filter(F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total, named = rows.agg(F.count("*"), F.count_distinct("lang")).first()
    if named > MAX_LANGUAGES:
        raise ValueError(f"{named} languages; at most {MAX_LANGUAGES} can be told apart")
    if total > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for name in sorted(set(langs)):
                own = [t for t, k in zip(texts, langs) if k == name]
                table, bits = found.setdefault(name, np.zeros(1 << BITS, np.int64)), scripts.setdefault(name, np.zeros(len(SCRIPTS) + 1, np.int64))
                for _, joined, offsets in joined_groups(own):
                    *_, words, one, two, _ = features(joined, offsets)
                    table += np.bincount(one, minlength=1 << BITS) + np.bincount(two, minlength=1 << BITS)
                    bits += [np.count_nonzero(words >> np.uint32(b) & np.uint32(1)) for b in range(len(SCRIPTS))] + [len(words)]
        for name, table in found.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + len(SCRIPTS) + 1)), pa.array(np.concatenate([some, -1 - np.arange(len(SCRIPTS) + 1)])), pa.array(np.concatenate([table[some], scripts[name]]))], names=["lang", "bucket", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = np.array(counts["lang"].to_pylist(), object), counts["bucket"].to_numpy(), counts["n"].to_numpy()
    langs = sorted(set(names.tolist()))
    table, scripts = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros(len(langs), np.uint32)
    used = max(1, len(np.unique(bucket[bucket >= 0])))
    for j, name in enumerate(langs):
        own = names == name
        hits = np.zeros(1 << BITS)
        hits[bucket[own & (bucket >= 0)]] = n[own & (bucket >= 0)]
        table[:, j] = np.log((hits + 0.5) / (hits.sum() + 0.5 * used))
        words = n[own & (bucket == -1 - len(SCRIPTS))].sum()
        for b in range(len(SCRIPTS)):
            if n[own & (bucket == -1 - b)].sum() >= 0.01 * max(words, 1):
                scripts[j] |= np.uint32(1 << b)
    return Model(langs, table, scripts)


SCHEMA = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, ids: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Label the languages of whole texts.

    Returns one row per input row: the id, the columns of ``keep``, lang_pred (the language with most bytes of words),
    score (its share of them, 0 to 1) and spans (byte ranges of one language each).

    A word is a run of letters. Its scripts narrow the languages (one that was not learnt in a word's script loses a fixed
    number of nats, so that a text wholly in an unknown script still gets the nearest one), byte n-grams score it, and
    the best sequence of labels under ``switch`` nats for each change is found by Viterbi, which holds the words of one
    text at a time. One pass without a shuffle; the model is 2^BITS numbers for each language. Null texts, texts without a letter, and all texts of a model without languages get `und` and 0;
    ties go to the first language by name; null ids and repeated rows are rows as any; other columns are ignored.
    """
    kinds = dict(docs.select(ids, *keep).dtypes)
    body, n_kept = text if text in keep and dict(docs.dtypes)[text] == "string" else "__text", 1 + len(keep)  # once only
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in small(batches, body):
            found = list(shared.value.label(texts_of(batch, body), switch))
            spans = pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in x[2]] for x in found], spans_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=[ids, *keep, "lang_pred", "score", "spans"])

    wanted = docs.select(ids, *keep, *([] if body == text else [docs[text].alias(body)]))
    return wanted.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", " + SCHEMA)
