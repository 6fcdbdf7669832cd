"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._text import _hash_joined, groups, pieces, small, texts_of, word_bounds

#: Context sizes, longest first; all are powers of two.
TIERS = (4096, 2048, 1024, 512)
#: Tokens that are packed at once; what is left over is carried on.
POOL = 1 << 20
STEP_TOKENS = 1 << 15

_WORDS: dict[str, "WordTokens"] = {}
#: The pre-tokeniser's pattern of word_bpe_49k.json, a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Token ids of white-space separated words, looked up by 64-bit hash for whole batches at a time.

    Exact for a tokenizer whose tokens never cross white space and that drops it. A word's ids come from the tokenizer's
    own merges once per worker; the open-addressing table is emptied when it is full, which costs time, not results.
    """

    BITS = 21

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(_SPLIT)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(odd)}
        self.reset()

    def reset(self):
        size = 1 << self.BITS
        self.keys = np.zeros(size, np.uint64)
        self.start = np.zeros(size, np.int32)
        self.count = np.zeros(size, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.entries = 0
        self.parts: dict[str, list[int]] = {}

    def ids_of(self, word: bytes) -> list[int]:
        text = word.decode()
        if b"<|" in word or max(text) > "\xff":
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out = []
        for part in self.split.findall(text.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
                if len(self.parts) > 100_000:
                    self.parts.clear()
                self.parts[part] = ids
            out += ids
        return out

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or of the empty one where it would go."""
        last = np.uint64((1 << self.BITS) - 1)
        slot = hashes >> np.uint64(64 - self.BITS)
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & last
            seen = self.keys[slot[open_]]
            open_ = open_[(seen != hashes[open_]) & (seen != 0)]
        return slot

    def add(self, hashes: np.ndarray, words: list[bytes]):
        """Put distinct new words into the table: each takes the first free slot from its own on."""
        ids, counts = [], np.zeros(len(words), np.int32)
        for i, word in enumerate(words):
            own = self.ids_of(word)
            counts[i] = len(own)
            ids += own
        used = self.used + len(ids)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), used - len(self.flat)), np.uint32)])
        self.flat[self.used : used] = ids
        starts = (self.used + np.cumsum(counts) - counts).astype(np.int32)
        last, left = np.uint64((1 << self.BITS) - 1), np.arange(len(words))
        slot = hashes >> np.uint64(64 - self.BITS)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.start[slot[won]], self.count[slot[won]] = hashes[won], starts[won], counts[won]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + np.uint64(1)) & last
        self.used = used
        self.entries += len(words)

    def joined(self, joined: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts that lie end to end."""
        data = np.frombuffer(joined, np.uint8)
        hashes, per_text = _hash_joined(joined, offsets, False)
        hashes = np.maximum(hashes, np.uint64(1))
        slot = self.slots(hashes)
        missing = np.flatnonzero(self.keys[slot] != hashes)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.entries + len(new) > 0.7 * (1 << self.BITS) and self.entries:
                self.reset()
                if len(new) > 0.7 * (1 << self.BITS):
                    raise ValueError("too many words in one batch")
                return self.joined(joined, offsets)
            starts, ends, _ = word_bounds(data, offsets)
            at = missing[first]
            self.add(new, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slot[missing] = self.slots(hashes[missing])
        counts = self.count[slot].astype(np.int64)
        ends = np.cumsum(counts)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slot] - (ends - counts), counts)
        edges = np.concatenate([[0], np.cumsum(per_text)])
        totals = np.concatenate([[0], ends])[edges]
        return self.flat[index], np.diff(totals)

    def encode(self, texts: list[bytes]):
        """Ids of each text in turn."""
        for first, last in groups(texts):
            if last - first == 1:
                yield np.concatenate([self.joined(p, np.array([0, len(p)]))[0] for p in pieces(texts[first])])
                continue
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]])])
            ids, per_text = self.joined(b"".join(texts[first:last]), offsets)
            yield from np.split(ids, np.cumsum(per_text)[:-1])


class Packer:
    """Pack pieces of documents into windows of several sizes; every window is filled but for what is carried on.

    A document first fills windows of the longest size alone. What is left goes to the smallest tier that holds it. From
    the longest tier down, each window opens with one document of its tier; its gap is filled with the longest shorter
    documents that fit, and at last with the beginning of one that is cut there.
    """

    def __init__(self, tiers=TIERS, step_tokens=STEP_TOKENS, first_id: int = 0):
        self.tiers, self.step_tokens, self.next_id, self.next_step = sorted(tiers, reverse=True), step_tokens, first_id, first_id
        self.rest: list[tuple[int, int, int]] = []  # (length, start, document), ascending

    def _take(self, most: int) -> tuple[int, int, int] | None:
        i = bisect.bisect_right(self.rest, (most, 1 << 62, 1 << 62))
        return self.rest.pop(i - 1) if i else None

    def pack(self, docs: list[tuple[int, int]], final: bool) -> list[list]:
        """[sequence, offset, document, start, length, window, step] of the pieces; docs: (key, tokens)."""
        longest, windows = self.tiers[0], []
        for key, n in docs:
            whole = n // longest * longest
            windows += [(longest, [(longest, at, key)]) for at in range(0, whole, longest)]
            if n > whole:
                self.rest.append((n - whole, whole, key))
        self.rest.sort()
        for i, size in enumerate(self.tiers):
            shorter = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            while self.rest and self.rest[-1][0] > shorter:
                window, room = [], size
                while room and self.rest:
                    piece = self._take(room)
                    if piece is None:  # all are longer than the room: cut the shortest
                        n, start, key = self.rest.pop(0)
                        piece = (room, start, key)
                        bisect.insort(self.rest, (n - room, start + room, key))
                    window.append(piece)
                    room -= piece[0]
                if room:
                    # nothing is left to fill it
                    self.rest = sorted(window)
                    break
                windows.append((size, window))
            else:
                continue
            break
        if final:
            windows += self._last()
        return self._number(windows)

    def _last(self):
        """The last pieces as windows at powers of two, so that none needs padding."""
        left, self.rest = self.rest[::-1], []
        total = sum(x[0] for x in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            for _ in range(total >> bit & 1):
                window, room = [], 1 << bit
                while room:
                    n, start, key = left.pop(0)
                    part = min(n, room)
                    window.append((part, start, key))
                    if n > part:
                        left.insert(0, (n - part, start + part, key))
                    room -= part
                yield 1 << bit, window

    def _number(self, windows):
        """Step groups hold windows of one size and equal tokens; windows are dealt to them in turn by attention cost."""
        out, by_size = [], {}
        for size, window in windows:
            by_size.setdefault(size, []).append(window)
        for size, own in by_size.items():
            steps = max(1, -(-len(own) * size // self.step_tokens))
            own.sort(key=lambda w: -sum(p[0] ** 2 for p in w))
            for i, window in enumerate(own):
                lap, at = divmod(i, steps)
                step = self.next_step + (at if lap % 2 == 0 else steps - 1 - at)
                offset = 0
                for n, start, key in window:
                    out.append([self.next_id, offset, key, start, n, size, step])
                    offset += n
                self.next_id += 1
            self.next_step += steps
        return out


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_id long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers=TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of tokenised documents in sequences of several context sizes.

    Returns one row per piece: the id, start and length in its document's tokens, doc_tokens (with the end id),
    sequence_id, offset there, window (the sequence's size), step_id (a group of sequences of one size whose tokens are
    balanced) and ids (little-endian unsigned 32-bit).

    Map only: each partition packs its own rows, a pool of ``pool`` tokens at a time, carrying on what does not fill a
    window; the last rest of a partition, less than a window, goes to at most a dozen short windows at powers of two.
    Nothing is shuffled and nothing is padded; to pack those rests together would take a second pass over all tokens.
    sequence_id and step_id count from the number of the partition, so they depend on how the table is split.
    Null and empty texts are the end id alone; null ids and repeated rows are documents of their own; an empty table has
    no pieces; very long texts are tokenised in pieces; other columns are ignored.
    """
    kind = dict(docs.select(ids).dtypes)[ids]
    names = ["start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_id"]

    def run(batches):
        from pyspark import TaskContext

        words = _WORDS.setdefault(tokenizer, None) or WordTokens(tokenizer)
        _WORDS[tokenizer] = words
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
        held: dict[int, tuple] = {}  # key -> (id, ids)
        state = {"size": 0, "key": 0, "kind": None}

        def emit(new, final):
            rows = packer.pack(new, final)
            own = [held[r[2]] for r in rows]
            arrays = [pa.array([r[j] for r in rows], pa.int64()) for j in (3, 4)] + [pa.array([len(o[1]) for o in own], pa.int64())] + [pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1, 5, 6)]
            data = pa.array([o[1][r[3] : r[3] + r[4]].tobytes() for o, r in zip(own, rows)], pa.binary())
            left = {x[2] for x in packer.rest}
            batch = pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], state["kind"]), *arrays, data], names=[ids, *names, "ids"])
            for key in [k for k in held if k not in left]:
                del held[key]
            return batch

        new = []
        for batch in small(batches):
            state["kind"] = batch.schema.field(0).type
            for id_, tokens in zip(batch.column(0).to_pylist(), words.encode(texts_of(batch, "text"))):
                held[state["key"]] = (id_, np.append(tokens, np.uint32(end_id)).astype("<u4"))
                new.append((state["key"], len(tokens) + 1))
                state["key"] += 1
                state["size"] += len(tokens) + 1
                if state["size"] >= pool:
                    yield emit(new, False)
                    new, state["size"] = [], 0
        if new or packer.rest:
            yield emit(new, True)

    return docs.select(ids, docs[text].alias("text")).mapInArrow(run, f"`{ids}` {kind}, {SCHEMA}")
