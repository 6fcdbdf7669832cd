"""Each registered query over a whole small table, against SQL, brute force or held-out truth."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return lambda q: c.execute(q).fetchall()


def run(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_matches_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        for t in ("pages", "labels"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        result = c.execute(entry.oracle_sql()["op1_url_reputation"])
        names = [x[0] for x in result.description]
        frame = entry.queries()["op1_url_reputation"](spark, sf)
        rounded = lambda r: repr([round(x, 5) if isinstance(x, float) else x for x in r])
        assert sorted(map(rounded, frame.select(*names).collect())) == sorted(map(rounded, result.fetchall()))


def test_op2_reads_back_every_conversation(spark, sql):
    turns = collections.defaultdict(list)
    for conv, _, role, text in sorted(sql("SELECT conv_id, turn, role, text FROM conversations"), key=lambda r: r[:2]):
        turns[conv].append((role, text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", said), ("assistant", said)]
    got = {r.conv_id: r for r in run(spark, "op2_reply_trees")}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        learnt = "".join(t for role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in own)
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[conv].formatted_chars > len(whole)


def test_op3_meets_targets(spark, sql):
    docs = sql("SELECT doc_id, text, source FROM documents")
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    own = collections.Counter()
    for i, s in source.items():
        own[s] += size[i]
    order = sorted(own, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(own.values())
    open_ = set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * own[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    got = {r.doc_id: r for r in run(spark, "op3_mixing")}
    taken = collections.Counter()
    assert len(got) == len(docs)
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], own[source[i]]) and math.isclose(r.target, target[source[i]]) and r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    longest = {s: max(size[i] for i in size if source[i] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order), [(taken[s], target[s], longest[s]) for s in order]
    again = {r.doc_id: r.taken for r in run(spark, "op3_mixing")}
    assert again == {i: r.taken for i, r in got.items()}


def test_op4_base_scores_and_gain(spark, sql):
    docs = {i: [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")] for i, t in sql("SELECT doc_id, text FROM documents")}
    size = {i: len((t or "").encode()) for i, t in sql("SELECT doc_id, text FROM documents")}
    counts = collections.Counter(w for i, ws in docs.items() if crc(i, 5) != 1 for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in run(spark, "op4_ppm")}
    assert set(got) == set(docs)
    held = []
    for i, ws in docs.items():
        r, tokens = got[i], [*ws, None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        held += [(r.score, size[i])] if r.held_out else []
    assert -sum(s for s, _ in held) * math.log2(10) < 4 * sum(n for _, n in held)  # bits a byte of unseen texts


def test_op5_held_out_accuracy(spark, sql):
    truth = {i: (t, lang) for i, t, lang in sql("SELECT doc_id, text, lang FROM documents")}
    got = run(spark, "op5_language_id")
    assert {r.doc_id for r in got} == set(truth)
    right = [r.lang_pred == truth[r.doc_id][1] for r in got if r.held_out and truth[r.doc_id][1] and any(c.isalpha() for c in truth[r.doc_id][0] or "")]
    assert len(right) > 20 and sum(right) / len(right) > 0.9
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)


def test_op6_recall(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        c = duckdb.connect()
        rows = [(i, v) for i, v in c.execute(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
        got = collections.defaultdict(list)
        for r in sorted(run(spark, "op6_kmeans_tree", sf), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
        hits = total = 0
        for q, found in got.items():
            far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:10]
            hits, total = hits + len({ids[j] for j in order} & {i for i, _ in found}), total + len(order)
            exact = dict(zip(ids.tolist(), far.tolist()))
            assert len(found) == len(order) and all(math.isclose(s, exact[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in found)
            assert found == sorted(found, key=lambda x: (x[1], x[0]))
        assert hits >= 0.93 * total, (sf, hits, total)


def test_op7_matches_brute_force(spark, sql):
    docs = sorted((i, t) for i, t in sql("SELECT doc_id, coalesce(text, '') FROM documents"))
    want = brute_classes([t for _, t in docs])
    got = {r.doc_id: r.class_id for r in run(spark, "op7_near_dedup")}
    assert got == {i: docs[j][0] for (i, _), j in zip(docs, want)}


def test_op8_round_trip(spark, sql):
    from tokenizers import Tokenizer

    from millrace.llm.queries import tokenizer_path

    tokenizer, pieces, sequences = Tokenizer.from_file(tokenizer_path()), collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op8_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    docs = sql("SELECT doc_id, coalesce(text, '') FROM documents")
    assert set(pieces) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padded = used = 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
        used, padded = used + end, padded + (end if end & (end - 1) == 0 else 4096)
    assert used >= 0.97 * padded


def test_op9_matches_brute_force(spark, sql):
    from millrace.llm import fingerprints as fp

    docs = sorted((i, t or "") for i, t in sql("SELECT doc_id, text FROM documents"))
    got = {r.doc_id: r for r in run(spark, "op9_fingerprints")}
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, other, following = fp.fingerprint_texts([text.encode(), edited.encode(), after.encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encode(own), fp.encode(other))
        assert math.isclose(r.near_edited, fp.resemblance(own, other)) and math.isclose(r.near_next, fp.resemblance(own, following))


def test_op10_base_places(spark, sql):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in run(spark, "op10_license_scan")}
    for i, text in sql("SELECT doc_id, text FROM documents"):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found = [(at, label) for phrase, label in phrases.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        r, at = got[i], sorted(x for x, _ in found)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), at[0] if at else None, at[-1] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1
