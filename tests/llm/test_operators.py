"""Each operator against brute force, and on null, empty, long, tied, repeated and clashing rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fingerprint string, block long, chance double, kind int, word string"


def words_of(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    """Odd rows: nulls everywhere, empty and long texts, repeats, equal texts, texts without letters."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéßж") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120)
    out = [(i, say(rng.randint(1, 60)), rng.choice(["aa", "bb"]), rng.choice(["s1", "s2", "s3"])) for i in range(40)]
    near = base.split()
    near[60] = "changed"
    out += [(100, base, "aa", "s1"), (101, base, "aa", "s2"), (102, " ".join(near), "bb", "s3"), (103, base.encode().upper().decode(), "aa", "s1")]
    out += [(200, None, None, None), (201, "", "aa", "s1"), (202, "   \n\t ", "bb", None), (203, "123 --- 456", None, "s2"), (204, "one", "aa", "s2")]
    out += [(205, "x" * 5_000_000, "aa", "s3"), (206, say(400_000), "bb", "s1"), (None, say(20), "aa", "s1"), (None, None, None, None), (7, out[7][1], out[7][2], out[7][3])]
    out += [(300, "under the MIT license, then Apache License, Version 2.0 and CC BY-NC 4.0; GNU General Public License version 3", "aa", "s1"), (301, "under the mit licenses", "aa", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, -1.0, "x", -5, 9.0, 3, "w") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_url_host_and_path(spark):
    from millrace.llm.url_reputation import judge_urls

    urls = ["http://A.Example.COM/en/x?y", "https://net/es/", "no scheme", None, "", "ftp://h", "x://Y?q/z", "http://www.example.com/en/", "http://example.com/enx", "http://a.b://c/d#e", "http://xnet/es/"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1), (None, urls[1], None, None)], "page_id long, url string, host string, bad int")
    outcomes = spark.createDataFrame([(0, True), (0, False), (None, True)], "id long, bad boolean")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    got = judge_urls(pages, outcomes, rules).collect()
    assert len(got) == len(urls) + 2
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by[1] == ("net", "/es/", "net/es/", "block")
    assert by[2][:3] == by[3][:3] == by[4][:3] == ("", "", None)
    assert by[5][:2] == ("h", "") and by[6][:2] == ("y", "")
    assert by[7][2:] == ("www.example.com/en/", "allow") and by[8][2] == "com/"
    assert by[9][:2] == ("a.b:", "//c/d") and by[10][2] is None
    assert judge_urls(pages.filter("false"), outcomes, rules).count() == 0
    none = judge_urls(pages, outcomes.filter("false"), rules)
    assert none.filter("bad_rate <> 0.5").count() == 0 and none.filter("rule is null and verdict <> 'allow'").count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    from millrace.llm.url_reputation import host_reputation

    counts = spark.createDataFrame([("bad.x.org", 200, 190), ("good.x.org", 500, 5), ("new.x.org", 1, 1), ("a.y.org", 300, 3), ("b.y.org", 0, 0)], "host string, n long, bad long")
    got = {r.host: r for r in host_reputation(counts).collect()}
    assert got["bad.x.org"].bad_bound > 0.8 and got["good.x.org"].bad_bound < 0.05
    assert got["new.x.org"].bad_rate < 1 and got["b.y.org"].bad_rate < got["new.x.org"].bad_rate


def test_planted_bad_host_is_blocked(spark):
    from millrace.llm.url_reputation import judge_urls

    urls = [(i, f"http://{('bad.shop', 'a.good', 'b.good')[i % 3]}.co.uk/x") for i in range(300)] + [(1000 + i, f"http://h{i}.other.org:8080/") for i in range(40)]
    pages = spark.createDataFrame([*urls, (2000, "http://new.shop.co.uk/"), (2001, "http://10.0.0.7/"), (2002, "http://b.good.co.uk/ok/1")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 3 == 0 and i % 10 != 0) for i in range(300)] + [(1000 + i, i == 7) for i in range(40)], "id long, bad boolean")
    for broadcast in (10, 0):
        got = {r.page_id: r for r in judge_urls(pages, outcomes, [("block", "good.co.uk/ok/")], broadcast_hosts=broadcast).collect()}
        assert {got[i].verdict for i in range(0, 300, 3)} == {"block"} and {got[i].verdict for i in range(1, 300) if i % 3} == {"allow"}
        assert {got[1000 + i].verdict for i in range(40)} == {"allow"} and got[2002].verdict == "block"
        assert got[2000].bad_rate > got[2001].bad_rate  # an unseen host takes after its domain


def test_registered_domains(spark):
    from millrace.llm.url_reputation import bare_host, domain_of, suffix_of

    hosts = ["a.b.co.uk", "co.uk", "www.x.org", "x.org:80", "me@w.x.com", "10.1.2.3:99", "localhost", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain_of(bare_host(F.col("h"))).alias("d")).select("d", suffix_of(F.col("d")))
    assert [tuple(r) for r in frame.collect()] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.org", "org"), ("x.org", "org"), ("x.com", "com"), ("10.1.2.3", "10.1.2.3"), ("localhost", "localhost"), ("", "")]


def test_reply_trees(spark):
    from millrace.llm.reply_trees import escape, format_trees, linear, read_back, read_turns, unescape

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("<|\\im_end>\n ") for _ in range(20))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    tree = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "<|im_end|>", 5.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 2, "user", "x", 0.5), ("t", 5, 2, "user", "x", 0.5), ("u", 1, 2, "user", "loop", 0.0), ("u", 2, 1, "user", "loop", 0.0), ("u", 3, 9, "us\ner\\", "alone", None), (None, 1, None, None, "n", 0.0), ("t", None, 1, "user", "lost", 0.0)]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in tree], "tree_id string, node_id long, parent_id long, role string, text string, score double, rank string, leaf double")
    got = {(r.tree_id, r.branch_rank): read_turns(r.formatted) for r in format_trees(frame, top=None, score="score").collect()}
    assert got == {("t", 1): [("user", "hi"), ("assistant", "<|im_end|>"), ("user", "")], ("t", 2): [("user", "hi"), ("assistant", "low"), ("user", "x")], ("u", 1): [("us\ner\\", "alone")], (None, 1): [("", "n")]}
    assert format_trees(frame.filter("false")).count() == 0
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i} <|x") for i in range(700)] + [(1, None, None, None)], "conv_id long, turn long, role string, text string")
    row = read_back(format_trees(linear(long))).first()
    said = [("", "")] + [("assistant" if i % 2 else "user", f"t{i} <|x") for i in range(700)]
    learnt = "".join(t for r, t in said if r == "assistant")
    assert row.n_turns == 701 and row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_branches_match_brute_force(spark):
    from millrace.llm.reply_trees import format_trees, left_out, read_turns

    rng = random.Random(12)
    given = []
    for t in range(6):
        for i in range(rng.choice([1, 2, 30, 60])):
            given.append((t, i, rng.randrange(i) if i and rng.random() < 0.95 else None, "user", f"{t}-{i}", rng.randint(-3, 3) / 2))
    given += [(0, 1000, 1001, "user", "loop", 0.0), (0, 1001, 1000, "user", "loop", 0.0), (0, 1002, 1001, "user", "below", 0.0), (1, None, 0, "user", "lost", 0.0), (1, 0, None, "user", "1-0", -9.0), (1, 0, None, "user", "1-0", -9.0)]
    nodes = {}
    for t, i, up, _, text, score in given:
        if i is not None and i < 1000:
            nodes[t, i] = min(nodes.get((t, i), (up, text, score)), (up, text, score), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    parents, want = {(t, up) for (t, _), (up, _, _) in nodes.items() if up is not None}, collections.defaultdict(list)
    for t, i in nodes:
        if (t, i) not in parents:
            path, at = [], i
            while at is not None:
                path.append(at)
                at = nodes[t, at][0]
            want[t].append((-sum(nodes[t, x][2] for x in path) / len(path), i, [("user", nodes[t, x][1]) for x in reversed(path)]))
    frame = spark.createDataFrame(given, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    every = {(r.tree_id, r.branch_rank): read_turns(r.formatted) for r in format_trees(frame, top=None, score="score").collect()}
    assert every == {(t, k + 1): turns for t, own in want.items() for k, (_, _, turns) in enumerate(sorted(own))}
    first = {(r.tree_id, r.branch_rank) for r in format_trees(frame, top=2, score="score").collect()}
    assert first == {k for k in every if k[1] <= 2}
    lost = collections.Counter()
    for r in left_out(frame).collect():
        lost[r.reason] += r.n
    assert lost == {"cycle": 3, "no node": 1, "repeated": 2}


def test_mixing(spark, docs, rows, none):
    from millrace.llm.mixing import mix_sources, round_chances

    got = mix_sources(docs, [3, 1, 2], block=8).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sorted(r.size for r in got) == sorted(len(words_of(r[1])) for r in rows)
    again = mix_sources(docs.repartition(7), [3, 1, 2], block=8)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert mix_sources(none, [1]).count() == 0
    # expectations stay, and the mass is kept but for one unit
    rng = np.random.default_rng(0)
    chance, size = [0.3] * 40, sorted(rng.integers(1, 50, 40).tolist(), reverse=True)
    mean = np.zeros(40)
    for _ in range(3000):
        out = round_chances(list(chance), size, rng.random(40).tolist())
        assert sum(0 < p < 1 for p in out) <= 1 and abs(np.dot(out, size) - 0.3 * sum(size)) < 1e-6
        mean += out
    assert np.abs(mean / 3000 - 0.3).max() < 0.05


def test_ppm(docs, rows, none):
    from millrace.llm.ppm import Ppm, score_corpus

    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    some = docs.filter("doc_id is null or doc_id not in (205, 206)")
    both = [score_corpus(some, train, order=3), score_corpus(some, train, order=3, broadcast_rows=0, block_bytes=900)]
    model, counts, texts, given = Ppm(3), collections.Counter(), 0, [r for r in rows if r[0] not in (205, 206)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, text, *_ in given:
        if not held(i):
            model.learn((text or "").encode())
            counts.update(words_of(text))
            texts += 1
    total = sum(counts.values()) + texts
    mass = total + 0.5 * (len(counts) + 2)
    want = sorted((str(i), held(i), len(words_of(t)) + 1, sum(w in counts for w in words_of(t)) + 1, total, round(sum(math.log10((counts[w] + 0.5) / mass) for w in words_of(t)) + math.log10((texts + 0.5) / mass), 3), round(model.code((t or "").encode()), 3)) for i, t, *_ in given)
    for scored in both:
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 3)) for r in scored.collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=0.002)
    assert score_corpus(none, train).count() == 0
    alone = score_corpus(some.limit(3), F.lit(False)).collect()
    assert all(math.isclose(r.base_score, r.n_tokens * math.log10(0.5 / 0.5), abs_tol=1e-9) for r in alone)
    adaptive = Ppm(3)
    assert adaptive.code(b"abababababab" * 9, learn=True) > -80


def test_ppm_scores_alike_by_broadcast_and_blocks(spark):
    from millrace.llm.ppm import score_corpus

    rng = random.Random(6)
    given = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"])[: rng.randint(1, 5)] for _ in range(40))) for i in range(30)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    both = [sorted((r.doc_id, r.base_score, r.score) for r in score_corpus(frame, F.col("doc_id") % 3 != 1, order=3, **more).collect()) for more in ({}, {"broadcast_rows": 0, "block_bytes": 900})]
    assert both[0] == both[1]


def test_ppm_long_texts_in_pieces(monkeypatch):
    from millrace.llm import _text, ppm

    texts = [b"", b"abc def " * 50, "é ß".encode() * 40, b"x"]
    whole = [(f, la, k.tolist(), c.tolist()) for f, la, k, c in ppm.symbol_keys(texts, 4)]
    monkeypatch.setattr(ppm, "PIECE", 37)
    parts = collections.defaultdict(list)
    for one in texts:
        for _, _, keys, _ in ppm.symbol_keys([one], 4):
            parts[one] += keys.tolist()
    assert [k for t in texts for k in parts[t]] == whole[0][2]
    hashes = [h.tolist() for h in _text.of_each(texts)]
    monkeypatch.setattr(_text, "PIECE", 24)
    assert [h.tolist() for h in _text.of_each(texts)] == hashes


def test_language_id(spark, docs, rows, none):
    from millrace.llm import langid

    rng = random.Random(5)
    tongue = {"xx": "abcd", "yy": "efgh", "ru": "абвг"}
    say = lambda k, n: " ".join("".join(rng.choice(tongue[k]) for _ in range(4)) for _ in range(n))
    given = [(i, say(k, 30), k) for i, k in enumerate(list(tongue) * 20)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string")
    model = langid.learn(frame, F.col("id") % 4 != 2)
    assert model.langs == ["ru", "xx", "yy"] and len(set(model.scripts.tolist())) == 2
    found = langid.identify(frame, model, keep=["lang", "text"]).collect()
    assert all(r.lang == r.lang_pred and r.score == 1 for r in found)
    mixed = say("xx", 20) + ". " + say("yy", 30) + " " + say("ru", 10)
    row = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["xx", "yy", "ru"] and row.lang_pred == "yy"
    assert mixed.encode()[row.spans[2].start : row.spans[2].end].decode() == mixed.split(" ", 50)[50]
    odd = langid.identify(docs, model).collect()
    assert len(odd) == len(rows) and {r.doc_id for r in odd if r.lang_pred == "und"} == {200, 201, 202, 203, None}
    assert langid.identify(none, model).count() == 0
    empty = langid.learn(none, F.lit(True))
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.identify(docs, empty).collect())


def test_viterbi_is_the_best_path():
    from millrace.llm.langid import viterbi

    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(size=(counts.sum(), 3)) * 3
        got, at = viterbi(scores, counts, 2.0), 0
        for n in counts.tolist():
            if n:
                value = lambda p: sum(scores[at + i, p[i]] for i in range(n)) - 2.0 * sum(p[i] != p[i - 1] for i in range(1, n))  # noqa: B023, E731
                assert math.isclose(value(got[at : at + n]), max(value(p) for p in itertools.product(range(3), repeat=n)))
            at += n


def test_language_id_long_texts_in_pieces(monkeypatch, spark):
    from millrace.llm import langid

    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.array([1, 1], np.uint32))
    texts = [b"abc de f " * 30, b"", b"one", b"gh ij klm " * 40, b"z"]
    whole = list(model.label(texts, 1.0))
    monkeypatch.setattr(langid, "PIECE", 50)
    monkeypatch.setattr(langid.joined_groups, "__defaults__", (50,))
    monkeypatch.setattr(langid.pieces, "__defaults__", (50,))
    assert list(model.label(texts, 1.0)) == whole


def test_kmeans_tree(spark):
    from millrace.llm.kmeans_tree import nearest

    rng = np.random.default_rng(0)
    points = rng.normal(size=(400, 8)).astype(np.float32)
    points[50:120] = points[50]
    given = [(i, p.tolist(), 1, 2.0) for i, p in enumerate(points)] + [(1000, None, 1, 2.0), (1001, [0.0] * 8, 1, 2.0), (1002, [float("nan")] * 8, 1, 2.0), (1003, [1.0], 1, 2.0), (None, [1.0] * 8, 1, 2.0), (1004, [None] * 8, 1, 2.0), (1100, [float("inf")] * 8, 1, 2.0)]
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>, rank int, leaf double")
    got = collections.defaultdict(list)
    for r in nearest(frame, frame.filter("vec_id % 10 = 0"), sample_rows=300, block=50).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 10))
    hits, exact = 0, points.astype(float)
    for q, found in got.items():
        found.sort()
        far = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(400), far)) if i != q][:10]
        assert [r for r, *_ in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(math.isclose(s, far[i], abs_tol=1e-12) for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits / (10 * len(got)) >= 0.9 and [i for _, i, _ in got[60]] == [*range(50, 60)]
    assert nearest(frame.filter("false"), frame.filter("false")).count() == 0
    few = frame.filter("vec_id < 4")
    assert nearest(few, few.filter("vec_id = 0")).count() == 3


def brute_classes(texts, threshold=0.8):
    """The first of each text's class, by all pairs of texts in plain Python."""
    counts = []
    for text in texts:
        words = words_of(text)
        width = min(5, len(words))
        counts.append(collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else {})
    n, held = len(texts), collections.Counter(x for own in counts for x in own)
    idf = {x: 1 + 0.5 * min(1, math.log((n + 1) / (f + 1)) / math.log(100)) for x, f in held.items()}
    total = [sum(k * idf[x] for x, k in own.items()) for own in counts]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        common = sum(min(k, counts[b][x]) * idf[x] for x, k in counts[a].items() if x in counts[b])
        if common and common >= threshold * (total[a] + total[b] - common):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def classes_of(frame, **sizes):
    from millrace.llm.near_dedup import duplicate_classes

    return {r.doc_id: r.class_id for r in duplicate_classes(frame, **sizes).collect()}


def test_near_dedup(spark, docs, rows, none):
    from millrace.llm.near_dedup import duplicate_classes

    got = classes_of(docs)
    assert got[101] == got[102] == got[103] == got[100] == 100 and got[7] == 7 and got[None] is None
    assert all(got[i] == i for i in (200, 201, 202, 203, 205, 206, 300))
    assert duplicate_classes(docs).count() == len(rows) and duplicate_classes(none).count() == 0
    # a large group whose members resemble their source more than each other
    rng = random.Random(2)
    source, texts = [f"w{i}" for i in range(400)], []
    for _ in range(90):
        words = list(source)
        for at in rng.sample(range(400), 6):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.random()}" for _ in range(50)) for _ in range(30)] + [" ".join(source)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    assert len(set(want)) == 31
    for small, broadcast in ((8, 10**6), (1000, 0)):
        found = classes_of(frame, small=small, broadcast_ids=broadcast)
        assert want == [found[i] for i in range(len(texts))]


def template_family():
    """Texts on one template, no two of them links, then near copies of some: all meet in the same buckets."""
    rng = random.Random(11)
    template, texts = [f"t{i}" for i in range(240)], []
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    for _ in range(260):
        texts.append(template + own(44))
    for i in range(80):
        words = list(texts[i])
        words[240:258] = own(18)
        texts.append(words)
    return [" ".join(w) for w in texts]


def test_near_dedup_pairs_within_a_template_family(spark):
    texts = template_family()
    want = brute_classes(texts)
    assert all(want[260 + i] == i for i in range(80)) and len(set(want)) == 260
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (16, 256):
        found = classes_of(frame, small=4, block=block)
        assert want == [found[i] for i in range(len(texts))]


def test_near_dedup_by_blocks_of_a_large_label(spark):
    """Most of a family are copies of one text, so that they fill blocks of their own; the rest stand apart."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for i in range(120):
        words = list(template)
        words[rng.randrange(300)] = f"c{i}"
        texts.append(words)
    for i in range(40):
        words = list(template)
        words[:90] = [f"z{i // 2}-{j}" for j in range(90)]
        words[200 + i] = f"e{i}"
        texts.append(words)
    texts = [" ".join(w) for w in texts]
    want = brute_classes(texts)
    assert len(set(want)) == 21
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert want == [x[1] for x in sorted(classes_of(frame, small=2, block=16).items())]


def test_blocks_find_what_pairs_find():
    from millrace.llm.near_dedup import BUCKETS, block_links, similarity

    rng = np.random.default_rng(4)
    table = (1 + 0.5 * rng.random(1 << BUCKETS)).astype(np.float32)
    for _ in range(40):
        keys = np.sort(rng.integers(0, 2**62, 60).astype(np.uint64) * np.uint64(4))
        sets = []
        for _ in range(14):
            some = np.sort(keys[rng.random(len(keys)) < 0.93])
            sets.append((some, rng.choice([1, 1, 1, 2, 3], len(some)).astype(float)))
        for a, b in ((sets, None), (sets[:6], sets[6:])):
            other = a if b is None else b
            far = np.arange(len(other)) + (0 if b is None else 100)
            skip = np.tri(len(a), dtype=bool) if b is None else np.zeros((len(a), len(other)), bool)
            links = block_links(a, b, np.arange(len(a)), far, skip, table, 0.8)
            every = [(i, j) for i in range(len(a)) for j in range(len(other)) if not skip[i, j] and similarity(a[i], other[j], table) >= 0.8]
            assert set(links) <= set(every)

            def joined(pairs):
                parent = {x: x for x in [*range(len(a)), *far.tolist()]}

                def find(x):
                    while parent[x] != x:
                        x = parent[x]
                    return x

                for i, j in pairs:
                    x, y = find(i), find(int(far[j]))
                    parent[max(x, y)] = min(x, y)
                return {x: find(x) for x in parent}

            assert joined(links) == joined(every)


def test_near_dedup_null_and_repeated_ids(spark):
    from millrace.llm.near_dedup import duplicate_classes, duplicate_nodes, keep_one

    words = [f"w{i}" for i in range(200)]
    base, one, two, far = (" ".join(w) for w in (words, [*words[:-1], "x"], ["y", *words[1:]], [f"f{i}" for i in range(30)]))
    given = [(1, base), (None, one), (None, two), (None, far), (None, far.upper()), (5, far + " more"), (6, base), (6, "quite another text of its own words"), (6, base), (None, ""), (8, None)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id) for r in duplicate_classes(frame).collect())
    assert got == {(1, 1): 1, (None, 1): 2, (None, 5): 2, (5, 5): 1, (6, 1): 2, (6, 6): 1, (None, None): 1, (8, 8): 1}
    alone = spark.createDataFrame([(None, one), (None, two), (None, base), (None, far)], "doc_id long, text string")
    assert len({r.label for r in duplicate_nodes(alone).collect()}) == 2
    assert sorted(r.text for r in keep_one(alone).collect())[0] == far and keep_one(alone).count() == 2
    left = collections.Counter((r.doc_id, r.text) for r in keep_one(frame).collect())
    assert left == {(1, base): 1, (5, far + " more"): 1, (6, "quite another text of its own words"): 1, (None, ""): 1, (8, None): 1}


def test_consistent_samples_estimate_weighted_similarity():
    from millrace.llm.near_dedup import consistent_samples

    rng = np.random.default_rng(0)
    keys = rng.integers(1, 2**63, 2000).astype(np.uint64)
    for size in (3, 40, 1500):
        weight = lambda k: 1 + (k % np.uint64(3)).astype(float)
        agree, wanted = [], []
        for s in range(0, 60, 3):
            a, b = (np.sort(x + np.uint64(s)) for x in (keys[:size], np.concatenate([keys[: size * 4 // 5], keys[-(size - size * 4 // 5) :]])))
            both = np.intersect1d(a, b)
            wanted.append(weight(both).sum() / (weight(a).sum() + weight(b).sum() - weight(both).sum()))
            x, y = consistent_samples(np.concatenate([a, b]), np.concatenate([weight(a), weight(b)]), np.array([len(a), len(b)]))
            alone = consistent_samples(a, weight(a), np.array([len(a)]))[0]
            assert (x == alone).all()
            agree.append(np.mean(x == y))
        assert abs(np.mean(agree) - np.mean(wanted)) < 0.06


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    from millrace.llm.packing import pack_documents
    from millrace.llm.queries import tokenizer_path

    got = pack_documents(docs, tokenizer_path(), pool=20_000).collect()
    tokenizer, by_doc = Tokenizer.from_file(tokenizer_path()), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text, *_ in rows:
        if i not in (None, 7, 205, 206):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            own = sorted(by_doc[i], key=lambda r: r.start)
            assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes() and own[0].doc_tokens == len(ids)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length, r.window))
    for own in windows.values():
        own.sort()
        assert [o for o, _, _ in own] == [0, *itertools.accumulate(n for _, n, _ in own)][:-1]
        assert sum(n for _, n, _ in own) == own[0][2] and own[0][2] & (own[0][2] - 1) == 0 and own[0][2] <= 4096
    assert pack_documents(none, tokenizer_path()).count() == 0


def test_word_tokens_match_the_tokenizer():
    from tokenizers import Tokenizer

    from millrace.llm.packing import WordTokens
    from millrace.llm.queries import tokenizer_path

    tokenizer, words = Tokenizer.from_file(tokenizer_path()), WordTokens(tokenizer_path())
    texts = ["It's A test_1, don't²½!", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É e\u0301 ﬁ ΣΑΣ İ ж\u00a0x\u2028y", "", " \t\n", "a\u0000b \x1c c", "日本 한국", "x" * 300]
    assert [x.tolist() for x in words.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    words.BITS = 4
    words.reset()
    many = " ".join(f"w{i}" for i in range(9))
    for _ in range(3):
        assert [x.tolist() for x in words.encode([many.encode()])] == [tokenizer.encode(many, add_special_tokens=False).ids]
        assert [x.tolist() for x in words.encode([b"q r s t u"])] == [tokenizer.encode("q r s t u", add_special_tokens=False).ids]


def test_fingerprints(spark, docs, rows, none):
    from millrace.llm import fingerprints as fp

    given = sorted(((i, t or "") for i, t, *_ in rows if i is not None and i != 7), key=lambda x: x[0])
    frame = docs.filter("doc_id is not null and doc_id <> 7")
    got = {r.doc_id: r for r in fp.edited_neighbours(frame).collect()}
    assert len(got) == len(given)
    for (i, text), (_, after) in zip(given, given[1:] + given[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        want = fp.fingerprint_texts([text.encode(), edited.encode(), after.encode()])
        assert got[i].fingerprint == fp.encode(want[0]) and got[i].edited_fingerprint == fp.encode(want[1])
        assert math.isclose(got[i].near_edited, fp.resemblance(want[0], want[1])) and math.isclose(got[i].near_next, fp.resemblance(want[0], want[2]))
    assert fp.edited_neighbours(docs).count() == len(rows) and fp.edited_neighbours(none).count() == 0
    assert fp.edited_neighbours(docs.filter("doc_id = 100")).first().near_next == 1
    assert fp.fingerprint(docs).count() == len(rows)


def test_fingerprint_ranges(spark):
    from millrace.llm import fingerprints as fp

    given = [(i * 3 % 1009, f"text {i} " * 9) for i in range(1009)]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = fp.neighbours(frame, rows_per_range=50).filter("ahead").collect()
    assert len(got) > 10
    texts = dict(given)
    by = {r.range: r for r in got}
    rows = fp.neighbours(frame, rows_per_range=50).filter("not ahead").groupBy("range").agg(F.max("id").alias("m")).collect()
    for r in rows:
        assert by[r.range].id == (r.m + 1) % 1009 and by[r.range].text == texts[by[r.range].id]
    # one id, or none, for most rows: split by their texts, in an order that any partitioning gives
    hot = [(5 if i % 2 else None, f"text {i} " * 9) for i in range(400)] + [(7, "last " * 9)]
    for n in (1, 6):
        frame = spark.createDataFrame(hot, "doc_id long, text string").repartition(n)
        got = fp.neighbours(frame, rows_per_range=50)
        sizes = [r["count"] for r in got.filter("not ahead").groupBy("range").count().collect()]
        assert sum(sizes) == len(hot) and max(sizes) <= 60 and got.filter("ahead").count() == len(sizes)
        found = sorted((r.doc_id or 0, r.fingerprint, r.edited_fingerprint, r.near_next) for r in fp.edited_neighbours(frame).collect())
        assert n == 1 or found == before
        before = found


def test_sketches_merge_and_estimate(spark):
    from millrace.llm import fingerprints as fp

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) for _ in range(2))
    b[:2000] = a[:2000]
    x, y = fp.sketch(a), fp.sketch(b)
    assert fp.merge(x, y).tolist() == fp.sketch(np.concatenate([a, b])).tolist()
    assert abs(fp.resemblance(x, y) - 1 / 3) < 0.2 and abs(fp.containment(x, y) - 0.5) < 0.25 and abs(fp.distinct(x) - 4000) < 1500
    assert fp.decode(fp.encode(x)).tolist() == x.tolist()
    parts = spark.createDataFrame([("g", fp.encode(x)), ("g", fp.encode(y)), ("e", "")], "k string, fingerprint string")
    got = {r.k: r.fingerprint for r in fp.merge_fingerprints(parts, ["k"]).collect()}
    assert got == {"g": fp.encode(fp.merge(x, y)), "e": ""}


def test_license_scan(docs, rows, none):
    from millrace.llm.license_scan import BASE_PHRASES, scan_licenses

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = collections.Counter()
    for i, text, *_ in rows:
        words = pattern.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(at, label) for phrase, label in BASE_PHRASES for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        at = [p for p, _ in places] or [None]
        want[(i, len(words), len(places), at[0] if len(at) == 1 else min(at), at[0] if len(at) == 1 else max(at), ",".join(sorted({x for _, x in places})))] += 1
    got = scan_licenses(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    row = next(r for r in got if r.doc_id == 300)
    assert row.labels == "apache-2,apache-2.0,cc-by-nc,gpl-3.0,mit" and row.score == 1
    assert all({*r.base_labels.split(",")} - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(none).count() == 0


def a_match(items, rng):
    """A random text that a parsed pattern matches."""
    out = b""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out += bytes([value])
        elif name == "IN":
            kinds = {"CATEGORY_WORD": br"\w", "CATEGORY_DIGIT": br"\d", "CATEGORY_SPACE": br"\s"}
            fits = lambda c, x: c == x[1] if str(x[0]) == "LITERAL" else x[1][0] <= c <= x[1][1] if str(x[0]) == "RANGE" else re.match(kinds[str(x[1])], bytes([c]))
            negated = str(value[0][0]) == "NEGATE"
            out += bytes([rng.choice([c for c in b" \n\t#*-/_:,abcstxyz0123456789.+" if any(fits(c, x) for x in value[negated:]) != negated])])
        elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT"):
            out += b"".join(a_match(value[2], rng) for _ in range(rng.randint(value[0], min(int(value[1]), value[0] + 3))))
        elif name == "SUBPATTERN":
            out += a_match(value[3], rng)
        elif name == "BRANCH":
            out += a_match(rng.choice(value[1]), rng)
        elif name in ("ANY", "NOT_LITERAL"):
            out += b" "
        else:
            assert name == "AT"
    return out


def test_license_prefilter_changes_nothing():
    from re import _parser

    from millrace.llm.license_scan import Rules, suppress

    rules, rng = Rules(), random.Random(8)
    for _, _, pattern in rules.rules:
        tree, hits = _parser.parse(pattern.pattern), 0
        for _ in range(8):
            text = b"Some text. ".lower() + a_match(tree, rng) + b" and more"
            every = [(j, *m.span(), rules.rules[j][0], rules.rules[j][1]) for j in range(len(rules.rules)) for m in rules.rules[j][2].finditer(text)]
            assert rules.detect(text) == suppress(every)
            hits += bool(pattern.search(text))
        assert hits


def test_license_rules_read_long_gaps_once():
    from millrace.llm.license_scan import Rules

    rules, began = Rules(), time.monotonic()
    for literal in rules.by_literal:
        for gap in (b" ", b"(", b" \n# "):
            text = literal + gap * 100_000 + b"! "
            for _, _, pattern in rules.rules:
                if literal in pattern.pattern:
                    assert len([*pattern.finditer(text)]) < 2
    assert not rules.detect(b"copyright" + b" " * 5_000_000) and not rules.base_places(b"under" + b" " * 5_000_000 + b"the mit")
    assert time.monotonic() - began < 60
    assert [x[2] for x in rules.detect(b"copyright (c) 2020 a; copyright \xc2\xa9 2021; copyright 1999")] == ["copyright-notice"] * 3


def test_wrapped_license_notices(spark):
    from millrace.llm.license_scan import scan_licenses

    texts = ["GNU General\n# Public License, version 3", "Creative\nCommons Attribution", "the End-User License Agreement", "all  rights\n * reserved", "see https://gnu.org/licenses/gpl", "General words of public use"]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == ["gpl-3.0", "cc-by", "eula", "all-rights-reserved", "gpl", ""]


def test_suppression():
    from millrace.llm.license_scan import Rules, suppress

    assert suppress([(0, 5, 10, "a", 1.0), (1, 6, 8, "b", 1.0), (2, 0, 20, "c", 1.0), (3, 0, 30, "a", 1.0)]) == [(0, 20, "c", 1.0), (5, 10, "a", 1.0)]
    assert suppress([(0, 0, 9, "gpl-3.0", 1.0), (1, 5, 14, "gpl", 0.5), (2, 20, 25, "gpl", 0.5)]) == [(0, 9, "gpl-3.0", 1.0), (20, 25, "gpl", 0.5)]
    assert len(Rules().rules) >= 200


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "mixing", "packing"]
    table, names = docs.select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [table]
    for _, stage in pipeline.STAGES[:-1]:
        kept.append(pipeline.kept(stage(spark, kept[-1], ""), "stage"))
        assert kept[-1].columns == names
    ids = [collections.Counter(r.doc_id for r in t.select("doc_id").collect()) for t in kept]
    assert not {200, 201, 202, 203} & set(ids[1]) and {100, 101, 300, 7} <= set(ids[1])
    assert 100 in ids[2] and not {101, 102, 103} & set(ids[2]) and ids[2][7] == 1
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 2
    pieces = pipeline.STAGES[-1][1](spark, kept[-1], "").collect()
    assert {r.doc_id for r in pieces} == set(ids[3])
    for _, stage in pipeline.STAGES:
        assert stage(spark, table.filter("false"), "").count() == 0
