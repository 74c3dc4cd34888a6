"""Quality, prefix trie and periodic runs against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
from factweave.llm import periodic, prefix_trie, quality, queries
from pyspark.sql import functions as F


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(2)
    words = ["tree", "house", "river", "stone", "of", "and"]
    good = lambda: " ".join(rng.choice(words) for _ in range(30)) + "."
    bad = lambda: "!! ".join(rng.choice(words).upper() for _ in range(30)) if rng.random() < 0.5 else " ".join([rng.choice(words)] * 30)
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "tree house " * 300_000), (None, "tree"), (7, "other text"), (7, "other text")]
    docs = spark.createDataFrame(rows + extra, "doc_id LONG, text STRING").withColumns({c: F.lit("x") for c in ("score", "y", "found", "id")})
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None), (6, 7), (8, 0), (8, 0)], "doc_id LONG, quality INT")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and quality.score(docs, model).columns == docs.columns
    assert sum((score[i] >= 0.5) == (i % 4 != 0) for i in range(300, 400)) >= 97
    assert score[1000] == score[1001] == score[1002] and score[1003] > 0.5
    assert np.array_equal(model.weights, quality.fit(docs.repartition(3), labels.repartition(5)).weights)
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()] == [0.5] * len(got)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert len(set(quality.fit(docs, labels.filter("quality = 1")).weights)) > 1


def test_quality_features_do_not_depend_on_the_slice(monkeypatch):
    text = "A b b, c!! " * 50
    at, values = quality.features(text)
    monkeypatch.setattr(quality, "SLICE", 7)
    again, same = quality.features(text)
    assert np.array_equal(at, again) and np.allclose(values, same) and at[-1] == quality.BUCKETS - 1


def test_leader_is_sparse():
    z, n = np.array([0.05, -0.05, 2.0, -2.0]), np.ones(4)
    w = quality.leader(z, n)
    assert (w[:2] == 0).all() and w[2] < 0 < w[3]


def nodes_of(rows):
    """The trie of (conv_id, turn, role, text) rows by plain loops."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, s in sorted(built.items()):
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k], digest(k)) for k, m in members.items())


def trie_of(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumns({c: F.lit("x") for c in ("pos", "n", "len", "k1")}).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect())


def test_prefix_trie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "PAGE", 8)
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, "", ""), (-7, 1, "user", "é" * 9), (-7, 1, "user", "é" * 9), (-5, 2, "a", "b")]
    for c in range(70):
        for t in range(rng.choice((1, 2, 5, 9, 12))):
            rows.append((c, t, rng.choice(("user", "bot")), rng.choice(("hi", "yes", None, "long text " * 3))))
    rows += [(c, t, "user", f"m{t}") for c in range(100, 160) for t in range(11)] + [(200, t // 3, "user", "same") for t in range(150)] + [(50, 1, "user", "tie"), (50, 1, "bot", "tie")]
    rng.shuffle(rows)
    assert trie_of(spark, rows, tmp_path) == nodes_of(rows)


def test_prefix_trie_of_nothing(spark, tmp_path):
    assert trie_of(spark, [(None, 1, "user", "x")], tmp_path / "a") == []
    only = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert trie_of(spark, [(only, 1, "user", "x")], tmp_path / "b") == nodes_of([(only, 1, "user", "x")]) == [(only, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(12, 2 * q):
                x = w[start : start + length]
                if q == next(p for p in range(1, length + 1) if x[p:] == x[: length - p]):
                    found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_find_runs():
    rng = random.Random(1)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases = [[], [1], [0] * 11, [0] * 12, [0] * 200, [0, 1] * 90, fibonacci[-1], [bin(i).count("1") & 1 for i in range(512)], ([0, 1] * 10 + [0]) * 6, ([0] * 20 + [1]) * 3, [0, 1] * 10 + [1, 0] * 10]
    for _ in range(500):
        n, u = rng.randrange(140), [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        cases.append([[rng.randrange(2) for _ in range(n)], (u * 40)[:n], (u * rng.randrange(1, 6) + [rng.randrange(3)]) * 4, u + [5] + u + u][rng.randrange(4)])
        if cases[-1] and rng.random() < 0.3:
            cases[-1][rng.randrange(len(cases[-1]))] = 9
    for w in cases:
        assert periodic.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w), w


def test_one_repeated_word_is_quick():
    assert periodic.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_op13_digests(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, " \t\n", "a " * 11, "a " * 12, "x y z " * 30 + "tail", " no break " * 20, "Aa aA " * 9]
    rows = [(i, texts[i]) for i in range(len(texts))] + [(None, "w " * 3 + "u v " * 40), (5, texts[5]), (5, texts[5])]
    rows += [(100 + i, " ".join(f"w{rng.randrange(k)}" for _ in range(rng.randrange(200)))) for i in range(120) for k in (rng.choice((2, 40, 1000)),)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "id", "start")}).write.parquet(f"{tmp_path}/documents.parquet")
    want, tails = [], 0
    for i, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words, tails = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)], tails + 1
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert tails > 5 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0
