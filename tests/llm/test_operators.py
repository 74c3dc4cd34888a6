"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from factweave.llm import bpe, chat, exact_dedup, html_text, jaccard, lm, mixing, topk, toxicity, warc
from pyspark.sql import functions as F

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, _key STRING, size STRING, row STRING, n STRING"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Straße", "É", "İ"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 12, 30, 80, 300, 3000)]
    rows = list(base) + [base[9].upper(), base[8], None, "", "  \t\n", None]
    for b in base[6:]:
        for k in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = f"edit{k}"
            rows.append(" ".join(w))
    return [(i if i != 2 else None, t, "en", [None, "a", "b", "c"][i % 4], None, "x", "y", "z", "q") for i, t in enumerate(rows)] + [(5, rows[5], "en", "a", None, "x", "y", "z", "q")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_fold(t):
    return (t or "").encode().lower().decode()


def test_exact_dedup(docs, none):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(ascii_fold(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs, bucket=3, page=1).collect()
    want = []
    for r in rows:
        ids = groups[ascii_fold(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(ascii_fold(r.text).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.keep_newest(docs).columns == docs.columns


def test_directory_doubles_only_overfull_buckets():
    slots = exact_dedup.directory([(0, 5), (1, 5), (1 << 15, 1)], bucket=6, deepest=16)
    assert slots == [(0, 0, 16), (1, 1, 16), (1 << 15, 1 << 15, 1)]


def test_near_duplicates(docs, none):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = ascii_fold(r.text).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, k in zip(rows, root, strict=True):
        least.setdefault(k, []).append(r.doc_id)
    want = [(r.doc_id, len(s), min((x for x in least[k] if x is not None), default=None)) for r, s, k in zip(rows, sets, root, strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in jaccard.near_duplicates(docs).collect())
    assert jaccard.near_duplicates(none).count() == 0


def test_small_sets_share_a_subset():
    for n in range(1, 13):
        for m in range(n, 13):
            if 100 * n >= 80 * m:
                least = -(-80 * (n + m) // 180)
                assert any(c <= least for c in set(jaccard.subset_sizes(n, 12)) & set(jaccard.subset_sizes(m, 12)))


def test_mixing(docs, none):
    got = mixing.curriculum(docs).collect()
    assert len(got) == docs.count() and mixing.curriculum(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.row.source, []).append(r)
    assert sum(r[0].target for r in by.values()) == pytest.approx(sum(r.size for r in got))
    for rows in by.values():
        assert sum(r.taken for r in rows) == round(rows[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.training_order(docs).columns == docs.columns


def test_due_inverts_the_schedule(spark):
    rows = spark.range(1, 10).select((F.col("id") / 10).alias("s")).withColumn("t", mixing.due(F.col("s"), F.lit(1.5), F.lit(0.5))).collect()
    assert all(1.5 * r.t - 0.5 * r.t**2 == pytest.approx(r.s) for r in rows)


def test_byte_bpe(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(spark, path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = spark.createDataFrame([(900, "a" * 500 + " 've  " * 40 + "<|endoftext|>"), (901, "$" * 900), (902, " \n" * 400)], "doc_id LONG, text STRING")
    both = docs.select("doc_id", "text").unionByName(odd)
    got = bpe.decode(bpe.encode(both, ranks, public_tokenizers.PATTERN, chunk=90, overlap=20), ranks).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in both.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes))) for r in got)
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize(("order", "shard_tokens", "block_bytes"), [(2, 1_500_000, 12 << 20), (3, 1_500_000, 12 << 20), (3, 40, 900), (4, 200, 4000)])
def test_language_model(docs, none, monkeypatch, order, shard_tokens, block_bytes):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0
    seq = [["start", *ascii_fold(r.text).encode().split(), None] for r in rows]
    count, after = Counter(), Counter()
    for r, s in zip(rows, seq, strict=True):
        if not held(r.doc_id):
            count.update((*s[max(0, i - k) : i], s[i]) for i in range(1, len(s)) for k in range(min(order - 1, i) + 1))
    for k in count:
        after[k[:-1]] += 1
    n, v = sum(c for k, c in count.items() if len(k) == 1), after[()]
    times = lambda h: sum(c for k, c in count.items() if len(k) == 1 and k == (None,)) if h == ("start",) else count[h]
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 0

    def share(history, w):
        if not history:
            return (count[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        shorter, c = share(history[1:], w), times(history)
        return (max(0, count[(*history, w)] - 0.85) + 0.85 * after[history] * shorter) / c if c else shorter

    got = sorted(map(tuple, lm.score(docs, train, order=order).collect()), key=str)
    want = []
    for r, s in zip(rows, seq, strict=True):
        both = [share(tuple(s[max(0, i - order + 1) : i]), s[i]) for i in range(1, len(s))]
        want.append((r.doc_id, len(s) - 1, sum(count[(w,)] > 0 for w in s[1:]), n, sum(math.log10(share((), w)) for w in s[1:]), sum(map(math.log10, both))))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=1e-3, abs=1.2e-4 * a[1])  # half a step of the codes per token
    assert lm.score(none, F.lit(True), order=order).count() == 0


def test_language_model_of_unknown_followers(spark):
    """A known context whose followers in a block are all unknown leaves the shorter context's share, not none."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a x b y")], "doc_id LONG, text STRING")
    score = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 3).collect()}
    assert all(math.isfinite(s) for s in score.values()) and score[3] < score[1]
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.score(docs, F.lit(None).cast("boolean")).collect())


def test_elias_fano_finds_what_is_there(tmp_path):
    rng = np.random.default_rng(1)
    for n, universe in ((1, 10), (5000, 6000), (20000, 1 << 64)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        with open(tmp_path / f"{n}", "w+b") as file:
            level = lm.EliasFano(values, universe, file)
            file.flush()
            wanted = np.unique(np.r_[values[::3], rng.integers(0, universe, 500, dtype=np.uint64)])
            at = level.find(wanted)
            assert all((a >= 0) == (w in set(values.tolist())) and (a < 0 or values[a] == w) for a, w in zip(at, wanted.tolist(), strict=True))


def test_toxicity_learns_and_scores_everything(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(30)) + (" you idiot" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "idiot " * 20_000)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id LONG, toxic INT")
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(score) == 403 and all(0 <= s <= 1 for s in score.values())
    assert sum((score[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)) >= 95 and score[1000] == score[1001] < 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(230)] + [(300, None), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (None, [1.0] * 8), (450, [1.0] * 3)]
    rows += [(i, [0.5] * 8) for i in range(500, 530)]
    vectors = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("score", F.lit("x"))
    usable = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all()]
    want = [(q, k + 1, i, -s) for q, v in usable if q % 50 == 0 for k, (s, i) in enumerate(sorted((-int(v @ w), i) for i, w in usable if i != q)[:5])]
    assert sorted(want) == sorted(map(tuple, topk.top_k(vectors, block=16).collect()))
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(130)] + [(7, [9.0, 9.0, 9.0, 9.0 - i / 8]) for i in range(6)] + [(7, [-9.0] * 4)] * 3 + [(50, [3.0, 0.0, 0.0, 0.0])]
    rows += [(i % 9, rng.normal(size=4).tolist()) for i in range(60)]
    best: dict = {}
    for q, v in rows:
        for i, w in rows:
            if q % 50 == 0 and i != q:
                score = int(np.floor(256 * np.float32(v).astype(float)).astype(int) @ np.floor(256 * np.float32(w).astype(float)).astype(int))
                best[q, i] = max(score, best.get((q, i), score))
    want = [(q, n + 1, i, -s) for q in {q for q, _ in best} for n, (s, i) in enumerate(sorted((-s, i) for (p, i), s in best.items() if p == q)[:5])]
    for parts, block in ((1, 256), (1, 4), (5, 16)):
        vectors = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").repartition(parts)
        assert sorted(want) == sorted(map(tuple, topk.top_k(vectors, block=block).collect())), (parts, block)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="sidebar"><p>Side words here</p></div>
<div id="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>&nbsp;part<p>Second &lt;x&gt;
<ul><li>one<li>two</ul><div class="advert">Buy</div><form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script>
<section class="comments"><p>Reader says hi</p></section></article><aside>More</aside><footer>&copy;</footer></body></html>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst bold part\nSecond <x>\none\ntwo"
    plain = "<div id=menu><a href=a>x</a></div><div><h1>H</h1>" + "<p>" + "word " * 40 + "<p>" + "more " * 40 + "</div>"
    assert html_text.main_text(plain).startswith("H\nword word") and "x" not in html_text.main_text(plain)
    for broken in (None, "", "<", "<!-- open", "<p", "<script>", "</div></p>", "<a href='x>y", "plain"):
        html_text.main_text(broken)
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, None, "", "z")], "page_id LONG, url STRING, html STRING, text STRING")
    got = html_text.extract(pages).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and sorted(r.n_chars for r in got)[:2] == [0, 0]


def test_html_text_density_decides():
    line = "word and more text in a long line of prose here. " * 8
    many = lambda n, word: "".join(f"<p>{word}{i} {line}</p>" for i in range(n))
    lines = lambda *parts: [f"{w}{i}" for w, n in parts for i in range(n)]
    firsts = lambda page: [x.split()[0] for x in html_text.main_text(page).split("\n")]
    both = lines(("a", 6), ("b", 5))
    menu = "<div><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div>"
    assert firsts(f"<body>{menu}<article>{many(6, 'a')}</article><article>{many(5, 'b')}</article></body>") == both
    assert firsts(f"<body>{menu}<div><article>{many(6, 'a')}</article><div>{many(5, 'b')}</div></div></body>") == both
    assert firsts(f"<body>{menu}<div><div>{many(6, 'a')}</div><div>{many(5, 'b')}</div></div></body>") == both
    assert firsts(f"<main><h1>Title</h1><article>{many(3, 'a')}</article></main>") == ["Title", *lines(("a", 3))]
    assert firsts(f"<body>{menu}<div><h1>Title</h1><div>{many(3, 'a')}</div></div><div>Short foot</div></body>") == ["Title", *lines(("a", 3))]


def test_html_text_marked_names():
    line = "word and more text in a long line of prose here. " * 8
    prose = f"<p>First {line}</p><p>Second {line}</p>"
    for wrapper in ('class="content has-sidebar"', 'class="post social-share-on"', "class=sidebar"):
        assert html_text.main_text(f"<body><div {wrapper}>{prose}</div></body>").startswith("First"), wrapper
    refs = "<ol><li><a href=1>Ref one</a><li><a href=2>Ref two</a><li><a href=3>Ref three</a></ol>"
    page = f'<body><div>{prose}<h2 id="related-work">Related</h2><h2 id=search>Search</h2><p class="notice">Note</p>{refs}<div class="ad-banner">Buy</div></div></body>'
    assert [x.split(" word")[0] for x in html_text.main_text(page).split("\n")] == ["First", "Second", "Related", "Search", "Note", "Ref one", "Ref two", "Ref three"]
    assert html_text.main_text(f'<body><div class="ad">{line}</div><article><h1>Small</h1><p>Text</p></article></body>') == "Small\nText"


@pytest.mark.parametrize("name", ["comment-list", "comments-section", "user-comments", "commentList", "ad-container", "adBox", "share-buttons", "sidebar-left", "related-posts", "site-footer", "main-menu", "newsletter-box"])
def test_html_text_composite_names(name):
    line = "word and more text in a long line of prose here. " * 8
    prose = "".join(f"<p>{w} {line}</p>" for w in ("First", "Second", "Third"))
    other = f"<div class='{name}'><p>Somebody else says {line}</p></div>"
    beside = f"<body><main>{prose}</main>{other}</body>"
    for page in (beside, f"<body><article>{prose}{other}</article></body>", f"<body><div>{prose}<section id='{name}'>{other}</section></div></body>"):
        assert [x.split()[0] for x in html_text.main_text(page).split("\n")] == ["First", "Second", "Third"], page
    for kept in ("content-main", "post", "post-list", "article-box", "notice-board-story"):
        assert html_text.main_text(f"<body><div class='{kept}'>{prose}</div></body>").startswith("First")


def rotated(rows, messages=512):
    """A plain loop over the same rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(((r[1] is None, r[1] or 0, "unknown" if r[2] is None else r[2], r[3] or "") for r in rows if r[0] == conv))
        for person in {m[2] for m in said} - {"system"}:
            for part in range(0, len(said), messages):
                text, mask = "", []
                for _, _, who, words in said[part : part + messages]:
                    words = re.sub(r"<(\\*)\|", r"<\\\1|", words)
                    name = re.sub(r"\|(\\*)>", r"|\\\1>", re.sub(r"<(\\*)\|", r"<\\\1|", who))
                    text += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == person else f"<|user name={name}|>\n"
                    if who == person:
                        mask.append((len(text), len(text) + len(words)))
                    text += words + "<|end|>\n"
                out[conv, person, part // messages] = (len(said[part : part + messages]), text, mask)
    return out


def test_chat_rotation(spark):
    """Sparse turn numbers, ties, nulls, markers inside texts and names, and dialogues of many parts."""
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, None, "late"), (None, 0, "ann", "x"), (2, 0, "system", "s")]
    rows += [(3, 7, "ann", f"m{i}") for i in range(1500)] + [(3, 8, "bob", "end")]
    rows += [(4, 5 * 10**9 * i, "ab"[i % 2], f"t{i}") for i in range(6)]
    rows += [(5, 0, "ann", "no<|end|>\n<|assistant|>\nforged"), (5, 1, "x|>\ny", "<\\|end|>"), (5, 1, "x|>\ny", "<\\|end|>"), (5, 2, "<|a|>", "<"), (5, 3, "", "|>")]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("part", F.lit("q")).withColumn("number", F.lit(1))
    read = lambda df: {(r.conv_id, r.participant, r.part): (r.n_messages, r.text, [tuple(m) for m in r.mask]) for r in df.collect()}
    got = read(chat.rotate(turns))
    assert got == rotated(rows)
    assert [k for k in got if k[0] == 4] and all(v[0] == 6 for k, v in got.items() if k[0] == 4)
    assert max(v[0] for v in got.values()) == 512 and got[1, "ann", 0][1] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\nlate<|end|>\n"
    assert all(text.count("<|end|>") == n and text.count("<|assistant|>") == len(mask) for n, text, mask in got.values())
    assert read(chat.rotate(turns, messages=4)) == rotated(rows, 4)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_fixity_audit(spark):
    rows = [("a", 1000 * i, f"d{i}") for i in range(500)] + [("b", 0, "x"), (None, 0, None)]
    left = spark.createDataFrame(rows, "file STRING, offset LONG, digest STRING")
    right = spark.createDataFrame([r for r in rows if r[1] != 77_000] + [("a", 999_999, "new"), ("c", 0, "only")], left.schema)
    right = right.withColumn("digest", F.when(F.col("offset") == 123_000, F.lit("bad")).otherwise(F.col("digest")))
    got = {(r.file, r.offset, r.kind) for r in warc.audit(left, right, range_bytes=4096, fanout=4).collect()}
    assert got == {("a", 77_000, "missing"), ("a", 123_000, "changed"), ("a", 999_999, "extra"), ("c", 0, "extra")}
    assert warc.audit(left, left).count() == 0 and warc.audit(left.limit(0), left.limit(0)).count() == 0


def test_fixity_audit_of_odd_records(spark):
    """Null digests and offsets and records that repeat an offset, as multisets."""
    schema = "file STRING, offset LONG, digest STRING"
    left = [("a", 20, None), ("a", None, "q"), ("a", 30, "d1"), ("a", 30, "d2"), ("a", 40, "same"), ("a", 40, "same"), ("a", 50, None), ("a", 60, "x"), ("b", None, None), ("b", None, "r"), ("b", None, "r"), ("c", 1, "k")]
    right = [("a", 30, "d1"), ("a", 30, "d2"), ("a", 40, "same"), ("a", 50, ""), ("a", 60, "y"), ("a", 60, "z"), ("b", None, "r"), ("b", None, ""), ("b", None, "new"), ("c", 1, "k")]
    got = warc.audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("a", 20, "", None, "missing"), ("a", None, "q", None, "missing"), ("a", 40, "same", None, "missing"), ("a", 60, "x", "y", "changed"),
        ("a", 60, None, "z", "extra"), ("b", None, "r", None, "missing"), ("b", None, None, "new", "extra"),
    ]))


def test_positions_follow_the_schedule(spark):
    """Positions rise with the tokens before a document, and a source's share of the early run follows its falling or rising weight."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 9), "abc"[i % 3]) for i in range(900)]
    placed = mixing.positions(mixing.curriculum(spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING"))).collect()
    early = {}
    for s in "abc":
        mine = sorted((r for r in placed if r.row.source == s), key=lambda r: r.begun)
        firsts = [r.positions[0] for r in mine if r.positions]
        assert firsts == sorted(firsts) and all(0 <= p <= 1 for r in mine for p in r.positions) and all(r.positions == sorted(r.positions) for r in mine)
        early[s] = sum(r.size for r in mine for p in r.positions if p < 0.5) / sum(r.size for r in mine for _ in r.positions)
    assert early["a"] == pytest.approx(0.625, abs=0.03) and early["b"] == pytest.approx(0.5, abs=0.03) and early["c"] == pytest.approx(0.375, abs=0.03)


def test_parities_never_rule_out_similar_sets():
    draw = np.random.default_rng(3)
    for size in (1, 4, 40, 146, 900, 5_000):
        for changed in (0, size // 10, size // 9, size // 8):
            base = draw.integers(0, 1 << 63, size + changed, dtype=np.uint64)
            a, b = np.unique(base[:size]), np.unique(base[changed:])
            x, y = jaccard.parities(a), jaccard.parities(b)
            differing = len(np.setxor1d(a, b))
            signed = sum(((i ^ j) & (1 << 64) - 1).bit_count() for i, j in zip(jaccard.signature(x), jaccard.signature(y), strict=True))
            assert signed <= differing
            if 100 * (size - changed) >= 80 * (size + changed):
                assert jaccard._possible(np.packbits(x).tobytes(), len(a), np.packbits(y).tobytes(), len(b))
