"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import ann, langid, near_dedup, packing, secrets


def shingle_set(text):
    w = [x for x in re.split(rb"[^a-z0-9_\x80-\xff]+", (text or "").encode().lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("raw", (text or ""))}


def classes(rows, threshold=0.8):
    """Components of plain Jaccard similarity; rows: (place, text)."""
    sets, inv = {i: shingle_set(t) for i, t in rows}, defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inv[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                root[find(i)] = find(j)
        for x in s:
            inv[x].append(i)
    out = defaultdict(set)
    for i in sets:
        out[find(i)].add(i)
    return {frozenset(v) for v in out.values()}


def test_near_duplicates(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    base = [word() for _ in range(200)]
    near = []
    for _ in range(120):  # a large group: few edits each
        w = list(base)
        for i in rng.sample(range(200), 2):
            w[i] = word()
        near.append(" ".join(w))
    other = [" ".join(base[:60] + [word() for _ in range(140)]) for _ in range(60)]  # share a passage only
    texts = near + other + ["", None, "!!", "a b", "A  b", "a b c", " ".join(base).upper(), "x " * 30_000]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, uid int").repartition(5)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for members in classes(list(enumerate(t for _, t in rows))):
        ids = [rows[k][0] for k in members]
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(known) if known else None, len(ids))] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.class_id for r in got}) and all(r.doc_id == r.class_id for r in kept)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rest_of_buckets(spark, monkeypatch):
    """Every node with a partner in its bucket gets the best one; all pairs agree and differ in root."""
    rng = np.random.default_rng(5)
    protos = rng.integers(0, 256, (3, near_dedup.SAMPLES), dtype=np.uint8)
    rows, roots = [], []
    for i in range(150):
        m = protos[i % 3].copy()
        m[rng.random(near_dedup.SAMPLES) < 0.3] = 0
        node = i.to_bytes(16, "big")
        rows.append((bytearray(node), [i % 2, 7], bytearray(m.tobytes())))
        if i % 5:
            roots.append((bytearray(node), bytearray((1000 + i % 5 // 4).to_bytes(16, "big"))))
    nodes = near_dedup.written(spark.createDataFrame(rows, "node binary, keys array<long>, marks binary").repartition(3), "signatures")
    roots_df = spark.createDataFrame(roots, "node binary, root binary")
    of, want = {bytes(n): bytes(r) for n, r in roots}, {}
    for i, (x, _, mx) in enumerate(rows):
        for y, _, my in rows[:i]:
            a, b = sorted((bytes(x), bytes(y)))
            agree = sum(p == q for p, q in zip(mx, my))
            if of.get(a, a) != of.get(b, b) and agree >= near_dedup.REST_AGREE:
                want[a, b] = agree
    most = Counter()
    for pair, n in want.items():
        for x in pair:
            most[x] = max(most[x], n)
    done = sorted(want)[:3]
    done_df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in done], "a binary, b binary")
    assert len(want) > 100
    for block in (7, 2048):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = [(bytes(r.a), bytes(r.b)) for r in near_dedup.rest_pairs(nodes, roots_df, done_df).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(want) - set(done)
        every = Counter()
        for pair in got + done:
            for x in pair:
                every[x] = max(every[x], want[pair])
        assert every == most


def test_refused_pairs_take_no_place(spark):
    """0-1 and 2-3 agree most and are done; 0-2 is neither's best, but no round leaves it out for good."""
    m = np.tile(np.arange(near_dedup.SAMPLES, dtype=np.uint8), (6, 1))
    m[2:, :12], m[1, 12:20], m[3, 20:28] = 200, 201, 202
    m[4:] = 203  # the largest component, unlike the others
    assert [int((m[i] == m[j]).sum()) for i, j in ((0, 1), (2, 3), (0, 2), (1, 2), (0, 3))] == [28, 28, 24, 16, 16]
    name = lambda i: bytearray([i] * 16)
    nodes = spark.createDataFrame([(name(i), [7], bytearray(m[i].tobytes())) for i in range(6)], "node binary, keys array<long>, marks binary")
    roots = spark.createDataFrame([(name(4), name(4)), (name(5), name(4))], "node binary, root binary")
    done = spark.createDataFrame([(name(0), name(1)), (name(2), name(3))], "a binary, b binary")
    pairs = lambda most: [tuple(x and x[0] for x in (r.a, r.b)) for r in near_dedup.rest_pairs(nodes, roots, done, most).collect()]
    assert pairs(1) == [(None, None)]  # none is new, but there are more
    assert pairs(2) == pairs(None) == [(0, 2)]
    assert near_dedup.PARTNERS[-1] is None


def test_rest_is_verified_within_blocks(spark, monkeypatch):
    """Links of the rest join all that brute force joins, in blocks of any size; unlike texts of one bucket give no pair rows."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for k in range(60):  # groups of three near copies, each group some 0.7 like the others
        w = list(base)
        for i in rng.sample(range(120), 4):
            w[i] = word()
        texts += [" ".join(w + w[:3] * 2), " ".join([word()] + w + w[:3] * 2), " ".join(w + w[:3] * 2 + [word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = near_dedup.document_frequencies(docs)
    shipped = spark.sparkContext.broadcast(idf)
    rows = docs.select(F.col("doc_id").alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
    signed = rows.mapInArrow(near_dedup._signer(shipped), "uid long, doc_id long, node binary, keys array<long>, marks binary, size int, mass double")
    signed = near_dedup.written(signed, "signed")
    node = {bytes(r.node): r.doc_id for r in signed.collect()}
    bags = {node[bytes(r.node)]: bytes(r.bag) for r in near_dedup.bags_of(rows, signed).collect()}
    signs = {r.doc_id: (list(r["keys"]), bytes(r.marks)) for r in signed.collect()}
    agree = lambda x, y: sum(p == q for p, q in zip(x, y))
    alike, unlike = set(), 0
    for i, (k, m) in signs.items():
        for j in range(i):
            if set(k) & set(signs[j][0]) and agree(m, signs[j][1]) >= near_dedup.REST_AGREE:
                ok = max(near_dedup.similarities(bags[i], bags[j], idf)) >= 0.8
                alike |= {(j, i)} if ok else set()
                unlike += not ok
    assert unlike > 500 and len(alike) > 100
    part = lambda links: {frozenset(c) for c in _joined(links).values()}
    none = spark.createDataFrame([], "node binary, root binary")
    for block in (7, 2048):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = [tuple(sorted((node[bytes(r.a)], node[bytes(r.b)]))) for r in near_dedup.rest_links(rows, signed, none, idf, 0.8).collect()]
        assert set(got) <= alike and part(got) == part(alike)


def _joined(links):
    of = {x: x for p in links for x in p}
    for a, b in links:
        a, b = of[a], of[b]
        of = {x: a if r == b else r for x, r in of.items()}
    out = defaultdict(set)
    for x, r in of.items():
        out[r].add(x)
    return out


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(2)
    icws = near_dedup.Icws(samples=3000)
    h = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    wx, wy = rng.random(300) + 0.1, rng.random(300) + 0.1
    s = [icws.samples(h, np.log(w), np.array([0]))[0] for w in (wx, wy)]
    assert abs((s[0] == s[1]).mean() - np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()) < 0.05


def test_nearest(spark, sf):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=8).tolist() for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[7]) for i in range(40)] + [(5000, x[0]), (9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0] * 3), (None, x[3]), (9100, [None] + x[1][1:]), (100, x[100])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, file int, key string").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    assert set(got) == {i for i, _ in use if i % 100 == 0}
    for q, found in got.items():
        v = dict(use)[q]
        every = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in use)
        every.remove((0.0, q))
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == every[:10]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(lone, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 3, 0.0)]


def test_ties_go_to_the_smaller_identifier(spark):
    """16 different vectors at distance 1 of the query; the places are those of the 10 smallest identifiers."""
    steps = [d for i in range(8) for d in (i + 1, -i - 1)]
    at = lambda d: [2.0 + (abs(d) == i + 1) * (1 if d > 0 else -1) for i in range(8)]
    rows = [(0, at(0)), *((n, at(d)) for n, d in enumerate(steps, 1))]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, n, n, 1.0) for n in range(1, 11)]


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as p

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_001, None, "en", "s", 0), (10_002, "12 34", "en", "s", 5), (10_003, rows[0][1].upper(), "en", "s", 1), (10_003, rows[0][1].upper(), "en", "s", 1), (10_004, "the secret = abcdef123 and more words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            want = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
            assert Counter((r[0], r[1]) for r in seen[name]) == Counter((r[0], r[1]) for r in want)
        elif name == "exact_dedup":
            best = {}
            for r in seen["language_id"]:
                k = r[1].encode().lower()
                best[k] = max(best.get(k, r[0]), r[0])
            assert sorted((r[0], r[1].encode().lower()) for r in seen[name]) == sorted((i, k) for k, i in best.items())
        elif name == "near_dedup":
            ids = [r[0] for r in seen["exact_dedup"]]
            found = classes(list(enumerate(r[1] for r in seen["exact_dedup"])))
            assert sorted(r[0] for r in seen[name]) == sorted(min(ids[k] for k in c) for c in found)
        elif name == "secret_scan":
            assert sorted(r[0] for r in seen[name]) == sorted(r[0] for r in seen["near_dedup"])
            assert not [1 for r in secrets.scan(docs).collect() if r.spans]
            assert any(secrets.MASK in r[1] for r in seen[name])
    texts = {r[0]: r[1] for r in seen["secret_scan"]}
    covered = Counter()
    for r in docs.collect():
        covered[r.doc_id] += r.length
    enc = packing.load(packing.tokenizer_path())
    assert covered == {i: len(enc.encode(t)) + 1 for i, t in texts.items()}
    assert langid.UNDETERMINED == "und" and p.ORACLE_SQL is None
