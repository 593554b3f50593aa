"""Exact dedup, BPE, packing and language ID against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe, exact_dedup, langid, packing

DOCS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "Äb"), (6, "äb"), (7, "abc"), (7, "abc"), (None, "abc"), (8, "x" * 200_000), (9, "X" * 200_000), (None, None)]


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    # clashing names of the operators' own columns
    return spark.createDataFrame([(*r, "u", 1, "k") for r in rows], schema + ", uid string, node int, digest string").repartition(parts)


def fold(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 11])
def test_exact_dedup(spark, keep, parts):
    rows = DOCS + [(100 + i, "hot") for i in range(60)] + [(1000 + i, f"t{i % 1700}") for i in range(3000)]
    got = exact_dedup.exact_duplicates(frame(spark, rows, parts=parts), keep=keep).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(fold(t)).digest()].append(i)
    pick = max if keep == "largest" else min
    for r in got:
        ids = groups[bytes(r.digest)]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (pick(known) if known else None)
    kept = [bytes(r.digest) for r in got if r.uid == r.keep_uid]
    assert sorted(kept) == sorted(groups)
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


PIECES = ["a", "don't", "'s", "!'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "à ", " ", "　", "\x1c", "\x85", "12", "...", "<|endoftext|>", "<|endof", "中文", "🙂", "x" * 40, "the", "ing "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=14).map("".join))
def test_bpe_equals_library(text):
    from tokenizers import Tokenizer

    ref = test_bpe_equals_library.__dict__.setdefault("ref", None) or Tokenizer.from_file(bpe.tokenizer_path())
    test_bpe_equals_library.ref = ref
    enc = bpe.load(bpe.tokenizer_path())
    ids = ref.encode(text, add_special_tokens=False).ids
    assert enc.encode(text).tolist() == ids == enc.encode(text, cut=False).tolist()
    assert enc.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_forced_pairs_are_in_no_token():
    enc = bpe.load(bpe.tokenizer_path())
    for t in enc.piece[:50256]:
        for a, b in zip(t, t[1:]):
            assert not enc.forced[a * 256 + b]
    assert "".join(enc.fragments("ab cd\n e  f")) == "ab cd\n e  f"


def test_bpe_frames(spark, reference):
    got = {(r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe.encode_digests(frame(spark, DOCS)).collect()}
    want = set()
    for i, t in DOCS:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids)))
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, DOCS))).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(str((i, t or "")) for i, t in DOCS)
    assert bpe.encode_digests(frame(spark, [])).count() == 0


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    assert (x >= 0).all()
    y = np.zeros(30)
    for _ in range(20000):
        y = np.maximum(0, y - 0.01 * a.T @ (a @ y - b))
    assert np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_strategies_fill_the_window():
    a, found = packing.strategies(16, 3)
    assert len(set(found)) == len(found) and all(sum(f) == 16 and len(f) <= 3 for f in found)
    assert len(found) == sum(1 for x in range(1, 17) for y in range(x + 1) for z in range(y + 1) if x + y + z == 16)


def packed_right(rows, docs, window, reference):
    ids = {}
    for i, t in docs:
        ids[i] = np.array(reference.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for spans, total in [*((v, len(ids[k])) for k, v in by_doc.items()), *((v, None) for v in by_seq.values())]:
        end = 0
        for s, n in sorted(spans):
            assert s == end and n > 0
            end += n
        assert end == total if total else end <= window and (end == window or end & (end - 1) == 0)


def test_packing(spark, reference):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "x1"]) for _ in range(int(rng.paretovariate(0.6)) % 900))) for i in range(150)] + [(900, None), (901, ""), (902, "w " * 6000)]
    packed_right(packing.pack_documents(frame(spark, docs), window=256).collect(), docs, 256, reference)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(12)] + [(20 + i, "le chat et le chien", "fr") for i in range(12)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 !?", None), (None, "the dog", "xx"), (54, "le chien " * 300_000, None), (55, "\U0001f600 the", None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52, None, 54, 55)] == ["und", "und", "und", "en", "fr", "en"] and got[50].score == 0
    none = langid.identify(frame(spark, [(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und"
    assert langid.identify(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


def test_code_lengths_against_plain_ppm():
    """The compiled table gives what a plain PPM coder gives, byte by byte."""
    rng = random.Random(5)
    texts = {"a": bytes(rng.choice(b"abcd e") for _ in range(3000)), "b": bytes(rng.choice(b"aabx y") for _ in range(3000))}
    langs, trees, grams = sorted(texts), {}, defaultdict(lambda: [0, 0])
    for j, lang in enumerate(langs):
        x = b"\0\0\0" + texts[lang]
        for i in range(3, len(x)):
            grams[int.from_bytes(x[i - 3 : i + 1], "big")][j] += 1
    g = np.array(sorted(grams))
    c = np.array([grams[k] for k in g.tolist()])
    model = langid.build(langs, g, c, np.bincount(g & 255, c.sum(1), 256))
    seen = defaultdict(int)
    for k, v in zip(g.tolist(), c.sum(1).tolist()):
        seen[k >> 8] += v

    def bits(lang, x, i):
        j = langs.index(lang)

        def p(order):
            if order < 0:
                return 1 / 256
            if order == 3 and seen[int.from_bytes(x[i - 3 : i], "big")] < langid.MIN_SEEN:
                return p(2)
            succ = defaultdict(int)
            for k, v in zip(g.tolist(), c[:, j].tolist()):
                if v and k.to_bytes(4, "big")[3 - order : 3] == x[i - order : i]:
                    succ[k & 255] += v
            n, d = sum(succ.values()), len(succ)
            if not n:
                return p(order - 1)
            return succ[x[i]] / (n + d) if x[i] in succ else d / (n + d) * p(order - 1)

        return -np.log2(p(3))

    text = b"\0\0\0abxe yab d"
    want = [sum(bits(lang, text, i) for i in range(3, len(text))) for lang in langs]
    data = np.frombuffer(text[3:], np.uint8)
    assert np.allclose(model.lengths(data, np.array([0])), [want], rtol=1e-4)
    # pieces of a long text add up
    old, langid.CHUNK = langid.CHUNK, 4
    try:
        assert np.allclose(model.lengths(np.tile(data, 2), np.array([0, len(data)])), [want, want], rtol=1e-4)
    finally:
        langid.CHUNK = old
