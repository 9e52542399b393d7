import random

import numpy as np
import pytest

from tidegrid.llm import shared_spans as module
from tidegrid.llm.shared_spans import _hash, _pieces, _sliding_min, shared_spans, super_kmers


def brute(docs, k):
    seen = {}
    for i, t in docs:
        for p in range(len(t or "") - k + 1):
            seen.setdefault(t[p : p + k], set()).add(i)
    out = {}
    for i, t in docs:
        on = set()
        for p in range(len(t or "") - k + 1):
            if len(seen[t[p : p + k]]) > 1:
                on |= set(range(p, p + k))
        out[i] = len(on)
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id BIGINT, text STRING, a INT, mini STRING")
    return {r.doc_id: r for r in shared_spans(df, **kw).collect()}


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(spark, hot):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé€😀") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(40)]
    notice = " ".join(word() for _ in range(12))
    for k in range(40):
        if k % 3 == 0:
            texts[k] += notice
        if k % 5 == 0:
            o = texts[rng.randrange(40)]
            texts[k] = texts[k][:50] + o[10 : 10 + rng.randint(20, 80)] + texts[k][50:]
    texts += ["aa" * 400, "aa" * 300, "ab" * 200, texts[0], texts[0], "short"]
    docs = list(enumerate(texts))
    got = run(spark, docs, least=30, hot=hot)
    want = brute(docs, 30)
    assert {i: r.shared_chars for i, r in got.items()} == want
    assert all(r.longest <= r.shared_chars and (r.n_spans > 0) == (r.shared_chars > 0) for r in got.values())


def test_notice_on_a_tenth_of_the_pages(spark, monkeypatch):
    """A hot minimiser, its joins salted instead of broadcast: the same result as by plain buckets."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    notice = text(120)
    docs = [(k, text(150) + (notice if k % 10 == 0 else "") + text(50)) for k in range(200)]
    plain = {i: (r.shared_chars, r.n_spans, r.longest) for i, r in run(spark, docs, least=60).items()}
    monkeypatch.setattr(module, "broadcast_if_small", lambda df, n: df)
    assert {i: (r.shared_chars, r.n_spans, r.longest) for i, r in run(spark, docs, least=60, hot=5).items()} == plain
    assert all((c >= 120) == (i % 10 == 0) for i, (c, _, _) in plain.items())


def test_edges(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefgh") for _ in range(400))
    got = run(spark, [(1, t), (2, t[100:300]), (3, t[101:300]), (4, None), (5, ""), (6, t[:199]), (None, t)])
    assert {i: r.shared_chars for i, r in got.items()} == {1: 200, 2: 200, 3: 0, 4: 0, 5: 0, 6: 0}
    assert got[1].n_chars == 400 and got[1].share == 0.5 and got[4].n_chars == 0
    assert run(spark, []) == {}
    again = run(spark, [(1, t + t), (1, t + t)])
    assert again[1].shared_chars == 0


def test_hashes_and_minima():
    x = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9], np.uint32)
    for n in (1, 2, 3, 5, 7, 8):
        h = _hash(np.concatenate([x, x]), n, 1)
        assert len(h) == 2 * len(x) - n + 1 and all(h[i] == h[i + len(x)] for i in range(len(x) - n + 1))
        m = _sliding_min(x, n)
        assert list(m) == [min(x[i : i + n]) for i in range(len(x) - n + 1)]


def test_runs_cover_every_window_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    own, at, n, _ = super_kmers(texts, 40, 20)
    got = sorted((o, p) for o, a, c in zip(own, at, n, strict=True) for p in range(a, a + c))
    assert got == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)]


def test_long_texts_come_in_overlapping_slices(monkeypatch):
    monkeypatch.setattr(module, "PIECE", 100)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 39, 40, 99, 100, 139, 140, 141, 1000)]
    got = []
    for ids, offsets, parts in _pieces(list(range(len(texts))), texts, 40):
        own, at, n, _ = super_kmers(parts, 40, 20)
        got += [(int(ids[o]), int(p + offsets[o])) for o, a, c in zip(own, at, n, strict=True) for p in range(a, a + c)]
    assert sorted(got) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)]
