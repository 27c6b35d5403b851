"""Resampling and whitening beside plain Python, on awkward rows and on empty tables."""

import hashlib
import math
import random
import re
from collections import Counter
from decimal import Decimal
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlog.llm import resampling, whitening
from tests.llm.cases import documents, empty, prose


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def drawn(docs, target, percent=25, least=20):
    """(id, n_features, weight, score, rank) of each (id, text), as the definition says."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 40)  # so that pivots decide, not the driver
    rng = random.Random(5)
    docs = [(i, prose(i % 90, rng.randrange(5, 90))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "Ünï 日本 ABC abc 12"), (403, " \n"), (404, prose(1, 30_000))]
    target = [prose(1000 + i, 40) for i in range(20)] + [None, ""]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(df, goal).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, out.collect())) == drawn(docs, target)
    # Without a target, and with all of it drawn.
    out = resampling.resample(df, goal.where("false"), percent=100, least_words=0)
    ranks = sorted(r.rank for r in out.collect())
    assert ranks == list(range(1, len(docs) + 1))


def test_pieces_cut_no_word(monkeypatch):
    text = prose(3, 500).encode()
    whole = resampling.feature_buckets(text)
    monkeypatch.setattr(resampling, "PIECE", 7)
    cut = resampling.feature_buckets(text)
    assert whole[0] == cut[0] and sorted(np.concatenate(whole[1])) == sorted(np.concatenate(cut[1]))


def test_cutoff_is_the_exact_rank(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 3)
    rng = random.Random(2)
    keys = [(rng.randrange(-9, 9), rng.random() < 0.2, rng.randrange(50), i) for i in range(600)]
    # Sorted rows in few partitions: each median is far from the whole's.
    df = spark.createDataFrame(sorted(keys), "minus long, no_id boolean, id long, row long").repartition(4, "minus")
    path = resampling.written(df, "keys")
    for rank in (1, 222, 600):
        assert resampling.cutoff(path, rank) == sorted(keys)[rank - 1]


def test_resampling_awkward_rows(spark):
    docs, none = documents(spark), empty(spark)
    out = resampling.resample(docs, docs.where("doc_id = 6"), least_words=1, percent=50)
    ids = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))
    assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is None, i)) == ids
    assert len({r.weight for r in out.collect()}) > 1 and {r.rank for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6}
    assert resampling.resample(none, docs).isEmpty()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n string")


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((500, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [r.tolist() for r in good]
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e30] * 12, [1.0] * 5]
    df = vectors(spark, [*rows, rows[0], *bad]).repartition(5)
    out = whitening.whiten(df).collect()
    x = np.floor(1024 * np.vstack([good, good[:1]]).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(out) == 8 * n
    got = {(r.vec_id, r.component): r for r in out}
    sign = {c: np.sign(got[0, c].whitened) * np.sign((y @ v / np.sqrt(e))[0, c - 1]) for c in range(1, 9)}
    for (i, c), r in got.items():
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        assert r.whitened == pytest.approx(sign[c] * (y[i] @ v[:, c - 1]) / math.sqrt(e[c - 1]), abs=1e-9)
        assert r.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-10) and r.identity_error < 1e-10


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]])).isEmpty()  # no variance
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]] * 9)).isEmpty()
    assert whitening.whiten(vectors(spark, [[1.0]]).where("false")).isEmpty()
    line = whitening.whiten(vectors(spark, [[float(i), float(2 * i), 3.0] for i in range(9)]))
    assert {r.component for r in line.collect()} == {1}
    wide = whitening.whiten(vectors(spark, [[2.0**40, 0.0], [0.0, 2.0**40], [5.0, 5.0]]))
    assert wide.first().deviation > Decimal(2) ** 90 and wide.first().identity_error < 1e-4


def test_spectrum_slicing():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for values in (np.arange(30) ** 2.0, np.r_[[7.0] * 4, [5.0] * 3, np.zeros(23)], np.r_[1e9, 1e9 * (1 - 1e-11), np.ones(28)], np.ones(30)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        for shift in (-1.0, 0.5, 6.0, 8.0, 300.0):
            assert whitening.above(a, shift) == (values > shift).sum()
        e, u = whitening.leading(a, 8)
        expected = np.sort(values[values > 0])[::-1][:8]
        assert len(e) == len(expected) and np.allclose(e, expected, rtol=1e-9, atol=1e-14 * values.max())
        assert np.allclose(u @ u.T, np.eye(len(e)), atol=1e-9)
        assert np.allclose(a @ u.T, u.T * e, atol=1e-6 * values.max())
    # A zero diagonal needs blocks of two rows.
    a = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert [whitening.above(a, x) for x in (-2, 0, 2)] == [2, 1, 0]
    assert whitening.leading(a, 2)[0] == pytest.approx([1.0])


def test_normal_rows_are_all_used(spark):
    rows = [[float(i % 7), float(i % 5), 1.0] for i in range(70)]
    out = whitening.whiten(vectors(spark, rows))
    assert out.select("vec_id").distinct().count() == 70
    assert out.groupBy("component").agg(F.avg("whitened").alias("m")).where("abs(m) > 1e-9").isEmpty()
