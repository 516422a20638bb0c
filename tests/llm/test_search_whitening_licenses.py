"""Hard negatives, whitening and licences against plain versions, and their edges."""

import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantity_jobs.llm import hard_negatives, licenses, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, anchor, positives=5, negatives=10, scale=256):
    """By all pairs, in Python integers."""
    best = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (str(lab), v)
        if i not in best or key < best[i]:
            best[i] = key
    own = {i: (lab, [math.floor(scale * int(x)) if abs(x) >= 2**53 else math.floor(scale * x) for x in v]) for i, (lab, v) in best.items()}
    out = set()
    for a in filter(anchor, own):
        lab, q = own[a]
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i, o) for i, (o, p) in own.items() if i != a and len(p) == len(q))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(-n, i) for n, i, o in scored if o != lab and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out |= {(a, p, r, i, -s, n) for r, (n, i) in enumerate(fit, 1)}
    return out


def vectors(rng, n, dim, spread):
    middles = rng.standard_normal((5, dim))
    return [(i, [float(np.float32(x)) for x in middles[i % 5] + spread * rng.standard_normal(dim)], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_against_all_pairs(spark, spread):
    rows = vectors(np.random.default_rng(3), 400, 6, spread)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for conf in (hard_negatives.Mining(), hard_negatives.Mining(members=4, block=16, chunk=50, group=13)):
        out = hard_negatives.mine(table, F.col("id") % 7 == 0, F.col("label"), conf=conf)
        assert {tuple(r) for r in out.collect()} == plain_negatives(rows, lambda i: i % 7 == 0)


def test_negatives_walk_ends_early(monkeypatch):
    """Far clusters are certified without scoring their rows."""
    rng = np.random.default_rng(1)
    near, far = rng.standard_normal((64, 8)) * 0.01 + np.eye(8)[0], rng.standard_normal((4000, 8)) * 0.01 + np.eye(8)[1]
    x = np.concatenate([near, far])
    conf = hard_negatives.Mining(block=32)
    own = hard_negatives.Scores(near[:16], 256)
    units = own.units()
    centre = units.mean(axis=0) / np.linalg.norm(units.mean(axis=0))
    cluster = hard_negatives.Cluster(np.arange(16), np.arange(16), np.array(["a"] * 16, object), own, centre, float(np.arccos(np.clip(units @ centre, -1, 1)).max()))
    scored, dot = [], hard_negatives.Scores.dot
    monkeypatch.setattr(hard_negatives.Scores, "dot", lambda self, other: scored.append(len(other.q)) or dot(self, other))
    held = {}
    hard_negatives.walk([cluster], held, np.arange(len(x)), np.array(["a"] * len(x), object), hard_negatives.Scores(x, 256), conf)
    assert sum(scored) <= 128 and len(held) == 16


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1), (7, [1.0, 0.0], None)]
    rows += [(8, [0.0, 0.0], 2), (9, [0.2, 0.1], 2), (10, [0.2, -0.1], 2), (11, [0.2, 0.1, 0.3], 2), (None, [1.0, 0.0], 1), (12, [0.3, None], 2), (1, [0.5, 0.5], 1), (9, [0.1, 0.1], 2)]
    rows += [(13, [-1.0, 0.0], 1), (20, [1e30, 1e30], 1), (21, [3e30, 1e30], 1), (22, [2e30, 1e29], 2)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("own", F.lit("x")).withColumn("id", F.lit("y"))
    table = table.withColumn("grp", F.lit(1))
    expect = {(*r[:4], *(max(min(x, 2**63 - 1), -(2**63)) for x in r[4:])) for r in plain_negatives([(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], lambda i: True)}
    assert {tuple(r) for r in hard_negatives.mine(table, F.lit(True), F.col("label")).collect()} == expect
    assert hard_negatives.mine(table.filter("false"), F.lit(True), F.col("label")).count() == 0
    assert hard_negatives.mine(table, F.lit(False), F.col("label")).count() == 0


def plain_whitening(vectors_, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors_], float)
    centred = x - x.mean(axis=0)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:k]
    return x, centred @ found[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(5)
    mixing = rng.standard_normal((40, 40))
    rows = [(i, [float(x) for x in mixing @ rng.standard_normal(40)], 0) for i in range(300)]
    out = defaultdict(dict)
    for r in whitening.whitening_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        out[r.vec_id][r.component] = r
    x, white, explained = plain_whitening([v for _, v, _ in rows], 32)
    sums = [int(s) for s in x.sum(axis=0)]
    signs = np.sign([out[0][c].whitened for c in range(1, 33)]) * np.sign(white[0])
    for i in range(300):
        assert sorted(out[i]) == list(range(1, 33))
        assert np.allclose([out[i][c].whitened for c in range(1, 33)], white[i] * signs, atol=1e-7)
        assert out[i][1].deviation == sum((300 * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True)) and out[i][1].n == 300
        assert np.allclose([out[i][c].explained for c in range(1, 33)], explained, rtol=1e-9) and out[i][5].identity_error < 1e-9


@pytest.mark.parametrize("case", ["spread", "equal", "rank", "near", "signs"])
def test_spectrum_slicing(case):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = {"spread": 2.0 ** -np.arange(30), "equal": np.repeat([5.0, 3.0, 1.0], 10), "rank": np.r_[np.arange(1, 11), np.zeros(20)], "near": 1 + 1e-9 * np.arange(30), "signs": np.arange(30) - 9.5}[case]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    exact = np.sort(values)[::-1]
    for shift in (-3.3, 0.0011, 0.7, 2.2, 4.9):
        assert whitening.count_above(a, shift) == (exact > shift).sum()
    found, vectors_ = whitening.leading(a, 12)
    size = np.abs(values).max()
    above = exact[exact > 1e-12 * size][:12]
    assert len(found) == len(above) and np.allclose(found, above, atol=1e-12 * size)
    assert np.allclose(vectors_.T @ vectors_, np.eye(len(found)), atol=1e-5 if case == "near" else 1e-9)
    assert np.allclose(a @ vectors_, vectors_ * found, atol=1e-12 * size)


def test_whitening_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [0.0, 5.0], None), (2, None, 0), (3, [nan, 1.0], 0), (4, [None, 1.0], 0), (5, [1.0], 0), (6, [], 0), (7, [float("inf"), 1.0], 0), (8, [3.0, 3.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).withColumn("n", F.lit(0))
    out = whitening.whitening_digest(table).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in out) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2)]
    assert {r.n for r in out} == {4} and max(r.identity_error for r in out) < 1e-9
    assert whitening.whitening_digest(table.filter("false")).count() == 0
    assert whitening.whitening_digest(table.filter("vec_id = 1")).count() == 0
    # large entries: exact sums and products, deviations beyond 64 bits
    wide = spark.createDataFrame([(i, [float(i) * 2**30, float(i * i) * 2**24], 0) for i in range(50)], "vec_id long, embedding array<double>, label int")
    big = whitening.whitening_digest(wide).collect()
    # x is 2^36 i and 2^30 i^2 beside the offset
    exact = {i: (50 * i * 2**36 - sum(range(50)) * 2**36) ** 2 + (50 * 2**30 * i * i - 2**30 * sum(j * j for j in range(50))) ** 2 for i in range(50)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2**63 else None) for r in big) and len(big) == 100
    assert max(r.identity_error for r in big) < 1e-4


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, t.label) for t in licenses.BASE for i in range(len(words)) if words[i : i + len(t.words())] == t.words()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_against_plain_and_sql(spark):
    rng = random.Random(4)
    phrases = [t.text for t in licenses.BASE + licenses.NOTICES]
    rows = [(None, None), (0, ""), (1, " . "), (1, " . "), (2, "MIT-License"), (3, "x MIT"), (4, "mit Mit LICENSE mit license"), (5, "cc by" * 3), (6, "MIT licenſe K mité license"), (7, "word " * 50_000 + "GNU general, public\nLICENSE " * 2)]
    for i in range(10, 120):
        words = rng.choice(phrases).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["", "odd", "gnu", "license", "the the"])
        rows.append((i, " ".join([*rng.choices(["the", "Lorem", "public", "software"], k=rng.randrange(9)), *words, *rng.choices(["by", "cc", "free"], k=rng.randrange(5))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("raw", F.lit("x")).repartition(3)
    found = sorted((tuple(r) for r in licenses.license_digest(docs).collect()), key=str)
    assert {r[:6] for r in found} == {(i, *plain_base(t)) for i, t in rows} and len(found) == len(rows)
    documents = docs.toPandas()  # noqa: F841  the SQL reads it
    assert found == sorted(duckdb.sql(licenses.ORACLE).fetchall(), key=str)


def test_licenses_notices(spark):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        2: "permission is hereby granted free of charge to whoever asks",
        3: "Licensed under the Apache License, Version 2.0 (the \"License\")",
        4: "Licensed under CC BY-NC 4.0.",
        5: "* Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:",
        6: "restriction without software the in deal to files documentation associated",
    }
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    labels = {i: {m.label for m in r.matches} for i, r in rows.items()}
    assert labels == {1: {"mit"}, 2: set(), 3: {"apache", "apache-2.0"}, 4: {"cc-by", "cc-by-nc"}, 5: {"bsd"}, 6: set()}
    assert all(0 <= m.share <= 1 + 1e-12 for r in rows.values() for m in r.matches)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licenses.scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), templates=()).first().n_words == 2
