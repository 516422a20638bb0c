"""What the Jaccard join and the pipeline's use of it keep from moving."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quantity_jobs.llm import bloom, jaccard_join


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_sketches_lose_no_link(percent):
    """Sets near the limit on either side, of sizes that put them into sketches of different widths; most unrelated ones are told apart."""
    rng = np.random.default_rng(1)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    apart = 0
    for size in (1, 2, 60, 64, 65, 120, 129, 500, 1030):
        for _ in range(40):
            x = draw(size)
            y = np.union1d(x[: int(rng.integers(0, len(x) + 1))], draw(int(rng.integers(0, len(x) // 2 + 2))))
            if not len(y):
                continue
            a, b = jaccard_join.sketch_of(x), jaccard_join.sketch_of(y)
            width = min(len(a), len(b))
            may = jaccard_join.may_link(jaccard_join.folded(a, width), jaccard_join.folded(b, width), len(x), len(y), percent)
            common = len(np.intersect1d(x, y))
            assert may or 100 * common < percent * (len(x) + len(y) - common)
            apart += not may
    assert apart > 60


def test_sets_of_chained_texts_stay(spark, monkeypatch):
    """200 texts that share a line, and nothing else but for three copies with a change, make one cluster; only sets of the likely ones are sent."""
    rng = random.Random(3)
    line = "all rights to these pages are kept by us"
    texts = [(k, line + " " + " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(3 + k % 5))) for k in range(200)]
    texts += [(1000 + k, f"{line} {' '.join(f'long{k}y{j}' for j in range(40))} end{k}" + " tail" * (k % 2)) for k in range(4)]
    texts += [(2000 + k, texts[200 + k][1] + " more") for k in range(3)]
    monkeypatch.setattr(jaccard_join, "FEW_CLASSES", 100)
    sent = []
    whole = jaccard_join.sets_of
    monkeypatch.setattr(jaccard_join, "sets_of", lambda docs, ids, n: sent.append(ids.count()) or whole(docs, ids, n))
    monkeypatch.setattr(jaccard_join, "word_ranks", lambda docs: np.zeros(1 << jaccard_join.CELLS_LOG2, np.uint8))  # so that common shingles are regions as well
    own = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(own, n=4, percent=85, large=8).collect()}
    assert got == {k: k - 1000 if 2000 <= k < 2003 else k for k, _ in texts}
    assert sum(sent) < 60


@pytest.mark.parametrize(("sketches", "tile"), [(7, 5), (2048, 256)])
def test_tiles_of_sketches(spark, monkeypatch, sketches, tile):
    """Clusters of many blocks and of several size bands, against all pairs."""
    rng = random.Random(8)
    texts, line = [], " ".join(f"s{j}" for j in range(9))
    for g in range(12):
        own = [f"g{g}w{j}" for j in range(15 + 12 * g)]
        for _ in range(6):
            changed = [w if rng.random() > 0.02 else f"n{rng.randrange(10**6)}" for w in own]
            texts.append((len(texts), line + " " + " ".join(changed)))
    monkeypatch.setattr(jaccard_join, "FEW_CLASSES", 0)
    real = jaccard_join.tiled_links
    seen = []
    monkeypatch.setattr(jaccard_join, "tiled_links", lambda *a: seen.append(1) or real(*a, tile=tile, sketches=sketches))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), n=4, percent=85, large=3).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    assert seen and got == {k: find(k) for k in range(len(texts))}
    assert len(set(got.values())) < len(texts)


def test_texts_that_stay_are_not_shuffled(spark, tmp_path):
    """Of 300 long texts two are copies; the rest are written where they lie."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.getrandbits(60):x}" for _ in range(300)), "en", "src", 0) for k in range(300)]
    rows += [(500, rows[0][1] + " end", "en", "src", 0), rows[1], (None, "no id", "en", "src", 0), (None, "no id", "en", "src", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    spark.sparkContext.setJobGroup("kept", "kept")
    kept = out.collect()
    spark.sparkContext.setJobGroup("other", "other")
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(r[0]), str(r[1])) for r in [*rows[:300], *rows[-2:]])
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("kept") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks]
    assert sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in ran) < 0.2 * sum(len(r[1] or "") for r in rows)


@pytest.mark.parametrize("few", [0, 21])
def test_holds(spark, monkeypatch, few):
    """Made by tasks or, of few hashes, on the driver."""
    monkeypatch.setattr(bloom, "FEW_LOG2_BITS", few)
    held = bloom.holds(spark.range(500).selectExpr("xxhash64(id)"))
    got = {r.id for r in spark.range(2000).filter(held(corpus_pipeline.F.xxhash64("id"))).collect()}
    assert set(range(500)) <= got and len(got) < 600
