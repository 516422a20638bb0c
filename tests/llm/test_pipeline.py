"""The pipeline over a small folder, each stage against a plain version of its rule on the same input."""

import random
import re

import corpus_pipeline
from quantity_jobs.llm import toxicity

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(30)
    rows = []
    for i in range(400):
        text = prose(rng.randrange(30, 90))
        if i % 5 == 0:
            text += " vile nasty foul"
        if i % 7 == 0:
            text += "\nSubscribe to our letter \n" + prose(20)
        if i % 11 == 0:
            text += " " + passage
        rows.append((i, text, "en", "src", len(text)))
    rows += [(1000 + k, rows[k][1] + " end", "en", "src", 0) for k in range(1, 30)]
    rows += [rows[3], (2000, None, None, None, None), (2001, "", "en", "src", 0), (None, "no id", "en", "src", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    docs = corpus_pipeline.table(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        seen[name] = docs.collect()
    clean = [r for r in seen["toxicity"]]
    assert not any("vile" in (r.text or "") for r in clean) and len(clean) > 0.75 * len(rows)
    lines = seen["line_dedup"]
    assert len(lines) == len(clean) and not any("Subscribe" in r.text for r in lines) and all(r.n_chars == len(r.text) for r in lines)

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in lines if r.doc_id is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    near = seen["jaccard_join"]
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted({find(i) for i in sets})
    assert sum(r.doc_id is None for r in near) == 1

    item = WORD.findall(passage)
    grams = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

    def contaminated(text):
        w, hit = WORD.findall(text.translate(LOWER)), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in grams:
                hit |= set(range(i, i + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = seen["decontamination"]
    assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(r.doc_id) for r in near if not contaminated(r.text))
    packed = seen["packing"]
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept}
    assert corpus_pipeline.run(spark, folder).count() == len(packed)
    assert toxicity.Ftrl().sample_rows >= 400
