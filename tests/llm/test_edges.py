"""Cases that once went wrong in the training-data operators: clashing names, repeated rows and ids, hot keys, other tokenizers."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quantity_jobs.llm import decontam, jaccard_join, line_dedup, lm_scores, near_vectors, packing, secret_forest, sharding, shared, toxicity, warc

#: Names that the operators use inside.
INTERNAL = ["own", "kept", "hits", "canonical", "slice", "full", "near", "far", "base", "__text", "__id", "text_hash", "id", "key", "label", "places", "block", "grp", "score_", "drop_id", "hot", "capture"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in INTERNAL if c not in df.columns})


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nshared line" if i % 2 else None) for i in range(40)], "doc_id long, text string")
    wide = clashing(docs)
    plain = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    for keep in ("none", "first"):
        for most in (line_dedup.BROADCAST_BYTES, -1):
            out = line_dedup.dedup_lines(wide, keep=keep, broadcast_bytes=most)
            assert out.columns == [*wide.columns, "n_lines", "n_dropped"] and out.count() == 40
            if keep == "none":
                assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()} == plain
            else:
                assert sorted(r.doc_id for r in out.collect() if "shared line" in r.text) == [1]
    scored = toxicity.score(wide, {3: 1.0})
    assert scored.columns == [*wide.columns, "score"] and scored.filter("own = 'x' AND kept = 'x'").count() == 40
    captures = spark.createDataFrame([(1, "http://a.com", 1, 200, "t", None, {"Date": "d1", "X": "1"}, "p"), (2, "http://a.com", 2, 304, "t", None, {"date": "d2"}, None)], "capture_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload_digest string")
    out = {r.capture_id: r for r in warc.resolve_revisits(clashing(captures)).collect()}
    assert out[2].source_id == 1 and out[2].canonical == "a.com" and out[2].own == "x"
    # header names differ in case only
    assert out[2].headers == {"X": "1", "date": "d2"}
    for f in (sharding.pack_shards, lm_scores.lm_scores, jaccard_join.jaccard_components):
        assert f(wide).count() == 40
    assert packing.pack_documents(wide, public_tokenizers.path("word_bpe_49k.json")).count() == 40
    bench = clashing(spark.createDataFrame([(1, "line 3")], "item_id long, text string"))
    assert decontam.decontaminate(wide, bench).filter("contaminated").count() == 1


def test_line_join_of_hot_keys(spark, monkeypatch):
    """Hot keys are joined in parts; the outcome is that of the keys sent to all tasks."""
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 20)
    rng = random.Random(1)
    rows = [(i % 90, "\n".join([f"own {i}", *rng.sample(["The same ", "the same", "Other", f"few {i % 30}", ""], 3)])) for i in range(120)] + [(None, "the same\nOther")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        one, two = (Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, keep=keep, min_docs=4, broadcast_bytes=b).collect()) for b in (1 << 20, -1))
        assert sum(one.values()) == 123
        if keep == "none":
            assert one == two
        else:  # rows of one id: which of them keeps a line follows from the id alone
            assert one == two


def test_line_min_chars(spark):
    rows = [(i, "ab\nabc\nÉÀ\nÉÀÎ") for i in range(12)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=3).collect()
    assert {(r.text, r.n_dropped) for r in out} == {("ab\nÉÀ", 2)}


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"copy {i % 3}") for i in range(3000)] + [(i, "x") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    sample, _ = toxicity.labelled_sample(docs, labels, toxicity.Ftrl(sample_rows=10), "doc_id", "text", "toxic")
    assert sample.count() == sample.select("id").distinct().count() <= 30


def plain_ftrl(rows, conf):
    """FTRL-proximal, one coordinate at a time."""
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= conf.l1 else -(z[k] - np.sign(z[k]) * conf.l1) / ((conf.beta + np.sqrt(n[k])) / conf.alpha + conf.l2)
    for _ in range(conf.rounds * conf.epochs):
        for places, label in rows:
            w = {k: weight(k) for k in places}
            p = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35)))
            g = p - label
            for k in places:
                sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / conf.alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z if weight(k)}


def test_toxicity_against_plain_ftrl(spark):
    rng = random.Random(3)
    conf = toxicity.Ftrl(bits=16, rounds=2, epochs=2)
    rows = []
    for i in range(150):
        t = [rng.choice(["sun", "moon", "star", "tree", "rock"]) for _ in range(rng.randrange(0, 12))] + (["vile"] if i % 3 == 0 else [])
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.fit(df, df, conf)
    import pyarrow as pa
    import xxhash

    turn = lambda i: xxhash.xxh3_64_intdigest(str(i).encode()) >> 1
    listed = []
    for i, text, label in sorted(rows, key=lambda r: turn(r[0])):
        _, places = toxicity.features(pa.array([text]), conf.bits)
        listed.append(([*dict.fromkeys(places.tolist()), 1 << conf.bits], label))
    want = plain_ftrl(listed, conf)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    weights = got
    for r in toxicity.score(df, weights, conf).collect():
        _, places = toxicity.features(pa.array([r.text]), conf.bits)
        x = weights.get(1 << conf.bits, 0.0) + sum(weights.get(k, 0.0) for k in set(places.tolist()))
        assert r.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-12)


def test_slop_limits(spark):
    filler = " ".join(f"filler{k}" for k in range(40))
    near = lambda gap: "rareone " + " ".join(filler.split()[: gap + 1]) + " raretwo end"
    docs = spark.createDataFrame([(g, near(g)) for g in (0, 5, 6, 7, 10)] + [(99, filler)] * 30, "doc_id long, text string")
    bench = spark.createDataFrame([("a-1", "rareone filler0 raretwo")], "item_id string, text string")
    got = {r.doc_id: len(r.near) for r in decontam.decontaminate(docs, bench, slop=6).collect()}
    assert {k: bool(v) for k, v in got.items()} == {0: False, 5: True, 6: True, 7: False, 10: False, 99: False}


def test_item_types(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    for kind in ("smallint", "date", "struct<a:int>", "string"):
        items = docs.select(F.lit(None).cast(kind).alias("name"), F.col("text").alias("body"))
        out = decontam.decontaminate(docs, items.withColumnRenamed("name", "item_id").withColumnRenamed("body", "text")).first()
        assert len(out.phrases) == 1 and out.n_hit == 3


def test_sharding_splits_one_id(spark):
    rows = [(7, "the same text of all")] * 4000 + [(i, f"text {i}") for i in range(400)]
    out = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, per_task=1000).collect()
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    assert len(out) == 4400 and len(loads) == 8 and max(loads.values()) < 1.05 * min(loads.values())


def test_sharding_of_groups_longer_than_a_block(spark):
    """Groups of several blocks and batches in one task stay in one shard; those above a task's rows are split and stay level."""
    rows = [(k, f"group {k // 300}") for k in range(3000)] + [(k, f"text {k}") for k in range(3000, 4000)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        whole = sharding.pack_shards(df, shards=4, per_task=1500, whole=0.5, block=100).collect()
        split = sharding.pack_shards(df, shards=4, per_task=100, whole=0.5, block=50).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for out in (whole, split):
        assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 4
    shards = {}
    for r in whole:
        if r.doc_id is not None and r.doc_id < 3000:
            shards.setdefault(r.doc_id // 300, set()).add(r.shard)
    assert len(shards) == 10 and all(len(x) == 1 for x in shards.values())
    loads = Counter()
    for r in split:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_revisits_of_a_burst(spark):
    """All captures of one URL within one second, over several slices; null times come first, repeated ids are captures of their own."""
    rows = [(i, "http://a.com/x", i // 50, 200 if i % 10 == 0 else 304, f"t{i // 10}", None, None, f"p{i}") for i in range(300)]
    rows += [(1000, "http://a.com/x", None, 304, "t0", None, None, None), (5, "http://a.com/x", 0, 304, "t0", None, None, None)]
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload_digest string")
    for per_slice in (7, 40, 10_000):
        out = warc.resolve_revisits(df.repartition(5), per_slice).collect()
        assert len(out) == 302
        assert all(r.source_id == r.capture_id // 10 * 10 for r in out if r.outcome == "resolved") and sum(r.outcome == "resolved" for r in out) == 271
        assert [r.outcome for r in out if r.capture_id == 1000] == ["orphan"]


def test_secrets_of_repeated_rows(spark):
    rows = [(None, "alpha token: alphabetagammadelta99", "a")] * 3 + [(i, "alpha beta gamma delta", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secret_forest.scan(df).collect()
    assert len(out) == 3 and len({(r.covered, r.length) for r in out}) == 1 and out[0].covered <= 1
    one = secret_forest.scan(df.filter("doc_id IS NOT NULL").union(df.filter("doc_id IS NULL").limit(1))).collect()
    assert one[0].covered == out[0].covered


def test_other_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Hello  World\n of tabs\t", "a" * 50 + " É", "the end. The END"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in packing.pack_documents(docs, path, with_ids=True).collect()}
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_tokens_over_many_runs(spark, monkeypatch):
    """Long texts, several batches and runs, and a table that starts anew."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "RUN_BYTES", 3000)
    monkeypatch.setattr(packing, "TABLE_BYTES", 20_000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéüßÉİ1'.-,!<|") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 60, 4000]))) for _ in range(40)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(list(range(k, k + 10))), pa.array(texts[k : k + 10])], ["id", "text"]) for k in range(0, 40, 10)]
    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    tok, found = Tokenizer.from_file(path), []
    for _, ids, sizes in packing.tokenized(iter(batches), vocabulary, 1):
        found += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert found == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_lm_scores_over_many_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(1, "a b c")] * 50, "doc_id long, text string").cache()
    one = Counter((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in lm_scores.lm_scores(docs).collect())
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", 1500)
    assert Counter((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in lm_scores.lm_scores(docs).collect()) == one


def test_vectors_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, None, 1), (2, [1.0, 0.001], 1), (3, [0.001, 1.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    runs = [sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in near_vectors.near_vectors(df.repartition(k)).collect()) for k in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 4 and [n for _, n, _ in runs[0]].count(1) == 2


def test_jaccard_struct_ids_and_repeats(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words), (1, "quite another text of one id here"), (2, words + " end"), (None, words), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    out = jaccard_join.jaccard_components(df, id_col="key").collect()
    assert len(out) == 6
    groups = {(r.key.doc_id, r.key.h): (r.component_id.doc_id, r.component_id.h) for r in out}
    assert len(set(groups.values())) == 3  # the copies, the other text, the empty ones


def test_pipeline_keeps_texts_of_one_id(spark):
    one, two = (" ".join(f"{letter}{k}" for k in range(40)) for letter in "ab")
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (2, one, "en", "s", 1), (None, "c " * 20, "en", "s", 1), (None, one + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text[:2]) for r in kept) == [("1", "b0"), ("None", "a0"), ("None", "c ")]


def test_pipeline_drops_contaminated_without_id(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, passage + " x", "en", "s", 1), (None, "clean text", "en", "s", 1), (5, "y", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == ["clean text", "y"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    """A text over many runs of work."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(400_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[200_000:200_020]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert got[1].n_words == 400_000 and got[1].n_hit == got[2].n_hit == 20 and got[3].n_hit == 0
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    out = {r.doc_id: r for r in lm_scores.lm_scores(docs).collect()}
    assert out[1].n_words == 400_000
    cut = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in cut) and len(cut) == 3


def test_split_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 8)
    left = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(600)], "key string, id long")
    right = spark.createDataFrame([(k, x) for k in ("hot", "k3", "k9", None, "none") for x in range(3)], "key string, x int")
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "id", "x").collect())
    out = shared.split_join(left, right, "key", "id", least=10)
    assert rows(out) == rows(left.join(right, "key"))
    assert shared.split_join(left.limit(0), right, "key", "id").count() == 0


def test_items_of_one_common_word(spark, monkeypatch):
    """An item of one word that nearly every document has: its postings and its candidates are split."""
    monkeypatch.setattr(shared.split_join, "__defaults__", (20,))
    texts = [None, ""] + [f"the text {i} of The house" if i % 9 else "no such word" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("a", "THE"), ("b", "text 5 of"), ("c", "a house"), ("d", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.decontaminate(docs, bench).collect()}
    for i, text in enumerate(texts):
        common = "the" in (text or "").lower().split()
        five = "text 5 of" in (text or "")
        assert got[i] == (2 * common + 3 * five, ["a"] * common + ["b"] * five)


def test_helpers():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([None, "", " a  B ", "x" * 50, "é!", "a b c d e"])], ["text"])
    for most in (1, 20, 1000):
        runs = list(shared.text_runs(batch, "text", most))
        assert sum(len(t) for _, t in runs) == 6 and [f for f, _ in runs] == sorted({f for f, _ in runs})
        hashes, counts = zip(*(shared.hashed_words(t, shared.WORD_BYTES) for _, t in runs), strict=True)
        assert np.concatenate(counts).tolist() == [0, 0, 2, 1, 1, 5]
        shingles, sizes = shared.run_shingles(np.concatenate(hashes), np.concatenate(counts), 3)
        assert sizes.tolist() == [0, 0, 1, 1, 1, 3] and len(set(shingles.tolist())) == 6
    assert zlib.crc32(b"1") >= 0
