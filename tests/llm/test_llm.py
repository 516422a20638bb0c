"""The training-data operators against brute force on small tables with the cases that break things."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantity_jobs.llm import decontam, jaccard_join, line_dedup, lm_scores, near_vectors, packing, secret_forest, sharding, toxicity, warc
from quantity_jobs.llm.components import components
from quantity_jobs.llm.queries import TOKENIZER

WORDS = "alpha beta gamma delta Épsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def texts(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    near = [t.replace(" ", "  ", 1) + " tail" for t in base[:8]]
    lined = ["Shared Line of many\n" + t + "\n \t\n shared line of MANY " for t in base[:12]]
    return [None, "", " \n ", "x", "A b c", *base, *base[:3], *near, *lined, "w " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, f"d{i}") for i, t in enumerate(texts())]
    rows += [rows[7], (None, "null id text", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, term string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_decontam(rows, items, window=13):
    out = []
    for r in rows:
        w, hit, ids = words(r.text), set(), set()
        for item, text in items:
            iw = words(text)
            k = min(window, len(iw))
            grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
        out.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, empty):
    rows = docs.collect()
    long = [r.text for r in rows if r.text and len(words(r.text)) > 60]
    items = [(1, long[0]), (2, " ".join(words(long[1])[5:25])), (3, "A b c"), (4, None), (5, "!!"), (6, "x"), (2, "w w w w w w w w w w w w w w"), (7, "absent words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontamination_digest(docs, bench)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_decontam(rows, items)
    assert decontam.decontamination_digest(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.decontamination_digest(docs, bench.filter("false")).collect()} == {0}


def test_proximity(spark):
    text = "one rare2 filler words in between rare9 end"
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one rare2 in rare9")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench, slop=6).collect()}
    assert got[1].near and not got[1].phrases and not got[2].near


def test_line_dedup(docs, empty):
    rows = docs.collect()
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for r in rows for k in {strip(x) for x in (r.text or "").split("\n")} if k)
    bad = {k for k, n in seen.items() if n >= 10}
    assert bad
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if strip(x) not in bad]
        want.append((r.doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted((tuple(r) for r in line_dedup.line_digest(docs).collect()), key=repr) == sorted(want, key=repr)
    first = line_dedup.dedup_lines(docs, keep="first", min_docs=10)
    assert first.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sum(strip(x) in bad for r in first.collect() for x in r.text.split("\n")) == len(bad)
    assert line_dedup.line_digest(empty).count() == 0


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == brute_components({i for x in links for i in x}, links)


@pytest.mark.parametrize(("tail", "run"), [(0, 7), (0, 250_000), (50_000, 7), (660, 250_000)])
def test_components_in_runs(spark, tail, run):
    """By rounds and by one task, from forests of runs of any length."""
    rng = random.Random(4)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(420)] + [(k, k + 1) for k in range(1000, 1100)] * 2
    links += [(5000, k) for k in range(4950, 5100)] + [(None, 1), (2, None), (7777, 7777)]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5), tail=tail, run=run).collect()
    links = [x for x in links if None not in x and x[0] != x[1]]
    want = brute_components({i for x in links for i in x}, links)
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), tail=tail).count() == 0


def test_jobs_of_components_and_jaccard(spark):
    """The driver holds something of every job; a long path took ten jobs a round, some 110 in all, and this join 200."""

    def jobs(name, make):
        spark.sparkContext.setJobGroup(name, name)
        rows = make().collect()
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), rows

    path = spark.createDataFrame([(k, k + 1) for k in range(1000)], "a long, b long")
    n, rows = jobs("path", lambda: components(path))
    assert n <= 12 and {r.component for r in rows} == {0} and len(rows) == 1001
    rng, texts = random.Random(6), []
    for g in range(6):
        own = [f"g{g}w{k}" for k in range(80)]
        for k in range(25):
            texts.append((len(texts), " ".join(own)))
            own = [*own]
            own[rng.randrange(80)] = f"g{g}n{k}"
    n, rows = jobs("copies", lambda: jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), n=4, percent=85))
    assert n <= 130 and len(rows) == 150 and len({r.component_id for r in rows}) < 150


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(docs, empty, n, percent):
    own = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets = {}
    for r in own.collect():
        w = re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(LOWER))
        k = min(n, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = brute_components(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(own, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}
    assert len(set(comp.values())) < len(ids)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == docs.count()


def test_jaccard_chains(spark):
    """Groups of many near copies that drift, so that ends of a group aren't similar."""
    rng, rows = random.Random(5), []
    for g in range(6):
        own = [f"g{g}w{k}" for k in range(80)]
        for k in range(25):
            rows.append((len(rows), " ".join(own)))
            own = [*own]
            own[rng.randrange(80)] = f"g{g}n{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(77)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    for large in (1, 48):  # nearly all in tiles, and nearly none
        assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, n=4, percent=85, large=large).collect()} == want


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        t = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "nasty", "foul"]))
        rows.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int"))
    got = toxicity.toxicity_scores(df.drop("toxic"), labels).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    conf = toxicity.Ftrl()
    weights = toxicity.fit(df.drop("toxic"), labels, conf)
    assert 0 < len(weights) < 2000
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.filter("false")).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.score(docs, weights).columns == [*docs.columns, "score"]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rows = docs.collect()
    odd = ["İstanbul ﬁn ΑΣ. Ǆ", "a1b2.c,d!? <|endoftext|> it's IT'S don’t ÉCOLE, école. naïve; x,, (y), 12:30", "数 学, русский. é é́"]
    spark = docs.sparkSession
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = packing.pack_documents(more, TOKENIZER, window=64, with_ids=True).collect()
    want = defaultdict(list)
    for i, t in [(r.doc_id, r.text) for r in rows] + [(900 + i, t) for i, t in enumerate(odd)]:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert by_doc.keys() == want.keys()
    for i, lists in want.items():
        own = sorted(by_doc[i], key=lambda r: r.start)
        for ids in lists:
            starts = {r.start: r for r in own}
            assert sum((starts[s].ids for s in sorted(starts)), []) == ids
        assert len(own) == sum(math.ceil(len(x) / 64) for x in lists) and all(r.doc_tokens == len(lists[0]) for r in own)
    for own in seqs.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.packing_digest(empty, TOKENIZER).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    fit = packing.BestFit(100)
    sequences, offsets = (a + b for a, b in zip(fit.place(lengths[:150]), fit.place(lengths[150:]), strict=True))
    room, made = {}, 0
    for n, s, o in zip(lengths, sequences, offsets, strict=True):
        fitting = [r for r in room.values() if r >= n]
        if fitting:
            assert room[s] == min(fitting)
        else:
            assert s not in room
            room[s] = 100
        assert o == 100 - room[s]
        room[s] -= n


def test_sharding(docs, empty, spark):
    rng = random.Random(4)
    rows = [(i, "copy " * 20 if i % 3 == 0 else "t" * rng.randrange(1, 400) + str(i)) for i in range(3000)]
    got = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, per_task=700).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].encode()) + 16 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.sharding_digest(docs).count() == docs.count()
    assert sharding.sharding_digest(empty).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, 2):
        for _ in range(120):
            c = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 4))):
                rows.append((c + 0.12 * rng.standard_normal(16), label))
    centre = rng.standard_normal(16)
    rows += [(centre + 0.05 * rng.standard_normal(16), 1) for _ in range(90)] + [(centre, 1)] * 30
    table = [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, table[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    x = np.array([t[1] for t in table[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([t[2] for t in table[:n]])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    comp = brute_components(range(n), [tuple(p) for p in np.argwhere(np.triu(near)).tolist()])
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, near_vectors.Descent(tile=40)).collect()}
    assert sorted(got) == list(range(n + 7))
    found, true = sum(got[i].n_links for i in range(n)), int(near.sum())
    assert 0.97 * true <= found <= true
    assert np.mean([got[i].component_id == comp[i] for i in range(n)]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 7))
    assert near_vectors.near_vectors(df.filter("false")).count() == 0


def exact_vectors(rows, threshold=0.93):
    """n_links and components of (vector, label) rows, by brute force."""
    x = np.array([v for v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([label for _, label in rows])
    near = (x @ x.T >= threshold) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    comp = brute_components(range(len(rows)), [tuple(p) for p in np.argwhere(np.triu(near)).tolist()])
    return near.sum(axis=1), comp


def two_groups(rng, size, cosine, dim=32):
    """Two tight groups whose members are at about that cosine."""
    basis = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    other = cosine * basis[0] + np.sqrt(1 - cosine * cosine) * basis[1]
    return [c + 0.003 * rng.standard_normal(dim) for c in (basis[0], other) for _ in range(size)]


def test_near_vectors_between_groups(spark):
    """Links between dense groups, and between them and single vectors, are all found, and the groups join."""
    rng = np.random.default_rng(5)
    rows = [(v, 1) for v in two_groups(rng, 60, 0.95)]
    bridge = rows[0][0] + 0.9 * (rows[0][0] - rows[60][0])
    rows += [(bridge, 1), (rows[0][0], 2)] + [(v, 1) for v in two_groups(rng, 20, 0.94)] + [(rng.standard_normal(32), 1) for _ in range(200)]
    df = spark.createDataFrame([(i, [float(z) for z in v], label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    n_links, comp = exact_vectors(rows)
    assert comp[60] == 0 and n_links[0] >= 119
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, near_vectors.Descent(tile=16)).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(rows))] == [(n_links[i], comp[i], comp[i] == i) for i in range(len(rows))]


def test_near_vectors_missed_target(spark, monkeypatch):
    """Where the descent finds nothing, the audit sees it and the links still come out whole."""
    rng = np.random.default_rng(6)
    rows = [(c + 0.03 * rng.standard_normal(16), 1) for c in rng.standard_normal((300, 16)) for _ in range(2)]
    df = spark.createDataFrame([(i, [float(z) for z in v], label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    n_links, comp = exact_vectors(rows)
    some = near_vectors.measured
    monkeypatch.setattr(near_vectors, "measured", lambda *a: some(*a).filter("a % 4 = 0"))
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, near_vectors.Descent(rounds=1)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == [(n_links[i], comp[i]) for i in range(len(rows))]


def test_lm_scores(docs, empty):
    for order in (2, 3):
        rows = docs.collect()
        lists = [words(r.text) for r in rows]
        c = Counter(tuple(w[i : i + n]) for w in lists for n in range(1, order + 1) for i in range(len(w) - n + 1))
        total = sum(map(len, lists))

        def s(gram):
            if len(gram) == 1:
                return math.log10(c[gram] / total)
            if c[gram] >= 2:
                return math.log10(c[gram] / c[gram[:-1]])
            return math.log10(0.4) + s(gram[1:])

        want = [(r.doc_id, len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for r, w in zip(rows, lists, strict=True)]
        got = sorted((tuple(r) for r in lm_scores.lm_scores(docs, order=order).collect()), key=repr)
        for a, b in zip(got, sorted(want, key=repr), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)
    assert lm_scores.lm_scores(empty).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x/", 1, 200, "t1", None, {"date": "d1", "server": "s"}, "p1"),
        (2, "https://www.A.com/x?utm_source=q#f", 5, 304, 'W/t1', None, {"date": "d2", "server": "z"}, None),
        (3, "http://a.com/x", 6, 304, "t9", None, {}, None),
        (4, "http://a.com/x", 0, 304, "t1", None, {}, None),
        (5, None, 3, 304, "t1", None, None, None),
        (6, "http://a.com/x", 7, 200, None, "lm", None, "p6"),
        (7, "http://a.com/x", 9, 304, "t1", "lm", None, None),
        (8, "http://a.com/x", None, 304, "t1", "lm", None, None),
    ]
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload_digest string")
    for per_slice in (1, 50_000):
        got = {r.capture_id: r for r in warc.resolve_revisits(df, per_slice).collect()}
        assert {k: r.outcome for k, r in got.items()} == {1: "response", 2: "resolved", 3: "mismatch", 4: "orphan", 5: "orphan", 6: "response", 7: "resolved", 8: "orphan"}
        assert got[2].source_id == 1 and got[2].payload_digest == "p1" and got[2].headers == {"date": "d2", "server": "s"}
        assert got[7].source_id == 6 and got[7].headers == {}
    assert warc.resolve_revisits(df.filter("false")).count() == 0


def test_secrets(spark, docs, empty):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(20)]
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        w.insert(10, {0: f'token = "{value}"', 1: "9807915762804490", 2: f"alpha.beta{i}@mail.example.com", 3: "alphabetagammadeltaalpha"}[i % 4])
        rows.append((i, " ".join(w), "src" if i % 2 else "tests/a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_forest.scan(df).collect()
    assert len(got) == 400
    assert np.mean([r.kept == (r.doc_id % 4 == 0) for r in got]) > 0.97
    labelled = spark.createDataFrame([(r.doc_id, r.position, int(r.doc_id % 4 == 2)) for r in got[:200]], "doc_id long, position long, label int")
    assert np.mean([r.kept == (r.doc_id % 4 == 2) for r in secret_forest.scan(df, labelled).collect()]) > 0.9
    assert secret_forest.secret_digest(empty).count() == 0
    assert secret_forest.secret_digest(docs).columns == ["doc_id", "position", "value_sha256", "probability", "kept"]


def test_secret_pieces(spark):
    """Every long run of a word is a candidate with its own surroundings."""
    one, two = "a1B2c3D4e5" * 4, "f6G7h8I9j0" * 4
    texts = [f'AWS_SECRET_ACCESS_KEY="{one}"', f'{{"id":"{two[:24]}","api_key":"{one}"}}', f"x https://long-host.example.com/path?token={one}", f"{one};{two}"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.position, r.piece): r for r in secret_forest.scan(df).collect()}
    values = {k: r.value for k, r in got.items()}
    assert values == {
        (0, 0, 0): "AWS_SECRET_ACCESS_KEY=", (0, 0, 1): one, (1, 0, 0): two[:24], (1, 0, 1): one, (2, 1, 0): "//long-host.example.com/path", (2, 1, 1): f"token={one}", (3, 0, 0): one, (3, 0, 1): two,
    }
    flags = {k: (r.keyword, r.assigned, r.quoted) for k, r in got.items()}
    assert flags[0, 0, 1] == flags[1, 0, 1] == (1, 1, 1) and flags[1, 0, 0] == (0, 1, 1) and flags[2, 1, 1] == (1, 1, 0) and flags[3, 0, 1] == (0, 0, 0)
    assert secret_forest.secret_digest(df).count() == 8


def test_secret_forms(spark):
    """Secrets without quotes count as true findings; unclear values are not judged."""
    rng = random.Random(4)
    hexa = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    forms = [lambda: f"PASSWORD={hexa()}", lambda: f"api_key: {hexa()}", lambda: f"Authorization: Bearer {hexa()}", lambda: f"export MY_TOKEN={hexa()}", lambda: f"token: eyJ{hexa(12)}.eyJ{hexa(30)}.{hexa(20)}", lambda: f'token = "{hexa()}"']
    noise = [lambda: "9807915762804490", lambda: f"alpha.beta{rng.randrange(99)}@mail.example.com", lambda: "alphabetagammadeltaalpha", lambda: "www.long-host.example.com/path"]
    rows = [(i, f"alpha beta {(forms[i // 2 % 6] if i % 2 else noise[i // 2 % 4])()} gamma delta", "src") for i in range(480)]
    got = secret_forest.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy((F.col("doc_id") % 2).alias("secret"), (F.floor(F.col("doc_id") / 2) % 6).alias("form")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect():
        assert r.kept > 0.95 if r.secret else r.kept < 0.05, r
    found = [("a1" * 20, 0, 0, 0, 0), ("a1" * 20, 0, 0, 1, 0), ("a1" * 20, 0, 1, 0, 0), ("a1" * 20, 1, 0, 0, 0), ("a1.b" * 10, 0, 0, 1, 0), ("a1.b" * 10, 1, 0, 0, 0), ("1" * 20, 1, 1, 1, 0)]
    rules = spark.createDataFrame(found, "value string, quoted int, assigned int, keyword int, address int").filter("crc32(cast(value AS binary)) % 10 <> 0")
    expected = {found[0][:4]: None, **{f[:4]: 1 for f in found[1:4]}, found[4][:4]: None, found[5][:4]: 0, found[6][:4]: 0}
    judged = {(r.value, r.quoted, r.assigned, r.keyword): r.label for r in rules.withColumn("label", secret_forest.rule_labels()).collect()}
    assert len(judged) >= 4 and all(expected[k] == v for k, v in judged.items())
