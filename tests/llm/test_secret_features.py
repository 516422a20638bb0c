"""Features of the secret scan against plain Python, and a forest that learns from planted findings; revisits that tie."""

import random
import re
import string
import uuid
import zlib
from collections import Counter, defaultdict

from quantity_jobs.llm import secret_forest, warc

RUN = re.compile("[A-Za-z0-9+/=_.@-]{16,}")
LETTERS = string.ascii_letters + string.digits


def plain_features(rows, conf):
    """(id, position, piece) -> value and FEATURES, text by text."""
    in_docs = Counter(w for _, text, _ in rows for w in set(re.split("[^a-z]+", (text or "").lower())) if len(w) >= conf.word_letters)
    known = {w for w, n in in_docs.items() if n >= conf.word_docs}
    out = {}
    for doc, text, path in rows:
        words = re.split(r"[\x20\x09-\x0D]+", text or "")
        for position, raw in enumerate(words):
            found = list(RUN.finditer(raw))
            for piece, m in enumerate(found):
                value, n = m[0], len(m[0])
                gap = raw[found[piece - 1].end() if piece else 0 : m.start()]
                head = (found[piece - 1][0] if piece else "") + gap
                tail = raw[m.end() : found[piece + 1].start() if piece + 1 < len(found) else len(raw)]
                before, before2 = words[position - 1] if position else None, words[position - 2] if position > 1 else None
                after = (words[position + 1] if position + 1 < len(words) else None) if piece == len(found) - 1 else tail
                named = re.search("[A-Za-z0-9]", head) is not None
                near = " ".join([head, value] if named else [w for w in (before2, before, value) if w is not None]).lower()
                classes = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", value)))
                covered = sum(len(w) for w in re.split("[^a-z]+", value.lower()) if len(w) >= conf.word_letters and w in known)
                assigned = re.search("[=:][\"'`]*$", head) if named else re.search("[=:]$", before or "")
                out[doc, position, piece] = (value, {
                    "length": n, "turns": len(classes) / n, "digits": sum(c in string.digits for c in value) / n, "capitals": sum(c in string.ascii_uppercase for c in value) / n,
                    "distinct": len(set(value)) / n, "hexadecimal": bool(re.fullmatch("[0-9a-fA-F]+", value)), "covered": min(1, covered / n),
                    "example_path": any(p in (path or "").lower() for p in secret_forest.EXAMPLE_PATHS),
                    "keyword": bool(re.search(rf"(^|[^a-z0-9])({'|'.join(secret_forest.KEYWORDS)})([^a-z0-9]|$)", near)),
                    "assigned": bool(assigned) or bool(re.match("[A-Za-z_][A-Za-z0-9_]*=[^=]", value)), "quoted": bool(re.search("[\"'`]$", head)) or tail[:1] in ("\"", "'", "`"),
                    "address": "@" in value or bool(re.fullmatch(r"\d+([.]\d+)+", value)), "next_alpha": bool(re.match("[a-z]", after or "")),
                })
    return out


def test_features_against_plain_python(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choices(LETTERS, k=n))
    forms = [
        lambda: f'token = "{key(40)}"', lambda: f"API_KEY={key(24)}", lambda: f"https://www.example.com/path/to/{key(8)}?id={key(20)}", lambda: f"user.name.long@mail.example.com", lambda: f'{{"id":"{key(18)}","secret":"{key(30)}"}};',
        lambda: "configuration_of_the_database_connection", lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: "Bearer " + key(33), lambda: "1.22.333.4444.55555.6", lambda: "=" * 20, lambda: "password: '" + key(17) + "'",
    ]
    rows = []
    for i in range(90):
        words = [rng.choice(["the", "Data", "of", "connection", "database", "x:", "key", "=", "path"]) for _ in range(rng.randrange(12))]
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice(forms)())
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["src/app.py", "tests/Example.py", None])))
    rows += [(900, None, "a"), (901, "", None)]
    conf = secret_forest.Forest()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = plain_features(rows, conf)
    got = {(r.doc_id, r.position, r.piece): r for r in secret_forest.scan(df, conf=conf).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    for place, (value, features) in want.items():
        assert got[place].value == value
        assert {f: round(float(got[place][f]), 9) for f in secret_forest.FEATURES} == {f: round(float(features[f]), 9) for f in secret_forest.FEATURES}, (place, value)


def planted(rng, true):
    """A finding of a kind that can be checked (prefix and checksum, key pairs, tokens of three parts), or what looks like one: ids, digests, paths, names."""
    key = lambda n: "".join(rng.choices(LETTERS, k=n))
    if true:
        body = key(30)
        value = rng.choice([f"ghx_{body}{zlib.crc32(body.encode()):08x}", f"AK{key(18)}:{key(40)}".replace(":", "."), f"eyJ{key(20)}.eyJ{key(40)}.{key(43)}", key(40)])
        return rng.choice([f'token = "{value}"', f"API_KEY={value}", f"password: {value}", f"Authorization: Bearer {value}", f"use {value} to log in"])
    hexa = "%040x" % rng.getrandbits(160)
    return rng.choice([f"commit {hexa} of the branch", f'"integrity": "sha256-{hexa}"', f"id = {uuid.UUID(int=rng.getrandbits(128))}", "see documentation/getting-started/installation.html for", "com.example.application.configuration.Settings", f'token = "{"x" * 24}"', "key = your_secret_key_goes_here_please", f"https://cdn.example.com/assets/{hexa[:20]}.png"])


def test_forest_on_planted_findings(spark):
    """Labels come from the planting, not from a rule over the features; precision and recall on documents that the forest hasn't seen."""
    rng = random.Random(11)
    rows, truth = [], {}
    for i in range(3000):
        true = rng.random() < 0.4
        words = [rng.choice(["the", "data", "of", "and", "value", "is", "set", "documentation", "example", "configuration", "application"]) for _ in range(20)]
        text = " ".join([*words[: rng.randrange(20)], planted(rng, true), *words[: rng.randrange(1, 9)]])
        rows.append((i, text, rng.choice(["src/app.py", "tests/app.py", "conf/env"])))
        truth[i] = int(true)
    places = plain_features(rows, secret_forest.Forest())
    labels = [(doc, position, piece, truth[doc]) for doc, position, piece in places if zlib.crc32(str(doc).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labelled = spark.createDataFrame(labels, "doc_id long, position long, piece int, label int")
    tally = defaultdict(int)
    for r in secret_forest.scan(df, labelled).collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            tally[truth[r.doc_id], r.kept] += 1
    precision, recall = tally[1, True] / (tally[1, True] + tally[0, True]), tally[1, True] / (tally[1, True] + tally[1, False])
    print(f"held-out findings {sum(tally.values())}, precision {precision:.3f}, recall {recall:.3f}")
    assert sum(tally.values()) > 500 and precision > 0.9 and recall > 0.9


def test_revisit_ties(spark):
    """Responses of one time and id: which one counts follows from what they say, in any order of the rows; header names that differ in case only."""
    schema = "capture_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>, payload_digest string"
    rows = [(1, "http://a.com/x", 5, 200, "t", None, {"X": "1", "date": "old"}, f"p{k}") for k in range(6)]
    rows += [(2, "http://a.com/x", 9, 304, "t", None, {"Date": "d1", "date": "d2", "Vary": "v"}, None)]
    out = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        r = warc.resolve_revisits(spark.createDataFrame(rows, schema).repartition(3)).filter("status = 304").first()
        out.add((r.payload_digest, tuple(sorted(r.headers.items()))))
    assert len(out) == 1 and next(iter(out))[1] == (("Vary", "v"), ("X", "1"), ("date", "d2"))
