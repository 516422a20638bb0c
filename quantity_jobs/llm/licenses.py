"""Licence scan by a positional index of licence templates; DataFrame and SQL functions only.

The index holds, for every word of the templates, its places in them and, counted over the whole corpus, its inverse document frequency. Of each template
a file's own rarest words are looked up; each occurrence says where the template would have to start, and the starts that these words agree on,
up to a few words inserted or left out, are candidates. A candidate counts once every mandatory phrase of the template stands where the template has it,
word by word, and enough of the template's weight does. Base phrases are templates whose every word is looked up and must stand exactly, so that all their places are found.

Nothing is shuffled but the counts of the templates' words: a file's words are looked up where they lie, in arrays, and a file that
lacks a word of every template's mandatory phrases only has its words counted.

Words are runs of letters and digits, A-Z lower-cased; bytes beyond ASCII count as letters. Defined results: null and empty texts have no words and no
matches; each row is a file, also when rows or ids repeat or are null; one place can match several templates; without templates nothing
matches; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever stands between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

NONE = "cast(array() AS array<struct<label: string, start: int, share: double, base: boolean>>)"


@dataclass(frozen=True)
class Template:
    """A label, the words of a notice, and the phrases in it that must stand as they are; base: the notice itself, exactly."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def keys(self) -> list[tuple[int, list[str]]]:
        """(place in the notice, words) of the mandatory phrases."""
        own, out = self.words(), []
        for phrase in self.phrases or (self.text,):
            words = phrase.split()
            out.append((next(i for i in range(len(own)) if own[i : i + len(words)] == words), words))
        return out


#: Phrases and labels of the base.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Sentences of public licences, and what must stand in them.
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("free software", "under the terms of the gnu general public license"),
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Scan:
    #: So many of a template's words that the file has, rarest first, must agree on where it starts.
    lookups: int = 3
    #: By how many words a place may be off in notices (never in base phrases and mandatory phrases).
    slack: int = 2
    #: Share of a template's weight that must stand where it belongs.
    least_share: float = 0.5


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words()})


def known_words(texts: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(id, n_words, known, hits) of (id, text): the distinct words of the templates that a text has, and, where it has all the words that some template
    demands, each of these words with its place."""
    demanded = {frozenset(w for _, key in t.keys() for w in key) for t in templates}
    demanded = sorted((sorted(d) for d in demanded if not any(other < d for other in demanded)), key=len)
    raw = texts.select("id", F.split("text", GAP, -1).alias("raw"))
    # a text that begins or ends with a gap has an empty piece there
    counted = raw.selectExpr("id", "raw", "int(get(raw, 0) = '') AS lead", "int(size(raw) > 1 AND element_at(raw, -1) = '') AS trail")
    # lower() is fast and takes more than A-Z, so what it finds is looked at again
    loose = f"transform(raw, (x, i) -> if(lower(x) IN ({_quoted(vocabulary(templates))}), named_struct('word', translate(x, '{UPPER}', '{LOWER}'), 'at', i - lead), NULL))"
    hits = f"filter(filter({loose}, h -> h IS NOT NULL), h -> h.word IN ({_quoted(vocabulary(templates))}))"
    found = counted.selectExpr("id", "bigint(size(raw) - lead - trail) AS n_words", f"{hits} AS hits")
    known = found.selectExpr("*", "array_distinct(transform(hits, h -> h.word)) AS known")
    enough = " OR ".join(f"size(array_except(array({_quoted(d)}), known)) = 0" for d in demanded)
    return known.selectExpr("id", "n_words", "known", f"if({enough}, hits, NULL) AS hits")


def word_counts(found: DataFrame) -> dict[str, int]:
    """In how many files each word of the templates stands; the key "" has the number of files."""
    counted = found.select(F.explode(F.array_append("known", "")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r.word: r.n for r in counted.collect()}  # a row per word of the templates at most


class Index:
    """The templates' words, numbered by how rare they are in the corpus, and what of the templates' places follows from a file's `places`: an array with
    the places of each word, by its number. The methods give SQL expressions; a column API would take thousands of calls for them."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[str, int], conf: Scan):
        self.conf = conf
        self.words = sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.idf = {w: math.log(1 + counts.get("", 0) / (1 + counts.get(w, 0))) for w in self.words}

    def starts(self, word: str, at: list[int], slack: int) -> str:
        """Where a notice would have to start that has the word at the given places."""
        shifts = sorted({d - q for q in at for d in range(-slack, slack + 1)})
        places = f"get(places, {self.number[word]})"
        if len(shifts) == 1:
            return f"transform({places}, p -> p + ({shifts[0]}))"
        return f"array_distinct(flatten(transform({places}, p -> array({', '.join(f'p + ({s})' for s in shifts)}))))"

    def phrase(self, words: list[str]) -> str:
        """Where the words stand one after another: the intersection of their places, each shifted to the phrase's start, from the rarest on."""
        order = sorted(range(len(words)), key=lambda i: self.number[words[i]])
        return reduce(lambda a, b: f"array_intersect({a}, {b})", [self.starts(words[i], [i], 0) for i in order])

    def base_matches(self, t: Template) -> str:
        return f"transform({self.phrase(t.words())}, p -> named_struct('label', '{t.label}', 'start', p, 'share', 1D, 'base', true))"

    def notice_matches(self, t: Template) -> str:
        slack = self.conf.slack
        words: dict[str, list[int]] = {}
        for place, word in enumerate(t.words()):
            words.setdefault(word, []).append(place)
        rarest = sorted(words, key=self.number.__getitem__)
        own = ", ".join(f"named_struct('s', {self.starts(w, words[w], slack)}, 'idf', {self.idf[w]!r}D)" for w in rarest)
        present = f"filter(array({own}), s -> size(s.s) > 0)"
        # the rarest that the file has must agree; then the mandatory phrases must stand near where a start puts them
        at = f"aggregate(slice(ps, 2, {self.conf.lookups - 1}), get(ps, 0).s, (acc, s) -> array_intersect(acc, s.s))"
        for off, key in t.keys():
            near = f"array_distinct(flatten(transform({self.phrase(key)}, p -> sequence(p - {off + slack}, p - {off - slack}))))"
            at = f"array_intersect({at}, {near})"
        held = f"transform(array({present}), ps -> named_struct('ps', ps, 'at', {at}))"
        total = sum(self.idf[w] for w in rarest)
        share = f"aggregate(filter(h.ps, s -> arrays_overlap(s.s, h.at)), 0D, (acc, s) -> acc + s.idf) / {total!r}D"
        match = f"transform({held}, h -> named_struct('label', '{t.label}', 'start', array_min(h.at), 'share', if(size(h.at) > 0, {share}, NULL), 'base', false))"
        demanded = sorted({w for _, key in t.keys() for w in key}, key=self.number.__getitem__)
        needed = " AND ".join(f"size(get(places, {self.number[w]})) > 0" for w in demanded)
        return f"if({needed}, filter({match}, m -> m.share >= {self.conf.least_share}D), {NONE})"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, conf: Scan = Scan()) -> DataFrame:
    """(id, n_words, matches): matches has label, start (in words; of a notice the first that its words allow, which an edited notice may put
    before the file), share of the template's weight that stands where it belongs, and whether a base phrase matched."""
    if any(not re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", x) for t in templates for x in (t.text, *t.phrases)):
        raise ValueError("templates and phrases are lower-case words of a-z and 0-9 with one space between them")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if not templates:
        templates = (Template("", "0"),)  # a vocabulary of something
        return known_words(texts, templates).selectExpr("id", "n_words", f"{NONE} AS matches").withColumnRenamed("id", id_col)
    found = cut(known_words(texts, templates))
    index = Index(templates, word_counts(found), conf)
    places = f"transform(array({_quoted(index.words)}), w -> transform(filter(hits, h -> h.word = w), h -> h.at))"
    placed = found.selectExpr("id", "n_words", f"if(hits IS NOT NULL, {places}, NULL) AS places")
    each = ", ".join(index.base_matches(t) if t.base else index.notice_matches(t) for t in templates)
    return placed.selectExpr("id", "n_words", f"if(places IS NOT NULL, concat({each}), {NONE}) AS matches").withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of scan."""
    out = scan(docs)
    labels = "array_join(array_sort(array_distinct(transform({}, m -> m.label))), ',')"
    base = out.selectExpr("*", "filter(matches, m -> m.base) AS based", "transform(filter(matches, m -> m.base), m -> m.start) AS starts")
    return base.selectExpr(
        "doc_id",
        "n_words",
        "bigint(size(based)) AS n_base",
        "bigint(array_min(starts)) AS first_word",
        "bigint(array_max(starts)) AS last_word",
        f"{labels.format('based')} AS base_labels",
        f"{labels.format('matches')} AS labels",
        "round(coalesce(array_max(transform(matches, m -> m.share)), 0D), 6) AS score",
    )


def _oracle(templates: tuple[Template, ...], conf: Scan) -> str:
    """The same in SQL: every word a row, every posting a row, starts by joins."""
    postings = ", ".join(f"({t}, '{w}', {q})" for t, x in enumerate(templates) for q, w in enumerate(x.words()))
    phrases = ", ".join(f"({t}, {k}, {at}, {i}, '{w}')" for t, x in enumerate(templates) for k, (at, key) in enumerate(x.keys()) for i, w in enumerate(key))
    labels = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()}, {len(x.keys())})" for t, x in enumerate(templates))
    return f"""
WITH post(t, word, q) AS (VALUES {postings}), key(t, k, off, i, word) AS (VALUES {phrases}), lab(t, label, base, n_keys) AS (VALUES {labels}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tok AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
hit AS (SELECT r, word, pos FROM tok WHERE word IN (SELECT word FROM post)),
df AS (SELECT p.word, count(DISTINCT h.r) AS n FROM (SELECT DISTINCT word FROM post) p LEFT JOIN hit h ON h.word = p.word GROUP BY p.word),
idf AS (SELECT word, n, ln(1 + (SELECT count(*) FROM d) / CAST(1 + n AS DOUBLE)) AS idf FROM df),
keyed AS (SELECT h.r, k.t, k.k, k.off, h.pos - k.i AS start FROM hit h JOIN key k ON k.word = h.word
  JOIN (SELECT t, k, count(*) AS n FROM key GROUP BY t, k) x ON x.t = k.t AND x.k = k.k GROUP BY h.r, k.t, k.k, k.off, h.pos - k.i, x.n HAVING count(*) = x.n),
based AS (SELECT r, label, start FROM keyed JOIN lab USING (t) WHERE base),
cand AS (SELECT r, t FROM keyed JOIN lab USING (t) WHERE NOT base GROUP BY r, t, n_keys HAVING count(DISTINCT k) = n_keys),
own AS (SELECT DISTINCT c.r, c.t, h.word, h.pos - p.q + s.slack AS start FROM cand c JOIN hit h ON h.r = c.r JOIN post p ON p.t = c.t AND p.word = h.word, (SELECT unnest(range(-{conf.slack}, {conf.slack + 1})) AS slack) s),
top AS (SELECT r, t, word FROM (SELECT DISTINCT r, t, word FROM own) JOIN idf USING (word) QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY n, word) <= {conf.lookups}),
agreed AS (SELECT o.r, o.t, o.start FROM own o JOIN top USING (r, t, word) JOIN (SELECT r, t, count(*) AS n FROM top GROUP BY r, t) x ON x.r = o.r AND x.t = o.t
  GROUP BY o.r, o.t, o.start, x.n HAVING count(*) = x.n),
verified AS (SELECT a.r, a.t, a.start FROM agreed a JOIN lab USING (t) JOIN keyed k ON k.r = a.r AND k.t = a.t AND abs(k.start - k.off - a.start) <= {conf.slack}
  GROUP BY a.r, a.t, a.start, n_keys HAVING count(DISTINCT k.k) = n_keys),
weight AS (SELECT t, sum(idf) AS total FROM (SELECT DISTINCT t, word FROM post) JOIN idf USING (word) GROUP BY t),
shared AS (SELECT r, t, sum(idf) / total AS share FROM (SELECT DISTINCT r, t, word FROM own JOIN verified USING (r, t, start)) JOIN idf USING (word) JOIN weight USING (t) GROUP BY r, t, total),
noticed AS (SELECT r, label, share FROM shared JOIN lab USING (t) WHERE share >= {conf.least_share})
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, (SELECT count(*) FROM based b WHERE b.r = d.r) AS n_base, (SELECT min(start) FROM based b WHERE b.r = d.r) AS first_word,
  (SELECT max(start) FROM based b WHERE b.r = d.r) AS last_word, coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM based b WHERE b.r = d.r), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT r, label FROM based UNION SELECT r, label FROM noticed) l WHERE l.r = d.r), '') AS labels,
  round(greatest(CASE WHEN d.r IN (SELECT r FROM based) THEN 1.0 ELSE 0.0 END, coalesce((SELECT max(share) FROM noticed n WHERE n.r = d.r), 0.0)), 6) AS score FROM d
"""


ORACLE = _oracle(BASE + NOTICES, Scan())
