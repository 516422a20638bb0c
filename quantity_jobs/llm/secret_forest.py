"""Secret scan with a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are long runs of the characters that keys are made of. Their features: length, transitions between letters and
digits, share of digits, capitals and distinct characters, whether they are hexadecimal, how much of them dictionary
words cover, what the path says, and the words beside them. The dictionary is counted over the whole corpus. The
forest (Spark's own, in the JVM) learns from labelled findings; a finding is kept where it gives 0.5 or more.

Defined results: null and empty texts have no candidates; a null path is an empty one; repeated rows give repeated
findings; without labelled findings of both classes nothing is removed (probability 1); other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

#: Words that announce a secret, and parts of paths that hold examples.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential")
EXAMPLE_PATHS = ("test", "example", "sample", "doc", "mock", "fixture")
FEATURES = ["length", "turns", "digits", "capitals", "distinct", "hexadecimal", "covered", "example_path", "keyword", "assigned", "quoted", "address", "next_alpha"]


@dataclass(frozen=True)
class Forest:
    min_length: int = 16
    #: A dictionary word has so many letters and is in so many documents.
    word_letters: int = 3
    word_docs: int = 20
    trees: int = 30
    depth: int = 6
    seed: int = 7
    #: Most labelled findings to learn from (expected number).
    sample_rows: int = 20_000


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str, conf: Forest) -> DataFrame:
    """(row, id, position, piece, path, value, head, tail, before, before2, after): row numbers the candidates for as long as the result is not computed anew; position counts the words between white space, piece the long runs
    of a word. head and tail are the word's text next to the run, head with the run before it; before and after are the words around."""
    long_run = f"[A-Za-z0-9+/=_.@-]{{{conf.min_length},}}"
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(path_col, F.lit("")).alias("path"), F.col(text_col).alias("text")).filter(F.col("text").rlike(long_run))
    parts = own.select("id", "path", F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    exploded = parts.select(
        "id",
        "path",
        F.explode(
            F.filter(
                F.transform(
                    "w",
                    lambda x, i: F.when(
                        F.length(x) >= conf.min_length,
                        F.struct(
                            i.alias("position"), x.alias("raw"), F.get("w", i - 1).alias("before"), F.get("w", i - 2).alias("before2"), F.get("w", i + 1).alias("after")
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("c"),
    )
    split = exploded.withColumns({"values": F.regexp_extract_all("c.raw", F.lit(long_run), F.lit(0)), "gaps": F.split("c.raw", long_run, -1)})
    pieces = split.select("*", F.posexplode("values").alias("piece", "value"))
    head = F.concat(F.coalesce(F.get("values", F.col("piece") - 1), F.lit("")), F.get("gaps", F.col("piece")))
    last = F.col("piece") == F.size("values") - 1
    tail = F.get("gaps", F.col("piece") + 1)
    return pieces.select(
        F.monotonically_increasing_id().alias("row"), "id", F.col("c.position").cast("long").alias("position"), "piece", "path", "value", head.alias("head"), tail.alias("tail"), "c.before", "c.before2", F.when(last, F.col("c.after")).otherwise(tail).alias("after")
    )


def dictionary(docs: DataFrame, text_col: str, runs: DataFrame, conf: Forest) -> DataFrame:
    """Of the letter runs in candidates, those that are words of enough documents of the whole corpus."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z]+"))
    counted = docs.select(F.explode(F.filter(words, lambda w: F.length(w) >= conf.word_letters)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= conf.word_docs).join(runs.select("run").distinct(), "run", "left_semi").select("run")


def _share(pattern: str, value: str = "value") -> Column:
    """Share of the value's characters that the class matches."""
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.length(value)


def featured(found: DataFrame, docs: DataFrame, text_col: str, conf: Forest) -> DataFrame:
    """The candidates with FEATURES."""
    runs = found.select("row", F.explode(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= conf.word_letters)).alias("run"))
    known = runs.join(dictionary(docs, text_col, runs, conf), "run").groupBy("row").agg(F.sum(F.length("run")).alias("letters"))
    joined = found.join(known, "row", "left")
    # the name of a value is in the text before it in its word, or else in the words before
    named = F.col("head").rlike("[A-Za-z0-9]")
    near = F.lower(F.when(named, F.concat_ws(" ", "head", "value")).otherwise(F.concat_ws(" ", "before2", "before", "value")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n = F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    return joined.select(
        *found.columns,
        n.cast("double").alias("length"),
        (F.length(classes) / n).alias("turns"),
        _share("0-9").alias("digits"),
        _share("A-Z").alias("capitals"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        flag(F.col("value").rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        F.least(F.coalesce(F.col("letters") / n, F.lit(0.0)), F.lit(1.0)).alias("covered"),
        flag(F.lower("path").rlike("|".join(EXAMPLE_PATHS))).alias("example_path"),
        flag(near.rlike(rf"(^|[^a-z0-9])({'|'.join(KEYWORDS)})([^a-z0-9]|$)")).alias("keyword"),
        flag(F.when(named, F.col("head").rlike("[=:][\"'`]*$")).otherwise(F.coalesce(F.col("before").rlike("[=:]$"), F.lit(False))) | F.col("value").rlike("^[A-Za-z_][A-Za-z0-9_]*=[^=]")).alias("assigned"),
        flag(F.col("head").rlike("[\"'`]$") | F.col("tail").rlike("^[\"'`]")).alias("quoted"),
        flag(F.col("value").contains("@") | F.col("value").rlike(r"^\d+([.]\d+)+$")).alias("address"),
        flag(F.col("after").rlike("^[a-z]+")).alias("next_alpha"),
    )


def train(findings: DataFrame, conf: Forest):
    """A forest from findings with FEATURES and a label of 0 or 1, or None where one class is missing."""
    counts = findings.filter("label IS NOT NULL").groupBy("label").count().collect()  # two rows
    if {r[0] for r in counts} != {0, 1}:
        return None
    share = min(1.0, conf.sample_rows / sum(r[1] for r in counts))
    sample = findings.filter("label IS NOT NULL").filter(F.pmod(F.xxhash64("value", "row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    data = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample.select(*FEATURES, F.col("label").cast("double").alias("label")))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=conf.trees, maxDepth=conf.depth, seed=conf.seed)
    return forest.fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", conf: Forest = Forest()) -> DataFrame:
    """(id, position, piece, path, value, FEATURES, probability, kept) of every candidate. labelled: (id, position, label) and maybe piece (else
    the first, 0) of findings that people or rules have judged; without it the rule of `rule_labels` judges."""
    found = cut(featured(cut(candidates(docs, id_col, text_col, path_col, conf)), docs, text_col, conf))
    if labelled is None:
        judged = found.withColumn("label", rule_labels())
    else:
        piece = F.col("piece") if "piece" in labelled.columns else F.lit(0)
        own = labelled.select(F.col(id_col).alias("l_id"), F.col("position").alias("l_position"), piece.alias("l_piece"), F.col("label").cast("int").alias("label")).dropDuplicates(["l_id", "l_position", "l_piece"])
        same = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("position") == F.col("l_position")) & (F.col("piece") == F.col("l_piece"))
        judged = found.join(own, same, "left").drop("l_id", "l_position", "l_piece")
    model = train(judged, conf)
    if model is None:
        out = found.withColumn("probability", F.lit(1.0))
    else:
        data = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(found)
        out = model.transform(data).withColumn("probability", vector_to_array("probability")[1])
        out = out.select(*found.columns, "probability")
    return out.withColumn("kept", F.col("probability") >= 0.5).drop("row").withColumnRenamed("id", id_col)


def rule_labels() -> Column:
    """Labels of findings where nobody has judged any: a checksum of the value decides which are judged (nine in ten). A value of one piece, or a JWT,
    with letters and digits mixed, no address and no plain number, counts as a true finding where it is quoted, assigned or announced by a
    keyword; without such evidence it is unclear and stays unjudged, as does an announced value of other form with digits in it. The rest is false."""
    judged = F.crc32(F.col("value").cast("binary")) % 10 != 0
    form = F.col("value").rlike("^[A-Za-z0-9+/_=-]{20,}$") | F.col("value").rlike(r"(^|=)eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]*$")
    form = form & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.col("address") == 0)
    shown = (F.col("quoted") == 1) | (F.col("assigned") == 1) | (F.col("keyword") == 1)
    unclear = (form & ~shown) | (~form & (F.col("keyword") == 1) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.col("address") == 0))
    return F.when(judged & ~unclear, (form & shown).cast("int"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per candidate, so several for a word with several; the value itself only as a hash."""
    out = scan(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "kept")
