"""Secrets in texts, with false positives removed by a random forest (operator 8). DataFrame functions only.

A candidate is a run of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]`` (with ``=`` padding) that has a digit or two capitals, or,
at any length and with all signs, the value assigned to the name of a credential (the whole quoted value, else up to a space, quote, comma or semicolon) or the password
part of a URL; these have a negative ``part``. Its features: length; whether it is such a value; character
transitions (changes between digits, small letters, capitals and signs, and changes between vowels and other letters, per character), shares of the
character classes and of different characters; dictionary coverage (share of it made of the corpus's ``DICTIONARY`` most frequent words of three letters and more, counted
over all documents); path (slashes, dots, ``@``, ``://`` around it); and the neighbouring words: the two before, the name it is assigned to in its own word, and the one
after, each as the log-odds of a secret beside it in the labelled findings, and whether it is quoted or assigned.

The forest is fitted to at most ``MAX_PER_CLASS`` labelled findings of each class (smallest hash). Labelled findings are an argument (doc_id, word_no, part, secret); the
tables have none, so the registered query labels by ``label_by_rule``: keys of known issuers' form, values with a digit assigned to the name of a credential, quoted values assigned to one, and passwords of URLs.

Without labelled findings of both classes every finding gets the only label (no labels: 0). A null or empty text has no candidates. Repeated rows give
repeated candidates.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import fresh, stash

LEAST = 16
MAX_PER_CLASS = 5000
DICTIONARY = 300
TREES, DEPTH = 24, 6
MIN_SEEN = 5
THRESHOLD = 0.5
MASK = "[SECRET]"
_RUN = r"([A-Za-z0-9+/_-]{%d,}={0,2})" % LEAST
_SPACE = r"[\x20\x09-\x0D]+"
#: What a name of a credential contains, and the forms of issued keys.
CREDENTIAL = r"(?i)(token|secret|passw|passwd|pwd|api_?key|apikey|access_?key|auth|credential|private_?key)"
ISSUED = r"\A(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{16,})\z"
_OWN = r"[^\x20\x09-\x0D\"'`,;]"
_NAME = r"(?i)(?!author)" + CREDENTIAL[4:] + r"[\w-]*[\"'`]?\]?[\x20\x09-\x0D]*(?:=>|:=|[=:])[\x20\x09-\x0D]*"
_QUOTED = [r"%s([^%s\\\r\n]*+(?:\\.[^%s\\\r\n]*+)*+)%s" % (q, q, q, q) for q in "\"'`"]
#: Text up to a value, and the value: assigned to the name of a credential, or a URL's password.
VALUES = ((_NAME + r"[\"'`]?", _NAME + "(?:" + "|".join([*_QUOTED, f"({_OWN}+)"]) + ")", (2, 3, 4, 5)),
          (r"[^:]*://[^:]*:", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x20\x09-\x0D/?#:@\"'<>]*:([^\x20\x09-\x0D/?#\"'<>]+)@", (1,)))
SIDES = ("before2", "before1", "name", "after1")
FEATURES = ("length", "named", "transitions", "vowel_changes", "digits", "capitals", "signs", "distinct", "coverage", "slashes", "dots", "at", "scheme", "quoted", "assigned", *(f"w_{s}" for s in SIDES))


def words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _SPACE, -1)


def _likely(word: Column) -> Column:
    return word.rlike(r"[0-9]|[A-Z].*[A-Z]")


def _text_key() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no (position of the word), part (number of the candidate in its word), candidate, word, the neighbouring words, and text_key, which tells rows without doc_id apart."""
    docs = docs.withColumn("text_key", _text_key())
    split = docs.select("doc_id", "text_key", words(F.col("text")).alias("words"))
    every = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(F.get("words", i)) >= LEAST) & F.get("words", i).rlike(_RUN) & _likely(F.get("words", i)))
    beside = lambda i, j: F.coalesce(F.get("words", i + j), F.lit(""))
    hits = F.transform(every, lambda i: F.struct(i.alias("word_no"), F.get("words", i).alias("word"), beside(i, -2).alias("before2"), beside(i, -1).alias("before1"), beside(i, 1).alias("after1")))
    found = split.select("doc_id", "text_key", F.explode(hits).alias("hit")).select("doc_id", "text_key", "hit.*")
    parts = found.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(_RUN), F.lit(1))).alias("part", "candidate"))
    runs = parts.where(_likely(F.col("candidate"))).withColumn("name", F.expr("substring_index(word, candidate, 1)"))
    for k, (before, pattern, groups) in enumerate(VALUES):
        runs = runs.unionByName(_values(docs, before, pattern, groups, k))
    return runs


def _values(docs: DataFrame, before: str, pattern: str, groups: tuple[int, ...], kind: int) -> DataFrame:
    """Candidates by a pattern over whole texts, but for those that are runs; ``part`` is -1, -3, ... or -2, -4, ... by kind, over the document."""
    spaces = lambda text: F.regexp_count(text, F.lit(_SPACE))
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.where(F.col("text").rlike(pattern)).select("doc_id", "text_key", words(F.col("text")).alias("words"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    cut = cut.withColumn("runs", F.zip_with("gaps", F.concat("hits", F.array(F.lit(""))), lambda g, h: F.struct(spaces(g).alias("gap"), spaces(h).alias("hit"))))
    one = cut.select("doc_id", "text_key", "words", "gaps", "runs", F.posexplode("hits").alias("k", "hit"))
    total = F.aggregate(F.slice("runs", F.lit(1), F.col("k")), F.lit(0), lambda n, x: n + x["gap"] + x["hit"]) + F.get("runs", F.col("k"))["gap"]
    one = one.withColumn("candidate", F.concat(*[F.regexp_extract("hit", pattern, g) for g in groups])).withColumn("ahead", F.regexp_extract("hit", rf"\A({before})", 0))
    one = one.where("candidate <> ''").withColumn("word_no", (total + spaces(F.col("ahead"))).cast("int"))
    last = lambda text: F.element_at(F.split(text, _SPACE, -1), -1)
    one = one.withColumn("name", last(F.concat(F.get("gaps", F.col("k")), F.col("ahead"))))
    rest = F.get(F.split(F.concat(F.expr("substring(hit, length(ahead) + length(candidate) + 1)"), F.get("gaps", F.col("k") + 1)), _SPACE, -1), F.lit(0))
    at = lambda j: F.coalesce(F.get("words", F.col("word_no") + j), F.lit(""))
    c = F.col("candidate")
    found = one.where(~(c.rlike(rf"\A{_RUN}\z") & _likely(c)))
    return found.select("doc_id", "text_key", "word_no", F.concat("name", "candidate", rest).alias("word"), at(F.lit(-2)).alias("before2"), at(F.lit(-1)).alias("before1"), at(spaces(c) + 1).alias("after1"),
                        (-2 * F.col("k") - 1 - kind).cast("int").alias("part"), "candidate", "name")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to twelve letters over all documents, lower-cased."""
    plain = F.filter(words(F.col("text")), lambda w: F.length(w).between(3, 12))
    counted = docs.select(F.explode(plain).alias("word")).groupBy("word").count()
    folded = counted.where(F.col("word").rlike(r"\A[A-Za-z]+\z")).groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("n"))
    return [r["word"] for r in folded.orderBy(F.desc("n"), "word").limit(size).collect()]


def _named() -> Column:
    assigned = F.col("name").rlike(r"[=:][\"'`]?\z") & F.col("name").rlike(CREDENTIAL) | F.col("before1").rlike(r"[=:]\z") & F.concat("before2", F.lit(" "), "before1").rlike(CREDENTIAL)
    return assigned | (F.col("part") < 0)


def label_by_rule(found: DataFrame) -> DataFrame:
    """doc_id, word_no, part, secret (0 or 1) of candidates."""
    c = F.col("candidate")
    whole = (F.col("part") < 0) & (F.col("name").rlike("[\"'`]\\z") | F.col("name").contains("://"))
    secret = c.rlike(ISSUED) | _named() & c.rlike("[0-9]") & c.rlike("[A-Za-z]") | whole
    return found.select("doc_id", "word_no", "part", secret.cast("int").alias("secret"))


def _bare(word: Column) -> Column:
    """A neighbouring word as it is looked up: letters and assignment signs, digits as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), r"[^\p{L}0-9=:]", ""), "[0-9]+", "0")


def _share(c: Column, kind: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, kind, "")) / F.length(c)


def featured(found: DataFrame, dictionary_words: list[str], odds: dict[str, dict[str, float]]) -> DataFrame:
    c, low = F.col("candidate"), F.lower("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "."), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "B")
    changes = lambda text: F.length(F.regexp_replace(text, r"(.)\1+", "$1")) / F.length(c)
    covering = "|".join(sorted((w for w in dictionary_words if w.isalpha()), key=lambda w: (-len(w), w)))
    after = F.when(F.col("part") < 0, F.expr("substring(word, length(name) + length(candidate) + 1)")).otherwise(F.expr("substring_index(word, candidate, -1)"))
    features = {
        "length": F.length(c).cast("double"), "named": _named().cast("double"), "transitions": changes(kinds), "vowel_changes": changes(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", "."), "[aeiouy]", "0"), "[a-z]", "1")),
        "digits": _share(c, "[0-9]"), "capitals": _share(c, "[A-Z]"), "signs": _share(c, "[^A-Za-z0-9]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "coverage": _share(low, covering) if covering else F.lit(0.0), "slashes": _share(F.col("word"), "[^/]") * -1 + 1, "dots": F.col("word").contains(".").cast("double"),
        "at": F.col("word").contains("@").cast("double"), "scheme": F.col("word").contains("://").cast("double"),
        "quoted": (F.col("name").rlike("[\"'`]\\z") & after.rlike("\\A[\"'`]")).cast("double"), "assigned": (F.col("name").rlike("[=:][\"'`]?\\z") | F.col("before1").rlike("[=:]\\z")).cast("double"),
    }
    for side in SIDES:
        known = F.from_json(F.lit(json.dumps(odds.get(side, {}))), "map<string,double>")
        features[f"w_{side}"] = F.coalesce(F.try_element_at(known, _bare(F.col(side))), F.lit(0.0))
    return found.withColumns(features)


def _odds(labelled: DataFrame) -> dict[str, dict[str, float]]:
    """Per side: log-odds of a secret beside each neighbouring word that at least MIN_SEEN labelled findings have."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _bare(F.col(s)).alias("word")) for s in SIDES]))
    counted = labelled.select(sides.alias("at"), "secret").groupBy("at.side", "at.word").agg(F.sum("secret").alias("yes"), F.count("*").alias("n")).where(F.col("n") >= MIN_SEEN)
    out: dict[str, dict[str, float]] = {}
    for r in counted.collect():
        value = math.log((r["yes"] + 0.5) / (r["n"] - r["yes"] + 0.5))
        if abs(value) >= 0.5:
            out.setdefault(r["side"], {})[r["word"]] = round(value, 6)
    return out


def scan(docs: DataFrame, labels=label_by_rule, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Candidates of all documents with ``score`` (the forest's probability of a secret) and ``secret`` (0 or 1).

    ``labels``: a DataFrame of labelled findings, or a function from candidates to one.
    """
    found = stash(candidates(docs.select("doc_id", "text")), "candidates")
    labelled = labels(found) if callable(labels) else labels
    labelled = labelled.where("secret IS NOT NULL").select("doc_id", "word_no", "part", "secret").dropDuplicates(["doc_id", "word_no", "part"])
    some = [labelled.where(F.col("secret") == y).orderBy(F.xxhash64("doc_id", "word_no", "part"), "doc_id", "word_no", "part").limit(max_per_class) for y in (0, 1)]
    training = stash(found.join(F.broadcast(some[0].unionAll(some[1])), ["doc_id", "word_no", "part"]), "findings")  # at most 2 * max_per_class rows of numbers
    classes = sorted(r["secret"] for r in training.select("secret").distinct().collect())
    if len(classes) < 2:
        return _judged(found.withColumn("score", F.lit(float(classes[0] if classes else 0))))
    frequent, odds = dictionary(docs), _odds(training)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # cross-validated odds would need folds; the forest sees them beside the other features and samples both
    forest = RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=TREES, maxDepth=DEPTH, seed=1)
    model = forest.fit(assembler.transform(featured(training, frequent, odds)).select("features", F.col("secret").cast("double").alias("secret")))
    scored = model.transform(assembler.transform(featured(found, frequent, odds)))
    return _judged(scored.withColumn("score", vector_to_array("probability")[1])).select(*found.columns, "score", "secret")


def _judged(scored: DataFrame) -> DataFrame:
    return scored.withColumn("secret", (F.col("score") >= THRESHOLD).cast("int"))


def redact(docs: DataFrame, findings: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of its own findings replaced by ``mask`` in the text; those shorter than ``LEAST`` where no letter or digit is beside them."""
    own = fresh(docs, "_secrets")
    row = fresh(docs, "_row")
    known = lambda text_key: F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text_key.cast("string")))
    mine = findings.where("secret = 1").groupBy(known(F.col("text_key")).alias(row)).agg(F.sort_array(F.collect_set("candidate")).alias(own))
    longest = F.transform(F.array_sort(F.transform(own, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    alone = lambda s: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    literal = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))
    hide = lambda text, s: F.when(F.length(s) < LEAST, F.regexp_replace(text, alone(s), literal)).otherwise(F.replace(text, s, F.lit(mask)))
    masked = F.when(F.col(own).isNotNull(), F.aggregate(longest, F.col("text"), hide)).otherwise(F.col("text"))
    return docs.withColumn(row, known(_text_key())).join(mine, row, "left").withColumn("text", masked).select(*docs.columns)
