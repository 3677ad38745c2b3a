"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt from the training labels: words (and word beginnings) that toxic texts hold far more
often than others. The features of a text are how densely it holds lexicon entries and how strong they
are, how near such words stand to the second person, capitals, punctuation and obfuscation (words that
match the lexicon only once digits and symbols are read as the letters they stand for). Trees are trained
on one part of the sample and the isotonic calibration on the other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm.common import col, free, per_text, ready, stored

#: Labelled rows that all is learnt from (an expected number: rows are drawn by a hash). It also bounds the lexicon.
SAMPLE = 24_000
#: Texts that must hold an entry, and how many times more likely a toxic text holds it.
LEAST, RATIO = 8, 6.0
PREFIX = 4
TOXIC = 0.7
FEATURES = ["hits", "distinct", "strength", "strongest", "density", "prefixes", "near_you", "capitals", "exclaims", "symbols", "obfuscated", "length"]

#: Pronouns of the second person in the languages at hand.
YOU = {"you", "your", "yours", "du", "dich", "dir", "dein", "ihr", "tu", "te", "toi", "vous", "votre", "tú", "ti", "usted", "vosotros"}
_LOOKS = str.maketrans("013457@$!|", "oieastasil")
_word = re.compile(r"\w+(?:[@$!|*]\w+)*")


@dataclass
class Lexicon:
    words: dict[str, float]
    prefixes: dict[str, float]

    def features(self, text: str) -> list[float]:
        low = text.lower()
        tokens = _word.findall(low)
        n = max(1, len(tokens))
        at = [i for i, t in enumerate(tokens) if t in self.words]
        weights = [self.words[tokens[i]] for i in at]
        heads = sum(t[:PREFIX] in self.prefixes for t in set(tokens))
        near = sum(any(t in YOU for t in tokens[max(0, i - 5) : i + 6]) for i in at)
        odd = sum(t.isalnum() is False and t.translate(_LOOKS).replace("*", "") in self.words for t in set(tokens))
        capitals = sum(map(str.isupper, text)) / max(1, len(text))
        symbols = sum(map(text.count, "*$%&#|@")) / max(1, len(text))
        return [len(at), len({tokens[i] for i in at}), sum(weights), max(weights, default=0.0), 100 * len(at) / n, heads, near, capitals, text.count("!") / n, symbols, odd, float(np.log1p(n))]


def _drawn(rows: DataFrame, key: str, sample: int) -> DataFrame:
    share = min(1.0, sample / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Entries of labelled (text, label 0/1), each with its log odds: words and word beginnings of at least LEAST toxic texts."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    seen = labelled.select("label", tokens.alias("t")).select("label", "t", F.array_distinct(F.transform("t", lambda t: F.concat(F.substring(t, 1, PREFIX), F.lit("-")))).alias("p"))
    counts = seen.select("label", F.explode(F.concat("t", "p")).alias("t")).groupBy("t").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    total = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not total[0] or not total[1]:
        return Lexicon({}, {})
    odds = F.log(((F.col("bad") + 0.5) / F.lit(float(total[0]))) / ((F.col("good") + 0.5) / F.lit(float(total[1]))))
    strong = counts.where(F.col("bad") >= LEAST).withColumn("w", odds).where(F.col("w") >= float(np.log(RATIO)))
    rows = strong.select("t", "w").collect()  # each entry stands in LEAST texts of a bounded sample
    return Lexicon({r["t"]: r["w"] for r in rows if r["t"][-1] != "-"}, {r["t"][:-1]: r["w"] for r in rows if r["t"][-1] == "-"})


def features(spark: SparkSession, lexicon: Lexicon):
    """A column function: FEATURES of a whole text; null texts count as empty."""
    shared = spark.sparkContext.broadcast(lexicon)

    def make():
        return lambda t: shared.value.features(t.decode("utf-8", "surrogatepass"))

    return per_text(make, "array<double>", pa.list_(pa.float64()))


@dataclass
class Model:
    lexicon: Lexicon
    trees: object
    calibration: object

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs without the text, with `score` (0..1) and `predicted`: one row for each row; columns of these names are replaced.

        Null and empty texts are scored like any other; repeated rows score alike; an empty table gives no rows.
        """
        ready(docs.sparkSession)
        rest = [col(c) for c in docs.columns if c not in (text, "score", "predicted")]
        # the columns of docs travel in one, so that they can't clash with those of the trees
        rows = docs.select(F.struct(F.lit(0).alias(free(docs, "_none")), *rest).alias("row"), array_to_vector(features(docs.sparkSession, self.lexicon)(col(text))).alias("features"))
        if self.trees is None:
            scored = rows.select("row", F.lit(0.0).alias("score"))
        else:
            raw = self.trees.transform(rows).select("row", vector_to_array("probability")[1].alias("_raw"))
            scored = self.calibration.transform(raw).select("row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int")).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (text, "score", "predicted")], "score", "predicted")


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of labelled rows (null texts count as empty, null labels don't count), from about `sample` of them.

    Without rows of both labels every score is 0.
    """
    ready(labelled.sparkSession)
    rows = labelled.where(col(label).isNotNull()).select(col(key).alias("key"), F.coalesce(col(text), F.lit("")).alias("text"), col(label).cast("double").alias("label"))
    rows = stored(_drawn(rows, "key", sample)).repartition(8)
    lexicon = learn_lexicon(rows)
    x = stored(rows.select("key", "label", features(rows.sparkSession, lexicon)(F.col("text")).alias("x")))
    x = x.withColumn("features", array_to_vector("x")).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(3)))
    if x.select("fold", "label").distinct().count() < 6:
        return Model(lexicon, None, None)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=1).fit(x.where("fold > 0").coalesce(4))
    raw = trees.transform(x.where("fold = 0")).select("label", vector_to_array("probability")[1].alias("_raw"))
    calibration = IsotonicRegression(featuresCol="_raw", predictionCol="_calibrated").fit(raw.coalesce(4))
    return Model(lexicon, trees, calibration)
