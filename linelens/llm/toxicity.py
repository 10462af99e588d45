"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of learned toxic words and stems, how often they stand within five words of a
second person, shares of capitals, exclamation marks, question marks and other punctuation, rates of words
with digits or signs inside and of stretched letters, and toxic words found once such writing is undone.

The lexicon holds words and word beginnings (4 to 6 letters) that go along with the label by a
log-likelihood ratio. Lexicon, trees and calibration learn from different folds of the labelled rows (CRC-32
of doc_id modulo 5: lexicon 1 and 2, trees 3, calibration 4; 0 is held out). They are fitted on about
SAMPLE_ROWS labelled rows at most, chosen by a hash of the doc_id; scoring reads every whole text, row by row,
without a shuffle. Broadcast are that sample's ids and the lexicon, both bounded by a parameter.

Defined cases: null text is empty and gets the score of an empty text; null doc_ids are no label and not
held out; null labels are ignored; of repeated labels the larger counts; where a fold lacks one of the
classes, trees or calibration use all training folds, and where those lack one, every score is the rate of
the label (0 without labels). No rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table
from linelens.session import materialize

NAME = "op5_toxicity"
FOLDS = 5
SAMPLE_ROWS = 20_000
LEXICON_ENTRIES = 5_000
MIN_RATIO = 20.0
NEAR = 5
TREES, DEPTH = 20, 3

# Second-person words of the corpus languages, and signs written for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer eure sie tu te toi ton ta tes vous votre vos tú ti tus tuyo usted ustedes vosotros vuestro os".split())
LETTER_FOR = str.maketrans("013457@$!|", "oieastasil")

_EDGE = ".,;:!?\"'()[]{}<>|*#%&$~_-“”«»¡¿…"
_STRETCHED = re.compile(r"(\w)\1\1")
_REPEATED = re.compile(r"(\w)\1+")
FEATURES = ["hit_density", "weight_density", "log_hits", "top_weight", "near_density", "near_share", "second_density", "capitals", "shouted", "exclaims", "asks", "punctuation", "obfuscated", "obfuscated_hits", "stretched", "log_words"]


def plain(token: str) -> str:
    return token.strip(_EDGE).lower()


def keys_of(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings."""
    return [word] + [f"{word[:n]}+" for n in (4, 5, 6) if len(word) >= n]


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            words = {plain(t) for t in (text.as_py() or "").split()} - {""}
            (toxic if label else clean).update({k for w in words for k in keys_of(w)})
    keys = list(toxic.keys() | clean.keys())
    for k in range(0, len(keys), 50_000):
        part = keys[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], ["key", "a", "b"])


def lexicon(rows: DataFrame, entries: int = LEXICON_ENTRIES, min_ratio: float = MIN_RATIO) -> dict[str, float]:
    """Weights of the words and beginnings that go along with the label in ``rows`` (text, toxic)."""
    n = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    if not n["a"] or not n["b"]:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(_key_counts, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, ta, tb = F.col("a"), F.col("b"), float(n["a"]), float(n["b"])
    term = lambda seen, hoped: F.when(seen > 0, seen * F.log(seen / hoped)).otherwise(F.lit(0.0))
    rate = (a + b) / (ta + tb)
    ratio = 2 * (term(a, rate * ta) + term(b, rate * tb) + term(ta - a, (1 - rate) * ta) + term(tb - b, (1 - rate) * tb))
    weight = F.log((a + 0.5) / (ta + 1)) - F.log((b + 0.5) / (tb + 1))
    best = counts.where(a >= 3).select("key", ratio.alias("ratio"), weight.alias("weight")).where((F.col("ratio") >= min_ratio) & (F.col("weight") >= 1))
    return {r["key"]: r["weight"] for r in best.orderBy(F.desc("ratio"), "key").limit(entries).collect()}


class _Tokens(dict):
    """What the features need of a token, packed: weight in hundredths, weight after undoing, five flags."""

    def __init__(self, words: dict[str, float]):
        super().__init__()
        self.words = words

    def weight(self, word: str) -> int:
        return min(2047, int(100 * max((self.words.get(k, 0.0) for k in keys_of(word)), default=0.0)))

    def __missing__(self, token: str) -> int:
        word = plain(token)
        own = self.weight(word) if word else 0
        inner = token.strip(".,;:!?\"'()[]{}").lower()
        mixed = any(c.isalpha() for c in inner) and not inner.replace("-", "").replace("'", "").isalpha()
        stretched = bool(_STRETCHED.search(word))
        undone = 0
        if mixed or stretched:
            letters = "".join(c for c in inner.translate(LETTER_FOR) if c.isalpha())
            undone = max(self.weight(letters), self.weight(_REPEATED.sub(r"\1", letters))) if letters else 0
        packed = own | undone << 11 | (word in SECOND_PERSON) << 22 | (len(word) > 1 and token.isupper()) << 23 | mixed << 24 | stretched << 25
        if len(self) > 400_000:
            self.clear()
        self[token] = packed
        return packed


def text_features(text: str, tokens: _Tokens) -> list[float]:
    import numpy as np

    split = text.split()
    p = np.fromiter(map(tokens.__getitem__, split), dtype=np.int64, count=len(split))
    n = max(1, len(split))
    own, undone = p & 2047, p >> 11 & 2047
    hit = np.flatnonzero((own > 0) | (undone > 0))
    second = np.flatnonzero(p >> 22 & 1)
    near = 0
    if len(hit) and len(second):
        after = np.searchsorted(second, hit)
        right = np.where(after < len(second), second[np.minimum(after, len(second) - 1)] - hit, NEAR + 1)
        left = np.where(after > 0, hit - second[np.maximum(after - 1, 0)], NEAR + 1)
        near = int((np.minimum(left, right) <= NEAR).sum())
    c = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size = max(1, int(c.sum()))
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum() + c[195:].sum())
    signs = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    best = int(max(own.max(), undone.max())) / 100 if len(p) else 0.0
    return [len(hit) / n, float(np.maximum(own, undone).sum()) / 100 / n, math.log1p(len(hit)), best, near / n, near / max(1, len(hit)), len(second) / n, upper / max(1, upper + lower), float((p >> 23 & 1).sum()) / n, c[33] / size, c[63] / size, signs / size, float((p >> 24 & 1).sum()) / n, float((undone > own).sum()) / n, float((p >> 25 & 1).sum()) / n, math.log1p(len(split))]


def features(text: Column, words: dict[str, float]) -> Column:
    """The dense features of a text as an array column."""

    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _Tokens(words)
        for texts in batches:
            yield pd.Series([text_features(t or "", tokens) for t in texts])

    return compute(text)


class Model:
    """Fitted lexicon, trees and calibration; ``score`` adds one column."""

    def __init__(self, words, trees, calibration, rate: float):
        self.words, self.trees, self.calibration, self.rate = words, trees, calibration, rate

    def _raw(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out = self.trees.transform(df.withColumn("_tox_features", array_to_vector(features(F.col(text), self.words))))
        return out.withColumn("_tox_p", vector_to_array("_tox_probability")[1]).drop("_tox_features", "_tox_raw", "_tox_probability", "_tox_prediction")

    def score(self, df: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """Adds the score; a column of that name is replaced."""
        df = df.drop(into) if into != text else df
        if self.trees is None:
            return df.withColumn(into, F.lit(self.rate))
        out = self._raw(df, text)
        out = self.calibration.transform(out)
        return out.withColumn("_tox_s", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_tox_calibrated"))).drop("_tox_p", "_tox_calibrated").withColumnRenamed("_tox_s", into)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IN (0, 1)")
    known = materialize(known.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("_id"))).where("fold <> 0"))
    n = known.count()
    part = int(1_000_000 * min(1.0, sample_rows / max(1, n)))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < part)
    rows = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", "fold"))
    held = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = lambda folds: all(any(held.get((f, t)) for f in folds) for t in (0, 1))
    total = sum(held.values())
    rate = sum(v for (_, t), v in held.items() if t) / total if total else 0.0
    everything = [1, 2, 3, 4]
    if not both(everything):
        return Model({}, None, None, rate)
    words_from, trees_from, calibrate_from = (x if both(x) else everything for x in ([1, 2], [3], [4]))
    words = lexicon(rows.where(F.col("fold").isin(words_from)))
    ready = materialize(rows.select(features(F.col("text"), words).alias("f"), F.col("toxic").cast("double").alias("toxic"), "fold").repartition(6)).withColumn("_tox_features", array_to_vector("f"))
    gbt = GBTClassifier(featuresCol="_tox_features", labelCol="toxic", predictionCol="_tox_prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed).setRawPredictionCol("_tox_raw").setProbabilityCol("_tox_probability")
    trees = gbt.fit(ready.where(F.col("fold").isin(trees_from)))
    judged = trees.transform(ready.where(F.col("fold").isin(calibrate_from))).select(vector_to_array("_tox_probability")[1].alias("_tox_p"), "toxic")
    calibration = IsotonicRegression(featuresCol="_tox_p", labelCol="toxic", predictionCol="_tox_calibrated").fit(judged)
    return Model(words, trees, calibration, rate)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = model.score(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


ORACLE_SQL = None
