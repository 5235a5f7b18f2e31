"""Toxic passages by maximum-scoring segments of token log-odds.

*Log-odds.* Each word has a chain of units: its prefixes of 4, 5 and 6
characters, then the word. A unit's rate in a class, relative to its share of
the whole corpus, is estimated with an informative Dirichlet prior: the corpus
count gives the base measure, and the prefix before it in the chain gives the
prior mean, R_c(u) = (y_c(u) + KAPPA * R_c(parent)) / (n_c * q(u) + KAPPA).
Units in fewer than MIN_DOCS labelled documents have no rate of their own.
The log-odds of a unit are log(R_toxic / R_clean); a unit is kept where they
differ from zero by Z standard deviations, or clearly from its kept parent's,
and a word takes the log-odds of the longest kept unit of its chain. So unseen
words of a known stem count and chance words do not. y counts the distinct words
of each document that hold the unit, so that a word repeated in one document is
no stronger for it.

*Segments.* A token scores its log-odds less DRIFT. A linear-time scan
finds all maximal-scoring segments of a text.

*Extreme values.* For tokens of clean text the best segment of n tokens has
P(S > x) = 1-exp(-K n exp(-LAMBDA x)). LAMBDA solves sum(p e^(LAMBDA s)) = 1 over clean
token scores, K is its maximum-likelihood value on clean documents. A segment
is significant if its expected count K n exp(-LAMBDA S) is at most E_MAX. A logistic
curve turns the best segment's -ln E and the number of significant segments
into a probability; it is fitted on labelled documents that gave no counts.

KAPPA and Z are cross-validated within the rows that are not held out
(``tests/llm/choose.py``).

Words of labelled documents come from at most ``max_labelled`` training rows
(those of least hash; where a doc_id repeats, the text of least hash is the
labelled one), so the model's size does not grow with the corpus; corpus counts are
over all documents. Calibration is sums and histograms taken by the executors:
token scores in thousandths, features in hundredths. Labels, language, source
and doc_id are never inputs of a score.

Defined cases: very long texts are scanned whole by the worker that reads them;
repeated rows are scored each; columns named score or passages are replaced,
others kept; an empty table gives an empty result; null text is empty; a text without words gets the score of no
evidence; null or repeated labels: null is no label, a document with any toxic
label is toxic; without training labels of both classes every score is 0.5 if
there are none, else near the class that there is.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
KAPPA, Z, DRIFT, E_MAX, THRESHOLD = 4.0, 4.0, 0.5, 1e-2, 0.7
LIMITS = (-3.0, 8.0)
MIN_DOCS = 5
MAX_LABELLED = 40_000
FLUSH, REMEMBERED = 100_000, 100_000
NO_SEGMENT, CERTAIN = -10.0, 40.0

COUNTS = T.StructType([T.StructField("unit", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])


def units(word: str) -> list[str]:
    """The chain of a word, shortest first; a prefix ends in ``*``."""
    return [word[:k] + "*" for k in STEMS if k < len(word)] + [word]


def count_units(docs: DataFrame, allowed=None) -> DataFrame:
    """(unit, toxic, clean): distinct words of documents of either class that hold the unit; the unit '' counts documents.

    ``docs`` is (text, toxic); a null label counts as clean. ``allowed`` is a
    broadcast set to which the units are restricted. Words are counted first
    and taken apart into units when FLUSH different ones have gathered.
    """
    schema = common.arrow_schema(COUNTS)

    def flush(words, n_docs, only):
        counts = (Counter({"": n_docs[0]}), Counter({"": n_docs[1]}))
        for mine, seen in zip(counts, words, strict=True):
            for word, n in seen.items():
                for unit in units(word):
                    if only is None or unit in only:
                        mine[unit] += n
        names = sorted({*counts[0], *counts[1]})
        return pa.record_batch([pa.array(names, schema.field(0).type), *(pa.array([counts[c].get(u, 0) for u in names], pa.int64()) for c in (1, 0))], schema=schema)

    def rows(batches):
        words, n_docs = (Counter(), Counter()), [0, 0]
        only = None if allowed is None else allowed.value
        for batch in batches:
            for text, toxic in zip(common.strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                label = 1 if toxic else 0
                words[label].update(set(WORD.findall(text.lower())))
                n_docs[label] += 1
                if len(words[label]) > FLUSH:
                    yield flush(words, n_docs, only)
                    words, n_docs = (Counter(), Counter()), [0, 0]
        yield flush(words, n_docs, only)
        del words
        common.release()

    common.ship(docs.sparkSession)
    return docs.mapInArrow(rows, COUNTS).groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text in one scan.

    ``scores`` lists (place, score) of the tokens that don't score -drift.
    Each segment is kept with the sums left of it and up to its end, and the
    nearest earlier one that starts lower, so that no segment is passed twice;
    a new one is merged with that one as long as it ends higher.
    """
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for place, score in scores:
        total -= drift * (place - last - 1)
        left, total, last = total, total + score, place
        if score <= 0:
            continue
        first, j = place, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, _, left, _, before = found[j]
            del found[j:]
            j = before
        found.append((first, place, left, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    """Kept log-odds and the calibration; ``lam`` and ``k`` of the extreme-value law, ``curve`` of the logistic."""

    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    neutral: set[str] = field(default_factory=set, compare=False)

    def token(self, word: str) -> float | None:
        """The score of a word with a kept unit, else None."""
        odds = next((self.odds[u] for u in reversed(units(word)) if u in self.odds), None)
        return None if odds is None else min(max(odds, LIMITS[0]), LIMITS[1]) - DRIFT

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        """Number of tokens, segments and the positive token scores. Words known to have no kept unit are passed over as a set."""
        tokens = WORD.findall(text.lower())
        scores = {}
        for word in set(tokens).difference(self.neutral):
            score = self.token(word)
            if score is None:
                self.neutral.add(word)
            else:
                scores[word] = score
        if len(self.neutral) > REMEMBERED:
            self.neutral.clear()
        if not scores:
            return len(tokens), [], []
        scored = [(i, scores[w]) for i, w in enumerate(tokens) if w in scores]
        return len(tokens), segments(scored), [s for _, s in scored if s > 0]

    def expected(self, n: int, score: float) -> float:
        """The number of clean segments as good as this one that n tokens hold by chance."""
        return self.k * n * float(np.exp(-self.lam * score))

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        if not found:
            return NO_SEGMENT, 0.0
        e = [max(self.expected(n, s), 1e-300) for _, _, s in found]
        return float(min(max(-np.log(min(e)), NO_SEGMENT), CERTAIN)), float(np.log1p(sum(x <= E_MAX for x in e)))

    def probability(self, features: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * features[0] / 10 + c * features[1], -30, 30))))

    def bare(self) -> Model:
        return Model(self.odds, self.lam, self.k, self.curve)


def log_odds(train: dict[str, tuple[int, int]], corpus: dict[str, int]) -> dict[str, float]:
    """Kept units and their log-odds from class counts (toxic, clean) and corpus counts; '' holds the totals."""
    n_toxic, n_clean = train.get("", (0, 0))
    n_all = max(corpus.get("", 0), 1)
    rates: dict[str, tuple[float, float]] = {}
    kept: dict[str, float] = {}
    for unit in sorted(train, key=lambda u: (not u.endswith("*"), len(u), u)):
        toxic, clean = train[unit]
        if not unit:
            continue
        stem = unit.rstrip("*")
        parent = next((p for k in reversed(STEMS) if k < len(stem) and (p := stem[:k] + "*") in rates), None)
        mean = rates.get(parent, (1.0, 1.0))
        q = max(corpus.get(unit, 0), toxic + clean, 1) / n_all
        rate = ((toxic + KAPPA * mean[0]) / (n_toxic * q + KAPPA), (clean + KAPPA * mean[1]) / (n_clean * q + KAPPA))
        rates[unit] = rate
        odds = float(np.log(rate[0] / rate[1]))
        sd = float(np.sqrt(1 / (toxic + KAPPA) + 1 / (clean + KAPPA)))
        if abs(odds) >= Z * sd or (parent in kept and abs(kept[parent] - odds) > 0.5):
            kept[unit] = odds
    return kept


def solve_lambda(scores: Counter, n: int) -> float:
    """The positive root of sum(p e^(lam s)) = 1 over clean tokens; one pseudo-token scores the upper limit."""
    values = np.array([LIMITS[1] - DRIFT, *scores])
    p = np.array([1.0, *scores.values()]) / (n + 1)
    rest = max(1 - p.sum(), 0.0)
    low, high = 1e-6, 5.0
    for _ in range(80):
        middle = (low + high) / 2
        if (p * np.exp(middle * values)).sum() + rest * np.exp(-middle * DRIFT) > 1:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method with an L2 penalty on all but the constant; rows count ``weight`` times."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1)) * max(weight.sum(), 1) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash; a cut of the hash leaves few to sort."""
    total = known.count()
    order = F.xxhash64("_id", F.lit("sample"))
    share = min(1.0, (most + 4 * most**0.5) / max(total, 1))
    rows = known.withColumn("order", order)
    rows = rows if share == 1.0 else rows.where(F.col("order") < int(-(2**63) + share * (2**64 - 1)))
    return rows.orderBy("order", "_id").limit(most).drop("order")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from the labels of rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("toxic"))
    sample = _sampled(known, max_labelled).withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))
    with common.scope(spark):
        texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
        texts = texts.groupBy("_id").agg(F.min_by(F.struct("text", "toxic", "half"), F.xxhash64("text")).alias("r"))
        texts = common.written(texts.select("r.*"), "labelled-texts")
        counted = count_units(texts.where("half = 0").select("text", "toxic")).where(F.col("toxic") + F.col("clean") >= MIN_DOCS)
        train = {r.unit: (r.toxic, r.clean) for r in counted.toLocalIterator()}
        if not train:
            return Model()
        allowed = spark.sparkContext.broadcast(set(train))
        everywhere = count_units(docs.select(F.col(text_col).alias("text"), F.lit(0).alias("toxic")), allowed)
        model = Model(log_odds(train, {r.unit: r.clean for r in everywhere.toLocalIterator()}))
        allowed.unpersist()
        return calibrated(model, texts.where("half = 1"))


SCANS = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("found", T.ArrayType(T.DoubleType())), T.StructField("positive", T.ArrayType(T.DoubleType()))])


def scans(model: Model, texts: DataFrame) -> DataFrame:
    """(toxic, n, found, positive): tokens, segment scores and positive token scores of each text."""
    schema = common.arrow_schema(SCANS)

    def rows(batch):
        each = [model.scan(text) for text in common.strings(batch.column(0))]
        yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([n for n, _, _ in each], pa.int64()), pa.array([[s for _, _, s in f] for _, f, _ in each], schema.field(2).type), pa.array([p for _, _, p in each], schema.field(3).type)], schema=schema)

    return common.map_arrow(texts.select("text", "toxic"), rows, SCANS)


def calibrated(model: Model, texts: DataFrame) -> Model:
    """The model with lambda, K and the curve from (text, toxic) rows that gave no counts."""
    seen = common.written(scans(model, texts), "scans")
    clean = seen.where("coalesce(toxic, 0) = 0")
    histogram = clean.select(F.explode("positive").alias("s")).groupBy(F.round("s", 3).alias("s")).agg(F.count("*").alias("n")).collect()
    model.lam = solve_lambda(Counter({r.s: r.n for r in histogram}), clean.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    total, weight = clean.agg(F.count("*"), F.sum(F.col("n") * F.exp(-F.lit(model.lam) * best))).first()
    model.k = float(min(1.0, total / weight)) if weight else 1.0
    cells = seen.select("toxic", *features_of(model)).groupBy(F.coalesce("toxic", F.lit(0)).alias("toxic"), F.round("a", 2).alias("a"), "b").agg(F.count("*").alias("n")).collect()
    if cells:
        x = np.array([(1.0, r.a / 10, r.b) for r in cells])
        model.curve = tuple(float(w) for w in logistic(x, np.array([float(bool(r.toxic)) for r in cells]), np.array([float(r.n) for r in cells])))
    return model.bare()


def features_of(model: Model) -> list:
    """``Model.features`` of SCANS rows, as columns a and b."""
    e = F.transform("found", lambda s: F.greatest(F.lit(model.k) * F.col("n") * F.exp(-F.lit(model.lam) * s), F.lit(1e-300)))
    some = F.size("found") > 0
    a = F.when(some, F.least(F.greatest(-F.log(F.array_min(e)), F.lit(NO_SEGMENT)), F.lit(CERTAIN))).otherwise(NO_SEGMENT)
    b = F.when(some, F.log1p(F.size(F.filter(e, lambda x: x <= E_MAX)).cast("double"))).otherwise(0.0)
    return [a.alias("a"), b.alias("b")]


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``df``, ``score`` and ``passages``: (first, last, score, expected) of each significant segment, in tokens."""
    keep = df.drop("score", "passages")
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    out = T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    schema, at = common.arrow_schema(out), keep.columns.index(text_col)

    def rows(batch):
        scores, passages = [], []
        for text in common.strings(batch.column(at)):
            n, found, _ = model.scan(text)
            scores.append(model.probability(model.features(n, found)))
            passages.append([{"first": a, "last": b, "score": s, "expected": e} for a, b, s in found if (e := model.expected(n, s)) <= E_MAX])
        yield pa.record_batch([*(c.cast(f.type) for c, f in zip(batch.columns, schema, strict=False)), pa.array(scores, pa.float64()), pa.array(passages, schema.field("passages").type)], schema=schema)

    return common.map_arrow(keep, rows, out)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` with a score below ``threshold``, all columns as they are."""
    at, schema = df.columns.index(text_col), common.arrow_schema(df.schema)

    def rows(batch):
        clean = []
        for text in common.strings(batch.column(at)):
            n, found, _ = model.scan(text)
            clean.append(model.probability(model.features(n, found)) < threshold)
        kept = batch.filter(pa.array(clean, pa.bool_()))
        yield pa.record_batch([c.cast(f.type) for c, f in zip(kept.columns, schema, strict=True)], schema=schema)

    return common.map_arrow(df, rows, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
