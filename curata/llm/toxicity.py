"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another.  The model of a category sees the words of the text
(and the first four letters of each word) and the probabilities of the categories before it.
While training, those earlier probabilities are out-of-fold: each row's comes from a model that
was fitted on the other folds, so later models learn from probabilities as uncertain as
the ones they get when predicting.  The models are sparse logistic regressions (L1).

Training uses at most ``train_docs`` labelled documents, chosen by a hash of the id (a bounded,
documented sample; whole texts).  The models see the ``vocabulary_size`` tokens that depend most on
a category (chi-squared), of those found in at least ``min_docs`` of these documents.
Every document is scored.

Defined results: null and empty texts have no words and get the models' base rate; labels null
or not given do not train; a document labelled several times counts with its highest labels;
with no labelled rows every probability is 0; a category of a single class predicts
that class; repeated rows are scored each; empty tables give no rows; extra columns stay untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import in_turn
from curata.session import checkpointed

_TOKENS, _IN = "__tokens", "__features"
_WORD = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[str]:
    """Distinct lower-cased words and, marked, the first four letters of words longer than that."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return sorted(words | {"^" + w[:4] for w in words if len(w) > 4})


def tokens_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens_of(t) for t in texts], dtype=object)

    return tokens(text)


class ToxicityChain:
    """A fitted chain: per category its name, intercept, weights of tokens and of the probabilities before it.

    ``models`` holds (name, intercept, {token: weight}, [weight of each earlier probability]); L1 leaves few
    weights, so a chain is small and goes to the tasks with the function."""

    def __init__(self, models: list[tuple[str, float, dict[str, float], list[float]]]):
        self.models = models

    def column(self, text: Column) -> Column:
        """struct<p_<category> ...> of a text."""
        models, names = self.models, [_p(m[0]) for m in self.models]
        wanted = {t for _, _, weights, _ in models for t in weights}
        starts = {t[1:] for t in wanted if t[0] == "^"}

        def probabilities(text: str | None) -> list[float]:
            words = set(_WORD.findall(text.lower())) if text else set()
            found = sorted((words & wanted) | {"^" + w[:4] for w in words if len(w) > 4 and w[:4] in starts})
            out: list[float] = []
            for model in models:
                out.append(_probability(model, found, out))
            return out

        @F.arrow_udf(", ".join(f"`{n}` double" for n in names))
        def score(texts: pa.Array) -> pa.Array:
            rows = [probabilities(t) for t in in_turn(texts)]
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))], names)

        return score(text)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The documents with a probability column ``p_<category>`` each."""
        return docs.withColumn("__p", self.column(F.col(text_col))).withColumns({_p(m[0]): F.col("__p")[_p(m[0])] for m in self.models}).drop("__p")


def _p(name: str) -> str:
    return f"p_{name}"


def _features(rows: DataFrame, words: list[str], earlier: list[str]) -> DataFrame:
    """Label columns and the feature vector: 1 for each of ``words`` that a row has, then its earlier probabilities.

    The vectors are made by hand: Spark's own vectorisers name every feature in the column's metadata, which every
    plan, job and file of a fit would carry along."""
    place, size = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)}), len(words)

    @F.udf(VectorUDT())
    def vector(tokens: list[str], given: list[float]):
        own = sorted(i for t in tokens if (i := place.value.get(t)) is not None)
        return Vectors.sparse(size + len(given), own + list(range(size, size + len(given))), [1.0] * len(own) + given)

    before = F.array(*[F.col(c) for c in earlier]) if earlier else F.array().cast("array<double>")
    kept = [c for c in rows.columns if c.startswith("__") and c not in (_TOKENS, "__id", "__fold")]
    return rows.select(*kept, vector(_TOKENS, before).alias(_IN))


def _fit(rows: DataFrame, words: list[str], earlier: list[str], name: str, penalty: float, max_iter: int) -> tuple[str, float, dict[str, float], list[float]]:
    """The model of one category, as a chain holds it."""
    table = checkpointed(_features(rows, words, earlier), "toxicvectors")
    lr = LogisticRegression(featuresCol=_IN, labelCol=f"__{name}", maxIter=max_iter, regParam=penalty, elasticNetParam=1.0, standardization=False, family="binomial")
    fitted = lr.fit(table)
    given = fitted.coefficients.toArray()
    return name, float(fitted.intercept), {w: float(x) for w, x in zip(words, given) if x}, [float(x) for x in given[len(words):]]


def _probability(model: tuple[str, float, dict[str, float], list[float]], tokens: Iterable[str], before: list[float]) -> float:
    _, intercept, weights, of_before = model
    z = intercept + sum(weights[t] for t in tokens if t in weights) + sum(a * b for a, b in zip(of_before, before))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _scored(rows: DataFrame, model: tuple, earlier: list[str], out: str) -> DataFrame:
    """The rows with the model's probability."""
    @F.pandas_udf("double")
    def score(tokens: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([_probability(model, t, list(b)) for t, b in zip(tokens, before)], dtype=float)

    before = F.array(*[F.col(c) for c in earlier]) if earlier else F.array().cast("array<double>")
    return rows.withColumn(out, score(_TOKENS, before))


def _base_rate(rows: DataFrame, label: str) -> float:
    """Log odds of a label among rows without words."""
    p = rows.agg(F.avg(label)).first()[0]
    return math.log(p / (1 - p)) if 0 < p < 1 else 700.0 * (2 * p - 1)


def _telling_tokens(rows: DataFrame, labels: list[str], n: int, min_docs: int, most: int) -> list[str]:
    """At most ``most`` tokens with the highest chi-squared to one of the labels."""
    given = rows.agg(*(F.sum(c).alias(c) for c in labels)).first()
    counted = rows.select(*labels, F.explode(_TOKENS).alias("token")).groupBy("token").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in labels)).where(F.col("n") >= min_docs)

    def chi(c: str) -> Column:
        all_of, both, has = given[c], F.col(c), F.col("n")
        cross = both * (n - has - all_of + both) - (has - both) * (all_of - both)
        return F.coalesce(F.try_divide(cross * cross * n, has * (n - has) * all_of * (n - all_of)), F.lit(0.0))

    scored = counted.select("token", F.greatest(*(chi(c) for c in labels)).alias("chi") if len(labels) > 1 else chi(labels[0]).alias("chi"))
    return [r.token for r in scored.orderBy(F.desc("chi"), "token").limit(most).collect()]


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", train_docs: int = 6_000,
                min_docs: int = 6, folds: int = 3, penalty: float = 5e-4, vocabulary_size: int = 1 << 15, max_iter: int = 25) -> ToxicityChain:
    """Fit the chain; ``labels`` has (id, one 0/1 column per category, in chain order).

    Folds are dealt by a hash of the text, so copies share one, and a fold's model chooses its tokens
    from the other folds alone."""
    known = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.max(F.col(c).cast("double")).alias(f"__{c}") for c in categories))
             .dropna().orderBy(F.xxhash64("__id"), "__id").limit(train_docs))
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")      # at most train_docs rows
            .withColumn(_TOKENS, tokens_column(F.col("__text"))).withColumn("__fold", F.pmod(F.xxhash64("__text"), F.lit(folds))).drop("__text"))
    rows = checkpointed(rows, "toxicwords")
    sizes = {r[0]: r[1] for r in rows.groupBy("__fold").count().collect()}
    n = sum(sizes.values())
    if not n or not rows.where(F.size(_TOKENS) > 0).head(1):
        return ToxicityChain([(c, -700.0 if not n else _base_rate(rows, f"__{c}"), {}, []) for c in categories])
    own = [f"__{c}" for c in categories]
    telling = lambda part, size: _telling_tokens(part, own, size, min(min_docs, size), vocabulary_size)
    words = telling(rows, n)
    rest = {f: (rows.where(F.col("__fold") != f), n - k) if k < n else (rows, n) for f, k in sizes.items()}
    rest_words = {f: telling(*part) for f, part in rest.items()} if len(categories) > 1 else {}
    models, earlier = [], []
    for i, c in enumerate(categories):
        models.append(_fit(rows, words, earlier, c, penalty, max_iter))
        if i + 1 < len(categories):      # out-of-fold probabilities for the models after it
            parts = []
            for f in sizes:
                others = rows.where(F.col("__fold") != f) if sizes[f] < n else rows
                parts.append(_scored(rows.where(F.col("__fold") == f), _fit(others, rest_words[f], earlier, c, penalty, max_iter), earlier, _p(c)))
            rows = checkpointed(reduce(DataFrame.unionByName, parts), "toxicwords")
            earlier.append(_p(c))
    return ToxicityChain(models)


def toxicity_chain(docs: DataFrame, labels: DataFrame, **options) -> ToxicityChain:
    """The chain low quality -> toxic; labels has (doc_id, quality, toxic)."""
    given = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
    return train_chain(docs, given, ["low_quality", "toxic"], **options)


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents with ``p_low_quality``, ``p_toxic`` and ``toxic``."""
    return toxicity_chain(docs, labels, **options).score(docs).withColumn("toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that are not judged toxic, unchanged."""
    chain = toxicity_chain(docs, labels, **options)
    return docs.where(chain.column(F.col("text"))["p_toxic"] < threshold)
