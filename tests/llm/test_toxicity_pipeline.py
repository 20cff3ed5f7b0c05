"""The classifier chain and the whole pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curata.llm import toxicity
from tests.llm.test_jaccard_join import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def toxic_corpus(n=400, seed=9):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
        if bad:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "awful", "nasty"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad and i % 7 > 0), int(bad)))
    return rows, labels


def test_chain_learns_from_earlier_categories(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "vile awful nasty " * 9), (902, "vile awful nasty " * 9)], "doc_id long, text string").withColumn("lang", F.lit("x"))
    given = spark.createDataFrame([*labels[:300], (5, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.judge_toxicity(docs, given).collect()
    assert len(found) == len(rows) + 4 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in found)
    held_out = [r for r in found if 300 <= r.doc_id < 400]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in held_out) >= 0.97 * len(held_out)
    assert {(r.doc_id, r.toxic) for r in found if r.doc_id >= 900} == {(900, False), (901, False), (902, True)}
    chain = toxicity.toxicity_chain(docs, given)
    assert [m[0] for m in chain.models] == ["low_quality", "toxic"] and [len(m[3]) for m in chain.models] == [0, 1] and chain.models[1][3][0] != 0


def plain_fit(x, y, penalty):
    """L1 logistic regression by accelerated proximal steps; the intercept isn't penalised."""
    import numpy as np

    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x1.shape[1])
    step, t = 4 * len(x) / np.linalg.norm(x1, 2) ** 2, 1.0
    for _ in range(20_000):
        grad = x1.T @ (1 / (1 + np.exp(-x1 @ v)) - y) / len(x)
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + (old - 1) / t * (new - w)
        w = new
    return w


def test_chain_equals_a_plain_one(spark):
    """Token choice per fold, out-of-fold probabilities and both models, computed again without Spark."""
    import numpy as np

    rows, labels = toxic_corpus(150, seed=4)
    rows += [(500 + i, t) for i, t in rows[:40]]                       # copies share a fold
    labels += [(500 + i, q, x) for i, q, x in labels[:40]]
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    penalty, min_docs, most = 0.01, 4, 60
    chain = toxicity.toxicity_chain(docs, given, penalty=penalty, min_docs=min_docs, vocabulary_size=most, max_iter=600)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.expr("pmod(xxhash64(text), 3)").alias("f")).collect()}
    tokens = {i: set(toxicity.tokens_of(t)) for i, t in rows}
    y = {i: (float(1 - q), float(x)) for i, q, x in labels}

    def telling(ids):
        n, counts = len(ids), {}
        for i in ids:
            for t in tokens[i]:
                c = counts.setdefault(t, [0, 0, 0])
                c[0] += 1
                c[1] += y[i][0]
                c[2] += y[i][1]
        total = [sum(y[i][k] for i in ids) for k in (0, 1)]

        def chi(c, k):
            a, b, d = c[0], c[1 + k], total[k]
            under = a * (n - a) * d * (n - d)
            return (b * (n - a - d + b) - (a - b) * (d - b)) ** 2 * n / under if under else 0.0

        scored = sorted((-max(chi(c, 0), chi(c, 1)), t) for t, c in counts.items() if c[0] >= min_docs)
        return [t for _, t in scored[:most]]

    matrix = lambda ids, words, more: np.hstack([np.array([[float(t in tokens[i]) for t in words] for i in ids]), more])
    ids = [i for i, _ in rows]
    out = {}
    for f in set(fold.values()):
        rest, here = [i for i in ids if fold[i] != f], [i for i in ids if fold[i] == f]
        words = telling(rest)
        w = plain_fit(matrix(rest, words, np.zeros((len(rest), 0))), np.array([y[i][0] for i in rest]), penalty)
        p = 1 / (1 + np.exp(-(matrix(here, words, np.zeros((len(here), 0))) @ w[:-1] + w[-1])))
        out.update(zip(here, p))
    words = telling(ids)
    first = plain_fit(matrix(ids, words, np.zeros((len(ids), 0))), np.array([y[i][0] for i in ids]), penalty)
    second = plain_fit(matrix(ids, words, np.array([[out[i]] for i in ids])), np.array([y[i][1] for i in ids]), penalty)
    p_low = 1 / (1 + np.exp(-(matrix(ids, words, np.zeros((len(ids), 0))) @ first[:-1] + first[-1])))
    p_toxic = 1 / (1 + np.exp(-(matrix(ids, words, p_low[:, None]) @ second[:-1] + second[-1])))
    found = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in chain.score(docs).collect()}
    assert max(abs(found[i][0] - p) for i, p in zip(ids, p_low)) < 5e-3
    assert max(abs(found[i][1] - p) for i, p in zip(ids, p_toxic)) < 5e-3


def test_chain_without_labels_or_with_one_class(spark):
    rows, labels = toxic_corpus(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.p_toxic < 1e-9, r.toxic) for r in toxicity.judge_toxicity(docs, none).collect()} == {(True, False)}
    one = spark.createDataFrame([(i, 1, 1) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.judge_toxicity(docs, one).collect()} == {True}
    assert toxicity.without_toxic(docs.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with a toxic part, copies, leaks, a secret and odd rows; the ids that should stay."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = toxic_corpus(200)
    rnd = random.Random(2)
    item = " ".join("".join(rnd.choice("etaoinshr") for _ in range(6)) for _ in range(30))
    clean = [t for i, t in rows if i % 4]
    extra = [(1000, clean[0] + " x"), (1001, clean[1]), (1002, item + " and more words after it"), (1003, "password=hunter22 is here " + clean[2][::-1]), (1004, None), (1005, "")]
    every = [*rows, *extra]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(every)


def test_pipeline(spark, small):
    import public_tokenizers
    import tiktoken
    from curata.llm.byte_bpe import load_ranks

    folder, texts = small
    kept = {i: t for i, t in texts.items() if i >= 1000 or i % 4}
    classes = brute(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if classes[i][1] == i and i != 1002}
    kept[1003] = kept[1003].replace("password=hunter22", "[SECRET]")
    assert not {1000, 1001, 1002} & set(kept)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {i: plain.encode_ordinary(t or "") for i, t in kept.items()} and len(found) == len(kept)
    assert all(r.decoded_sha256 == hashlib.sha256((kept[r.doc_id] or "").encode()).hexdigest() for r in found)


def test_stages_keep_columns_and_take_empty_tables(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            clashing = docs.withColumns({"id": F.lit(1), "p_toxic": F.lit("x"), "node": F.lit("y")}).where("doc_id < 40")
            assert out.columns == docs.columns and stage(spark, clashing, folder).columns == clashing.columns
