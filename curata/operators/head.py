"""Linear multi-label head fitted and scored on Spark.

The reference fine-tunes a transformer; what is kept is its last layer and its
protocol: a linear head with mean BCE, warm-started task after task, scored on
every task.  The head (L x D doubles) is bounded by the model size, never by
the data, so it travels to executors as a broadcast variable.  Each epoch is
one distributed pass: ``mapInPandas`` turns an Arrow batch of feature rows
into a partial gradient (numpy matrix product), the partials are summed per
chunk by a ``groupBy``, and only the summed gradient (L x (D+1) numbers)
reaches the driver.  The feature table is checkpointed once, so every epoch re-reads it
instead of re-running its lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty



@dataclass
class Head:
    weights: np.ndarray   # (L, D)
    bias: np.ndarray      # (L,)

    @staticmethod
    def zeros(n_labels: int, dim: int) -> "Head":
        return Head(np.zeros((n_labels, dim)), np.zeros(n_labels))

    def to_frame(self, spark, **keys) -> DataFrame:
        """Long table (keys..., label_id, weights, bias) for the head catalogue."""
        rows = [(*keys.values(), i, [float(v) for v in self.weights[i]], float(self.bias[i]))
                for i in range(self.weights.shape[0])]
        kschema = ", ".join(f"{k} {_sql_type(v)}" for k, v in keys.items())
        schema = (kschema + ", " if kschema else "") + "label_id int, weights array<double>, bias double"
        return spark.createDataFrame(rows, schema)


def _sql_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint"
    if isinstance(v, float):
        return "double"
    return "string"


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()]) if len(s) else np.zeros((0, 0))


def score_linear_head(df: DataFrame, head: Head, features: str = "embedding", key: str = "note_id",
                      keep: Sequence[str] = ()) -> DataFrame:
    """logit = W x + b for every label; long output (keep..., key, label_id, logit).

    One Arrow batch at a time: X (rows x D) @ W.T — a vectorised pandas UDF; the
    head is a broadcast variable.
    """
    bc = df.sparkSession.sparkContext.broadcast((head.weights, head.bias))

    @F.pandas_udf(Ty.ArrayType(Ty.DoubleType()))
    def logits(x: pd.Series) -> pd.Series:
        w, b = bc.value
        if len(x) == 0:
            return pd.Series([], dtype=object)
        z = _stack(x) @ w.T + b
        return pd.Series(list(z))

    return df.select(*keep, key, F.posexplode(logits(F.col(features))).alias("label_id", "logit")).withColumn(
        "label_id", F.col("label_id").cast("int"))


GRAD_CHUNK = 1024      # doubles per row of a partial gradient


def gradient_pass(df: DataFrame, heads: np.ndarray, biases: np.ndarray, features: str, targets: str
                  ) -> tuple[np.ndarray, np.ndarray, int]:
    """Summed BCE gradient of K heads at once: (K, L, D), (K, L) and the row count.

    heads: (K, L, D); biases: (K, L).  `targets` is array<int> of positive label ids.
    Each task emits its partial gradient as rows of GRAD_CHUNK doubles (chunk id,
    values); the chunks are summed per chunk id with numpy (applyInPandas), so the
    shuffle carries tasks x model-size numbers in dense arrays, and the driver gets
    one summed copy.  The input is coalesced (no shuffle) to at most one task per
    core, which bounds the number of partials.
    """
    k, n_labels, dim = heads.shape
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((heads, biases))
    size = k * n_labels * (dim + 1) + 1                       # gradient, bias gradient, row count

    def part(it):
        w, b = bc.value
        g = np.zeros_like(w)
        gb = np.zeros_like(b)
        n = 0
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = _stack(pdf[features])
            y = np.zeros((len(pdf), n_labels))
            for i, ids in enumerate(pdf[targets].to_numpy()):
                y[i, np.asarray(ids, dtype=int)] = 1.0
            for t in range(k):
                p = 1.0 / (1.0 + np.exp(-(x @ w[t].T + b[t])))
                r = p - y
                g[t] += r.T @ x
                gb[t] += r.sum(axis=0)
            n += len(pdf)
        flat = np.concatenate([np.concatenate([g, gb[:, :, None]], axis=2).ravel(), [float(n)]])
        starts = range(0, len(flat), GRAD_CHUNK)
        yield pd.DataFrame({"chunk": [i // GRAD_CHUNK for i in starts],
                            "vals": [flat[i:i + GRAD_CHUNK] for i in starts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["vals"].to_numpy()), axis=0)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "vals": [total]})

    src = df.select(features, targets)
    schema = "chunk int, vals array<double>"
    parts = src.mapInPandas(part, schema)
    summed = parts.groupBy("chunk").applyInPandas(add, schema).collect()   # size / GRAD_CHUNK rows
    bc.unpersist()
    flat = np.zeros(size)
    for r in summed:
        v = np.asarray(r["vals"], dtype=np.float64)
        flat[r["chunk"] * GRAD_CHUNK: r["chunk"] * GRAD_CHUNK + len(v)] = v
    n = int(round(flat[-1]))
    full = flat[:-1].reshape(k, n_labels, dim + 1)
    return full[:, :, :dim].copy(), full[:, :, dim].copy(), n


def lr_at(step: int, lr: float, warmup: int, total: int) -> float:
    """Step size of the 0-based `step`: linear warm-up over `warmup` steps, then
    linear decay that reaches 0 at `total` (the usual warm-up schedule)."""
    if step < warmup:
        return lr * step / warmup
    if total <= warmup:
        return lr
    return lr * max(0.0, (total - step) / (total - warmup))


def fit_linear_heads(df: DataFrame, inits: Sequence[Head], lrs: Sequence[float], warmups: Sequence[int],
                     epochs: int, features: str = "embedding", targets: str = "label_ids",
                     on_epoch: Callable[[int, list[Head]], None] | None = None) -> list[Head]:
    """M2 (and the trial pass of M4): full-batch gradient steps on mean BCE for K heads at once.

    One distributed pass per epoch trains every head; the driver only updates
    K x L x (D+1) numbers.  `on_epoch(epoch, heads)` lets callers score the
    heads after each epoch (validation metric for early stopping).
    """
    w = np.stack([h.weights for h in inits]).astype(np.float64)
    b = np.stack([h.bias for h in inits]).astype(np.float64)
    n_labels = w.shape[1]
    for e in range(epochs):
        g, gb, n = gradient_pass(df, w, b, features, targets)
        if n == 0:
            break
        scale = 1.0 / (n * n_labels)
        for t in range(len(inits)):
            step = lr_at(e, lrs[t], warmups[t], epochs)
            w[t] -= step * scale * g[t]
            b[t] -= step * scale * gb[t]
        if on_epoch is not None:
            on_epoch(e, [Head(w[t].copy(), b[t].copy()) for t in range(len(inits))])
    return [Head(w[t], b[t]) for t in range(len(inits))]


def fit_linear_head(df: DataFrame, init: Head, lr: float, epochs: int, warmup: int = 0,
                    features: str = "embedding", targets: str = "label_ids") -> Head:
    """M2: one head, warm-started from `init`."""
    return fit_linear_heads(df, [init], [lr], [warmup], epochs, features, targets)[0]


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | Ty.StructType
               ) -> DataFrame:
    """M6: batch scoring by a user model function over Arrow batches.

    `fn` maps a pandas batch to a pandas frame with the declared columns (e.g.
    note_id, label_id, y_prob); missing columns fail the task with a clear error.
    """
    st = schema if isinstance(schema, Ty.StructType) else Ty._parse_datatype_string(schema)
    names = [f.name for f in st.fields]

    def run(it):
        for pdf in it:
            out = fn(pdf)
            missing = [c for c in names if c not in out.columns]
            if missing:
                raise ValueError(f"model function output lacks columns {missing}")
            yield out[names]

    return df.mapInPandas(run, st)


def head_from_rows(rows: list, n_labels: int, dim: int) -> Head:
    """Rebuild a Head from collected (label_id, weights, bias) rows (bounded: L rows)."""
    h = Head.zeros(n_labels, dim)
    for r in rows:
        h.weights[r["label_id"]] = np.asarray(r["weights"], dtype=np.float64)
        h.bias[r["label_id"]] = r["bias"]
    return h
