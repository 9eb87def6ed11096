"""Mixing to target weights with soft domain membership.

A multinomial classifier, fitted on labelled documents, gives each document a posterior over domains. Rates r >= 0, how
often a document is read, minimise the squared distance of the expected domain token totals
``sum r n p`` from the targets by accelerated projected gradient, starting from one common rate. A document's
rate depends on the iterations only through its own posterior and the sequence of gradients, one number per
domain: so a step is one distributed sum, rates are recomputed where the documents are, and nothing that grows
with the corpus leaves the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, hash_share, quoted, words

#: Labelled documents that the classifier is fitted on, about (chosen by a hash of the id).
LABELLED = 20_000
BITS = 18
LEAST_DOCS = 20
#: A guard only: steps end when the targets are met or the rates stand still; a gap that is left is reported.
STEPS = 2000
TOLERANCE = 1e-4
#: Mean movement of the rates in a step at which they stand still.
STILL = 1e-7
#: Or the squared distance from the targets has lost less than a hundredth in so many steps.
STALLED, GAIN = 25, 0.01
#: Target shares of tokens by domain.
TARGETS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}


def buckets(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct hashed words, and the number of words."""
    import zlib

    ws = words(text)
    own = set(ws)
    return np.unique(np.fromiter((zlib.crc32(w) >> (32 - BITS) for w in own), np.int64, len(own))), len(ws)


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], text: str = "text", key: str = "doc_id",
                most: int = LABELLED, epochs: int = 8) -> dict:
    """Softmax regression on word presence. labelled: key and domain; other domains and nulls are left out."""

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([buckets(t)[0].astype(np.int32).tobytes() for t in texts])

    hashed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    want = labelled.where(F.col("domain").isin(names)).groupBy(quoted(key).alias("_id")).agg(F.min("domain").alias("domain"))
    want = hash_share(want, most, "_id")  # so about this many rows are broadcast and gathered
    rows = docs.select(quoted(key).alias("_id"), quoted(text).alias("_text")).join(F.broadcast(want), "_id")
    rows = rows.select("_id", "domain", F.pandas_udf(hashed, T.BinaryType())("_text").alias("x"))
    rows = rows.groupBy("_id", "domain").agg(F.min("x").alias("x"))  # of rows that repeat an id one is enough
    rows = sorted(rows.collect(), key=lambda r: r._id)
    k = len(names)
    w, bias = np.zeros((1 << BITS, k), np.float32), np.zeros(k)
    if rows:
        xs = [np.frombuffer(r.x, np.int32) for r in rows]
        y = np.array([names.index(r.domain) for r in rows])
        count = np.bincount(np.concatenate(xs), minlength=1 << BITS)
        xs = [x[count[x] >= LEAST_DOCS] for x in xs]  # rarer words only name documents
        bias = np.log((np.bincount(y, minlength=k) + 0.5) / (len(y) + 0.5 * k))
        square, order = np.full((1 << BITS, k), 1e-2, np.float32), np.random.default_rng(1)
        for _ in range(epochs):
            for i in order.permutation(len(xs)):
                x = xs[i]
                s = bias + w[x].sum(axis=0)
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = p.astype(np.float32) + 2e-4 * w[x]
                square[x] += g * g
                w[x] -= 0.1 * g / np.sqrt(square[x])
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    return {"names": names, "used": used, "w": w[used], "bias": bias}


def posteriors(model: dict, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Domain posteriors and word counts of texts."""
    w = np.zeros((1 << BITS, len(model["names"])), np.float32)
    w[model["used"]] = model["w"]
    s, n = np.zeros((len(texts), w.shape[1])), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        x, n[i] = buckets(t)
        s[i] = model["bias"] + w[x].sum(axis=0)
    p = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
    return p / p.sum(axis=1, keepdims=True) if len(s) else p, n


def last_rates(p: np.ndarray, start: float, path: list) -> tuple[np.ndarray, np.ndarray]:
    """Rates before and after the last step: path has (momentum, step times gradient) of each."""
    old = r = np.full(len(p), start)
    for momentum, g in path:
        ahead = r + momentum * (r - old)
        old, r = r, np.maximum(0.0, ahead - p @ g)
    return old, r


def rates(p: np.ndarray, start: float, path: list) -> np.ndarray:
    """Rates after the steps so far."""
    return last_rates(p, start, path)[1]


def domains(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and posterior (array in the order of the model's names) of every row."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(texts: pd.Series) -> pd.DataFrame:
        p, n = posteriors(model, texts)
        return pd.DataFrame({"n": n, "p": list(p)})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    out = docs.select(quoted(key).alias("doc_id"), F.pandas_udf(run, kind)(quoted(text)).alias("m"))
    return out.select("doc_id", F.col("m.n").alias("n_tokens"), F.col("m.p").alias("posterior"))


def fit_rates(table: DataFrame, targets: list[float], epochs: float = 1.0, steps: int = STEPS) -> dict:
    """Start rate and gradient path that bring the expected totals to the targets (shares of the tokens to read).

    table: n_tokens and posterior. Steps are first preconditioned by the domains' k x k matrix, so that rare domains
    converge too; rates that meet the targets are optimal by any measure. Targets that no nonnegative rates reach are
    approached as closely as they can be, by plain steps. gap: the largest distance left, as a share of the budget.
    """
    k = len(targets)

    def sums(f) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for pdf in batches:
                if len(pdf):
                    total = total + f(pdf["n_tokens"].to_numpy(np.float64), np.array(pdf["posterior"].tolist(), np.float64))
            if not np.isscalar(total):
                yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        rows = table.select("n_tokens", "posterior").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted(map(tuple, rows))])

    first = sums(lambda n, p: np.concatenate([[n.sum()], n @ p, ((p * n[:, None]).T @ p).ravel()]))
    if not first.size or first[0] <= 0:
        return {"start": 1.0, "path": [], "totals": [0.0] * k, "wanted": [0.0] * k, "gap": 0.0}
    budget = epochs * first[0]
    want = np.array(targets, np.float64) / sum(targets) * budget
    gram = first[1 + k :].reshape(k, k)
    measures = [np.linalg.pinv(gram, rcond=1e-10, hermitian=True), np.eye(k) / np.linalg.eigvalsh(gram).max()]
    start = budget / first[0]
    path: list = []
    totals, previous, age = start * first[1 : 1 + k], None, 0
    measure = measures.pop(0)
    errors: list[float] = []
    for _ in range(steps):
        if np.abs((totals - want) / budget).max() < TOLERANCE:
            break
        # The next step leaves from the point ahead: its totals follow from those of the last two points.
        momentum = 0.0 if previous is None else age / (age + 3)
        ahead = totals if previous is None else totals + momentum * (totals - previous)
        path.append((momentum, measure @ (ahead - want)))
        now = list(path)

        def moved(n: np.ndarray, p: np.ndarray, now: list = now) -> np.ndarray:
            old, r = last_rates(p, start, now)
            return np.append((n * r) @ p, n @ np.abs(r - old))

        error = (totals - want) @ measure @ (totals - want)
        got = sums(moved)
        previous, totals = totals, got[:k]
        age = age + 1 if (totals - want) @ measure @ (totals - want) <= error else 0  # restart when it swings over
        errors.append(float((totals - want) @ measure @ (totals - want)))
        stalled = len(errors) > STALLED and min(errors[-STALLED:]) > (1 - GAIN) * min(errors[:-STALLED])
        if stalled or got[k] < STILL * budget:
            if not measures:
                break
            measure, previous, age, errors = measures.pop(0), None, 0, []
    return {"start": start, "path": path, "totals": list(totals), "wanted": list(want), "gap": float(np.abs((totals - want) / budget).max())}


def copies(rate, key: str):
    """Whole copies whose expectation over ids is the rate: the fraction is rounded by a hash of the id."""
    u = F.pmod(F.xxhash64(quoted(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id",
        epochs: float = 1.0) -> DataFrame:
    """docs with a struct column ``mix`` (``_mix`` where that name is taken): n_tokens, posterior, rate and copies.

    epochs: tokens to read, as a multiple of the corpus's own. A warning names targets that are not met.

    labelled: key and domain. A null or empty text has no tokens and the posterior of no words; a null id rounds
    like any other; repeated rows get the same rate; without labels all posteriors are equal; an empty table stays empty.
    """
    names = list(targets)
    model = fit_domains(docs, labelled, names, text, key)
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(domains(docs, model, text, key))
    fitted = fit_rates(table, [targets[n] for n in names], epochs)
    scratch.drop(table)
    if fitted["gap"] >= TOLERANCE:
        read = ", ".join(f"{n} {t:.0f} of {w:.0f}" for n, t, w in zip(names, fitted["totals"], fitted["wanted"], strict=True))
        warnings.warn(f"targets are not met, tokens to read: {read}", stacklevel=2)
    (name,) = fresh(docs, "mix")
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType())])

    def run(texts: pd.Series) -> pd.DataFrame:
        p, n = posteriors(model, texts)
        return pd.DataFrame({"n_tokens": n, "posterior": list(p), "rate": rates(p, fitted["start"], fitted["path"])})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    out = docs.withColumn(name, F.pandas_udf(run, kind)(quoted(text)))
    return out.withColumn(name, F.col(name).withField("copies", copies(F.col(name)["rate"], key)))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from a table of quality and toxic flags."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
