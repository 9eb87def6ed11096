"""Quality classifier by co-training two views: text content, and page metadata.

Each view has a logistic model on dense features. Both start from the labelled rows; in every round each view scores
all unlabelled documents and hands confident ones, labelled by itself, to the other view. Afterwards each
view is calibrated on labelled rows held out from training, the calibrated views are combined there by a
logistic model, and all documents are scored.

Bounds, for fitting only: about LABELLED labelled rows and EXCHANGED pseudo-labels a view and round, chosen by a hash of
the id. Scoring, and the search for confident documents, cover all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, hash_share, quoted, release, tidy

LABELLED = 20_000
EXCHANGED = 1_000
ROUNDS = 3
CONFIDENT = 0.98
#: A document with a lower combined probability of being good is rejected.
THRESHOLD = 0.25
META = ("lang", "source", "n_chars")
HASHED = 32
SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
SCORE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("content", "metadata", "score")])


def content(text: str | None) -> np.ndarray:
    """Shape of a text: byte frequencies, word and line statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(data))
    ws = data.split()
    w = max(1, len(ws))
    lines = [x for x in data.split(b"\n") if x.strip()]
    low = len(set(ws)) / w
    stats = [
        np.log1p(len(ws)), np.log1p(len(data) / w), low, low * np.log1p(w), len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n, hist[128:].sum() / n,
        sum(x[-1] < 48 for x in ws) / w, len(SYMBOLS.findall(data)) / w, 1.0 if ws else 0.0,
    ]
    return np.concatenate([np.sqrt(hist[32:127] / n), stats])


def metadata(row: tuple) -> np.ndarray:
    """Page metadata: strings hashed to indicators, numbers as logarithm and decade."""
    import zlib

    out = np.zeros(HASHED * len(row) + len(row))
    for k, v in enumerate(row):
        at = HASHED * k
        if v is None or v != v:
            out[at] = 1
        elif isinstance(v, str):
            out[at + 1 + zlib.crc32(v.encode("utf-8", "surrogatepass")) % (HASHED - 1)] = 1
        else:
            size = np.log1p(abs(float(v)))
            out[at + 1 + min(HASHED - 2, int(2 * size))] = 1
            out[HASHED * len(row) + k] = size / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> dict:
    """Ridge logistic regression by Newton steps, features standardised."""
    mean, scale = np.average(x, axis=0, weights=weight), np.sqrt(np.average((x - np.average(x, axis=0, weights=weight)) ** 2, axis=0, weights=weight)) + 1e-6
    z = np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]), -8, 8)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def logit(m: dict | None, x: np.ndarray) -> np.ndarray:
    if m is None:
        return np.zeros(len(x))
    z = np.clip(np.column_stack([(x - m["mean"]) / m["scale"], np.ones(len(x))]), -8, 8)
    return np.clip(z @ m["w"], -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _features(docs: DataFrame, text: str, key: str, meta: tuple[str, ...]) -> DataFrame:
    """doc_id and both views' features as float16 bytes: what the rounds read instead of texts."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [content(t).astype(np.float16).tobytes() for t in pdf["text"]]
            m = [metadata(r).astype(np.float16).tobytes() for r in zip(*(pdf[f"m{i}"] for i in range(len(meta))), strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "content": c, "metadata": m})

    own = [_meta(docs, c).alias(f"m{i}") for i, c in enumerate(meta)]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(quoted(key).isNotNull()).select(quoted(key).alias("id"), quoted(text).alias("text"), *own)
    return rows.mapInPandas(tidy(build), f"id {kind}, content binary, metadata binary")


def _meta(docs: DataFrame, c: str) -> Column:
    if c not in docs.columns:
        return F.lit(None).cast("string")
    return quoted(c).cast("double") if isinstance(docs.schema[c].dataType, T.NumericType) else quoted(c).cast("string")


def _matrix(rows: list, view: str) -> np.ndarray:
    return np.array([np.frombuffer(r[view], np.float16) for r in rows], np.float64)


VIEWS = ("content", "metadata")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", meta: tuple[str, ...] = META,
        labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> dict:
    """Models of both views, their calibration and combination. labels: key and quality (0, 1); nulls are left out.

    With labels of one class only, or none, the model knows nothing: it scores every document 0.5 and rejects none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    y = labels.where("quality IS NOT NULL").groupBy(quoted(key).alias("id")).agg(F.max("quality").cast("double").alias("y"))
    features = scratch.keep(_features(docs, text, key, meta).join(y, "id", "left"))
    # Of rows that repeat an id one is enough.
    some = hash_share(features.where("y IS NOT NULL"), labelled)
    once = some.groupBy("id", "y").agg(F.min(F.struct("content", "metadata")).alias("v")).select("id", "y", "v.*")
    known = sorted(once.collect(), key=lambda r: r.id)
    target = np.array([r.y for r in known])
    held = np.arange(len(known)) % 4 == 0
    if min((target[held] > 0.5).sum(), (target[held] <= 0.5).sum(), (target[~held] > 0.5).sum(), (target[~held] <= 0.5).sum(), key=int) < 1:
        return {"meta": meta, "content": None, "metadata": None, "calibrate": {v: None for v in VIEWS}, "combine": None}
    train = {v: (_matrix([r for r, h in zip(known, held, strict=True) if not h], v), target[~held], np.ones(int((~held).sum()))) for v in VIEWS}
    share = target[~held].mean()
    models = {v: fit_logistic(*train[v]) for v in VIEWS}
    for _ in range(rounds):
        scored = scratch.keep(_score_features(features.where("y IS NULL").drop("y"), models))
        picked = None
        for view, other in (VIEWS, VIEWS[::-1]):
            for good, part in ((1.0, share), (0.0, 1 - share)):
                sure = scored.where(f"p_{view} >= {CONFIDENT}" if good else f"p_{view} <= {1 - CONFIDENT}")
                some = hash_share(sure, max(1, int(exchanged * part))).select("id", F.lit(other).alias("view"), F.lit(good).alias("good"))
                picked = some if picked is None else picked.unionByName(some)
        rows = features.join(F.broadcast(picked), "id").collect()  # about 2 * exchanged rows
        rows.sort(key=lambda r: (r.id, r.view, r.good))
        scratch.drop(scored)
        for v in VIEWS:
            if own := [r for r in rows if r.view == v]:
                x, t, w = train[v]
                more = np.array([r.good for r in own])
                models[v] = fit_logistic(np.vstack([x, _matrix(own, v)]), np.concatenate([t, more]), np.concatenate([w, np.full(len(own), 0.5)]))
    valid = [r for r, h in zip(known, held, strict=True) if h]
    t, ones = target[held], np.ones(int(held.sum()))
    raw = {v: logit(models[v], _matrix(valid, v))[:, None] for v in VIEWS}
    calibrate = {v: fit_logistic(raw[v], t, ones, ridge=1e-2) for v in VIEWS}
    both = np.column_stack([logit(calibrate[v], raw[v]) for v in VIEWS])
    scratch.drop(features)
    return {"meta": meta, **models, "calibrate": calibrate, "combine": fit_logistic(both, t, ones, ridge=1e-2)}


def _score_features(features: DataFrame, models: dict) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"id": pdf["id"]}
            for v in VIEWS:
                x = np.frombuffer(b"".join(pdf[v]), np.float16).reshape(len(pdf), -1).astype(np.float64)
                out[f"p_{v}"] = _sigmoid(logit(models[v], x))
            yield pd.DataFrame(out)

    return features.mapInPandas(tidy(run), f"id {features.schema['id'].dataType.simpleString()}, p_content double, p_metadata double")


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column ``quality`` (``_quality`` where that name is taken): the calibrated probabilities
    content and metadata, their combination score, and rejected (score below the threshold)."""
    (name,) = fresh(docs, "quality")
    meta = model["meta"]

    def run(texts: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        x = {
            "content": np.array([content(t).astype(np.float16) for t in texts], np.float64).reshape(len(texts), -1),
            "metadata": np.array([metadata(r).astype(np.float16) for r in zip(*columns, strict=True)], np.float64).reshape(len(texts), -1),
        }
        each = {v: logit(model["calibrate"][v], logit(model[v], x[v])[:, None]) for v in VIEWS}
        total = logit(model["combine"], np.column_stack([each[v] for v in VIEWS]))
        del x
        release()
        return pd.DataFrame({v: _sigmoid(each[v]) for v in VIEWS} | {"score": _sigmoid(total)})

    run.__annotations__ = {"texts": pd.Series, "columns": pd.Series, "return": pd.DataFrame}
    out = docs.withColumn(name, F.pandas_udf(run, SCORE)(quoted(text), *(_meta(docs, c) for c in meta)))
    return out.withColumn(name, F.col(name).withField("rejected", F.col(name)["score"] < threshold))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", meta: tuple[str, ...] = META) -> DataFrame:
    """``score`` of all docs by a model fitted on them and their labels.

    Nulls: a null text is empty, null metadata is a value of its own, rows without id are scored but not used to fit.
    Repeated rows are each scored. An empty table stays empty.
    """
    return score(docs, fit(docs, labels, text, key, meta), text)
