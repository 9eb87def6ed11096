"""Language-model scoring with a gated recurrent network in numpy and a class-factored softmax.

Word counts of all training texts give the base model. The recurrent model predicts the most frequent words and one
``rest`` symbol; a word of the rest has its share of the rest's smoothed counts, so the model gives every text a
probability. Documents run through the network in lanes, in windows of steps; the state is carried from window to
window until the document ends, so its log-likelihood is that of the whole text.

Training is distributed: all documents that are not held out (or one in ``one_in`` where a caller asks for it) are dealt to
shards, each runs truncated backpropagation from the common weights, and the weights are averaged by tokens, round
by round. Each shard learns from whole documents, once a round. Counts, vocabulary and scores cover all documents. Words that are not among the KNOWN most frequent ones are
looked up by a join, so no table that grows with the vocabulary is sent anywhere.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, tidy, words

#: Words that the network predicts; words whose counts travel with the tasks (at most so many).
PREDICTED = 2000
KNOWN = 131_072
HIDDEN = 16
TRAIN_ONE_IN = 1
ROUNDS = 1
#: Steps of truncated backpropagation, and of a scoring window; lanes of each.
STEPS, WINDOW = 16, 48
TRAIN_LANES, LANES = 256, 320
#: Tokens after which training starts a long text's state anew; scoring never does.
CUT = 512
RATE = 0.08
#: Bound of a gradient's entries; what keeps a step finite where all gradients so far are none; exponents that are safe.
CLIP, TINY, SAFE = 50.0, 1e-12, 80.0
#: Tokens that are scored together.
LOAD = 3_000_000
#: Tokens that a shard learns from, about; shards at least, so that small corpora use several executors; tokens that are
#: dealt to the lanes together in training.
SHARD_TOKENS, LEAST_SHARDS, TRAIN_LOAD = 2_000_000, 6, 400_000
SMOOTH = 0.1
END = b""  # no word is empty
PIECE = 4096
FLUSH = 400_000


def held_out(key: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text is divisible by 10. A null id is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """word and c over a table of one column ``text``, the end symbols included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                c.update(words(t))
                c[END] += 1
                if len(c) > FLUSH:
                    yield pd.DataFrame({"word": list(c), "c": list(c.values())})
                    c.clear()
        yield pd.DataFrame({"word": list(c), "c": list(c.values())})

    return texts.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, in order: at most ``most``, and all of a level of frequency or none.

    Levels are sixteenths of a power of two, so the histogram has a few hundred rows; no sort of the vocabulary.
    """
    level = F.floor(F.log2("c") * 16).cast("int").alias("level")
    n, least = 0, None
    for r in sorted(counts.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        n += r.n
        if n > most:
            break
        least = r.level
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("c") * 16) >= least).collect()
    return sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def layout(counts: list[int]) -> dict:
    """Sizes of a model for words with these counts, most frequent first; rest and start follow the words."""
    m = len(counts)
    size = max(1, int(np.ceil(np.sqrt(m))))
    return {"m": m, "size": size, "classes": -(-m // size)}


def initial(counts: list[int], rest: float) -> dict[str, np.ndarray]:
    """Weights of a network that knows the unigram frequencies."""
    s, rng = layout(counts), np.random.default_rng(7)
    c = np.array(counts, np.float64) + SMOOTH
    by_class = np.add.reduceat(c, np.arange(0, s["m"], s["size"])) if s["m"] else np.zeros(0)
    f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "x": f(s["m"] + 2, 3 * HIDDEN), "h": f(HIDDEN, 3 * HIDDEN), "uc": np.zeros((s["classes"] + 1, HIDDEN), np.float32),
        "bc": np.log(np.append(by_class, rest)).astype(np.float32), "uw": np.zeros((s["m"], HIDDEN), np.float32),
        "bw": np.log(c).astype(np.float32),
    }


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Lanes:
    """Sequences dealt to lanes, the longest lane first; a lane's sequences follow each other in flat arrays, so memory
    grows with the tokens and not with the longest lane. Time runs down the lanes, a window at a time."""

    def __init__(self, seqs: list[np.ndarray], lanes: int, start: int):
        heap = [(0, k) for k in range(max(1, min(lanes, len(seqs))))]
        own: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
            n, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (n + len(seqs[i]), k))
        own.sort(key=lambda o: -sum(len(seqs[i]) for i in o))
        self.lengths = np.array([sum(len(seqs[i]) for i in o) for o in own])
        self.starts = np.cumsum(self.lengths) - self.lengths
        order = [i for o in own for i in o]
        sizes = np.array([len(seqs[i]) for i in order], np.int64)
        self.target = np.concatenate([seqs[i] for i in order]) if order else np.zeros(0, np.int32)
        self.owner = np.repeat(np.array(order, np.int32), sizes)
        self.first = np.zeros(len(self.target), bool)
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        self.first[heads] = True
        self.given = np.empty_like(self.target)
        self.given[1:] = self.target[:-1]
        self.given[heads] = start

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lanes that run in each step of the window, and the positions of its tokens, step by step."""
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        for t in range(0, longest, steps):
            active = np.searchsorted(-self.lengths, -np.arange(t, min(t + steps, longest)), "left")
            yield active, np.concatenate([self.starts[:n] + (t + s) for s, n in enumerate(active)])


def run_window(w: dict, lanes: Lanes, at: np.ndarray, active: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States of the window's tokens, a column each, step by step; the lanes' states are updated in place.

    Arrays have a row for each unit, so that gates are whole rows. keep: gets what the way back needs.
    """
    # The logistic function is 1 / (1 + exp(-x)), tanh 2 / (1 + exp(-2 x)) - 1: the factors of x go to the weights.
    scale = np.repeat(np.array([-1, -1, -2], state.dtype), HIDDEN)[:, None]
    x, ht, first = (w["x"].T * scale).take(lanes.given[at], axis=1), w["h"].T * scale, lanes.first[at]
    out = np.empty((HIDDEN, len(at)), state.dtype)
    if keep is not None:
        keep.update(prev=np.empty_like(out), gates=np.empty((2 * HIDDEN, len(at)), state.dtype), c=np.empty_like(out), an=np.empty_like(out), first=first)
    a = 0
    with np.errstate(over="ignore"):  # an infinite exponential gives the function's limit
        for n in active:
            b = a + n
            prev = state[:, :n]
            if first[a:b].any():
                prev[:, first[a:b]] = 0
            u = ht @ prev
            g = x[: 2 * HIDDEN, a:b] + u[: 2 * HIDDEN]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c = g[HIDDEN:] * u[2 * HIDDEN :]
            c += x[2 * HIDDEN :, a:b]
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            h = out[:, a:b]
            np.subtract(prev, c, out=h)
            h *= g[:HIDDEN]
            h += c
            if keep is not None:
                keep["prev"][:, a:b], keep["gates"][:, a:b], keep["c"][:, a:b], keep["an"][:, a:b] = prev, g, c, u[2 * HIDDEN :]
            state[:, :n] = h
            a = b
    if keep is not None:
        keep["an"] *= -0.5
    return out


def _with_bias(u: np.ndarray, bias: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Groups of ``size`` rows of weights, biases in a last column, filled up with rows of no probability; and whether
    exponentials of their logits are safe without the greatest one taken off.

    Biases are shifted so that the greatest of a group is 0, which changes no probability. Units are within -1 and 1, so
    weights bound the logits.
    """
    groups = -(-len(bias) // size)
    out = np.zeros((groups * size, HIDDEN + 1), u.dtype)
    out[: len(bias), :HIDDEN], out[: len(bias), HIDDEN], out[len(bias) :, HIDDEN] = u, bias, -np.inf
    out = out.reshape(groups, size, HIDDEN + 1)
    out[:, :, HIDDEN] -= out[:, :, HIDDEN].max(axis=1, keepdims=True)
    np.maximum(out, -1e30, out=out)  # infinite weights times 0 are no numbers
    return out, bool(np.abs(u).sum(axis=1).max(initial=0) < SAFE)


def _pick(logits: np.ndarray, at: np.ndarray, safe: bool, grad: bool) -> np.ndarray:
    """Log-probability of one column in each row; with grad, logits become the gradient."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    at = at + np.arange(len(at)) * logits.shape[1]
    own = logits.ravel()[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if grad:
        logits *= (1 / total)[:, None]
        logits.ravel()[at] -= 1
    return own - np.log(total)


def softmax(w: dict, h: np.ndarray, target: np.ndarray, size: int, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (natural) of the targets, by class and then word; and gradients where asked for.

    A row for each token, in the order of their classes: a class is a run of rows, so that only products are by class.
    """
    m = len(w["bw"])
    classes = len(w["bc"]) - 1
    cls = np.where(target >= m, classes, target // size)
    order = np.argsort(cls.astype(np.int16) if classes < 30_000 else cls, kind="stable")
    cls, target = cls[order], target[order]
    cut = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    known, grad = cut[-1], grads is not None
    ht = np.ones((len(order), HIDDEN + 1), h.dtype)
    ht[:, :HIDDEN] = h.take(order, axis=1).T
    (uc,), safe = _with_bias(w["uc"], w["bc"], classes + 1)
    d = ht @ uc.T
    logp = _pick(d, cls, safe, grad)
    uw, safe = _with_bias(w["uw"], w["bw"], size)
    runs = [(c, i, j) for c, (i, j) in enumerate(pairwise(cut)) if i < j]
    e = np.empty((known, size), h.dtype)
    for c, i, j in runs:
        np.matmul(ht[i:j], uw[c].T, out=e[i:j])
    logp[:known] += _pick(e, target[:known] - cls[:known] * size, safe, grad)
    out = np.empty_like(logp)
    out[order] = logp
    if not grad:
        return out, np.zeros((HIDDEN, 0), h.dtype)
    g = d.T @ ht
    grads["uc"], grads["bc"] = g[:, :HIDDEN], g[:, HIDDEN]
    g, dh, own = np.zeros_like(uw), d @ uc, np.empty((known, HIDDEN + 1), h.dtype)
    for c, i, j in runs:
        np.matmul(e[i:j].T, ht[i:j], out=g[c])
        np.matmul(e[i:j], uw[c], out=own[i:j])
    g = g.reshape(-1, HIDDEN + 1)[:m]
    grads["uw"], grads["bw"] = g[:, :HIDDEN], g[:, HIDDEN]
    dh[:known] += own
    back = np.empty((len(order), HIDDEN), h.dtype)
    back[order] = dh[:, :HIDDEN]
    return out, np.ascontiguousarray(back.T)


def train(w: dict, squares: dict, seqs: list[np.ndarray], size: int) -> float:
    """Truncated backpropagation over sequences, Adagrad in place; returns the summed log-probability.

    All tokens are learned from. The state starts anew every CUT tokens, so that long texts fill the lanes, too.
    """
    lanes = Lanes([x[k : k + CUT] for x in seqs for k in range(0, len(x), CUT)], TRAIN_LANES, len(w["bw"]) + 1)
    state, total = np.zeros((HIDDEN, len(lanes.lengths)), w["h"].dtype), 0.0
    for active, at in lanes.windows(STEPS):
        keep: dict = {}
        h = run_window(w, lanes, at, active, state, keep)
        grads: dict = {}
        logp, dh = softmax(w, h, lanes.target[at], size, grads)
        total += float(logp.sum())
        prev, c, an, z, r = keep["prev"], keep["c"], keep["an"], keep["gates"][:HIDDEN], keep["gates"][HIDDEN:]
        # What does not depend on later steps, for the whole window at once.
        fc = 1 - c * c
        fc *= 1 - z
        f = np.concatenate([(prev - c) * z * (1 - z), fc * an * r * (1 - r), fc * r])
        up, back, b = np.empty_like(f), np.zeros((HIDDEN, 0), h.dtype), len(at)
        for n in reversed(active):
            a = b - n
            d = dh[:, a:b]
            d[:, : back.shape[1]] += back
            u = up[:, a:b]
            np.multiply(f[:, a:b].reshape(3, HIDDEN, n), d, out=u.reshape(3, HIDDEN, n))
            back = w["h"] @ u
            back += d * z[:, a:b]
            if keep["first"][a:b].any():
                back[:, keep["first"][a:b]] = 0
            b = a
        grads["h"] = prev @ up.T
        # Input rows: only those of the window's words are touched.
        up[2 * HIDDEN :] = dh * fc
        given = lanes.given[at]
        seen = np.bincount(given, minlength=len(w["x"])) > 0
        rows = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1)[given]
        g = np.stack([np.bincount(place, x, len(rows)) for x in up], axis=1).astype(h.dtype)
        np.clip(g, -CLIP, CLIP, out=g)
        s = squares["x"][rows] + g * g
        squares["x"][rows] = s
        w["x"][rows] -= RATE * g / np.sqrt(s + TINY)
        for k, g in grads.items():
            g = np.clip(g, -CLIP, CLIP)
            squares[k] += g * g
            w[k] -= RATE * g / np.sqrt(squares[k] + TINY)
    return total


def log_likelihoods(w: dict, seqs: list[np.ndarray], size: int) -> np.ndarray:
    """Log-probability (natural) of each whole sequence."""
    lanes = Lanes(seqs, LANES, len(w["bw"]) + 1)
    state, out = np.zeros((HIDDEN, len(lanes.lengths)), w["h"].dtype), np.zeros(len(seqs))
    for active, at in lanes.windows(WINDOW):
        h = run_window(w, lanes, at, active, state)
        out += np.bincount(lanes.owner[at], weights=softmax(w, h, lanes.target[at], size)[0], minlength=len(seqs))
    return out


def _sequence(ws: list[bytes], number: dict[bytes, int], rest: int) -> np.ndarray:
    return np.fromiter(map(number.get, [*ws, END], repeat(rest)), np.int32, len(ws) + 1)


def fit_network(texts: DataFrame, top: list[tuple[bytes, int]], rest: float, tokens: float, rounds: int = ROUNDS) -> dict:
    """Weights averaged over shards. texts: the documents to train on (column text, key id); tokens: about how many.

    Texts become word numbers where they are, and only those are dealt to the shards. A shard reads its documents in
    the order of a hash, so a task that runs again gives the same weights.
    """
    w = initial([c for _, c in top], rest)
    number = {x: i for i, (x, _) in enumerate(top)}
    size = layout([c for _, c in top])["size"]
    shards = int(np.clip(tokens // SHARD_TOKENS, LEAST_SHARDS, 100_000))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seqs = [_sequence(words(t), number, len(top)).astype(np.uint16 if len(top) < 65_000 else np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"shard": pdf["shard"], "place": pdf["place"], "seq": seqs})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shaped(now, w)
        squares = {k: np.full_like(v, 0.1) for k, v in own.items()}
        seen, seqs, load, shard = 0, [], 0, 0
        for pdf in batches:
            for x, shard in zip(pdf["seq"], pdf["shard"], strict=True):  # noqa: B007
                seqs.append(np.frombuffer(x, np.uint16 if len(top) < 65_000 else np.int32).astype(np.int32))
                load += len(seqs[-1])
                if load > TRAIN_LOAD:
                    train(own, squares, seqs, size)
                    seen, seqs, load = seen + load, [], 0
        if seqs:
            train(own, squares, seqs, size)
            seen += load
        if seen:
            v = flat(own).astype(np.float64) * seen
            for k in range(0, len(v), PIECE):
                yield pd.DataFrame({"piece": [k // PIECE], "salt": [int(shard) % 64], "v": [v[k : k + PIECE].tobytes()], "n": [float(seen)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, np.float64) for x in pdf["v"])
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "salt": [0], "v": [v.tobytes()], "n": [pdf["n"].sum()]})

    kind = "piece int, salt int, v binary, n double"
    dealt = texts.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("id", "text").alias("place"), "text")
    dealt = dealt.mapInPandas(tidy(numbered), "shard int, place long, seq binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("place")
    for _ in range(rounds):
        now = flat(w)
        parts = dealt.mapInPandas(tidy(local), kind).groupBy("piece", "salt").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind)
        rows = sorted(parts.collect(), key=lambda r: r.piece)  # as large as the network
        if rows:
            w = shaped(np.concatenate([np.frombuffer(r.v, np.float64) / r.n for r in rows]), w)
    return w


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", one_in: int = TRAIN_ONE_IN, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    one_in: the network learns from one in so many of the documents that are not held out; counts are always of all.

    A null or empty text is the end symbol alone. Rows without id are learned from and scored; repeated rows count
    each. Without training tokens every word is unknown. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"), held_out(quoted(key)).alias("held_out"))
    learn = own.where("NOT held_out")
    counts = scratch.keep(count_words(learn.select("text")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known = most_frequent(counts, KNOWN)
    top = known[:PREDICTED]
    z = n + SMOOTH * (v + 1)
    rest = z - sum(c + SMOOTH for _, c in top)
    sample = learn.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where(F.pmod(F.xxhash64("id", F.lit("lm")), F.lit(one_in)) == 0)
    w = fit_network(sample, top, rest, n / one_in, rounds) if top else None
    size, m = layout([c for _, c in top])["size"], len(top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {x: i for i, (x, _) in enumerate(known)}
        c = np.array([k for _, k in known], np.float64)
        # By word number; the last entry is for words that are looked up later.
        worth = np.append(np.log10((c + SMOOTH) / z), 0.0)
        inner = np.append(np.where(np.arange(len(c)) < m, 0.0, np.log10(c + SMOOTH) - np.log10(rest)), 0.0)
        columns = ["doc_id", "held_out", "n_tokens", "found", "base", "model", "rare", "times"]

        def scored(rows: list, seqs: list) -> Iterator[pd.DataFrame]:
            model = log_likelihoods(w, seqs, size) / np.log(10) if w else np.zeros(len(seqs))
            for at in range(0, len(rows), 500):
                out = pd.DataFrame(rows[at : at + 500], columns=columns)
                yield out.assign(model=out["model"] + model[at : at + 500])

        rows, seqs, load = [], [], 0
        for pdf in batches:
            for doc_id, held, t in zip(pdf["doc_id"], pdf["held_out"], pdf["text"], strict=True):
                ws = [*words(t), END]
                ids = np.fromiter(map(number.get, ws, repeat(-1)), np.int32, len(ws))
                seqs.append(np.where((ids < 0) | (ids >= m), m, ids).astype(np.int32))
                load += len(ids)
                rare = Counter([ws[i] for i in np.flatnonzero(ids < 0).tolist()])
                rows.append((doc_id, held, len(ws), int((ids >= 0).sum()), float(worth[ids].sum()), float(inner[ids].sum()), list(rare), list(rare.values())))
            if load > LOAD:  # so many tokens fill the lanes
                yield from scored(rows, seqs)
                rows, seqs, load = [], [], 0
        yield from scored(rows, seqs)

    kind = docs.schema[key].dataType.simpleString()
    ids = own.withColumn("doc_id", F.col("doc_id").cast("string"))  # a null would make floats of whole numbers
    schema = "doc_id string, held_out boolean, n_tokens long, found long, base double, model double, rare array<binary>, times array<long>"
    scored = ids.mapInPandas(tidy(run), schema).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.keep(scored)
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k"))).alias("r")).select("row", "r.word", "r.k")
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum("k").alias("k"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("s"),
    )
    full = scored.drop("rare", "times").join(found, "row", "left")
    k, s = F.coalesce("k", F.lit(0)), F.coalesce("s", F.lit(0.0))
    return full.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + s - k * float(np.log10(z))).alias("base_score"),
        (F.col("model") + s - k * float(np.log10(rest))).alias("score"),
    )
