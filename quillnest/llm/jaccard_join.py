"""Exact Jaccard join on word shingles with token-combination prefixes.

1. Every document becomes its set of distinct shingle hashes (64 bits). Equal sets are one class; only the class's
   smallest doc_id goes on.
2. A filter in hash order: of the first ``miss + n / 10`` hashes of two sets that link, some ``n / 10`` are common
   (``miss``: how many of its hashes a set may lack). Each task sends a hash once, in blocks, and documents with too few
   hashes that any other has are done. Most documents end here.
3. The others count document frequencies, sort their hashes from rare to frequent and take a prefix. Rare hashes are
   signatures on their own. A frequent hash would be shared by too many, so frequent hashes fall into token classes and a
   signature is a combination of two of one class; k hashes of a class are worth k - 1, so the prefix is extended until
   what it is worth exceeds ``miss``. Then two sets that link share a signature, whichever hashes they lack.
4. Candidates are verified exactly on the whole sets; see ``linkage`` for hot signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHashes, mix64, quoted, release, select_ids, tidy, words
from .linkage import linked_components

WORDS = 5
PERCENT = 80
#: Document frequency from which a shingle is frequent: indexed only in combination with another of its class.
FREQUENT = 1000
SKETCH_BITS = 1024
#: Hashes of a batch of sets that exchange their document frequencies together.
BATCH_HASHES = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(ws: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, no words are none."""
    if not ws:
        return np.zeros(0, np.uint64)
    x = hashes.of(ws)
    k = min(size, len(x))
    h = np.zeros(len(x) - k + 1, np.uint64)
    for i in range(k):
        h = h * PRIME + x[i : i + len(h)]
    return np.unique(mix64(h))


def need(n, percent: int = PERCENT):
    """Hashes that a set of n has in common with any set it links with, at least."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    k = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * k >= percent * (len(a) + len(b) - k)


def levels(most: int, percent: int = PERCENT) -> list[int]:
    """Lower bounds of size levels; sets that link are at most one level apart."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def signatures(h: np.ndarray, df: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> np.ndarray:
    """Signatures of one set: h its hashes, df how many sets have each."""
    n = len(h)
    miss = n - need(n, percent)
    if 100 * n < percent * (n + 1) or (df == 1).sum() > miss:
        return np.zeros(0, np.uint64)  # only an equal set can link, or too many hashes are its own
    order = np.lexsort((h, df))
    h, df = h[order], df[order]
    often = df > frequent
    bounds = levels(n, percent)
    level = int(np.searchsorted(bounds, n, "right")) - 1
    bounds.append(100 * bounds[-1] // percent + 1)
    out, single = [], 0
    for tag in (level, level + 1):
        classes = max(1, bounds[tag] // 16)
        kind = np.where(often, (mix64(h + PRIME) % np.uint64(classes)).astype(np.int64), -1)
        later = np.ones(n, bool)  # worth one: rare hashes, and all but the first of a class
        _, firsts = np.unique(kind, return_index=True)
        later[firsts[kind[firsts] >= 0]] = False
        length = int(np.searchsorted(np.cumsum(later), miss + 1)) + 1
        single = max(single, length)
        top, kinds = h[:length][often[:length]], kind[:length][often[:length]]
        for c in np.unique(kinds):
            own = np.sort(top[kinds == c])
            i, j = np.triu_indices(len(own), 1)
            out.append(mix64(own[i] * PRIME + mix64(own[j] + np.uint64(tag))))
    out.append(h[:single][~often[:single] & (df[:single] > 1)])
    return np.unique(np.concatenate(out))


def _tidied(f, *args):
    out = f(*args)
    release()
    return out


def _deal(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes: equal ranges of the hash space."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=object).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


def _facts(docs: DataFrame, buckets: int, percent: int, size: int) -> DataFrame:
    """A row of each document: doc_id, n, digest, and whether it is open: as many hashes of its hash-order prefix as a link
    takes are another document's, too.

    Each task sends a hash once, in blocks. Buckets answer each batch with one row, the number of its documents' hashes
    that other batches have; of documents that are open by their own batch nothing is asked.
    """

    def least(n: np.ndarray) -> np.ndarray:
        return np.maximum(1, need(n, percent) // 10)

    def send(batch: int, own: list, ids: list, n: list, digest: list) -> pd.DataFrame:
        every = np.concatenate(own)
        doc = np.repeat(np.arange(len(own)), [len(s) for s in own])
        order = np.argsort(every)
        every, doc = every[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(every)))
        common = np.bincount(doc[np.repeat(count > 1, count)], minlength=len(own))
        done = common >= least(np.array(n, np.int64))
        once, who = every[first], np.where((count > 1) | done[doc[first]], -1, doc[first]).astype(np.int32)
        cut = _deal(once, buckets)
        rows = [(k, batch, once[a:b].tobytes(), who[a:b].tobytes(), None, None) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        rows.append((batch % buckets, batch, np.array(ids, np.int64).tobytes(), np.array(n, np.int64).tobytes(), common.astype(np.int64).tobytes(), b"".join(digest)))
        return pd.DataFrame(rows, columns=["bucket", "batch", "x", "y", "z", "digest"])

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyspark import TaskContext

        # A task that runs again names its batches as before.
        hashes, batch = WordHashes(), TaskContext.get().partitionId() << 32
        own, ids, n, digest, load = [], [], [], [], 0
        for pdf in batches:
            for doc_id, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(words(t), hashes, size)
                own.append(s[: len(s) - need(len(s), percent) + max(1, len(s) // 10)].copy())
                ids.append(doc_id)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                load += len(own[-1])
                if load > BATCH_HASHES:
                    yield send(batch, own, ids, n, digest)
                    own, ids, n, digest, load = [], [], [], [], 0
                    batch += 1
        if own:
            yield send(batch, own, ids, n, digest)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        facts = pdf[pdf["digest"].notna()]
        out = [facts[["batch", "x", "y", "z", "digest"]]]
        sent = pdf[pdf["digest"].isna()]
        if len(sent):
            h = np.frombuffer(b"".join(sent["x"]), np.uint64)
            who = np.frombuffer(b"".join(sent["y"]), np.int32)
            row = np.repeat(np.arange(len(sent)), [len(x) // 8 for x in sent["x"]])
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(first, len(h)))
            asked = order[np.repeat(count > 1, count)]
            asked = asked[who[asked] >= 0]
            for k in np.unique(row[asked]).tolist():
                own, times = np.unique(who[asked[row[asked] == k]], return_counts=True)
                out.append(pd.DataFrame({"batch": [sent["batch"].iloc[k]], "x": [own.tobytes()], "y": [times.astype(np.int64).tobytes()], "z": [None], "digest": [None]}))
        return pd.concat(out)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        (facts,) = pdf[pdf["digest"].notna()].itertuples()
        n, common = np.frombuffer(facts.y, np.int64), np.frombuffer(facts.z, np.int64).copy()
        answers = pdf[pdf["digest"].isna()]
        for x, y in zip(answers["x"], answers["y"], strict=True):
            common[np.frombuffer(x, np.int32)] += np.frombuffer(y, np.int64)
        digest = [facts.digest[i : i + 16] for i in range(0, len(facts.digest), 16)]
        return pd.DataFrame({"doc_id": np.frombuffer(facts.x, np.int64), "n": n, "digest": digest, "open": common >= least(n)})

    kind = "batch long, x binary, y binary, z binary, digest binary"
    sent = docs.mapInPandas(tidy(prefix), f"bucket int, {kind}")
    answers = sent.groupBy("bucket").applyInPandas(lambda pdf: _tidied(meet, pdf), kind)
    return answers.groupBy("batch").applyInPandas(lambda pdf: _tidied(add, pdf), "doc_id long, n long, digest binary, open boolean")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, hashes, sketch of each document, and the batch that it exchanges frequencies with."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        hashes, batch, load = WordHashes(), uuid.uuid4().hex, 0
        for pdf in batches:
            rows = []
            for doc_id, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = shingle_set(words(t), hashes, size)
                bits = np.bincount((s >> np.uint64(7)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
                rows.append((doc_id, len(s), s.tobytes(), np.packbits(bits.astype(bool)).tobytes(), batch))
                load += len(s)
                if load > BATCH_HASHES:
                    batch, load = uuid.uuid4().hex, 0
            yield pd.DataFrame(rows, columns=["doc_id", "n", "hashes", "sketch", "batch"])

    return docs.mapInPandas(tidy(build), "doc_id long, n long, hashes binary, sketch binary, batch string")


def _index(sets: DataFrame, buckets: int, percent: int, frequent: int) -> DataFrame:
    """Signatures of all sets: sig, id."""

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        h, count = np.unique(np.frombuffer(b"".join(pdf["hashes"]), np.uint64), return_counts=True)
        cut = _deal(h, buckets)
        count = count.astype(np.int64)
        rows = [(k, pdf["batch"].iloc[0], h[a:b].tobytes(), count[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pd.DataFrame(rows, columns=["bucket", "batch", "h", "df"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint64) for x in pdf["h"]]
        h, at = np.unique(np.concatenate(each), return_inverse=True)
        df = np.zeros(len(h), np.int64)
        np.add.at(df, at, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["df"]]))
        rows = []
        for batch, own in zip(pdf["batch"], each, strict=True):
            d = df[np.searchsorted(h, own)]
            rows.append((batch, own[d > 1].tobytes(), d[d > 1].tobytes()))
        return pd.DataFrame(rows, columns=["batch", "h", "df"])

    def sign(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(answers["h"]), np.uint64)
        df = np.frombuffer(b"".join(answers["df"]), np.int64)
        order = np.argsort(h)
        h, df = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(df[order], 1)
        ids, sigs = [], []
        for doc_id, s in zip(own["doc_id"], own["hashes"], strict=True):
            s = np.frombuffer(s, np.uint64)
            at = np.searchsorted(h, s)
            got = signatures(s, np.where(h[at] == s, df[at], 1), percent, frequent)
            ids.append(np.full(len(got), doc_id, np.int64))
            sigs.append(got.view(np.int64))
        return pd.DataFrame({"sig": np.concatenate(sigs) if sigs else [], "id": np.concatenate(ids) if ids else []}).astype("int64")

    sent = sets.select("batch", "hashes").groupBy("batch").applyInPandas(lambda pdf: _tidied(send, pdf), "bucket int, batch string, h binary, df binary")
    answers = sent.groupBy("bucket").applyInPandas(lambda pdf: _tidied(total, pdf), "batch string, h binary, df binary")
    own = sets.select("batch", "doc_id", "hashes").groupBy("batch")
    return own.cogroup(answers.groupBy("batch")).applyInPandas(lambda own, answers: _tidied(sign, own, answers), "sig long, id long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    Documents link if 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id reachable by links, class_id the smallest of those with an equal set. A null or empty text has no
    shingles and is a component of its own. Rows without a doc_id link with nothing and keep a null component.
    Rows that repeat a doc_id are each returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * own.rdd.getNumPartitions())
    facts = scratch.keep(_facts(own.where("doc_id IS NOT NULL"), buckets, percent, size))
    classes = facts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.keep(classes)
    lead = facts.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    open_ = scratch.keep(lead.where("open").select("doc_id").distinct())
    few = own.where("doc_id IS NOT NULL")
    sets = scratch.keep(_sets(select_ids(few, open_, "left_semi"), size))
    index = scratch.keep(_index(sets, buckets, percent, FREQUENT))

    def verify(pairs: DataFrame) -> DataFrame:
        def same(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)], dtype=bool)

        same.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
        side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"{c}_set"))
        full = pairs.join(side("b"), "b").join(side("a"), "a")  # the hub's side last: its partition is then large and can be split
        return full.where(F.pandas_udf(same, T.BooleanType())("a_set", "b_set")).select("a", "b").distinct()

    def limit(n, others):
        near = 100 * np.minimum(n, others) >= percent * np.maximum(n, others)
        return np.where(near, (100 - percent) * (n + others) // (100 + percent), -1)

    comp = linked_components(index, sets.select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "sketch"), verify, limit, scratch)
    done = facts.join(classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    done = done.join(comp.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    lost = own.where("doc_id IS NULL")
    count = lambda t: pd.Series([len(shingle_set(words(x), WordHashes(), size)) for x in t], dtype="int64")
    count.__annotations__ = {"t": pd.Series, "return": pd.Series}
    none = lost.select("doc_id", F.pandas_udf(count, T.LongType())("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return done.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id").unionByName(none)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """docs with one document, the one of smallest id, of each connected group; all columns unchanged.

    Documents without an id or without words all stay. Rows that repeat the id that stays all stay.
    """
    groups = Scratch(docs.sparkSession).keep(near_duplicates(docs, text, key, percent, size).where("component_id <> doc_id"))
    return select_ids(docs, groups.select(F.col("doc_id").alias(key)), "left_anti", key)
