"""From an index of signatures to connected groups, without emitting the pairs inside a hot signature.

Two items are candidates if they share a signature; ``verify`` decides exactly. First every item is verified
against the smallest item of each of its signatures (a star: linear in the index). What those links connect needs
no further pair. Signatures that still hold several components are then searched in blocks: sketches bound the
distance from below, so a vectorised comparison discards the pairs that cannot link and emits the others; first one
pair for each component of a block, which connects a group of items that are all close with as many pairs as it has items,
then, with the components joined by that, all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, tidy
from .components import components

#: Items of a block: block pairs compare at most BLOCK x BLOCK sketches at once.
BLOCK = 256
#: Pairs that are compared at once, about.
PAIRS = 100_000


def _flat(lists: dict) -> dict:
    """Rows of all blocks of a batch after each other, and where each block starts."""
    n = np.array([len(v) for v in lists["id"]], np.int64)
    put = lambda c: np.concatenate(list(lists[c])).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    sketch = np.frombuffer(b"".join(x for v in lists["sketch"] for x in v), np.uint64)
    return {"n": n, "at": np.cumsum(n) - n, "id": put("id"), "comp": put("comp"), "size": put("size"), "sketch": sketch.reshape(max(1, n.sum()), -1)}


def _close(x: dict, y: dict, same: np.ndarray, limit: Callable, first: bool) -> np.ndarray:
    """Pairs of ids of different components in block pairs whose sketches are within the limit; same: a block with itself."""
    count = x["n"] * y["n"]
    found: list[np.ndarray] = []
    bound = np.cumsum(count)
    at = 0
    while at < len(count):
        # As many block pairs at once as make about PAIRS pairs.
        end = max(at + 1, int(np.searchsorted(bound, (bound[at - 1] if at else 0) + PAIRS, "right")))
        own = count[at:end]
        k = np.repeat(np.arange(at, end), own)
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        i, j = np.divmod(place, np.maximum(y["n"][k], 1))
        open_ = ~same[k] | (i < j)
        i, j = (x["at"][k] + i)[open_], (y["at"][k] + j)[open_]
        open_ = x["comp"][i] != y["comp"][j]
        i, j = i[open_], j[open_]
        far = np.bitwise_count(x["sketch"][i] ^ y["sketch"][j]).sum(axis=1, dtype=np.int64)
        ok = far <= limit(x["size"][i], y["size"][j])
        i, j = i[ok], j[ok]
        if first:
            # A pair for each component of y: with the smallest one of x that is close.
            order = np.lexsort((x["comp"][i], y["comp"][j]))
            _, one = np.unique(y["comp"][j][order], return_index=True)
            i, j = i[order[one]], j[order[one]]
        a, b = x["id"][i], y["id"][j]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        at = end
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _residual(shared: DataFrame, sketches: DataFrame, comp: DataFrame, limit: Callable, first: bool) -> DataFrame:
    """Pairs a < b of different components that share a signature and that the sketches don't rule out."""
    if comp.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        comp = F.broadcast(comp)
    rows = shared.join(comp, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("comp"))
    mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("lo < hi AND n > 2")  # of two items, one is the pivot: they have been verified
    mixed = mixed.select("sig", F.expr(f"CAST(n DIV {BLOCK} + 1 AS int)").alias("blocks"))
    dealt = rows.join(mixed, "sig").select("sig", "id", "comp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    full = dealt.join(sketches, "id")
    # Lists of the same rows in the same order: plain arrays travel to Python far cheaper than structs.
    parts = ("id", "comp", "size", "sketch")
    blocks = full.groupBy("sig", "blocks", "block").agg(*(F.collect_list(c).alias(c) for c in parts))
    left = blocks.select("sig", F.col("block").alias("i"), *(F.col(c).alias(f"x_{c}") for c in parts), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"))
    both = left.join(blocks.select("sig", "block", *(F.col(c).alias(f"y_{c}") for c in parts)), ["sig", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (_flat({c: pdf[f"{s}_{c}"] for c in parts}) for s in "xy")
            found = _close(x, y, pdf["i"].to_numpy() == pdf["block"].to_numpy(), limit, first)
            yield pd.DataFrame(found, columns=["a", "b"])

    return both.drop("sig").mapInPandas(tidy(search), "a long, b long").distinct()


def linked_components(
    index: DataFrame, sketches: DataFrame, verify: Callable[[DataFrame], DataFrame], limit: Callable, scratch: Scratch,
    passes: tuple[bool, ...] = (True, False),
) -> DataFrame:
    """id and component of all items that have a link.

    index: sig, id (long), where linked items share a signature; sketches: id, size, sketch (bytes of equal length);
    verify: pairs (a, b) to those that link; limit(size, sizes): the most sketch bits in which linked items differ;
    passes: whether to look for one pair of each component first, where sketches let many through.
    """
    stars = index.groupBy("sig").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("sig", "pivot")
    shared = scratch.keep(index.join(stars, "sig").distinct())
    tried = scratch.keep(shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    links = scratch.keep(verify(tried))
    comp = components(links, scratch)
    for first in passes:
        pairs = scratch.keep(_residual(shared.select("sig", "id"), sketches, comp, limit, first).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if first:
                continue
            break
        tried = tried.unionByName(pairs)
        new = scratch.keep(verify(pairs))
        if not new.isEmpty():
            links = links.unionByName(new)
            comp = components(links, scratch)
    return comp
