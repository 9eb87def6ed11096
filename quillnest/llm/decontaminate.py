"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is 13 consecutive words of
an item, or the whole of a shorter item. Every word of the benchmark is one symbol and all other words are another one, so
the automaton has a node for a word, not for a character. It holds every window once; each document is normalised and
scanned once, and hits are mapped back to word numbers and to code-point offsets of the original text.

The benchmark passes through the driver and travels with the tasks, in parts of PART_CHARS code points: a worker holds
the automata of all parts, one after the other for each batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, fresh, quoted

WINDOW = 13
#: A document is contaminated if at least this share of its words is hit: one in 20.
SHARE = 20
#: Code points of benchmark texts in one automaton; a larger benchmark is split, and each part scans once.
PART_CHARS = 4_000_000
#: Symbol of words that no window has; those of windows follow, without the range of surrogates.
OTHER = "\x00"
#: Runs of the characters that words are made of; fixed by the contract.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit", T.BinaryType()),  # a bit for each word
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def normalised(text: str | None) -> list[str]:
    """Words of a text; as Latin-1 strings of their UTF-8 bytes, so that one character is one byte."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).decode("latin-1").split(" ")


def _words(text: str | None) -> list[str]:
    return [w for w in normalised(text) if w]


class Automaton:
    """Windows of (item_id, text) pairs as strings with one character a word; a null item_id owns nothing."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        self.symbol: dict[str, str] = {}
        number: dict[str, int] = {}
        self.length: list[int] = []
        self.owners: list[tuple] = []
        self.a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, text in items:
            line = "".join(self.symbol.setdefault(w, self._next()) for w in _words(text))
            mine = () if item is None else (item,)
            for i in range(max(1, len(line) - size + 1) if line else 0):
                w = line[i : i + size]
                k = number.setdefault(w, len(self.length))
                if k == len(self.length):
                    self.length.append(len(w))
                    self.owners.append(mine)
                    self.a.add_word(w, k)
                elif item is not None and item not in self.owners[k]:
                    self.owners[k] += mine
        if self.length:
            self.a.make_automaton()
            self.runs = re.compile(f"[^{OTHER}]{{{min(self.length)},}}")

    def _next(self) -> str:
        n = len(self.symbol) + 1
        return chr(n if n < 0xD800 else n + 0x800)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, a flag for each word that lies in a window, and the items with windows."""
        ws = _words(text)
        hit, items = np.zeros(len(ws) + 1, np.int64), set()
        if ws and self.length:
            line = "".join(map(self.symbol.get, ws, repeat(OTHER)))
            for known in self.runs.finditer(line):  # no window fits into what is between
                for end, k in self.a.iter(known[0]):
                    end += known.start() + 1
                    hit[end - self.length[k]] += 1
                    hit[end] -= 1
                    items.update(self.owners[k])
        return len(ws), np.cumsum(hit)[:-1] > 0, items


def longest_run(hit: np.ndarray) -> int:
    """Most consecutive hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans, end exclusive, of the runs of hit words in the original text."""
    found: list[tuple[int, int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text or "")):
        if k < len(hit) and hit[k]:
            if last == k - 1:
                found[-1] = (found[-1][0], m.end())
            else:
                found.append(m.span())
            last = k
    return found


def parts(bench: DataFrame, chars: int = PART_CHARS) -> Iterator[list[tuple]]:
    """The benchmark's items in parts of about ``chars`` code points; item ids as strings."""
    own = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    total = own.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = -(-total // chars) or 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def hits(text: Column, items: list[tuple], size: int = WINDOW) -> Column:
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = Automaton(items, size)
        for texts in batches:
            rows = []
            for t in texts:
                n, hit, own = a.scan(t)
                rows.append((n, np.packbits(hit).tobytes() if hit.any() else b"", sorted(map(str, own))))
            yield pd.DataFrame(rows, columns=["n_words", "hit", "items"])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(find, HITS)(text)


_BITS = T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = WINDOW, share: int = SHARE, text: str = "text") -> DataFrame:
    """docs with a struct column ``hits`` (or ``_hits``, where that name is taken): n_words, n_hit, longest (most
    consecutive hit words), items (ids as sorted strings), spans (code points, of the original text) and contaminated.

    Nulls: a null text has no words and is clean; null benchmark texts have no windows; those of a null item_id count as
    hits, but it is left out of items. Repeated rows are each marked. An empty benchmark hits nothing; an empty table
    stays empty. Long texts are scanned whole.
    """
    name, raw = fresh(docs, "hits", "raw_hits")
    found = None
    for items in parts(bench):
        one = hits(quoted(text), items, size)
        found = one if found is None else _both(found, one)

    def last(texts: pd.Series, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, n, bits in zip(texts, got["n_words"], got["hit"], strict=True):
            if not bits:
                rows.append((0, 0, []))
                continue
            hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n)).astype(bool)
            rows.append((int(hit.sum()), longest_run(hit), [list(s) for s in spans(t, hit)]))
        return pd.DataFrame(rows, columns=["n_hit", "longest", "spans"])

    last.__annotations__ = {"texts": pd.Series, "got": pd.DataFrame, "return": pd.DataFrame}
    out = docs.withColumn(raw, found)
    hit_text = F.when(F.length(F.col(raw)["hit"]) > 0, quoted(text))  # other texts need no offsets
    out = out.withColumn(name, F.pandas_udf(last, _BITS)(hit_text, F.col(raw)))
    n_words, n_hit = F.col(raw)["n_words"], F.col(name)["n_hit"]
    return out.withColumn(
        name,
        F.struct(
            n_words.alias("n_words"), n_hit.alias("n_hit"), F.col(name)["longest"].alias("longest"), F.col(raw)["items"].alias("items"), F.col(name)["spans"].alias("spans"),
            ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"),
        ),
    ).drop(raw)


def _both(a: Column, b: Column) -> Column:
    """Hits of two parts of a benchmark."""

    def join(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, h, i, g, j in zip(x["n_words"], x["hit"], x["items"], y["hit"], y["items"], strict=True):
            if h and g:
                h = (np.frombuffer(h, np.uint8) | np.frombuffer(g, np.uint8)).tobytes()
            rows.append((n, h or g, sorted({*i, *j})))
        return pd.DataFrame(rows, columns=["n_words", "hit", "items"])

    join.__annotations__ = {"x": pd.DataFrame, "y": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(join, HITS)(a, b)
