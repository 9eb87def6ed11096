"""Fuzzy line deduplication: prefixes of neighbouring words, edit similarity, connected groups.

Lines are split at line feeds and normalised: A-Z lower-cased, digits as 0 (but in lines of one to three words), ASCII
signs and white space as one space, each character of a script without spaces as a word.
Equal normalised lines are one class (rows of 16 bytes, pre-aggregated). Two lines within the edit similarity keep most
of their grams of three neighbouring words, so they share one of the few rarest grams of each (see ``reach``): these are the
signatures, and no line within the similarity is missed. Candidates are ruled out by word parities and verified by word
edit distance where the lines of a signature come together, and of each connected group the occurrence
that comes first by (doc_id, line number) stays.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, LOWER, Scratch, fresh, hash_share, mix64, quoted, tidied, tidy
from .components import components
from .linkage import BLOCK

BITS = 128
#: Edit similarity of two lines: 1 - edits / words of the longer one, in percent.
PERCENT = 90
#: Under it, short lines can be similar without two neighbouring words in common.
LEAST_PERCENT = 70
#: Default of ``least``, and fewer words than so many keep their digits: they have little else to tell them apart.
LEAST_WORDS = 4
#: Bytes from which a word is hashed by byte, so that few long words take no step for each eight bytes.
LONG_WORD = 64
#: Characters of texts whose lines are hashed together; signatures and lines that a batch sends together.
PIECE, BATCH = 1_000_000, 1_000_000
#: Lines of a batch from which a signature is shared for certain.
HOT = 64
#: Lines of a signature that a bucket compares with each other; words of a line as a bucket knows them, at most.
WHOLE, LONG = 512, 65_535
#: Documents in which words are counted, and words that are known as frequent: for the order of signatures only.
SAMPLED, FREQUENT = 5000, 50_000
_SIGNS = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 10 else 32 for b in LOWER)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))
#: Scripts without spaces between words (Thai to Khmer, kana, bopomofo, Han): each character is a word.
UNSEGMENTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def _folded(text: str | None) -> bytes:
    """The text with only words, spaces and line feeds left; digits as they are."""
    text = text or ""
    if not text.isascii() and UNSEGMENTED.search(text):
        text = UNSEGMENTED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").translate(_SIGNS)


def normalised_lines(text: str | None) -> list[list[bytes]]:
    """The words of each line."""
    data = _folded(text)
    folded = [x.split() for x in data.translate(_DIGITS).split(b"\n")]
    return [x.split() if len(ws) < LEAST_WORDS else ws for x, ws in zip(data.split(b"\n"), folded, strict=True)]


def hashed_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; and of all lines together, as ``normalised_lines`` has them: words of each line, and two
    independent 64-bit hashes of every word (eight bytes at a time; of long words sums over bytes and their places)."""
    parts = [_folded(t) for t in texts]
    lines = np.array([x.count(b"\n") + 1 for x in parts], np.int64)
    data = np.frombuffer(bytearray(b" " + b"\n".join(parts) + b" " * 8), np.uint8)
    inside = data > 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    feed = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(start, feed), prepend=0, append=len(start)) if len(texts) else np.zeros(0, np.int64)
    digit = np.flatnonzero((data >= 48) & (data <= 57))
    data[digit[n[np.searchsorted(feed, digit)] >= LEAST_WORDS]] = 48
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    piece = eight[start] & mask[np.minimum(size, 8)]
    out = [mix64(piece ^ seed) for seed in _SEEDS]
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        piece = eight[start[more] + at] & mask[np.minimum(size[more] - at, 8)]
        for h in out:
            h[more] = mix64(h[more] + piece)
        at += 8
        more = more[size[more] > at]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        first = np.cumsum(size[long]) - size[long]
        place = np.arange(size[long].sum()) - np.repeat(first, size[long])
        byte = data[np.repeat(start[long], size[long]) + place] | place.astype(np.uint64) << np.uint64(8)
        for h, seed in zip(out, _SEEDS, strict=True):
            h[long] = mix64(np.add.reduceat(mix64(byte ^ seed), first) + size[long].astype(np.uint64))
    return lines, n, out[0], out[1]


def edits(a: list, b: list, most: int) -> int:
    """Word edit distance of two sequences, or most + 1 where it is larger.

    Bit-parallel: a whole column of the usual table is two integers, of its upward and its downward steps.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    m, left = len(a), len(b)
    if not m:
        return min(left, most + 1)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    for y in b:
        left -= 1
        eq = at.get(y, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | full & ~(diagonal | up), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - left > most:  # every further column takes off one at most
            return most + 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(eq | down | plus)) & full, plus & (eq | down) & full
    return min(score, most + 1)


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    x, y = a.split(" "), b.split(" ")
    most = (100 - percent) * max(len(x), len(y)) // 100
    return edits(x, y, most) <= most


def apart(n, others, percent: int = PERCENT):
    """The most word parities in which lines of so many words differ if they are similar, or -1 if they can't be.

    Of the edits, at least the difference of the lengths are insertions: they change one parity, the others up to two.
    """
    longer, d = np.maximum(n, others), np.abs(n - others)
    e = (100 - percent) * longer // 100
    return np.where(d <= e, 2 * e - d, -1)


def gram(percent: int) -> int:
    """Neighbouring words of a signature: three, or two where lines can be similar without three in common."""
    return 3 if percent >= 85 else 2


def reach(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its grams, in any common order, a line of n words needs as signatures; 0 without similar lines.

    Of grams of q words, an insertion breaks q - 1 of the shorter line, another edit q. So if e edits lead to a line longer
    by d, at most q e - d grams of the shorter one and q e of the longer one are not shared, and one more is enough.
    """
    sizes, back = np.unique(n, return_inverse=True)
    return np.array([_reach(x, percent) for x in sizes.tolist()], np.int64)[back]


@functools.lru_cache(100_000)
def _reach(x: int, percent: int) -> int:
    # Each ten-odd words more allow an edit more, which breaks q grams at most: the first jumps decide.
    q = gram(percent)
    d = np.arange(min(x, q * 100 // max(1, 100 - percent) + 2) + 1)
    e = (100 - percent) * (x + d) // 100
    most = int(np.where((d <= e) & (e > 0), q * e - d, -1).max())
    return most + 1 if most > 0 else 0


def frequencies(docs: DataFrame, sampled: int = SAMPLED, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of frequent words and their counts in a share of the documents (column text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for texts in _pieces(pdf["text"]):
                h, c = np.unique(hashed_lines(texts)[2], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    counts = hash_share(docs, sampled, "doc_id").select("text").mapInPandas(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(frequent).collect()
    h, c = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _pieces(texts) -> Iterator[list]:
    """Texts in lists of about PIECE characters."""
    own, load = [], 0
    for t in texts:
        own.append(t)
        load += len(t or "")
        if load > PIECE:
            yield own
            own, load = [], 0
    if own:
        yield own


def signatures(n: np.ndarray, h: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word parities, BITS bits as two numbers, of lines of n words with hashes h; and the lines' signatures, with the
    line of each.

    The common order is by the frequency of a gram's rarest word, in quarters of a power of two, and then by hash. A key
    of 48 bits has both, so the lines' numbers fit in front and one sort of plain numbers does all lines.
    """
    start = np.cumsum(n) - n
    sketch, full = np.zeros((len(n), 2), np.uint64), n > 0
    if len(h):
        one = np.uint64(1) << (h & np.uint64(63))
        low = one * (h >> np.uint64(6) & np.uint64(1))
        for k, bits in enumerate((low, one ^ low)):
            sketch[full, k] = np.bitwise_xor.reduceat(bits, start[full])
    want, q = reach(n, percent), gram(percent)
    level = np.zeros(1 << 20, np.uint8)  # by the end of a word's hash: rare words that share it count as frequent
    rank = np.argsort(common[1])
    level[(common[0][rank] & np.uint64(len(level) - 1)).astype(np.int64)] = np.minimum(4 * np.log2(common[1][rank] + 1.0), 63)
    some = np.flatnonzero(want)
    sigs, owns = [], []
    for at in range(0, len(some), 1 << 16):
        line = some[at : at + (1 << 16)]
        count = np.maximum(n[line] - q + 1, 0)
        base = np.cumsum(count) - count
        first = np.repeat(start[line] - base, count) + np.arange(count.sum())
        seldom = level[(h & np.uint64(len(level) - 1)).astype(np.int64)]
        words, rare = h[first], seldom[first]
        for k in range(1, q):
            words = words * _SEEDS[1] + h[first + k]
            rare = np.minimum(rare, seldom[first + k])
        key = mix64(words) >> np.uint64(22) | rare.astype(np.uint64) << np.uint64(42)
        key |= np.repeat(np.arange(len(line)), count).astype(np.uint64) << np.uint64(48)
        key.sort()
        kept = np.minimum(count, want[line])
        place = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        key = key[np.repeat(base, kept) + place]
        # The same gram again in a line is another signature: grams are counted with their repeats.
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        spot = np.arange(len(key))
        again = (spot - np.maximum.accumulate(np.where(new, spot, 0))).astype(np.uint64)
        sigs.append(mix64((key & np.uint64((1 << 48) - 1)) + (again << np.uint64(48))))
        owns.append(np.repeat(line, kept))
    return sketch, np.concatenate(sigs) if sigs else np.zeros(0, np.uint64), np.concatenate(owns) if owns else np.zeros(0, np.int64)


#: Rows of ``_facts``: of lines, and of groups of classes that share a signature.
FACTS = "doc_id long, line long, h1 long, h2 long, sig long, whole boolean, ids binary"


def _facts(docs: DataFrame, least: int, percent: int, buckets: int) -> DataFrame:
    """A row for each eligible line (where it is, the hashes of its normalised form), and one for each group of classes
    that share a signature (sig, ids).

    Signatures meet in buckets of the hash space, as plain arrays with parities (folded to 64) and the word count of their line:
    most have no partner that these allow and end there. Lines that are connected by allowed pairs are a whole
    group, named after its members: the many signatures that two similar lines share give the same group. A
    signature that very many lines of one batch have does not go through a bucket, so a bucket's load is bounded by the
    number of batches; its lines, and those of a signature with more than WHOLE, are parts of a group.
    """
    common = frequencies(docs)
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=object).astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)

    def send(lines: list[np.ndarray], sigs: list[np.ndarray], ids: list[np.ndarray], bits: list[np.ndarray], sizes: list[np.ndarray]) -> pd.DataFrame:
        rows = np.concatenate(lines, axis=1)
        sig, own, odd, n = (np.concatenate(x) for x in (sigs, ids, bits, sizes))
        order = np.argsort(sig)
        sig, own, odd, n = sig[order], own[order], odd[order], np.minimum(n[order], LONG).astype(np.uint16)
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        hot = np.repeat(np.diff(np.append(first, len(sig))) > HOT, np.diff(np.append(first, len(sig))))
        at = int(rows[0, 0] % buckets) if rows.shape[1] else 0
        named = np.searchsorted(edges, sig[hot], "right").astype(np.uint64) << np.uint64(32) | sig[hot] & low
        out = [(at, 1, rows.tobytes(), b"", b"", b""), (at, 2, named.tobytes(), own[hot].tobytes(), b"", b"")]
        # Of a hot one a line goes through its bucket, marked by no words, where those of other batches find that it is hot.
        n[hot] = 0
        thin = ~hot
        thin[first] = True
        sig, own, odd, n = sig[thin], own[thin], odd[thin], n[thin]
        cut = np.concatenate(([0], np.searchsorted(sig, edges), [len(sig)]))
        code = sig.astype(np.uint32)
        out += [(k, 0, *(x[a:b].tobytes() for x in (code, own, odd, n))) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pd.DataFrame(out, columns=["bucket", "kind", "a", "b", "c", "d"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = ([], [], [], [], [])
        load, seen = 0, np.zeros(0, np.uint64)
        for pdf in batches:
            done = 0
            for texts in _pieces(pdf["text"]):
                docs = pdf["doc_id"].to_numpy()[done : done + len(texts)].astype(np.int64)
                done += len(texts)
                per, n, h, g = hashed_lines(texts)
                at, good = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per), n >= least
                whose = np.repeat(docs, per)[good]
                word = np.repeat(good, n)
                h, g, n, at = h[word], g[word], n[good], at[good]
                h1, h2 = _line_hash(n, h), _line_hash(n, g)
                _, one = np.unique(h1, return_index=True)
                one = np.sort(one[~np.isin(h1[one], seen)])
                seen = np.union1d(seen, h1[one])
                mine = np.zeros(len(n), bool)
                mine[one] = True
                sketch, sig, line = signatures(n[one], h[np.repeat(mine, n)], common, percent)
                new = (np.stack([whose, at, h1.view(np.int64), h2.view(np.int64)]), sig, h1[one][line], np.bitwise_xor(*sketch[line].T), n[one][line])
                for x, y in zip(held, new, strict=True):
                    x.append(y)
                load += len(sig) + len(n)
                if load > BATCH:
                    yield send(*held)
                    held, load, seen = ([], [], [], [], []), 0, np.zeros(0, np.uint64)
        if held[0]:
            yield send(*held)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, a, b in zip(pdf["kind"], pdf["a"], pdf["b"], strict=True):
            if kind == 1 and len(a):
                out.append(pd.DataFrame(dict(zip(("doc_id", "line", "h1", "h2"), np.frombuffer(a, np.int64).reshape(4, -1), strict=True))))
            elif kind == 2 and len(a):
                out.append(_listed(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), False))
        sent = pdf[pdf["kind"] == 0]
        if len(sent):
            code, own, odd, n = (np.frombuffer(b"".join(sent[c]), t) for c, t in (("a", np.uint32), ("b", np.int64), ("c", np.uint64), ("d", np.uint16)))
            order = np.argsort(code.astype(np.uint64) << np.uint64(32) | own.view(np.uint64) & low)
            code, own, n = code[order], own[order], n[order]
            # Copies of a line send the same in several batches.
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1]) | (n[1:] != n[:-1])
            code, own, odd, n = code[new], own[new], odd[order[new]], n[new]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            size = np.diff(np.append(first, len(code)))
            open_ = np.repeat((size > WHOLE) | (np.minimum.reduceat(n, first) == 0), size)
            size = np.repeat(size, size)
            name = code[open_].astype(np.int64) | int(sent["bucket"].iloc[0]) << 32
            out.append(_listed(name, own[open_], False))
            rest = ~open_ & (size > 1)
            label = _connected(code[rest], odd[rest], n[rest].astype(np.int64), size[rest], percent)
            own, kept = own[rest], label >= 0
            own, label = own[kept], label[kept]
            if len(own):
                total = np.zeros(int(label.max()) + 1, np.uint64)
                np.add.at(total, label, mix64(own.view(np.uint64)))
                # A group once for all signatures of the bucket that have it.
                used = np.unique(label)
                _, one = np.unique(total[used], return_index=True)
                once = np.isin(label, used[one])
                out.append(_listed(total[label[once]].view(np.int64), own[once], True))
        names = [f.split()[0] for f in FACTS.split(", ")]
        kinds = {c: "Int64" for c in ("doc_id", "line", "h1", "h2", "sig")} | {"whole": "boolean"}
        done = [x.assign(**{c: None for c in names if c not in x}).astype(kinds)[names] for x in out if len(x)]
        return pd.concat(done) if done else pd.DataFrame({c: [] for c in names})

    sent = docs.mapInPandas(tidy(find), "bucket int, kind int, a binary, b binary, c binary, d binary")
    return sent.groupBy("bucket").applyInPandas(tidied(meet), FACTS)


def _line_hash(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each line of n > 0 words with hashes h, in their order."""
    first = np.cumsum(n) - n
    step = (np.arange(len(h)) - np.repeat(first, n) + 1).astype(np.uint64) * _SEEDS[0]
    return np.add.reduceat(mix64(h + step), first) if len(n) else np.zeros(0, np.uint64)


def _listed(sig: np.ndarray, own: np.ndarray, whole: bool) -> pd.DataFrame:
    """A row for each sig, with the distinct ids that come with it in ascending order."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own = sig[new], own[new]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    return pd.DataFrame({"sig": sig[first], "whole": whole, "ids": [x.tobytes() for x in np.split(own, first[1:])] if len(sig) else []})


def _unlisted(groups: DataFrame) -> DataFrame:
    """sig and id of each member of groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"sig": pdf["sig"].repeat(pdf["ids"].map(len) // 8), "id": np.frombuffer(b"".join(pdf["ids"]), np.int64)})

    return groups.select("sig", "ids").mapInPandas(run, "sig long, id long")


def _connected(code: np.ndarray, odd: np.ndarray, n: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """A number for each entry: equal for those of a code that are connected by pairs which parities and words allow, -1 for
    entries without such a pair. code: sorted; size: entries of the same code."""
    at, left, right = np.arange(len(code)), [], []
    for step in range(1, int(size.max()) if len(size) else 0):
        at = at[size[at] > step]
        i = at[at + step < len(code)]
        i = i[code[i] == code[i + step]]
        j = i + step
        ok = (np.bitwise_count(odd[i] ^ odd[j]) <= apart(n[i], n[j], percent)) | (n[i] == LONG) | (n[j] == LONG)
        left.append(i[ok])
        right.append(j[ok])
    label = np.arange(len(code))
    if not left:
        return label - len(code)
    i, j = np.concatenate(left), np.concatenate(right)
    while True:
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    alone = np.ones(len(code), bool)
    alone[i] = alone[j] = False
    return np.where(alone, -1, label)


def _among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df before a join with ids on key: where few ids are left, without its other rows, so that they are not shuffled."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids), key, "left_semi") if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _line_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """id, words (64-bit hashes, one after the other), sig and block (arrays) and sigs (the former as bytes) of the lines at
    places (doc_id, line, id, cells). A text is shuffled once at most."""
    cell = np.dtype([("sig", ">i8"), ("block", ">i4")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = 0
            for texts in _pieces(pdf["text"]):
                wanted = pdf["w"].iloc[done : done + len(texts)]
                done += len(texts)
                per, n, h, _ = hashed_lines(texts)
                line, word = np.cumsum(per) - per, np.append(0, np.cumsum(n))
                rows = []
                for a, own in zip(line.tolist(), wanted, strict=True):
                    for w in own:
                        cells = np.frombuffer(w["cells"], cell)
                        words = h[word[a + w["line"]] : word[a + w["line"] + 1]]
                        rows.append((w["id"], words.tobytes(), cells["sig"].astype(np.int64), cells["block"].astype(np.int32) - 1, cells["sig"].tobytes()))
                yield pd.DataFrame(rows, columns=["id", "words", "sig", "block", "sigs"])

    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id", "cells")).alias("w"))
    full = _among(docs, places, "doc_id").join(wanted, "doc_id").select("text", "w")
    return full.mapInPandas(tidy(run), "id long, words binary, sig array<long>, block array<int>, sigs binary")


def _links(sig: int, ids: np.ndarray, words: list[bytes], sigs: list[bytes], comp: np.ndarray, left: int, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect lines (ids, word hashes) of different components, no more than it takes.

    sigs: the groups of each line; a pair is looked at in the first of those that both have, here if that is sig.
    left: if not 0, only pairs of one of the first so many lines with one of the others are looked at.
    """
    n = np.array([len(w) // 8 for w in words], np.int64)
    h = np.frombuffer(b"".join(words), np.uint64)
    first = np.cumsum(n) - n
    one = np.uint64(1) << (h & np.uint64(63))
    low = one * (h >> np.uint64(6) & np.uint64(1))
    x, y = (np.bitwise_xor.reduceat(b, first) for b in (low, one ^ low))
    a, b = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    far = np.bitwise_count(x[a, None] ^ x[None, b]).astype(np.int64) + np.bitwise_count(y[a, None] ^ y[None, b])
    close = (far <= apart(n[a, None], n[None, b], percent)) & (comp[a, None] != comp[None, b])
    if not left:
        close = np.triu(close, 1)
    if not close.any():
        return []
    row = np.repeat(np.arange(len(sigs)), [len(x) // 8 for x in sigs])
    before = np.frombuffer(b"".join(sigs), ">u8").astype(np.uint64)
    row, before = row[before < np.uint64(sig % (1 << 64))], before[before < np.uint64(sig % (1 << 64))]
    _, column, count = np.unique(before, return_inverse=True, return_counts=True)
    if len(count) and count.max() > 1:
        place = np.cumsum(count > 1) - 1
        has = np.zeros((len(ids), int(place[-1]) + 1), np.float32)
        has[row[count[column] > 1], place[column[count[column] > 1]]] = 1
        close &= has[a] @ has[b].T == 0
    i, j = np.nonzero(close)
    order = np.argsort(far[i, j], kind="stable")
    i, j = i[order], j[order] + left
    root = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out, seqs = [], {}
    of = lambda k: seqs[k] if k in seqs else seqs.setdefault(k, h[first[k] : first[k] + n[k]].tolist())
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        u, v = top(int(comp[p])), top(int(comp[q]))
        if u == v:
            continue
        most = (100 - percent) * int(max(n[p], n[q])) // 100
        if edits(of(p), of(q), most) <= most:
            root[u] = v
            out.append((int(ids[p]), int(ids[q])))
    return out


def _linked_lines(groups: DataFrame, words_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """id and component of all classes with a link. groups: sig, whole, ids; words_of: id and cells (sig and block of each,
    as bytes) to what ``_line_words`` returns.

    Whole groups are searched in one piece; the others are dealt to blocks, each is searched, and then those pairs of blocks
    that still hold several components. A search verifies pairs at once and gives only the links that connect: fewer than
    it has lines, however many of its lines are similar.
    """
    whole = _unlisted(groups.where("whole").select("sig", "ids").distinct()).select("sig", F.lit(-1).alias("block"), "id")
    parts = scratch.keep(_unlisted(groups.where("NOT whole")).distinct())
    many = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", F.expr(f"CAST(n DIV {BLOCK} + 1 AS int)").alias("blocks"))
    parts = scratch.keep(parts.join(many, "sig").select("sig", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "blocks"))
    cells = whole.unionByName(parts.drop("blocks"))
    spell = lambda x: F.concat(F.lpad(F.hex(x["sig"]), 16, "0"), F.lpad(F.hex(x["block"] + 1), 8, "0"))
    spelt = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("sig", "block"))), spell), "")
    own = scratch.keep(cells.groupBy("id").agg(F.unhex(spelt).alias("cells")))
    words = scratch.keep(words_of(own))
    fields = ("id", "words", "sigs")
    gathered = [F.collect_list(c).alias(c) for c in fields]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["sig"].tolist(), *(pdf[c] for c in fields), strict=True)
            out = [r for sig, ids, ws, gs in rows if len(ids) > 1 for r in _links(sig, np.asarray(ids), list(ws), list(gs), np.arange(len(ids)), 0, percent)]
            yield pd.DataFrame(out, columns=["a", "b"])

    each = words.select(*fields, F.explode(F.arrays_zip("sig", "block")).alias("cell"))
    lists = each.select("cell.sig", "cell.block", *fields).groupBy("sig", "block").agg(*gathered)
    links = scratch.keep(lists.drop("block").mapInPandas(tidy(alone), "a long, b long").distinct())
    comp = components(links, scratch)
    rows = parts.where("blocks > 1").join(comp, "id", "left").select("sig", "block", "blocks", "id", F.coalesce("component", "id").alias("comp"))
    rows = scratch.keep(rows)
    mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    if mixed.isEmpty():
        scratch.drop(parts, own, words, rows)
        return comp
    each = rows.join(mixed, "sig").join(words.select(*fields), "id")
    fields += ("comp",)
    lists = each.groupBy("sig", "block", "blocks").agg(*(F.collect_list(c).alias(c) for c in fields))
    lists = scratch.keep(lists)
    x = lists.select("sig", *(F.col(c).alias(f"x_{c}") for c in fields), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"), F.col("block").alias("i")).where("i < block")
    both = x.join(lists.select("sig", "block", *(F.col(c).alias(f"y_{c}") for c in fields)), ["sig", "block"])

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sig, *both in zip(pdf["sig"].tolist(), *(pdf[f"{s}_{c}"] for c in fields for s in "xy"), strict=True):
                ids, ws, gs, cs = ([*x, *y] for x, y in zip(both[::2], both[1::2], strict=True))
                out += _links(sig, np.array(ids), ws, gs, np.array(cs), len(both[0]), percent)
            yield pd.DataFrame(out, columns=["a", "b"])

    new = scratch.keep(both.drop("block", "i").mapInPandas(tidy(across), "a long, b long").distinct())
    comp = comp if new.isEmpty() else components(links.unionByName(new), scratch)
    scratch.drop(parts, own, words, rows, lists)
    return comp


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id and line (from 0) of every line that an earlier one, by (doc_id, line), repeats or nearly repeats.

    Earlier lines are those of the same connected group. Lines of fewer than ``least`` words, those of null
    texts and those of rows without a doc_id are never repeated ones. Rows that repeat a doc_id share its lines' numbers.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} or more, not {percent}")
    scratch = Scratch(docs.sparkSession)
    own = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * own.rdd.getNumPartitions())
    facts = scratch.keep(_facts(own, least, percent, buckets))
    rows = facts.where("doc_id IS NOT NULL").select("doc_id", "line", "h1", "h2")
    place = F.struct("doc_id", "line")
    classes = scratch.keep(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")))

    places: list[DataFrame] = []

    def words_of(cells: DataFrame) -> DataFrame:
        # An id of 64 bits: should two classes share one, both are verified under it.
        found = _among(classes.select(F.col("h1").alias("id"), "first.doc_id", "first.line"), cells, "id")
        places.append(scratch.keep(found.join(cells, "id")))
        return _line_words(own, places[-1])

    comp = _linked_lines(facts.where("ids IS NOT NULL").select("sig", "whole", "ids"), words_of, percent, scratch)
    named = classes.join(comp.select(F.col("id").alias("h1"), "component"), "h1", "left")
    named = scratch.keep(named.where("component IS NOT NULL OR first < last"))
    scratch.drop(classes, *places)
    heads = scratch.keep(named.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("head")))
    if heads.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        heads = F.broadcast(heads)  # so that the lines of a large group need not come together
    first = named.join(heads, "component", "left").select("h1", "h2", F.coalesce("head", "first").alias("head"))
    out = scratch.keep(rows.join(first, ["h1", "h2"]).where(place != F.col("head")).select("doc_id", "line").distinct())
    scratch.drop(facts, named)
    return out


def deduplicate_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated lines taken out of their text, and an array column ``dropped_lines`` (``_dropped_lines``
    where that name is taken) of their numbers, null where there are none.

    The other lines, line feeds and columns are unchanged; a text that loses all its lines is empty. See
    ``repeated_lines`` for nulls, repeated rows and short lines. An empty table stays empty.
    """
    name, drop = fresh(docs, "dropped_lines", "drop_from")
    lines = repeated_lines(docs, text, key, percent, least)
    drops = lines.groupBy(F.col("doc_id").alias(drop)).agg(F.sort_array(F.collect_list("line")).alias(name))

    def cut(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        out = []
        for t, d in zip(texts, dropped, strict=True):
            if t is None:
                out.append(None)
                continue
            gone = set(d)
            out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
        return pd.Series(out)

    cut.__annotations__ = {"texts": pd.Series, "dropped": pd.Series, "return": pd.Series}
    # The lines to drop grow with the corpus: the planner alone decides whether they are few enough for a broadcast.
    out = docs.join(drops, quoted(key) == F.col(drop), "left").drop(drop)
    # Only texts that lose lines go to Python.
    cutting = F.pandas_udf(cut, T.StringType())(F.when(F.col(name).isNotNull(), quoted(text)), F.col(name))
    return out.withColumn(text, F.when(F.col(name).isNull(), quoted(text)).otherwise(cutting))
