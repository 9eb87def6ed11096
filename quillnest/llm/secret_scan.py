"""Secret scans: fixed patterns, and random strings exposed by a token-efficiency test.

A BPE vocabulary spends few tokens on what resembles language and many on random strings. Candidate strings with
fewer characters per token than a limit are reported as kind ``random``, unless they are known digests
(hexadecimal of digest length), UUIDs or identifiers (words joined by case, digits or underscores, each of which has
as many characters per token itself).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted

#: Kinds in the order that breaks ties; fixed by the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Random strings: candidates have 20 characters or more, and fewer than this many characters a token.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CHARS_PER_TOKEN = 2.0
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of an identifier, as its case divides it, and its numbers: runs are whole, so a string is read once.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Digits of a number inside an identifier.
NUMBER = 4
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def encoder(vocabulary: str):
    import base64

    import tiktoken

    # The pattern of the vocabulary's tokenizer: contractions, letters, digits, other signs, white space.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()  # of bytes: ASCII letters only
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # runs are whole: the same as dropping short ones
    return out


def known(s: str) -> bool:
    """Digests and UUIDs: long strings that are no secrets."""
    if DIGEST.fullmatch(s) and len(s) in DIGEST_LENGTHS or UUID.fullmatch(s):
        return True
    return len(set(s)) < 8  # rules, padding and repeated signs


def identifier(s: str, enc, limit: float) -> bool:
    """Words joined by case, numbers or signs: each word, as one of a text, passes the test that the whole failed."""
    parts = PART.findall(s)
    names = [w for w in parts if not w[0].isdigit()]
    if not names or parts[0] != names[0] or any(len(w) > NUMBER for w in parts if w[0].isdigit()):
        return False
    return all(len(w) >= max(2, limit * len(enc.encode_ordinary(f" {w.lower()}"))) for w in names)


def random_spans(text: str, enc, limit: float) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not known(s) and len(s) < limit * len(enc.encode_ordinary(s)) and not identifier(s, enc, limit):
            out.append((m.start(), 3, m.end()))
    return out


def scan_secrets(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, chars_per_token: float = CHARS_PER_TOKEN
) -> DataFrame:
    """docs with an array column ``secrets`` (``_secrets`` where that name is taken) of struct<kind, start, stop>.

    Spans are code points, stop exclusive, by start, then kind in the order of KINDS. A null or empty text has
    none; long texts are scanned whole; repeated rows are each scanned; an empty table stays empty.
    """
    (name,) = fresh(docs, "secrets")

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series(
                [
                    [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in sorted(base_spans(t) + random_spans(t, enc, chars_per_token))]
                    if t
                    else []
                    for t in texts
                ]
            )

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(find, SPAN)(quoted(text)))
