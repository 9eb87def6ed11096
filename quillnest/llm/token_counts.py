"""Token counts from flat, unindexed token files, by a scan for end-of-document identifiers.

A token file is a plain run of little-endian uint16 or uint32 identifiers; every document ends with one end
identifier and there is no index. Files are cut into blocks of equal size. Each block is searched by one vectorised
comparison; a document that crosses blocks is stitched by a prefix scan over one small row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .secret_scan import VOCABULARY, encoder

END = 50256
#: Tokens of a block: 4 MB of uint16.
BLOCK = 2_000_000
MANIFEST = "file string, bytes long, place long, doc_id string"


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Tokenize every whole text to flat uint16 files in ``folder`` (a URI all executors reach); return the manifest.

    Manifest: file, bytes, place (the document's number in its file), doc_id. Each task streams to one new file and
    names it in its rows, so a task that runs again leaves no trace but an unnamed file. A null text has no tokens.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        enc, out, ids = encoder(vocabulary), None, []
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name, size = f"{uuid.uuid4().hex}.tokens", 0
        for pdf in batches:
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}")
            for doc_id, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                tokens = np.array([*(enc.encode_ordinary(t) if t else ()), end], "<u2")
                out.write(tokens.tobytes())
                size += tokens.nbytes
                ids.append(doc_id)
        if out is not None:
            out.close()
            for at in range(0, len(ids), 100_000):
                part = ids[at : at + 100_000]
                yield pd.DataFrame({"file": f"{folder}/{name}", "bytes": size, "place": np.arange(at, at + len(part)), "doc_id": part})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ids.mapInPandas(write, MANIFEST)


def count_tokens(files: DataFrame, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Documents of flat token files: file, place, start (token number in the file), n_tokens, ended.

    files: distinct file (URI) and bytes. The end identifier is not counted. Tokens after the last end form
    an unended document; an empty file, or a null name, has none. Bytes after the last whole identifier are left out.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, k, tokens in zip(pdf["file"], pdf["block"], pdf["tokens"], strict=True):
                fs, path = _fs(file)
                n = int(min(block, tokens - k * block))
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, k * block * width), f"<u{width}")
                at = np.flatnonzero(ids == end) + k * block
                yield pd.DataFrame({"file": [file], "block": [k], "stop": [k * block + n], "ends": [at.astype(np.int64)]})

    tokens = files.where("file IS NOT NULL").select("file", F.expr(f"bytes DIV {width}").alias("tokens"))
    blocks = tokens.select("file", "tokens", F.explode(F.expr(f"sequence(0L, (greatest(tokens, 1L) - 1) DIV {block})")).alias("block"))
    found = blocks.repartition("file", "block").mapInPandas(search, "file string, block long, stop long, ends array<long>")
    # The scan: documents ended, and where the last one ended, before each block.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scanned = found.select(
        "file", "block", "stop", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("place"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).cast("long").alias("last"),
        F.max("block").over(W.partitionBy("file")).alias("final"),
    )
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("last")) + 1
    unended = (F.col("block") == F.col("final")) & (F.col("stop") > tail)
    starts = F.concat(F.array(F.col("last") + 1), F.transform("ends", lambda e: e + 1))
    ends = F.when(unended, F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    n_ended = F.size("ends")
    docs = scanned.select("file", "place", n_ended.alias("n_ended"), F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("a"), ends.alias("b"))))
    return docs.select(
        "file", (F.col("place") + F.col("pos")).alias("place"), F.col("col.a").alias("start"),
        (F.col("col.b") - F.col("col.a")).alias("n_tokens"), (F.col("pos") < F.col("n_ended")).alias("ended"),
    )


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every document: tokenized to flat files, counted by the scan, joined by place.

    Repeated rows are counted each; a null doc_id is kept; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    manifest = scratch.keep(write_tokens(docs, scratch.path(), vocabulary))
    files = manifest.groupBy("file").agg(F.first("bytes").alias("bytes"))
    counts = count_tokens(files, block=block)
    # Not a broadcast: the block rows are small, but there is a count for each document.
    return manifest.join(counts.hint("merge"), ["file", "place"]).select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "ended")
