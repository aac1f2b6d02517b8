"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at boundaries that no match of the public pattern spans and none
looks across: before white space that follows anything else, and between punctuation (but an
apostrophe) and a letter. So the ids of the pieces are the ids of the whole text. A stretch without
such a boundary, and a text under any other pattern, stays whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import slices, table, text_bytes

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 200_000
#: Letters of scripts whose ranges no version of Unicode changes any more, and common punctuation.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0904-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = ".,;:!?()\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u060c\u061f\u0964"
_SAFE = re.compile(rf"(?<=\S)[ \t-\r\u00a0\u2028\u2029\u3000]|(?<=[{_MARK}])[{_LETTER}]")


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive pieces of about `size` characters; a stretch without a safe boundary stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size or enc._pat_str != default_ranks()[1]:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]


def tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_column: str = "text") -> DataFrame:
    """Adds `token_ids` (array<int>) and `decoded` (the bytes that the ids stand for) to every row.

    A null text counts as empty: no ids, no bytes. Other columns pass through, but for columns
    named token_ids or decoded, which are replaced.
    """
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]
    base = docs.drop("token_ids", "decoded")
    at = base.columns.index(text_column)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in it:
            texts = text_bytes(batch.column(at))
            for a, b in slices(len(texts), lambda i: len(texts[i])):  # noqa: B023
                ids, decoded = [], []
                for t in texts[a:b]:
                    own = encode(enc, t.decode())
                    decoded.append(enc.decode_bytes(own))
                    ids.append(np.asarray(own, np.int32))
                rows = batch.slice(a, b - a)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(decoded, pa.binary())], names=[*rows.schema.names, "token_ids", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, token_ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every row.

    The ids never leave the worker, so a row's output has a fixed size. Null and empty texts give
    no tokens and the digest of no bytes; null and repeated doc_ids are rows like any other.
    """
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in it:
            n, ids_sha, decoded_sha = [], [], []
            for value in batch.column(1):
                ids = encode(enc, value.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
