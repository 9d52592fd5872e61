"""Text vectors made of the corpus itself: random indexing.

Every token has a sparse vector of ENTRIES signs at places that its MD5 names, so no table of tokens is kept or shared. A
text's vector is the sum over its tokens, each weighted by how rare it is, at unit length. Rarity is counted for buckets of
tokens (named by the same hash), so it is a table of fixed size whatever the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, tokenize

#: Length of a vector, entries of a token, and buckets of tokens.
DIMS, ENTRIES, BUCKETS = 64, 2, 4096


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each token of the last column, an array of words: the number is the first 40 bits of the token's MD5,
    seven for each entry from below (place and sign), then its bucket. A batch's distinct tokens are hashed once."""
    words = batch.column(batch.num_columns - 1)
    coded = words.flatten().dictionary_encode()
    number = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:5], "big") for t in coded.dictionary.to_pylist()], np.int64)
    rows = np.repeat(np.arange(batch.num_rows), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return rows, number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.empty(0, np.int64)


def _bucket(number: np.ndarray) -> np.ndarray:
    return (number >> (7 * ENTRIES)) & (BUCKETS - 1)


def _worded(texts: DataFrame, id_col: str) -> DataFrame:
    return texts.select(F.col(id_col), F.coalesce(tokenize(ascii_fold(F.col("text"))), F.array().cast("array<string>")).alias("words"))


def bucket_weights(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(bucket, weight) of the tokens of ``docs`` (id, text): ln(1 + (N - df + 0.5) / (df + 0.5)), where df is the number of
    documents with a token of the bucket and N the number of all. BUCKETS rows at most. A task counts its documents and goes
    on with its sums alone."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows, number = _tokens(batch)
            df += np.bincount(np.unique(rows * BUCKETS + _bucket(number)) % BUCKETS, minlength=BUCKETS)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["bucket", "df"])

    df = _worded(docs, id_col).select("words").mapInArrow(counted, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("bucket", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))  # one row


def encode(texts: DataFrame, weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, vector) of ``texts`` (id, text): unit vectors of DIMS entries.

    Tokens of buckets that ``weights`` lacks count for nothing. Texts without tokens, null ones among them, and those whose
    entries cancel out have no vector and no row. Rows of one id are one text; a null id is an id like another. The weights,
    BUCKETS numbers, are read at once; a task sums its texts' entries."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    weight = np.zeros(BUCKETS)
    for r in weights.collect():
        weight[r["bucket"]] = r["weight"]
    kind = texts.schema[id_col].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number = _tokens(batch)
            w, sums = weight[_bucket(number)], np.zeros(batch.num_rows * DIMS)
            for i in range(ENTRIES):
                place, sign = (number >> (7 * i)) & (DIMS - 1), 1 - 2 * ((number >> (7 * i + 6)) & 1)
                sums += np.bincount(rows * DIMS + place, w * sign, len(sums))
            at = pa.array(np.arange(0, len(sums) + 1, DIMS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(sums))], names=[id_col, "sums"])

    made = _worded(texts, id_col).where("size(words) > 0").mapInArrow(summed, f"`{id_col}` {kind}, sums array<double>")
    made = made.groupBy(id_col).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("vector"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            kept = (np.abs(sums) > 1e-9).any(axis=1)
            sums = sums[kept] / np.sqrt((sums[kept] ** 2).sum(axis=1, keepdims=True))
            at = pa.array(np.arange(0, sums.size + 1, DIMS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.ListArray.from_arrays(at, pa.array(sums.ravel()))], names=[id_col, "vector"])

    # A column of the optimizer's would be worked out again for each use of the vector.
    return made.mapInArrow(unit, f"`{id_col}` {kind}, vector array<double>")
