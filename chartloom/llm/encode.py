"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6)."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.bpe import default_vocabulary, encoder


def _shipped(vocabulary: str | None) -> str:
    """Send the vocabulary file to all executors and return the name under which they have it."""
    path = vocabulary or default_vocabulary()
    SparkSession.active().sparkContext.addFile(path)
    return os.path.basename(path)


def token_ids(text: Column, vocabulary: str | None = None) -> Column:
    """Token ids of a string column, computed batch by batch in Arrow; null and empty texts give an empty list."""
    name = _shipped(vocabulary)

    @F.arrow_udf("array<int>")
    def ids(col: pa.Array) -> pa.Array:
        enc, offsets, flat = encoder(SparkFiles.get(name)), [0], []
        for t in col.to_pylist():
            flat.extend(enc.encode(t))
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of a string column; 0 for null and empty texts."""
    name = _shipped(vocabulary)

    @F.pandas_udf("int")
    def count(col: pd.Series) -> pd.Series:
        enc = encoder(SparkFiles.get(name))
        return col.map(lambda t: len(enc.encode(t)), na_action=None).astype("int32")

    return count(text)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row ``(id, ids)`` per row of ``docs``.

    Repeated rows stay repeated, a null or empty text has the empty list, a null id is kept, further columns are
    ignored, and an empty table gives an empty table. There is no shuffle: each scan task encodes its own rows.
    """
    return docs.select(F.col(id_col), token_ids(F.col(text_col), vocabulary).alias("ids"))
