"""Encoding of a whole corpus with a public byte-level BPE tokenizer, and back.

Each Arrow batch of texts goes through the streaming transducer of bpe.py; the vocabulary file is read once a worker.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointlake.llm import bpe
from pointlake.session import spread

#: Ids after which an output batch is handed over.
MAX_IDS = 1 << 22


def _mapped(df: DataFrame, id_col: str, in_col: str, fn: object, out: str) -> DataFrame:
    return spread(df.select(df[id_col].alias("_id"), df[in_col].alias("_in"))).mapInArrow(fn, f"_id {dict(df.dtypes)[id_col]}, {out}").withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and ids (array<int>) of each row, no special tokens; strings of special tokens are ordinary text.

    Defined cases: null and empty texts give an empty list, never NULL; repeated rows and NULL ids stay as they are; a text
    may be of any length; other columns are dropped, so their names can't clash; an empty table gives none.
    """
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe.load(path)
        for b in batches:
            ids, ends, first = array("i"), [0], 0
            for i, x in enumerate(b.column(1), 1):
                ids.extend(t.encode(x.as_py()))
                ends.append(len(ids))
                if len(ids) >= MAX_IDS or i == b.num_rows:
                    values = pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.empty(0, np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["_id", "ids"])
                    ids, ends, first = array("i"), [0], i

    return _mapped(docs, id_col, text_col, run, "ids array<int>")


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and n_tokens (0 for null and empty texts)."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode(x.as_py())) for x in b.column(1)], pa.int64())], names=["_id", "n_tokens"])

    return _mapped(docs, id_col, text_col, run, "n_tokens bigint")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and text; an empty or NULL list gives an empty text."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(path).merges
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(bpe.decode(m, x.as_py() or [])) for x in b.column(1)], pa.string())], names=["_id", "text"])

    return _mapped(encoded, id_col, ids_col, run, "text string")
