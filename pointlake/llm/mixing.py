"""Mixing sources to target weights, sizes in tokens of a public tokenizer.

A mix wants B = target_share * total_factor * (all tokens of the corpus) tokens of a source that holds S. Whole passes over the source
give what they can (B // S of them, at most max_repeats); the rest, smaller than S, is fitted by document counts a token length:
every length contributes its floor share, then a bounded knapsack by dynamic programming fills the remaining budget to the
token where a subset of lengths allows it. Which documents of a length are taken is decided by a seeded hash.

A source that can't reach its budget within max_repeats gives all it may; the others keep their own budgets, so that their
shares stay in the wanted proportion and the shares reached are reported.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm import bpe
from pointlake.llm.sources import source_key
from pointlake.session import small, spread, stage

#: Budget in tokens that the dynamic program takes on; what is above it is filled in seeded order of lengths first.
KNAPSACK = 1 << 16
#: Documents that one sub-bucket of a (source, length) group holds on average, when it has to be ranked.
BUCKET = 1000


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source (as source_key), n_tokens: one row a doc_id; of repeated ones the greatest. Rows without doc_id are left out."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe.load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t.encode(x.as_py())) for x in b.column(2)], pa.int64())], names=["doc_id", "source", "n_tokens"])

    d = docs.where("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    d = spread(d).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, n_tokens bigint")
    return d.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens")


def knapsack(lengths: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """Counts a length, at most available, whose total is the greatest that doesn't exceed budget."""
    used = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return used
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int32)
    chunks: list[tuple[int, int, int]] = []  # (length's index, copies, tokens)
    for i in np.argsort(-lengths, kind="stable"):
        left, copies = int(min(available[i], budget // lengths[i])), 1
        while left > 0 and not reached[budget]:
            c = min(copies, left)
            left, copies = left - c, copies * 2
            w = c * int(lengths[i])
            if w > budget:
                break
            new = reached[: budget + 1 - w] & ~reached[w:]
            by[w:][new] = len(chunks)
            reached[w:] |= new
            chunks.append((int(i), c, w))
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, c, w = chunks[by[at]]
        used[i] += c
        at -= w
    return used


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int, seed: int) -> tuple[int, np.ndarray]:
    """(whole passes, further documents a length) whose tokens come as near to budget as they can without exceeding it."""
    total = int((lengths * counts).sum())
    none = np.zeros(len(lengths), dtype=np.int64)
    if total == 0 or budget <= 0 or max_repeats <= 0:
        return 0, none
    passes = min(budget // total, max_repeats)
    rest = budget - passes * total
    if passes == max_repeats or rest <= 0:
        return int(passes), none
    extra = (counts * (rest / total)).astype(np.int64)
    extra = np.minimum(extra, counts)
    rest -= int((extra * lengths).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if rest <= KNAPSACK:
            break
        n = min(int(counts[i] - extra[i]), 1 + (rest - KNAPSACK) // int(lengths[i]), rest // int(lengths[i]))
        extra[i] += n
        rest -= n * int(lengths[i])
    if rest > 0:
        extra += knapsack(lengths, counts - extra, min(rest, 2 * KNAPSACK))
    return int(passes), extra


def wanted(targets: DataFrame, total: int) -> DataFrame:
    """mix, source (as source_key), target_share, max_repeats, total_factor, budget: one row a source of a mix. Targets that name a source
    twice, or in two spellings, add up; the greater repeats and factor count."""
    t = targets.where("mix is not null and source is not null and target_share > 0").select("mix", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "total_factor").where("source is not null")
    t = t.groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("total_factor").alias("total_factor"))
    return t.withColumn("budget", F.round(F.col("target_share") * F.col("total_factor") * F.lit(float(total))).cast("bigint"))


def total_tokens(sizes: DataFrame) -> int:
    return sizes.agg(F.sum("n_tokens")).first()[0] or 0


def plan(docs: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """mix, source, n_tokens, n, passes, extra for each token length of each source of each mix; docs as sized().

    One task handles the length histogram of one source of one mix; its rows are bounded by the longest document, not by
    the number of documents.
    """
    t = wanted(targets, total_tokens(docs))
    lengths = docs.where("source is not null and n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens").reset_index(drop=True)
        passes, extra = fit(pdf.n_tokens.to_numpy(np.int64), pdf.n.to_numpy(np.int64), int(pdf.budget[0]), int(pdf.max_repeats[0] or 0), seed)
        return pdf[["mix", "source", "n_tokens", "n"]].assign(passes=passes, extra=extra)

    return lengths.join(t, "source").groupBy("mix", "source").applyInPandas(solve, "mix string, source string, n_tokens bigint, n bigint, passes bigint, extra bigint")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> DataFrame:
    """mix, source, doc_id, n_tokens, copies: the documents of each mix and how often each is used.

    Defined cases: documents of a NULL or unlisted source and those without tokens (null and empty texts) are never used, though
    their tokens count in the corpus; spellings of a source are one source; repeated rows of a doc_id are one document;
    max_repeats NULL or 0 gives nothing; empty tables give none. Equal lengths of any number are split into hash buckets,
    of which only the one at the border is ranked, so a group that holds a third of all rows is never in one task.
    """
    return mix_sized(stage(sized(docs, path), "sized"), targets, seed)


def mix_sized(d: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """mix() of documents whose sizes are known: d as sized() gives it, staged."""
    p = small(plan(d, targets, seed).where("passes > 0 or extra > 0"), "mixplan")
    j = d.join(p, ["source", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "mix", "doc_id"))
    whole = (F.col("extra") <= 0) | (F.col("extra") >= F.col("n"))
    j = j.withColumn("b", F.pmod("h", F.greatest(F.lit(1), F.expr(f"n div {BUCKET}"))))
    done = j.where(whole).withColumn("copies", F.col("passes") + (F.col("extra") > 0).cast("bigint"))
    part = j.where(~whole)
    key = ["mix", "source", "n_tokens", "b"]
    upto = Window.partitionBy("mix", "source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = part.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))).drop("m")
    part = part.join(buckets, key).withColumn("left", F.col("extra") - F.col("before"))
    ranked = part.where("left > 0").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id")))
    taken = ranked.withColumn("copies", F.col("passes") + (F.col("r") <= F.col("left")).cast("bigint"))
    rest = part.where("left <= 0").withColumn("copies", F.col("passes"))
    out = ["mix", "source", "doc_id", "n_tokens", "copies"]
    return done.select(*out).unionByName(taken.select(*out)).unionByName(rest.select(*out)).where("copies > 0")


def shares(mixed: DataFrame, total: int, targets: DataFrame) -> DataFrame:
    """mix, source, target_share, budget, tokens, share, documents, most_copies, max_repeats: what mix() reached of the targets, one row
    a source of a mix; total: tokens of the whole corpus. A mix that used nothing has NULL shares."""
    used = mixed.groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies"))
    out = wanted(targets, total).join(used, ["mix", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    w = Window.partitionBy("mix")
    return out.select("mix", "source", "target_share", "budget", "tokens", F.try_divide(F.col("tokens"), F.sum("tokens").over(w)).alias("share"), "documents", "most_copies", "max_repeats")
