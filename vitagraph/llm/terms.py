"""Frequency of every distinct value, term or n-gram and of its records.

Method: the suffixes of all token sequences, cut at ``max_n`` tokens, form a
suffix array that is range-partitioned by (suffix, record), so that a hot suffix
is divided among tasks. Neighbours' common prefixes give the intervals of every
n-gram; its occurrences are the interval's length, its records that length less
the duplicate adjacencies within records. Intervals cut by the edge of a batch
are handed on record by record, so the counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagraph.sources.tables import checkpointed

_SEP = "\u0001"


def _intervals(part: pd.DataFrame, max_n: int) -> pd.DataFrame:
    """Counts of one batch of the suffix array, in its order."""
    size = len(part)
    group, record = part["g"].to_numpy(object), pd.factorize(part["r"])[0]
    cut = [s.split(_SEP) for s in part["suffix"]] if max_n > 1 else [[s] for s in part["suffix"]]
    length = np.fromiter(map(len, cut), np.int64, size)
    common = np.zeros(size, np.int64)
    # neighbours' common prefixes, token by token for the rows that still agree
    code = pd.factorize(np.fromiter((t for c in cut for t in c), object, int(length.sum())))[0]
    start = np.cumsum(length) - length
    alike = 1 + np.flatnonzero(group[1:] == group[:-1])
    for k in range(int(length.max(initial=0))):
        alike = alike[(length[alike] > k) & (length[alike - 1] > k)]
        alike = alike[code[start[alike] + k] == code[start[alike - 1] + k]]
        if not len(alike):
            break
        common[alike] = k + 1
    out = []
    for n in range(1, max_n + 1):
        run = np.cumsum(common < n) - 1
        ok = length >= n
        if not ok.any():
            break
        first = np.flatnonzero(common < n)
        rows = np.flatnonzero(ok)
        rows = rows[np.lexsort((record[rows], run[rows]))]
        r, c = run[rows], record[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        occurrences = np.bincount(r, minlength=len(first))
        repeats = np.bincount(r[~new], minlength=len(first))
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        inner = np.flatnonzero((occurrences > 0) & ~edge)
        head = first[inner]
        out.append(
            pd.DataFrame(
                {
                    "g": group[head],
                    "ngram": [_SEP.join(cut[i][:n]) for i in head],
                    "n": n,
                    "record": None,
                    "occurrences": occurrences[inner],
                    "records": occurrences[inner] - repeats[inner],
                }
            )
        )
        at = np.flatnonzero(new & edge[r])
        if len(at):
            until = np.append(np.flatnonzero(new)[1:], len(rows))
            many = (until - np.flatnonzero(new))[edge[r[new]]]
            head = first[r[at]]
            out.append(
                pd.DataFrame(
                    {
                        "g": group[head],
                        "ngram": [_SEP.join(cut[i][:n]) for i in head],
                        "n": n,
                        "record": part["r"].to_numpy(object)[rows[at]],
                        "occurrences": many,
                        "records": 1,
                    }
                )
            )
    return pd.concat(out, ignore_index=True)


def ngram_counts(df: DataFrame, group: str, record: str, tokens: str, max_n: int = 1) -> DataFrame:
    """Occurrences and records of all n-grams of up to ``max_n`` tokens.

    df: ``group`` (counts are kept apart by it), ``record`` and ``tokens``
        (``array<string>``); a record may have several rows. Rows whose group or
        record is null, and null tokens, are not counted; empty arrays and an
        empty table give nothing. Extra columns are pruned.
    Result: group, ngram (tokens joined by a blank), n, occurrences, records.
    """
    kept = F.filter(F.col(tokens), lambda t: t.isNotNull())
    suffixes = (
        F.transform(kept, lambda t, i: F.array_join(F.slice(kept, i + 1, max_n), _SEP)) if max_n > 1 else kept
    )
    listed = df.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(group).alias("g"), F.col(record).cast("string").alias("r"), F.explode(suffixes).alias("suffix"))
    # written once: the ranges are sampled from it before it is sorted
    array = checkpointed(listed).repartitionByRange("g", "suffix", "r").sortWithinPartitions("g", "suffix", "r")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield _intervals(part, max_n)

    partial = array.mapInPandas(
        batches, "g string, ngram string, n int, record string, occurrences bigint, records bigint"
    )
    return (
        partial.groupBy("g", "ngram", "n", "record")
        .agg(F.sum("occurrences").alias("o"), F.sum("records").alias("c"))
        .groupBy("g", "ngram", "n")
        .agg(
            F.sum("o").alias("occurrences"),
            F.sum(F.when(F.col("record").isNull(), F.col("c")).otherwise(1)).alias("records"),
        )
        .select(F.col("g").alias(group), F.translate("ngram", _SEP, " ").alias("ngram"), "n", "occurrences", "records")
    )


def mark_terms(counts: DataFrame, totals: DataFrame, group: str, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare`` (in one record), ``common`` (in more than
    ``common_share`` of the ``all_records`` of its group), else null. ``totals``
    has one row for each group."""
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > common_share * F.col("all_records"), "common")
    return counts.join(totals, group).withColumn("mark", mark)
