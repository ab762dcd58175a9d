"""The star graph over a stream of sentences.

Each sentence is matched and related on its own, so the map is stateless and can run
on micro-batches; nodes are deduplicated by id within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagraph.operators import graph as G
from vitagraph.operators.matching import LONGEST_FIRST, match_terms


def stream_edges(sentences: DataFrame, terms: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands the star edges of each micro-batch to ``sink``.

    sentences: a streaming frame with ``case_id``, ``sent_no``, ``sentence``. A batch
    that is run again after a failure has the same id, so an idempotent sink keeps
    the result exact. ``checkpoint`` is a folder that all executors share.
    """
    def each(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["case_id", "sent_no"])
        sink(G.star_edges(once, terms), number)

    return sentences.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def first_nodes(nodes: DataFrame, when: str, delay: str = "1 hour") -> DataFrame:
    """Stream of nodes, each id once within the watermark."""
    return nodes.withWatermark(when, delay).dropDuplicatesWithinWatermark(["node_id"])


def windowed_mentions(mentions: DataFrame, when: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Mentions per type in tumbling windows, late rows within ``delay`` counted."""
    return mentions.withWatermark(when, delay).groupBy(F.window(when, window), "type").agg(F.count("*").alias("n"))


def batch_spans(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """The batch form of the matching step, for comparison."""
    return match_terms(sentences, ["case_id", "sent_no"], "sentence", terms, LONGEST_FIRST)
