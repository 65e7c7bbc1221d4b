"""Mixing sources to target shares of all tokens.

Each source's budget is filled with complete epochs first.  What remains is a
weighted sample without replacement after Efraimidis and Spirakis: every
document gets an exponential key whose rate is its quality, documents are
sorted by it within their source, and the prefix sums of their tokens are cut
at the budget.  Keys come from a hash, so a repeated run draws the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomloom.llm.tokens import TOKENIZER_FILE, sized
from bomloom.runtime import materialize

_RUN = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each document in its partition and source; only one sum is held."""
    part, source, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sources, tokens = batch.column("source").to_pylist(), batch.column("n_tokens").to_numpy()
        before = np.empty(n, dtype=np.int64)
        at = 0
        while at < n:
            stop = at
            while stop < n and sources[stop] == sources[at]:
                stop += 1
            if sources[at] != source:
                source, total = sources[at], 0
            sums = total + np.cumsum(tokens[at:stop])
            before[at:stop] = sums - tokens[at:stop]
            total, at = int(sums[-1]), stop
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("n_tokens"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(before)], schema=_RUN)


def prefix_sums(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, n_tokens, key) with ``before``: the tokens of its source with smaller keys.

    Range partitions on (source, key) are sorted and summed on their own; the
    sums of the partitions before are added afterwards, so that no source has to
    pass through one task.
    """
    ranged = docs.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    local = materialize(ranged.select("doc_id", "source", "n_tokens").mapInArrow(_running, "doc_id bigint, source string, n_tokens bigint, part int, before bigint"), "prefix-sums")
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition and source
    sums = local.groupBy("source", "part").agg(F.sum("n_tokens").alias("own")).select("source", "part", F.coalesce(F.sum("own").over(w), F.lit(0)).alias("earlier"))
    return local.join(F.broadcast(sums), ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.col("earlier")).alias("before"))


def _plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row a source: stock, budget, complete epochs and the rest to be drawn."""
    stock = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("stock"))
    plan = targets.where("source is not null").join(stock, "source", "left").fillna(0, ["docs", "stock"])
    plan = plan.withColumn("cap", F.col("stock") * F.col("max_repeats"))
    if total_tokens is None:
        # the largest total at which every source that has documents reaches its share
        total = F.min(F.when((F.col("cap") > 0) & (F.col("target_share") > 0), F.col("cap") / F.col("target_share"))).over(Window.partitionBy())
    else:
        total = F.lit(float(total_tokens))
    plan = plan.withColumn("wanted", F.floor(F.coalesce(total, F.lit(0.0)) * F.col("target_share") + 1e-6))
    plan = plan.withColumn("budget", F.least("wanted", "cap"))
    plan = plan.withColumn("epochs", F.when(F.col("stock") > 0, F.floor(F.col("budget") / F.col("stock"))).otherwise(0).cast("int"))
    return plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("stock"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER_FILE) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the shares.

    First frame: ``doc_id, source, repeats, n_tokens``, a row for each document
    drawn at least once.  Second frame: a row for each target ``source,
    target_share, actual_share, wanted_tokens, drawn_tokens, short_tokens,
    docs_drawn, most_repeats``; sources without documents are there with zero.

    * Copies of one text in a source are one document, drawn under its smallest
      id, so that no text is used more than ``max_repeats`` times.
    * Without ``total_tokens`` the total is the largest at which every source
      that has documents reaches its share; a larger total makes sources fall
      short, which is reported.  The document that crosses the budget is drawn
      if at least half of it fits, so a share is off by half a document at most.
    * Documents without source or target aren't drawn; empty texts have no
      tokens and are drawn with their epochs; an empty table draws nothing.
    """
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    docs = sized(documents.where("source is not null"), tokenizer)
    docs = docs.groupBy("source", "copy1", "copy2").agg(F.min_by(F.struct("doc_id", "n_tokens", "quality"), "doc_id").alias("d")).select("source", "d.*")
    docs = materialize(docs.join(F.broadcast(wanted.select("source")), "source", "left_semi"), "sized")
    plan = materialize(_plan(docs, wanted, total_tokens), "mix-plan")
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << 53) - 1) + 0.5) / float(1 << 53)
    keyed = docs.select("doc_id", "source", "n_tokens", (-F.ln(u) / F.col("quality")).alias("key"))
    summed = prefix_sums(keyed).join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    repeats = F.col("epochs") + F.when((F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("n_tokens") > 0), 1).otherwise(0)
    drawn = materialize(summed.withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("doc_id", "source", "repeats", "n_tokens"), "drawn")
    sums = drawn.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("drawn_tokens"), F.count("*").alias("docs_drawn"), F.max("repeats").alias("most_repeats"))
    shares = plan.join(sums, "source", "left").fillna(0, ["drawn_tokens", "docs_drawn", "most_repeats"])
    everything = F.sum("drawn_tokens").over(Window.partitionBy())
    shares = shares.select(
        "source", "target_share", F.coalesce(F.try_divide("drawn_tokens", everything), F.lit(0.0)).alias("actual_share"), F.col("wanted").cast("bigint").alias("wanted_tokens"), "drawn_tokens",
        (F.col("wanted") - F.col("drawn_tokens")).cast("bigint").alias("short_tokens"), "docs_drawn", "most_repeats",
    )
    return drawn, shares
