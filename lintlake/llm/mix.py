"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.encode import TOKENIZERS, WORDS
from lintlake.llm.running import running_sum
from lintlake.session import shared_table, spread

#: A list of sources is written by hand; beyond this it is no such list.
MOST_SOURCES = 100_000


def source_name(column: Column) -> Column:
    """One spelling for a source: lower case, outer spaces off, spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def _count(lines: bytes):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text__").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return split


def token_sizes(df: DataFrame, key: Column, source: Column, text: Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, source and n_tokens of every row; null and empty texts have 0 tokens."""
    with open(os.path.join(folder or TOKENIZERS, f"{tokenizer}.tiktoken"), "rb") as f:
        lines = f.read()
    rows = spread(df.select(key.alias("doc_id"), source.alias("source"), text.alias("text__")))
    return rows.mapInArrow(_count(lines), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, n_tokens long")


def weighted_mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """The mixed sequence: doc_id, source, copy (from 1), n_tokens, finish_time, position, total_tokens.

    sized: doc_id (unique), source, n_tokens, as token_sizes gives them. targets: source, target_share, max_repeats.
    Sources without documents or with a null or non-positive share or repeats take no part, their share is spread over the others in
    proportion; documents of unlisted or null sources and those without tokens are left out. Of a source listed twice the larger share holds.

    Each source's documents are shuffled anew for every pass over it (by a hash of seed, pass and doc_id), up to max_repeats
    passes. A document's virtual finish time is the source's running token count divided by its share; the sequence is
    sorted by it and cut where the budget is full. The default budget is the largest at which every source still
    reaches its share. With a larger one, sources that ran out of passes stay behind and the others fill the rest.
    """
    spark = sized.sparkSession
    targets = targets.where("target_share > 0 and not isnan(target_share) and max_repeats > 0")
    targets = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    targets = targets.where("source is not null").select("source", "t.target_share", "t.max_repeats")
    given = {r[0]: (r[1], r[2]) for r in targets.limit(MOST_SOURCES + 1).collect()}
    if len(given) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    schema = "source string, share double, passes int"
    sized = sized.withColumn("source", source_name(F.col("source"))).where("n_tokens > 0 and source is not null")
    listed = F.broadcast(spark.createDataFrame([(s, float(t), int(m)) for s, (t, m) in given.items()], schema))
    sized = shared_table(sized.join(listed, "source").drop("share", "passes"), "sized")
    held = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    whole = sum(given[s][0] for s in held) or 1.0
    share = {s: given[s][0] / whole for s in held}
    fair = int(min((given[s][1] * held[s] / share[s] for s in held), default=0))
    budget = fair if budget is None else budget
    # passes that a source can need before the budget is full: beyond the fair budget the others' parts are not known beforehand
    need = {s: given[s][1] if budget > fair else min(given[s][1], int(budget * share[s] / held[s]) + 1) for s in held}
    passes = F.broadcast(spark.createDataFrame([(s, share[s], need[s]) for s in held], schema))
    queued = sized.join(passes, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes")))).drop("passes")
    queued = queued.withColumn("shuffled", F.xxhash64(F.lit(seed), "copy", "doc_id"))
    queued = running_sum(queued, ["copy", "shuffled", "doc_id"], {"n_tokens": "source_tokens"}, group="source")
    queued = queued.withColumn("finish_time", F.col("source_tokens") / F.col("share")).withColumn("one", F.lit(1).cast("long"))
    order = ["finish_time", "source", "copy", "shuffled", "doc_id"]
    # what fits is a beginning of the order, so positions before the cut are those after it
    mixed = running_sum(queued, order, {"n_tokens": "total_tokens", "one": "position"}).where(F.col("total_tokens") <= budget)
    return mixed.select("doc_id", "source", "copy", "n_tokens", "finish_time", "position", "total_tokens")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, n_tokens, n_documents, n_uses, most_uses and the actual_share of the mixed sequence.

    Sources of which nothing was taken have zeros; if nothing was taken at all, actual_share is 0.
    """
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("uses"))
    per_source = per_doc.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    listed = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share")).where("source is not null")
    out = listed.join(per_source, "source", "left").na.fill(0, ["n_tokens", "n_documents", "n_uses", "most_uses"])
    total = out.agg(F.sum("n_tokens").alias("t")).first()["t"] or 1
    return out.withColumn("actual_share", F.col("n_tokens") / F.lit(total))
