"""Repetition inside a document: the exact share of repeated substrings, and n-gram perplexity under a Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.hashing import code_points, window_hashes
from lintlake.session import partitions, shared_table, spread

#: Length of the substrings, and of the shortest normalised text that has a share at all.
SPAN, SHORTEST = 20, 200
#: Words of running text for a bucket of the language model, so that a bucket's trigrams and their occurrences fit a task.
BUCKET_WORDS = 1 << 21


def repeated_share(text: str | None, span: int = SPAN, shortest: int = SHORTEST) -> float:
    """1 - d/n over the substrings of the normalised text, d of n being distinct: counted in the sorted array of their hashes."""
    if not text:
        return 0.0
    text = regex.sub("[ \t\r\n]+", " ", text).strip(" ").lower()
    if len(text) < shortest:
        return 0.0
    hashes = np.sort(window_hashes(code_points(text), span))
    return float(1 - (1 + np.count_nonzero(hashes[1:] != hashes[:-1])) / len(hashes))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shares = [repeated_share(t) for t in batch.column("text__").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shares, pa.float64())], ["doc_id", "repeated_share"])


def repeated_shares(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """doc_id and repeated_share of every row, repeated rows too.

    Runs of space, tab, CR and LF become one space, outer spaces go, letters become lower case. Null, empty and white texts and those
    then shorter than 200 characters have the share 0. A text of any length is measured whole, in its own row; nothing is shuffled.
    """
    rows = spread(df.select(key.alias("doc_id"), text.alias("text__")))
    return rows.mapInArrow(_shares, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, repeated_share double")


# The language model: trigrams of words, single characters for scripts without spaces.

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W\p{Han}\p{Hiragana}\p{Katakana}]+|[^\w\s]")
_START, _END = 1, 2


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        lists = []
        for text in batch.column("text__").to_pylist():
            words = _WORD.findall(text.lower()) if text else []
            if not words:
                lists.append([])
                continue
            if len(known) > 1 << 18:
                known = {}
            ids = [_START, _START]
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                ids.append(i)
            lists.append([*ids, _END])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "lang", "words"])


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4 of ``c``."""
    n = dict(counts.where("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, by: list[str], d: list[float]) -> DataFrame:
    """Per context: the sum of counts and the probability mass that its discounts leave to the lower order."""
    out = counts.groupBy(*by).agg(F.sum("c").alias("total"), F.sum(_discount(d)).alias("left"))
    return out.select(*by, "total", (F.col("left") / F.col("total")).alias("left"))


def kneser_ney(words: DataFrame) -> DataFrame:
    """gram (hash of a trigram) and logp of every trigram of the column ``words`` (array of long).

    Modified Kneser-Ney: three discounts an order, lower orders from continuation counts, the lowest mixed with the uniform
    distribution over the vocabulary. All counts run over all documents as Spark aggregations with map-side combination.
    """
    grams = words.where("size(words) > 2").select(F.explode(F.expr("transform(sequence(0, size(words) - 3), i -> struct(words[i] as a, words[i + 1] as b, words[i + 2] as w))")).alias("g")).select("g.*")
    three = shared_table(grams.groupBy("a", "b", "w").agg(F.count("*").alias("c")), "grams3")
    two = shared_table(three.groupBy("b", "w").agg(F.count("*").alias("c")), "grams2")
    one = two.groupBy("w").agg(F.count("*").alias("c"))
    d3, d2, d1 = _discounts(three), _discounts(two), _discounts(one)
    whole = one.agg(F.sum("c").alias("total"), F.sum(_discount(d1)).alias("left"), F.count("*").alias("size")).first()
    total, left, size = whole["total"] or 1, whole["left"] or 0.0, whole["size"] or 1
    p1 = one.select("w", ((F.col("c") - _discount(d1)) / F.lit(total) + F.lit(left / total / size)).alias("p1"))
    p2 = two.join(_contexts(two, ["b"], d2), "b").join(p1, "w")
    p2 = p2.select("b", "w", ((F.col("c") - _discount(d2)) / F.col("total") + F.col("left") * F.col("p1")).alias("p2"))
    p3 = three.join(_contexts(three, ["a", "b"], d3), ["a", "b"]).join(p2, ["b", "w"])
    p3 = p3.select(F.xxhash64("a", "b", "w").alias("gram"), ((F.col("c") - _discount(d3)) / F.col("total") + F.col("left") * F.col("p2")).alias("p"), "c")
    return p3.select("gram", F.log("p").cast("float").alias("logp"), "c")


def _sorted_arrays(table: pa.Table) -> pa.Table:
    grams, logp = table.column("gram").to_numpy(), table.column("logp").to_numpy()
    at = np.argsort(grams)
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "grams": pa.array([grams[at].tobytes()], pa.binary()), "logps": pa.array([logp[at].tobytes()], pa.binary())})


def _score(model: pa.Table, occurrences: pa.Table) -> pa.Table:
    if not occurrences.num_rows or not model.num_rows:
        return pa.table({"doc_id": occurrences.column("doc_id").slice(0, 0), "logp": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
    row = model.slice(0, 1).to_pylist()[0]
    grams, logps = np.frombuffer(row["grams"], np.int64), np.frombuffer(row["logps"], np.float32)
    found = logps[np.searchsorted(grams, occurrences.column("gram").to_numpy())].astype(np.float64)
    part = pa.table({"doc_id": occurrences.column("doc_id"), "logp": found, "n": np.ones(len(found), np.int64)})
    summed = part.group_by("doc_id").aggregate([("logp", "sum"), ("n", "sum")])
    return summed.rename_columns(["doc_id", "logp", "n"])


def perplexities(df: DataFrame, key: Column, lang: Column, text: Column) -> DataFrame:
    """doc_id, lang (lower case, null as 'unknown'), n_words (end mark included) and perplexity of every row whose text has a word.

    ``key`` must be unique. The model is spread over hash buckets, each a pair of arrays sorted by the trigrams' hashes; the trigrams of
    the documents come to their bucket and are found by binary search. A bucket that one frequent trigram makes heavy
    is read by several tasks, each with a share of the documents and a copy of its arrays.
    """
    spark = df.sparkSession
    rows = df.select(key.alias("doc_id"), F.coalesce(F.lower(F.trim(lang)), F.lit("unknown")).alias("lang"), text.alias("text__"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = shared_table(spread(rows).mapInArrow(_words, f"doc_id {kind}, lang string, words array<long>"), "words")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    n_buckets = max(4 * partitions(spark), -(-total // BUCKET_WORDS))
    bucket = F.pmod("gram", F.lit(n_buckets)).cast("int")
    model = shared_table(kneser_ney(words).withColumn("bucket", bucket), "model")
    load = {r[0]: r[1] for r in model.groupBy("bucket").agg(F.sum("c").alias("n")).collect()}
    fair = max(1, sum(load.values()) // max(1, len(load)))
    salts = F.broadcast(spark.createDataFrame([(b, max(1, round(n / fair))) for b, n in load.items()], "bucket int, salts int"))
    arrays = model.select("bucket", "gram", "logp").groupBy("bucket").applyInArrow(_sorted_arrays, "bucket int, grams binary, logps binary")
    arrays = arrays.join(salts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    grams = words.where("size(words) > 2").select("doc_id", F.explode(F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")).alias("gram"))
    grams = grams.withColumn("bucket", bucket).join(salts, "bucket").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).drop("salts")
    scored = arrays.groupBy("bucket", "salt").cogroup(grams.groupBy("bucket", "salt")).applyInArrow(_score, f"doc_id {kind}, logp double, n long")
    scored = scored.groupBy("doc_id").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n_words"))
    return scored.join(words.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "n_words", F.exp(-F.col("logp") / F.col("n_words")).alias("perplexity"))


def perplexity_bands(scored: DataFrame, low: float = 0.05, high: float = 0.98) -> DataFrame:
    """The result of perplexities with ``rejected``: 'low' or 'high' outside the band of the language's own quantiles, else 'kept'."""
    bands = scored.groupBy("lang").agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("band"))
    out = scored.join(F.broadcast(bands), "lang")
    band = F.when(F.col("perplexity") < F.col("band")[0], "low").when(F.col("perplexity") > F.col("band")[1], "high").otherwise("kept")
    return out.withColumn("rejected", band).drop("band")


