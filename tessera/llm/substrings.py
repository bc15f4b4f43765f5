"""Substring deduplication by hashing sentences and lines.

Units are cut at newlines and after sentence ends, A-Z count as a-z and white space doesn't count. Digests are grouped
globally; the occurrence with the smallest (doc_id, start) stays and all others go, adjacent ones as one span. A greater
run than RUN keeps those in spans of fewer words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .filters import bit_filter, passes
from .scratch import forget, ship, store

#: Words of a run of repeated units from which it is removed: any.
RUN = 1
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each unit with a word: text, number within the text, byte start and end, words, digest."""
    low = K.LOWER[buf]
    starts, ends = K.word_bounds(low, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    n = len(starts)
    if not n:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    lines = np.concatenate([[0], np.cumsum(low == 10)])
    first = np.ones(n, bool)
    first[1:] = (text[1:] != text[:-1]) | _END[low[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    at = np.flatnonzero(first)
    last = np.append(at[1:], n) - 1
    size = last - at + 1
    words = K.hashes(low, starts, ends)
    position = np.arange(n) - np.repeat(at, size)
    digest = K.mix(np.add.reduceat(K.mix(words + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at) + size.astype(np.uint64))
    of = text[at]
    number = np.arange(len(at)) - np.searchsorted(of, of)
    return of, number, starts[at], ends[last], size, digest


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    for batch in batches:
        whole, offsets = K.utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in K.runs(offsets):
            buf, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield ids[i:j], buf, at, units(buf, at)


def _runs_of(of: np.ndarray, number: np.ndarray, words: np.ndarray, hit: np.ndarray, least: int) -> np.ndarray:
    """The units of hit that lie in runs with so many words."""
    k = np.flatnonzero(hit)
    if not len(k):
        return k
    cut = np.ones(len(k), bool)
    cut[1:] = (of[k[1:]] != of[k[:-1]]) | (number[k[1:]] != number[k[:-1]] + 1)
    at = np.flatnonzero(cut)
    total = np.add.reduceat(words[k], at)
    return k[np.repeat(total >= least, np.diff(np.append(at, len(k))))]


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, start, end, n_units, n_words) of each run to be removed; code points, end exclusive."""
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")

    def digests(batches):
        for ids, _, _, (of, number, *_, digest) in _each_run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[of].astype(np.int64)), pa.array(number.astype(np.int32))], names=["digest", "doc_id", "number"])

    found = picked.mapInArrow(digests, "digest long, doc_id long, number int")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_doc")
    first = store(first, "digests")
    bits = spark.sparkContext.broadcast(bit_filter(first, "digest"))

    def likely(batches):
        for ids, buf, at, (of, number, starts, ends, words, digest) in _each_run(batches):
            digest = digest.view(np.int64)
            k = _runs_of(of, number, words, passes(bits.value, digest), run)
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            base = points[at[of[k]]]
            columns = [ids[of[k]].astype(np.int64), number[k].astype(np.int32), points[starts[k]] - base, points[ends[k]] - base, words[k], digest[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "number", "start", "end", "n_words", "digest"])

    later = picked.mapInArrow(likely, "doc_id long, number int, start long, end long, n_words long, digest long").join(first, "digest").repartition("doc_id")  # dealt by document here, so that Spark may split a digest that many have
    own = Window.partitionBy("doc_id", "digest").orderBy("number")
    order = Window.partitionBy("doc_id").orderBy("number")
    later = later.withColumn("nth", F.dense_rank().over(own)).filter((F.col("doc_id") != F.col("first_doc")) | (F.col("nth") > 1))
    later = later.withColumn("again", F.coalesce(F.lag("number").over(order) == F.col("number"), F.lit(False))).filter("NOT again")
    island = F.col("number") - F.row_number().over(order)
    spans = later.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"))
    out = store(spans.filter(F.col("n_words") >= run).drop("island"), "spans")
    forget(first)
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """docs with the text without repeated units, removed: the array of (start, end) in the original text, and repeated: the array of (start, end, n_words) of all runs of later occurrences.

    What is removed are the runs of repeated with at least run words; with run 1, all. doc_id names a document: rows that
    share one share their spans. A null doc_id takes no part; null and empty texts have no units and stay. A document that
    only repeats earlier ones keeps an empty text. Columns named removed or repeated are replaced; an empty table gives none.
    """
    spans = repeated_spans(docs, doc_id, text).groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "n_words"))).alias("repeated")).hint("merge")  # one plan at every size

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, some in enumerate(removed.to_pylist()):
            if some and out[i] is not None:
                edges = [0, *(x for s in some for x in (s["start"], s["end"])), len(out[i])]
                out[i] = "".join(out[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return pa.array(out, pa.string())

    names = [c for c in docs.columns if c not in ("removed", "repeated")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names)).join(spans, F.col(doc_id).cast("long") == F.col("__id"), "left")
    rows = rows.withColumn("repeated", F.coalesce("repeated", F.array().cast("array<struct<start:long,end:long,n_words:long>>")))
    rows = rows.withColumn("removed", F.transform(F.filter("repeated", lambda s: s["n_words"] >= run), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    short = F.when(F.size("removed") == 0, F.col(text)).otherwise(cut(F.col(text).cast("string"), F.col("removed")))
    return rows.select(*((short.alias(c) if c == text else F.col(f"`{c}`")) for c in names), "removed", "repeated")
