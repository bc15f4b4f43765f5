"""Mixing sources to target weights by pivotal dependent rounding, in Spark expressions only.

Each row should be taken target / source size times: a whole number of times for sure, and once more with the
fractional rest as probability. Pairs of rows of one source exchange probability, weighted by size, until one of the
two is 0 or 1; the other goes on to the next pair. So the words taken stay the same throughout, and the one row that
is left of a whole source at the end is the only error. Rows are dealt into buckets by a hash; the rests of the buckets
are the rows of the next level, up to one bucket per source. Large rows are paired first, so what is left is small. All draws are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

#: Rows to a bucket on average, and the fixed pattern of a word.
BUCKET, WORD = 256, r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """(source, source_size, target) from (source, size). Sources by code point, null last, weigh as in weights, repeating.

    With caps in order of cap / weight, the common level of the sources below their cap is the largest of the levels
    that come of capping each first few. The windows run over one row per source.
    """
    by = F.array(*(F.lit(float(w)) for w in weights))
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("weight", F.element_at(by, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    total = total.withColumn("level", level)
    return total.select("source", "source_size", F.least("most", F.max("level").over(whole) * F.col("weight")).alias("target"))


def _fold(items: str) -> str:
    """SQL that pairs the items (id, w, p) of an array one after the other: (id, w, p) of what is left, and the ids taken."""
    gain, lose = "least(s.w * (1 - s.p), x.w * x.p)", "least(s.w * s.p, x.w * (1 - x.p))"
    draw = "(pmod(xxhash64(s.id, x.id, s.w, x.w), 9007199254740992) / 9007199254740992D)"
    up = f"({draw} * ({gain} + {lose}) < {lose})"
    ends = f"(CASE WHEN {up} THEN s.w * (1 - s.p) <= x.w * x.p ELSE s.w * s.p <= x.w * (1 - x.p) END)"
    state = "named_struct('id', {}, 'w', {}, 'p', {}, 'took', {})"
    none = "cast(array() as array<struct<id:bigint,w:double>>)"
    as_x = "x.p + (CASE WHEN {} THEN - s.w * (1 - s.p) ELSE s.w * s.p END) / x.w".format(up)
    as_s = "s.p + (CASE WHEN {} THEN x.w * x.p ELSE - x.w * (1 - x.p) END) / s.w".format(up)
    s_took = "concat(s.took, array(named_struct('id', s.id, 'w', s.w)))"
    x_took = "concat(s.took, array(named_struct('id', x.id, 'w', x.w)))"
    pair = (
        f"CASE WHEN s.w = 0 THEN {state.format('x.id', 'x.w', 'x.p', 's.took')} "
        f"WHEN {ends} THEN {state.format('x.id', 'x.w', as_x, f'CASE WHEN {up} THEN {s_took} ELSE s.took END')} "
        f"ELSE {state.format('s.id', 's.w', as_s, f'CASE WHEN {up} THEN s.took ELSE {x_took} END')} END"
    )
    return f"aggregate({items}, {state.format('cast(null as bigint)', '0D', '0D', none)}, (s, x) -> {pair})"


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) per row of docs: how often the mix takes the row, and its words.

    Sizes are in words; a null text has none. Rows that agree in doc_id, source and size are decided alike. A null
    source is a source, a null doc_id an id. Rows without words get no fractional copy. An empty table gives no rows.
    """
    sizes = store(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size")), "sizes")
    goals = store(targets(sizes, weights, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0.0)), "targets")
    part = F.col("rate") - F.floor("rate")
    items = sizes.filter("size > 0").groupBy("doc_id", "source", "size").count()
    rates = goals.withColumnRenamed("source", "of")
    items = items.join(rates.filter((part > 1e-9) & (part < 1 - 1e-9)), F.col("source").eqNullSafe(F.col("of"))).select("source", F.col("doc_id").alias("id"), (F.col("size") * F.col("count")).cast("double").alias("w"), part.alias("p"), "size")
    items = store(items, "items")
    keys = items.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("w").alias("weight"), F.col("size").alias("z"))
    taken, level = None, items.select("source", "id", "w", "p")
    while True:
        counts = level.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        dealt = level.join(counts, F.col("source").eqNullSafe(F.col("of"))).select("source", "id", "w", "p", F.pmod(F.xxhash64("id", "w", F.lit(most)), F.ceil(F.col("n") / BUCKET)).alias("bucket"))
        folded = dealt.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("first"), F.xxhash64("id", "w").alias("h"), "id", "w", "p"))).alias("items"))
        folded = store(folded.select("source", F.expr(_fold("items")).alias("r")), "folded")
        took = folded.select("source", F.inline("r.took"))
        taken = took if taken is None else taken.unionByName(took)
        level = folded.select("source", "r.id", "r.w", "r.p")
        if most <= 1:
            last = F.pmod(F.xxhash64("id", "w", F.lit("last")), F.lit(1 << 53)) / float(1 << 53)
            taken = taken.unionByName(level.filter(last < F.col("p")).select("source", "id", "w"))
            break
    rows = sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "rate")
    whole = F.when(part >= 1 - 1e-9, F.ceil("rate")).otherwise(F.floor("rate"))
    if taken is None:
        rows = rows.withColumn("more", F.lit(0))
    else:
        same = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("w") == F.col("weight"))
        more = taken.join(keys, same).select("s", "i", "z", F.lit(1).alias("more"))
        rows = rows.join(more, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")), "left")
    rows = rows.withColumn("copies", (whole + F.coalesce("more", F.lit(0))).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """The rows of docs, each as often as copies() says, with their columns; rows that it takes zero times go.

    Null sources and doc_ids count as values, rows without words (or with a null text) are taken as often as their
    source's whole copies say, repeated rows each alike. An empty table gives an empty one. Columns may have any names but
    __i, __s, __z, __n, __size and __copy.
    """
    often = copies(docs, weights=weights, cap=cap).filter("copies > 0").select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__n")).distinct()
    names = docs.columns
    rows = docs.withColumn("__size", word_count(F.col("text").cast("string")))
    rows = rows.join(often, F.col("doc_id").cast("long").eqNullSafe(F.col("__i")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*(F.col(f"`{c}`") for c in names))
