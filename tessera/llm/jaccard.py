"""N-gram Jaccard self-join of texts through prefix trees.

Every text becomes the set of its word n-grams, as 64-bit values; equal sets are one node all along. Sets of sizes
a <= b that link have at least o = percent * (a + b) / (100 + percent) values in common, so each misses few of the
other's. From that follow three exact filters, each over less than the one before:

1. Of a set's smallest values (a bottom sketch, as long as the values it may miss and SPARE more), linked sets share
   a sure number. A set with fewer values that any other set shows has no partner and is left out. This is the only
   pass over all sets.
2. The sets left are counted whole: each value by the sets that hold it. The global order of values is rarest first;
   in it, the first value two linked sets have in common lies within the first that either may miss. These prefixes
   are the top of the prefix tree: sets meet in the shard of a value, under bounds by sizes, remaining lengths and
   the number of values that any other set holds, too.
3. What meets is searched in tries of the whole sets (trie.py): first each set with the best connected set it meets,
   which joins groups of copies at linear cost, then whatever meets within the bounds and isn't connected yet.

Nothing is capped: each pair that can be similar is compared or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .filters import bit_filter, passes
from .graph import components
from .scratch import forget, ship, store
from .trie import Trie

#: One value to spare in the bottom sketches for so many that a set may miss. The more, the longer the sketches and the fewer sets pass that share passages only.
SPARE = 2


def ngram_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The ascending distinct k-word n-grams of each text, A-Z as a-z; of fewer words, all as one; of none, empty."""
    buf = K.LOWER[buf]
    starts, ends = K.word_bounds(buf, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = K.hashes(buf, starts, ends)
    grams, at = K.windows(words, text, k, 4)
    bounds = np.searchsorted(text[at], np.arange(len(offsets)))
    first = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        s = grams[bounds[i] : bounds[i + 1]]
        n = first[i + 1] - first[i]
        if 0 < n < k:
            s = K.mix(np.array([(words[first[i] : first[i + 1]] * K.seeds(k, 4)[:n]).sum()], np.uint64) + np.uint64(n))
        elif len(s):
            s = np.sort(s)
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
    return out


def _ceil(x, y):
    return -(-x // y)


def sketch_bounds(n: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """By the size of a set: the values in its sketch, those in the part of it that meets larger sets, and the values shared with any linked set at least, where that is larger (in that part) and where it isn't.

    With m(n) the values that a set of n misses at most of a linked one that is smaller, e(n) of one that is larger and
    l(n) the spare ones, the first l(a) common values of sets of sizes a <= b lie in the first e(a) + l(a) of one and in
    the first m(b) + l(b) of the other, as l doesn't fall. Sets that can only link with equal ones have no sketch.
    """
    n = np.asarray(n, np.int64)

    def spare(size):
        least = _ceil(percent * size, 100)
        return np.maximum(1, np.minimum((size - least) // SPARE, least))

    least = _ceil(percent * n, 100)
    misses, small = n - least, n - _ceil(2 * percent * n, 100 + percent)
    whole, part = np.minimum(n, misses + spare(n)), np.minimum(n, small + spare(n))
    able = (misses > 0) | (100 * n // percent > n)
    return np.where(able, whole, 0), part, spare(n), spare(least)


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows, with the sets of their last column."""
    for batch in batches:
        buf, offsets = K.utf8(batch.column(batch.num_columns - 1))
        for i, j in K.runs(offsets):
            yield batch.slice(i, j - i), ngram_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def _node(s: np.ndarray) -> int:
    return int(K.mix(K.mix(s + np.uint64(11)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, text): row tells rows apart by these two columns."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, keys) per row of docs: node identifies the set and is null where that is empty, keys is its sketch."""

    def each(batches):
        for rows, sets in _texts(batches, k):
            size = np.array([len(s) for s in sets], np.int64)
            keys = [s[:n] for s, n in zip(sets, sketch_bounds(size, percent)[0], strict=True)]
            node = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size), node, K.lists(flat, [len(s) for s in keys], pa.int64())], names=["doc_id", "row", "n_shingles", "node", "keys"])

    return _rows(docs, doc_id, text).mapInArrow(each, "doc_id long, row long, n_shingles long, node long, keys array<long>")


def _alive(sigs: DataFrame, percent: int) -> DataFrame:
    """(node): the sets of which enough values of the sketch are in the sketches of others."""
    spark = sigs.sparkSession
    each_key = sigs.select(F.explode("keys").alias("key"), "node")
    several = store(each_key.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key"), "keys")
    bits = spark.sparkContext.broadcast(bit_filter(several, "key"))

    def each(batches):
        for batch in batches:
            n, keys = batch.column(1).to_numpy(), batch.column(2)
            size = keys.value_lengths().to_numpy(zero_copy_only=False)
            flat = keys.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            _, part, small, large = sketch_bounds(n, percent)
            hit = passes(bits.value, flat)
            low = hit & (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) < part[row])
            all_hits, low_hits = np.bincount(row[hit], minlength=len(size)), np.bincount(row[low], minlength=len(size))
            good = (all_hits >= large) | (low_hits >= small)
            hit &= good[row]
            columns = [batch.column(0), pa.array(np.where(low_hits >= small, small, 1 << 62)), pa.array(large), pa.array(low_hits, pa.int32()), K.lists(flat[hit], np.where(good, all_hits, 0), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "small", "large", "low", "keys"]).filter(pa.array(good))

    likely = sigs.filter("node is not null and size(keys) > 0").select("node", "n_shingles", "keys").mapInArrow(each, "node long, small long, large long, low int, keys array<long>").dropDuplicates(["node"])
    rows = likely.select("node", "small", "large", "low", F.posexplode("keys").alias("pos", "key")).join(several, "key", "left_semi")
    counted = rows.groupBy("node").agg(F.max("small").alias("small"), F.max("large").alias("large"), F.count("*").alias("n"), F.count_if(F.col("pos") < F.col("low")).alias("n_low"))
    out = store(counted.filter("n >= large or n_low >= small").select("node"), "alive")
    forget(several)
    return out


def _whole_sets(docs: DataFrame, doc_id: str, text: str, k: int, sigs: DataFrame, alive: DataFrame) -> DataFrame:
    """(node, n, grams): the whole sets of the nodes of alive, made again from one row of each."""
    rep = store(sigs.join(alive, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "reps")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(rep, "row"))

    def each(batches):
        picked = (batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy()))) for batch in batches)
        for _, sets in _texts(picked, k):
            sets = [s for s in sets if len(s)]
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array(size, pa.int64()), K.lists(flat, size, pa.int64())], names=["node", "n", "grams"])

    found = _rows(docs, doc_id, text).select("row", "text").mapInArrow(each, "node long, n long, grams array<long>").dropDuplicates(["node"])
    out = store(found.join(rep.select("node"), "node", "left_semi"), "sets")
    forget(rep)
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, shared, rank): the places of each set among the first values, rarest first, one of which it has in common with any linked set.

    shared counts the values of the set that another one holds; rank is the place among all its values, from 0.
    """
    grams = sets.select(F.explode("grams").alias("gram"), "node", "n")
    several = store(grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "grams")
    rows = grams.join(several, "gram")
    own = Window.partitionBy("node")  # as many rows as the text has n-grams
    rows = rows.withColumn("shared", F.count("*").over(own)).withColumn("rank", F.col("n") - F.col("shared") + F.row_number().over(own.orderBy("df", "gram")) - 1)
    least = F.expr(f"({percent} * n + 99) div 100")
    out = store(rows.filter((F.col("shared") >= least) & (F.col("rank") <= F.col("n") - least)).select("gram", "node", "n", "shared", "rank"), "prefixes")
    forget(several)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): those pairs that are similar. The sets that meet one probe a lie in one trie, as far as they come in one batch."""
    probes = sets.select(F.col("node").alias("a"), F.col("grams").alias("probe"))
    rows = pairs.join(sets.select(F.col("node").alias("b"), "grams"), "b").join(probes, "a").select("a", "probe", "b", "grams")

    def values(column: pa.ListArray) -> list[np.ndarray]:
        at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def each(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            probe, grams = values(batch.column(1)), values(batch.column(3))
            cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            found = [i + x for i, j in zip(cuts, cuts[1:], strict=False) if i < j for x in Trie(grams[i:j]).search(probe[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array(a[found], pa.int64()), pa.array(b[found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def _star_pairs(prefixes: DataFrame) -> DataFrame:
    """(a, b): each node b with the hub a that it meets most often. The hub of a value is its set with the largest share of values that others hold."""
    hubs = prefixes.groupBy("gram").agg(F.max_by("node", F.col("shared") / F.col("n")).alias("a"))
    met = prefixes.join(hubs, "gram").filter("node <> a").groupBy("node", "a").agg(F.count("*").alias("times"))
    return met.groupBy(F.col("node").alias("b")).agg(F.max_by("a", "times").alias("a")).select("a", "b")


def _open_pairs(prefixes: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of sets, a the smaller, that meet within the bounds and that comp doesn't connect."""
    labelled = prefixes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = labelled.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("gram")
    left = store(labelled.join(split, "gram", "left_semi"), "open")
    small = left.filter(f"rank <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent}")
    least = F.expr(f"({percent} * (s.n + t.n) + {99 + percent}) div {100 + percent}")
    within = (least <= F.least("s.shared", "t.shared")) & (F.col("s.rank") <= F.col("s.n") - least) & (F.col("t.rank") <= F.col("t.n") - least)
    first = F.expr("s.n < t.n or s.n = t.n and s.node < t.node")
    met = small.alias("s").join(left.alias("t"), (F.col("s.gram") == F.col("t.gram")) & F.expr("s.comp <> t.comp") & first & within)
    return met.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct()


def similar_sets(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, node) per row of docs, and (node, comp) of the nodes that link with another."""
    ship(docs.sparkSession)
    keyed = store(signatures(docs, doc_id, text, k, percent), "signatures")
    sigs = store(keyed.drop("keys"), "nodes")
    alive = _alive(keyed, percent)
    forget(keyed)
    sets = _whole_sets(docs, doc_id, text, k, sigs, alive)
    prefixes = _prefixes(sets, percent)
    star = store(_verified(_star_pairs(prefixes), sets, percent), "links")
    comp = components(star, "a", "b")
    rest = store(_verified(store(_open_pairs(prefixes, comp, percent), "pairs"), sets, percent), "links")
    comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(rest), "a", "b")
    for table in (alive, sets, prefixes, star, rest):
        forget(table)
    return sigs, comp


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    Two texts link when 100 * intersection >= percent * union of their sets of k-word n-grams; component_id is the
    smallest doc_id that links reach. A text without words, or null, links with nothing and is its own component.
    A row with a null doc_id links like any other; a component of only such rows has no number (null). Repeated rows and
    ties are in one component. Other columns, whatever their names, are left alone. An empty table gives no rows.
    Sets are told apart by 64-bit hashes: about n * n / 2**65 false equalities are expected among n n-grams or sets.
    """
    sigs, comp = similar_sets(docs, doc_id, text, k, percent)
    rows = sigs.join(comp, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    # stored, so that the join below is one of two plain exchanges, of which Spark can split the large partitions
    least = store(rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id (null comes last), with its columns.

    Rows without words, or with a null text, are in no component and all stay. Of rows with the same doc_id and text one
    stays, whatever their other columns. An empty table gives an empty one. A column named __row would be dropped.
    """
    sigs, comp = similar_sets(docs, "doc_id", "text", k, percent)
    rows = sigs.filter("node is not null").join(comp, "node", "left").select(F.coalesce("comp", "node").alias("comp"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("first"))
    kept = rows.groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")).distinct()
    names, worded = docs.columns, F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    ours = docs.filter(worded).withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    ours = ours.join(store(kept, "kept"), "__row", "left_semi").dropDuplicates(["__row"])
    return ours.select(*(F.col(f"`{c}`") for c in names)).unionByName(docs.filter(~worded))
