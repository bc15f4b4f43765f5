"""Quality rules: fixed base rules, and boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .boost import Boosted, fit
from .scratch import ship

#: Fixed values of the base rules.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 50, 50
#: Labelled rows to fit on at most, those of the smallest hashes of doc_id; and the score below which a text goes.
LABELLED, REJECT_BELOW = 20_000, 0.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
#: Statistics that the trees see, and whether quality may only fall with them.
FEATURES = {"symbols per word": -1, "repeated words": -1, "repeated lines": -1, "capitals per character": -1, "marks per word": -1, "digits per character": -1, "characters per word": 0, "log of words": 0, "words per line": 0}


def counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    kinds = _kinds()[buf]
    starts, ends = K.word_bounds(buf, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    grams, at = K.windows(K.hashes(buf, starts, ends), text, 3, 3)
    twice = _repeats(grams, text[at])
    marked = np.zeros(len(starts), bool)
    for i in range(3):
        marked[at[twice[0] | twice[1]] + i] = True
    line_starts, line_ends, line_text = K.line_bounds(buf, offsets)
    in_word = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(K.IS_WORD[buf], out=in_word[1:])
    full = in_word[line_ends] > in_word[line_starts]
    lines = K.hashes(buf, line_starts, line_ends, (10,))[full]
    _, later = _repeats(lines, line_text[full])
    return {
        "n_words": np.bincount(text, minlength=n), "word_chars": per_text(K.IS_WORD[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": per_text((kinds & 1) > 0),
        "n_dup_lines": np.bincount(line_text[full][later], minlength=n), "n_repeat_words": np.bincount(text[marked], minlength=n),
        "n_upper": per_text((kinds & 2) > 0), "n_marks": per_text((kinds & 4) > 0), "n_digits": per_text((kinds & 8) > 0), "n_lines": np.bincount(line_text[full], minlength=n),
    }


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for bit, chars in ((1, SYMBOLS), (2, bytes(range(65, 91))), (4, b"!?*=_~^"), (8, b"0123456789")):
        out[list(chars)] |= bit
    return out


def _repeats(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are the first of several equal ones of their text, and which are later ones."""
    first, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    key = K.mix(values + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later[order[1:][same]] = True
    first[order[:-1][same]] = True
    return first & ~later, later


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Boosted | None = None) -> DataFrame:
    """(doc_id, *COUNTS, score) per row of docs, in one pass; score is null without a model."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in _counted(batch.column(0), batch.column(1)):
                score = pa.array(model.score(features(found))) if model else pa.nulls(len(ids), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c], pa.int64()) for c in COUNTS), score], names=["doc_id", *COUNTS, "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")


def _counted(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    buf, offsets = K.utf8(texts)
    for i, j in K.runs(offsets):
        yield ids.slice(i, j - i), counts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def features(found: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of texts with these COUNTS."""
    c = {k: np.asarray(v, float) for k, v in found.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([c["n_symbols"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_upper"] / chars, c["n_marks"] / words, c["n_digits"] / chars, chars / words, np.log(words), words / lines], 1)


def failed():
    """The base rules, over COUNTS."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", most: int = LABELLED) -> Boosted | None:
    """Trees for quality = 1, fitted on the labelled rows with the smallest hashes of doc_id, of which most bounds the number (twice that many texts, where doc_ids repeat), of those that the base rules keep; None if these are of one kind or none."""
    sample = labels.filter(F.col(quality).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(quality).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left_semi")
    found = statistics(texts).drop("score").filter(~failed())
    rows = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "label", *COUNTS).limit(2 * most).toArrow()
    y = rows["label"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return None
    return fit(features({c: rows[c].to_numpy() for c in COUNTS}), y.astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = LABELLED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the other COUNTS and score) per row of docs.

    A null text counts as empty and fails, as do texts of under 50 words or with over half of their words in 3-word
    windows found twice. Other texts are kept unless the trees' log odds are below REJECT_BELOW; without labels of both
    kinds, all are kept (score null). Repeated rows are judged alike; ties, extra columns and empty tables need no care.
    """
    scored = statistics(docs, doc_id, text, train(docs, labels, doc_id, text, most=most))
    judged = scored.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= REJECT_BELOW, F.lit(True)))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *(c for c in judged.columns if c not in first))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns; nothing of them is shuffled.

    Null and empty texts go, as the base rules say; repeated rows stay or go alike; an empty table gives an empty one.
    """
    model = train(docs, labels, most=most)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = []
        for _, c in _counted(texts, texts):
            fine = (c["n_words"] >= LEAST_WORDS) & (100 * c["n_repeat_words"] <= MOST_REPEATED * c["n_words"])
            out.append(fine & (model.score(features(c)) >= REJECT_BELOW) if model else fine)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(good(F.col("text").cast("string")))
