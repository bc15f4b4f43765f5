"""Secret scans: candidates found by their characters over the whole text, and a random forest that removes false ones.

A candidate is a run of LEAST characters or more of the alphabets of keys, or one of any length after a word that
announces secrets. The forest sees its length and digits, the transitions between kinds of characters, how much of it a
dictionary covers, whether it looks like words or a path, and the words around it. It is trained from labelled findings:
a table (before, candidate, after, secret), by default one that labelled_findings() makes.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .forest import Forest, fit
from .scratch import ship

#: Characters of candidates that nothing announces; characters of context on either side; the forest's share from which a candidate is a secret.
LEAST, CONTEXT, ACCEPT = 16, 48, 0.5
#: Starts of well-known keys, words that announce secrets, words that announce other strings, and common parts of names.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "rk_live_", "AIza", "ya29.", "eyJ", "npm_", "pypi-", "SG.")
ANNOUNCE = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "auth", "authorization", "bearer", "credential", "private", "access")
OTHERWISE = ("commit", "sha1", "sha256", "sha512", "md5", "digest", "checksum", "integrity", "etag", "uuid", "guid", "hash", "revision", "version", "isbn", "order", "invoice", "example", "href", "src", "image", "file", "path", "id")
NAMES = ("the", "and", "this", "that", "with", "your", "here", "user", "name", "data", "file", "test", "main", "home", "http", "www", "com", "org", "index", "image", "page", "post", "static", "asset", "build", "lib", "src", "local", "config", "version", "example", "sample", "change", "replace", "document", "report", "model", "train", "class", "value", "table", "node", "list", "item", "date", "time", "year", "info", "html", "json", "yaml")
_CHARS = np.zeros(256, bool)
_CHARS[list((string.ascii_letters + string.digits + "+/_-=.").encode())] = True
_PREFIX = re.compile("|".join(map(re.escape, PREFIXES)))
_NAMES = re.compile("|".join(sorted(NAMES, key=len, reverse=True)))
_WORD = re.compile(r"[a-z_][a-z0-9_-]*")
_VALUE = re.compile(rb"(?:" + "|".join(sorted(ANNOUNCE, key=len, reverse=True)).encode() + rb")(?:[\"'`]?\s{0,4}(?:[:=]{1,2}>?|\sis\s)|(?<=bearer)\s)\s{0,4}[\"'`]?")


def candidates(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all candidates, and the text of each."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    run = _CHARS[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    begins, ends = run.copy(), run.copy()
    begins[1:] &= ~run[:-1] | first[1:-1]
    ends[:-1] &= ~run[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    found = np.array([m.span() for m in _VALUE.finditer(K.LOWER[buf].tobytes())], np.int64).reshape(-1, 2)
    found = found[np.searchsorted(offsets, found[:, 0], "right") == np.searchsorted(offsets, found[:, 1], "right"), 1]
    found = found[run[np.minimum(found, len(buf) - 1)] & (found < len(buf))]
    cut = np.union1d(starts, found)  # a run is cut where an announced value begins in it: name=value
    stops = np.minimum(stops[np.searchsorted(starts, cut, "right") - 1], np.append(cut[1:], len(buf)))
    good = (stops - cut >= LEAST) | np.isin(cut, found)
    return cut[good], stops[good], np.searchsorted(offsets, cut[good], "right") - 1


def features(before: str, candidate: str, after: str) -> list[float]:
    """What the forest sees of a candidate of any length."""
    n = len(candidate)
    data = np.frombuffer(candidate.encode("latin-1", "replace"), np.uint8)
    kind = _kind()[data]
    counts = np.bincount(kind, minlength=4) / n
    share = np.bincount(data, minlength=256) / n
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    low = candidate.lower()
    covered = sum(len(m) for m in _NAMES.findall(low)) / n
    left, right = _WORD.findall(before.lower())[-3:], _WORD.findall(after.lower())[:3]
    near = " ".join(left)
    return [
        n, float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, entropy, *counts.tolist(), covered,
        candidate.count("/") / n, candidate.count(".") / n, candidate.count("-") / n, float(bool(re.search(r"\.[a-z]{2,4}$", low))), float(before.rstrip().endswith(("/", ":", "//"))),
        float(any(w in near for w in ANNOUNCE)), float(any(w in left for w in OTHERWISE)), float(any(w in right for w in OTHERWISE)), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), float(bool(before) and before[-1] in "\"'`"),
        float(all(c in "0123456789abcdef" for c in low)), float(_PREFIX.match(candidate) is not None), float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low))), float(counts[2] > 0.9),
        len(set(candidate)) / n, float(counts[2] * n), sum(map(low.count, "aeiou")) / n, float(max(map(len, re.findall(r"[b-df-hj-np-tv-z]+", low)), default=0)), float(candidate[1:] != low[1:] and candidate[1:].upper() != candidate[1:]),
    ]


@cache
def _kind() -> np.ndarray:
    out = np.full(256, 3)
    for k, chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)):
        out[list(chars.encode())] = k
    return out


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, secret), about half of them secrets, made by rule."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(("the", "an", "er", "ti", "on", "re", "ou", "st", "le", "qu")) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: "".join(rng.choice(("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "z")) + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "t", "ch")) for _ in range(rng.randint(a, b)))
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexa, base = "0123456789abcdef", string.ascii_letters + string.digits
    while len(out) < n:
        text, after = f"{word()} {word()} ", f" {word()} {word()}."
        quote = rng.choice(("", '"', "'"))
        if len(out) % 2:
            name = rng.choice(("token", "secret", "api_key", "password", "apikey", "auth_token", "access_key", "private_key", "client_secret", "key"))
            value = rng.choice((some(hexa, 32, 64), some(hexa, 40, 40), some(base, 20, 48), some(base + "+/", 40, 44), some(base, 24, 32) + "="))
            before = text + rng.choice((f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"{name} is {quote}"))
            if rng.random() < 0.3:
                value = rng.choice(PREFIXES) + some(base, 20, 40)
                before = rng.choice((text, before, text + "Authorization: Bearer "))
            elif rng.random() < 0.3:
                value = rng.choice((some(base, 6, 15), some(string.ascii_letters, 8, 40), some(string.ascii_lowercase, 8, 20), some(base, 16, 24)))
            out.append((before, value, quote + after, 1))
        else:
            kind = rng.randrange(15)
            value, before = some(string.digits, 16, 20), text
            if kind == 0:
                value, before = some(hexa, 40, 40), text + rng.choice(("commit ", "revision ", "sha1 ", "hash: "))
            elif kind == 1:
                value, before = some(hexa, 64, 64), text + rng.choice(("sha256 ", "checksum: ", "digest = ", "etag: "))
            elif kind == 2:
                value, before = "/".join(rng.choice(NAMES) for _ in range(rng.randint(3, 6))) + some(string.digits, 2, 4) + rng.choice((".html", ".json", ".png")), text + rng.choice(("", "http://", "file "))
            elif kind == 3:
                value = "-".join((some(hexa, 8, 8), some(hexa, 4, 4), some(hexa, 4, 4), some(hexa, 4, 4), some(hexa, 12, 12)))
                before = text + rng.choice(("", "uuid ", "id: ", "guid = "))
            elif kind == 4:
                value, before = rng.choice(("your", "replace", "example", "sample", "change")) + rng.choice("-_") + rng.choice(("token", "key", "value")) + "-here-" + some(string.digits, 2, 4), text + rng.choice(("token = ", "api_key: ", "key="))
            elif kind == 5:
                value = "_".join(rng.choice(NAMES) for _ in range(4)) + some(string.digits, 2, 3)
            elif kind == 6:
                value = rng.choice(("x", "0", "ab12")) * rng.randint(16, 24)
                before = text + rng.choice(("token = ", "", "password: "))
            elif kind == 7:
                value = some(string.digits, 2, 2) + "." + word() + "-" + word() + "." + word() + some(string.digits, 4, 6) + ".example"
            elif kind in (9, 10):
                value = rng.choice((prose(1, 4).capitalize(), prose(1, 4), prose(1, 4), word(), rng.choice(NAMES), rng.choice(("a", "to", "is", "of", "not", "none", "null", "true"))))
                before = text + rng.choice(ANNOUNCE) + rng.choice((": ", " is ", " = ", "="))
            elif kind in (11, 12):
                value = rng.choice(("", "-", "_", ".", "/")).join(prose(2, 4) for _ in range(rng.randint(5, 8)))
                before = text + rng.choice(("", "", "http://", "key: "))
            elif kind == 13:
                value = rng.choice("-=_.") * rng.randint(LEAST, 80)
            elif kind == 14:
                value = "".join(prose(2, 4).capitalize() for _ in range(rng.randint(4, 6)))
            value = value[:200] if kind in (9, 10) else value[:200].ljust(LEAST, "0")
            out.append((before, value, after, 0))
    return out


def train(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """A forest from labelled findings; the table is held by the driver and should be small."""
    findings = findings or labelled_findings()
    return fit(np.array([features(*f[:3]) for f in findings]), np.array([float(f[3]) for f in findings]))


def _scan(texts: pa.Array, forest: Forest) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[int, int, int, float]]]]:
    """For each run of texts: its bounds, bytes and offsets, and (text, start, end, score) of the candidates in bytes."""
    whole, offsets = K.utf8(texts)
    for i, j in K.runs(offsets):
        buf, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, stops, text = candidates(buf, at)
        if len(starts):
            part = lambda a, b: buf[a:b].tobytes().decode("latin-1")  # noqa: E731, B023
            rows = [features(part(max(at[t], a - CONTEXT), a), part(a, b), part(b, min(at[t + 1], b + CONTEXT))) for a, b, t in zip(starts, stops, text, strict=True)]
            scores = forest.score(np.array(rows))
        else:
            scores = np.zeros(0)
        yield i, j, buf, at, list(zip(text.tolist(), starts.tolist(), stops.tolist(), scores.tolist(), strict=True))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", findings: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, secrets: array of (start, end, score)) per row of docs, in code points.

    Null and empty texts have none; repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    ship(docs.sparkSession)
    forest = train(findings)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at, found in _scan(batch.column(1), forest):
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                many = np.bincount([f[0] for f in found], minlength=j - i) if found else np.zeros(j - i, np.int64)
                for t, a, b, score in found:
                    if score >= ACCEPT:
                        start = int(((buf[at[t] : a] & 0xC0) != 0x80).sum())
                        spans[t].append({"start": start, "end": start + b - a, "score": round(score, 6)})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(many, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_candidates", "n_secrets", "secrets"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start:long,end:long,score:double>>")


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>", findings: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """docs with each secret replaced by mark, and all other columns as they are.

    Null and empty texts stay; repeated rows are changed alike; a text of any length is read whole; an empty table gives
    an empty one. A column n_chars, if there is one, follows the text.
    """
    ship(docs.sparkSession)
    forest = train(findings)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, _, buf, at, found in _scan(texts, forest):
            for t, spans in groupby((f for f in found if f[3] >= ACCEPT), key=lambda f: f[0]):
                parts, last = [], at[t]
                for _, a, b, _ in spans:
                    parts += [buf[last:a].tobytes(), mark.encode()]
                    last = b
                out[i + t] = b"".join([*parts, buf[last : at[t + 1]].tobytes()]).decode(errors="replace")
        return pa.array(out, pa.string())

    names = docs.columns
    rows = docs.withColumn(text, clean(F.col(text).cast("string")))
    return rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in names)) if "n_chars" in names else rows
