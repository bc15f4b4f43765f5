"""Personal data: exact patterns, and a conditional random field that finds other spellings by word shapes.

The field reads a chain of words: every word that holds a digit, an @ or a bracketed "at", with CONTEXT words on either
side, overlapping chains joined; other words have none of the shapes it can label. It is trained from a small labelled
table that labelled_lines() makes, and decoded by Viterbi over batches of chains. Its spans are added where no base
span lies; base spans stay as they are.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .crf import Chain, fit
from .scratch import ship

#: The kinds in order, which are also the labels after 0.
KINDS = ("email", "ip", "card", "phone")
#: Words on either side of one of interest; feature numbers.
CONTEXT, FEATURES = 4, 4096
_MAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_AT = re.compile(r"[\[({]at[\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, leftmost and not overlapping within a kind, by kind and start; code points."""
    out, last = [], 0
    if "@" in text:
        for m in _MAIL.finditer(text):  # a domain fixes the match: its local part is all that can stand before
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def shape(word: str) -> str:
    """The whole word's letters and digits by kind, runs shortened."""
    kinds = "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", kinds)


def token_features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word of a chain: its shape, its neighbours' shapes, and what it is made of."""
    marks = []
    for w in words:
        digits = _digits(w)
        core = w.strip(".,;:!?()\"'")
        four = core.split(".")
        marks.append((
            shape(w), f"digits {min(len(digits), 20)}", f"at {'@' in w} {bool(_AT.search(w))}", f"ends {w[0]} {w[-1] if not w[-1].isalnum() else 'x'}",
            f"check {len(digits) >= 13 and luhn(digits)} {len(w) > 64}", f"dots {min(w.count('.'), 5)} {len(four) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in four)}",
            f"pure {core.isdigit()} {min(len(core), 20)}",
        ))
    none = ("",) * 7
    rows = []
    for i, m in enumerate(marks):
        before, after = marks[i - 1] if i else none, marks[i + 1] if i + 1 < len(marks) else none
        names = [f"{j}{x}" for j, x in enumerate(m)] + [f"b{before[0]}", f"a{after[0]}", f"bw{words[i - 1].lower() if i else ''}", f"two {before[1]} {m[1]}", f"next {m[1]} {after[1]}"]
        rows.append([zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names])
    return np.array(rows, np.int64)


def labelled_lines(n: int = 500, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, labels) made by rule: other spellings of the kinds among plain words and harmless numbers."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(("the", "an", "er", "ti", "on", "re", "ou", "st", "le", "qu", "ción", "über")) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", ".", ","))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        while luhn(d := rng.choice("3456") + num(15)) != good:
            pass
        return d

    while len(out) < n:
        kind = rng.randrange(12)
        d = card(True)
        bad = card(False)
        some: list[tuple[str, int]] = {
            0: [(f"{word().strip('.,')}{num(2)}{rng.choice(('[at]', '(at)', '[AT]'))}{word().strip('.,')}.com", 1)],
            1: [(f"({num(3)})", 4), (f"{num(3)}-{num(4)}", 4)],
            2: [(f"{num(3)}-{num(3)}-{num(4)}", 4)],
            3: [(rng.choice((".", "_")).join(d[i : i + 4] for i in (0, 4, 8, 12)), 3)],
            4: [(bad, 0)],
            5: [(num(rng.randint(1, 9)) + rng.choice(("", ".", ",", "%")), 0)],
            6: [(f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", 0)],
            7: [(f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", 0)],
            8: [("=", 0), (f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', 0)],
            9: [(f"{word().strip('.,')}.{num(2)}@mail{num(1)}.example.com", 1)],
            10: [(".".join(str(rng.randint(0, 255)) for _ in range(4)), 2)],
            11: [(num(rng.randint(16, 30)), 0), (bad[:8], 0)],
        }[kind]
        left, right = [word() for _ in range(rng.randint(1, 5))], [word() for _ in range(rng.randint(1, 5))]
        out.append(([*left, *(w for w, _ in some), *right], [0] * len(left) + [y for _, y in some] + [0] * len(right)))
    return out


@cache
def _default() -> Chain:
    return train(labelled_lines())


def train(lines: list[tuple[list[str], list[int]]]) -> Chain:
    """A chain from a small labelled table, held by the driver."""
    return fit([(token_features(w), np.array(y)) for w, y in lines], FEATURES, 1 + len(KINDS))


def _of_interest(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a digit, an @ or brackets around "at"; no other text has spans."""
    sign = np.zeros(256, bool)
    sign[list(b"0123456789@")] = True
    bracket = np.zeros(256, bool)
    bracket[list(b"[({")] = True
    hit = sign[buf]
    k = np.flatnonzero(bracket[buf[:-3]]) if len(buf) > 3 else np.zeros(0, np.int64)
    hit[k[(K.LOWER[buf[k + 1]] == 97) & (K.LOWER[buf[k + 2]] == 116)]] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[offsets[1:]] > total[offsets[:-1]]


def chains(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """The words, with their spans, of each chain of a text."""
    words = [(m[0], m.span()) for m in _WORDS.finditer(text)]
    hot = [i for i, (w, _) in enumerate(words) if "@" in w or any("0" <= c <= "9" for c in w) or _AT.search(w)]
    out, at = [], 0
    while at < len(hot):
        low = max(0, hot[at] - CONTEXT)
        high = hot[at] + CONTEXT + 1
        while at + 1 < len(hot) and hot[at + 1] - CONTEXT <= high:
            at += 1
            high = hot[at] + CONTEXT + 1
        part = words[low:high]
        out.append(([w for w, _ in part], [s for _, s in part]))
        at += 1
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], chain: Chain) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the words that the chain labels, adjacent ones joined, where they touch no base span."""
    found = [(i, *c) for i, t in enumerate(texts) for c in chains(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not found:
        return out
    labels = chain.decode(np.concatenate([token_features(w) for _, w, _ in found]), np.array([len(w) for _, w, _ in found]))
    at = 0
    for i, words, spans in found:
        run = labels[at : at + len(words)]
        at += len(words)
        k = 0
        while k < len(run):
            j = k + 1
            while j < len(run) and run[j] == run[k]:
                j += 1
            if run[k]:
                first, last = words[k], words[j - 1]
                a = spans[k][0] + len(first) - len(first.lstrip("\"'<[{,;:"))
                b = spans[j - 1][1] - (len(last) - len(last.rstrip("\"'>]},;:.!?")))
                if a < b and not any(s < b and a < e for _, s, e in base[i]):
                    out[i].append((int(run[k]) - 1, a, b))
            k = j
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """(doc_id, base, spans: arrays of (kind, start, end)) per row of docs, each by kind as in KINDS, then start; code points, end exclusive.

    Null and empty texts have none; repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    ship(docs.sparkSession)
    chain = train(lines) if lines else _default()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = K.utf8(batch.column(1))
            for i, j in K.runs(offsets):
                buf, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                k = np.flatnonzero(_of_interest(buf, at)).tolist()
                texts = [buf[at[x] : at[x + 1]].tobytes().decode(errors="replace") for x in k]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, chain)
                left: list[list] = [[] for _ in range(j - i)]
                right: list[list] = [[] for _ in range(j - i)]
                for x, b, m in zip(k, base, more, strict=True):
                    left[x], right[x] = named(b), named(sorted(b + m))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(left, kind), pa.array(right, kind)], names=["doc_id", "base", "spans"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(each, "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")
