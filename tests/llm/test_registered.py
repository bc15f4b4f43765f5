"""Every registered query on the smallest tables, against plain versions of what its contract fixes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, name, first):
    df = Q.queries()[name](spark, sf_dir)
    assert df.columns[: len(first)] == first
    return df.collect()


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, sf_dir, texts):
    rows = rows_of(spark, sf_dir, "op1_mixing", ["doc_id", "size", "source_size", "target", "taken"])
    size = {i: len(WORD.findall(r.text or "")) for i, r in texts.items()}
    total, taken, target = {}, {}, {}
    for r in rows:
        s = texts[r.doc_id].source
        total[s], taken[s], target[s] = total.get(s, 0) + size[r.doc_id], taken.get(s, 0) + r.taken, r.target
        assert r.size == size[r.doc_id] and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert len(rows) == len(texts) and all(r.source_size == total[texts[r.doc_id].source] for r in rows)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (sum(total.values()) - sum(fixed.values())) / max(1e-9, sum(weight[s] for s in rest))
        if not (over := [s for s in rest if level * weight[s] > 3 * total[s]]):
            break
        fixed |= {s: 3.0 * total[s] for s in over}
    for s in names:
        want = fixed.get(s, level * weight[s])
        assert abs(target[s] - want) < 1e-6 * max(1, want)
        assert abs(taken[s] - want) <= max(size[i] for i, r in texts.items() if r.source == s)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, Q.op1_mixing(spark, sf_dir).collect()), key=str)


def test_op3(spark, sf_dir, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    rows = rows_of(spark, sf_dir, "op3_sentencepiece", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_op6(spark, sf_dir, texts):
    rows = rows_of(spark, sf_dir, "op6_personal_data", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    assert len(rows) == len(texts)
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    for r in rows:
        base = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[r.doc_id].text or "") if good(m.group())] for k, (p, good) in kinds.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in base.values()]
        assert r.base_sha256 == sha(",".join(s for x in base.values() for s in x)) and set(s for x in base.values() for s in x) <= set(r.spans.split(","))


def test_op7(spark, sf_dir, texts):
    rows = rows_of(spark, sf_dir, "op7_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id].text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        where = {}
        for i in range(len(words) - 2):
            where.setdefault(tuple(words[i : i + 3]), []).append(i)
        again = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_op9(spark, sf_dir, texts):
    rows = rows_of(spark, sf_dir, "op9_secret_scans", ["doc_id", "n_candidates", "n_secrets"])
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_secrets == len(r.secrets) <= r.n_candidates and all(0 <= s.start < s.end <= len(texts[r.doc_id].text) for s in r.secrets)
        planted = re.findall(r"token = \"([0-9a-f]{40})\"", texts[r.doc_id].text or "")
        found = {texts[r.doc_id].text[s.start : s.end] for s in r.secrets}
        assert set(planted) <= found


def test_op10(spark, sf_dir):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    good = {i: np.array(v, float) for i, v in table.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    unit = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    got = {}
    for r in sorted(rows_of(spark, sf_dir, "op10_vantage_point_trees", ["query_id", "rank", "vec_id", "score"]), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        scores = unit @ (good[q] / np.linalg.norm(good[q]))
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        assert [i for i, _ in found] == ids[order].tolist() and np.allclose([s for _, s in found], scores[order], atol=1e-12)
