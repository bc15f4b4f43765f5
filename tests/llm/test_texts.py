"""Mixing, quality, personal data, secrets, substrings, pieces and chats against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import boost, chat, forest, mixing, pieces, pii, quality, secrets, sharding, substrings
from tessera.llm import kernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "A a\na A\n\nb", "Ünï cödé 日本 \u3000x", "x" * 70_000 + " y", "a\tb\x0bc\x0cd\re", "one two three one two three one two three.\nOne two."]


def docs(spark, texts, extra="n_words string, score string, removed string"):
    rows = [(i, t, "s", "e", "f", "g") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}")


# kernel


def test_word_and_line_bounds():
    buf, at = K.utf8(pa.array(["a b", None, "", "c\n\nd "]))
    starts, ends = K.word_bounds(buf, at)
    assert [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"a", b"b", b"c", b"d"]
    starts, ends, text = K.line_bounds(buf, at)
    assert [(t, buf[a:b].tobytes()) for a, b, t in zip(starts, ends, text, strict=True)] == [(0, b"a b"), (1, b""), (2, b""), (3, b"c"), (3, b""), (3, b"d ")]


def test_hashes_follow_content_alone(monkeypatch):
    words = ["alpha", "b", "alpha", "x" * 300, "x" * 300, "b"]
    buf, at = K.utf8(pa.array([" ".join(words)]))
    for window, long in ((1 << 21, 1 << 16), (64, 1 << 16), (1 << 21, 100)):
        monkeypatch.setattr(K, "WINDOW", window)
        monkeypatch.setattr(K, "LONG", long)
        h = K.hashes(buf, *K.word_bounds(buf, at))
        assert [len(set(h)), h[0] == h[2], h[1] == h[5], h[3] == h[4]] == [3, True, True, True]


# op 1


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(("a", "b", "b", "b", None, "c"))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.copies(df).collect()
    assert len(got) == 3000 and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free = {}, dict(weight)
    while True:
        rest = sum(size.values()) - sum(want.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > 3 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            del free[s]
    want |= {s: rest * w / sum(free.values()) for s, w in free.items()}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.copies(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df).count() == sum(r.copies for r in got)


def test_mix_of_nothing_nulls_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.copies(none).collect() == [] and mixing.mix(none).collect() == []
    df = spark.createDataFrame([(None, "a b", "x"), (1, None, "y"), (2, "c d", "x"), (2, "c d", "x")], "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    assert len(got) == 4 and len({r.copies for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(df.withColumn("size", F.lit(1))).columns == ["doc_id", "text", "source", "size"]
    assert mixing.copies(df.limit(0).union(spark.createDataFrame([(1, "", "x")], df.schema))).first().taken == 0


def test_mix_has_no_python_in_its_plan(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert "Python" not in mixing.copies(df)._jdf.queryExecution().toString()


# op 7


def plain_counts(t):
    w = WORD.findall(t or "")
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c", "#", "\n", "ä "]) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(docs(spark, texts), labels).collect():
        assert tuple(r[c] for c in quality.COUNTS[:5]) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept != r.base_failed
    assert quality.judge(docs(spark, []), labels).collect() == []


def test_trees_obey_their_constraints_and_learn():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)
    model = boost.fit(x[:2000], y[:2000], [-1, 1, 0, -1])
    assert ((model.score(x[2000:]) >= 0) == (y[2000:] == 1)).mean() > 0.97
    for column, sign in ((0, -1), (1, 1), (3, -1)):
        probe = np.repeat(rng.random((50, 4)), 40, 0)
        probe[:, column] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(model.score(probe).reshape(50, 40), axis=1) >= -1e-9).all()


def test_quality_agrees_with_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    judged = quality.judge(table, train).join(held, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in judged}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == quality.judge(table, labels).filter("kept").count()


# op 6


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1 2.@-+(9)0%4é") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert [pii.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]
    texts = ODD + texts[:300] + ["call (123) 555-0199 or mail joe[at]host.com", "4" + "1" * 15 + ", 10.0.0.1"]
    for r in pii.find(docs(spark, texts)).collect():
        base = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base]
        every = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans]
        assert base == plain_spans(texts[r.doc_id] or "") and set(base) <= set(every) and every == sorted(every)


def test_chain_decodes_held_out_lines_and_adds_other_spellings():
    chain = pii._default()
    held = pii.labelled_lines(200, seed=99)
    got = chain.decode(np.concatenate([pii.token_features(w) for w, _ in held]), np.array([len(w) for w, _ in held]))
    want = np.concatenate([y for _, y in held])
    assert (got == want).mean() > 0.99
    text = "please call (123) 555-0199 or not"
    assert [text[a:b] for _, a, b in pii.added_spans([text], [[]], chain)[0]] == ["(123) 555-0199"]
    assert pii.added_spans(["nothing to see here"], [[]], chain) == [[]]


# op 9


def test_forest_removes_false_findings():
    model = secrets.train()
    held = secrets.labelled_findings(1000, seed=77)
    score = model.score(np.array([secrets.features(*f[:3]) for f in held]))
    assert ((score >= secrets.ACCEPT) == np.array([f[3] == 1 for f in held])).mean() > 0.97


def test_forest_learns():
    x = np.random.default_rng(1).random((600, 3))
    y = (x[:, 1] > 0.5).astype(float)
    assert ((forest.fit(x, y, trees=15).score(x) > 0.5) == y).mean() > 0.95


def test_scan_and_redact(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [*ODD, f'é token = "{key}" and commit {key}', f"secret = {key}\nsecret = {key}"]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert all(got[i].n_secrets == 0 for i in range(len(ODD))) and len(got) == len(texts)
    first = got[len(ODD)]
    assert (first.n_candidates, [texts[len(ODD)][s.start : s.end] for s in first.secrets], first.secrets[0].start) == (2, [key], 11)
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert [clean[i] for i in range(len(ODD))] == ODD
    assert clean[len(ODD)] == texts[len(ODD)].replace(f'"{key}"', '"<secret>"') and key not in clean[len(ODD) + 1]
    assert secrets.scan(docs(spark, [])).collect() == []


# op 2


def test_keys_without_digits_and_short_announced_ones_reach_the_forest(spark):
    keys = ["qZxWvKpLmTrBnGhJdSfC", "kTq7ZwXpLmVbRnGhJdSf", "hG7kQz2x", "QwZxkTpVbnRm"]
    texts = [f"token = {keys[0]} and so on", f"api_key: '{keys[1]}'", f'password = "{keys[2]}"', f"pwd={keys[3]}", "a plain text without any, the key", "secret:"]
    rows = {r.doc_id: r for r in secrets.scan(docs(spark, texts)).collect()}
    assert [rows[i].n_candidates for i in range(len(texts))] == [1, 1, 1, 1, 0, 0]
    assert [[texts[i][s.start : s.end] for s in rows[i].secrets] for i in range(4)] == [[k] for k in keys]
    buf, offsets = K.utf8(pa.array(["the token: ", "next", "token=ab", "", "x" * 16]))
    assert [x.tolist() for x in secrets.candidates(buf, offsets)] == [[21, 23], [23, 39], [2, 4]]


def plain_dedup(texts: dict, least: int) -> dict:
    found, first = {}, {}
    for i in sorted(texts):
        t, out = texts[i] or "", []
        words = [m.span() for m in WORD.finditer(t)]
        for k, (a, b) in enumerate(words):
            if not k or t[words[k - 1][1] - 1] in ".!?" or "\n" in t[words[k - 1][1] : a]:
                out.append([a, b, []])
            out[-1][1] = b
            out[-1][2].append("".join(c.lower() if "A" <= c <= "Z" else c for c in t[a:b]))
        found[i] = out
        for n, u in enumerate(out):
            first.setdefault(tuple(u[2]), (i, n))
    result = {}
    for i, out in found.items():
        spans, run = [], []
        for n, u in [*enumerate(out), (-1, None)]:
            if u and first[tuple(u[2])] != (i, n):
                run.append(u)
                continue
            if sum(len(x[2]) for x in run) >= least:
                spans.append((run[0][0], run[-1][1]))
            run = []
        t, edges = texts[i], [0, *(x for s in spans for x in s)]
        result[i] = (spans, t if not spans else "".join(t[a:b] for a, b in zip(edges[::2], [*edges[1::2], len(t)], strict=True)))
    return result


def test_substrings_equal_a_plain_version(spark):
    rng = random.Random(12)
    sentences = [" ".join(rng.choice(("ä", "b", "c", "dd")) for _ in range(rng.randint(1, 8))) + rng.choice(".!?") for _ in range(60)]
    texts = ODD + [rng.choice((" ", "\n", "  ")).join(rng.choice(sentences) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += texts[20:30]
    got = {r.doc_id: r for r in substrings.deduplicate(docs(spark, texts), run=6).collect()}
    want = plain_dedup(dict(enumerate(texts)), 6)
    assert {i: ([(s.start, s.end) for s in r.removed], r.text) for i, r in got.items()} == want
    assert {i: [(s.start, s.end) for s in r.repeated] for i, r in got.items()} == {i: s for i, (s, _) in plain_dedup(dict(enumerate(texts)), 1).items()}
    assert any(s for s, _ in want.values()) and substrings.deduplicate(docs(spark, [])).collect() == []


def test_dedup_of_null_and_repeated_doc_ids(spark):
    rows = [(1, "A b. C d."), (1, "A b. C d."), (None, "A b."), (2, "c D.\nnew one. New one. new one.")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, digest string, number int")
    got = sorted(((r.doc_id, r.text, len(r.repeated)) for r in substrings.deduplicate(df).collect()), key=str)
    assert got == sorted([(1, "A b. C d.", 0), (1, "A b. C d.", 0), (None, "A b.", 0), (2, "\nnew one. ", 2)], key=str)


def test_every_later_occurrence_of_a_unit_goes(spark):
    inner = [f"s{i} " + " ".join(f"w{i}x{j}" for j in range(10)) + "." for i in range(2)]
    passage = "b " * 15 + "b. " + " ".join(inner) + " " + "c " * 15 + "c"  # 54 words, of which whole units have 22
    texts = ["All rights reserved.\nOne.", "Two. all  rights reserved. Three.", f"x y {passage} z.", f"other {passage} words follow.", "Two.\nTwo."]
    got = {r.doc_id: r for r in substrings.deduplicate(docs(spark, texts)).collect()}
    assert {i: ([(s.start, s.end) for s in r.removed], r.text) for i, r in got.items()} == plain_dedup(dict(enumerate(texts)), 1)
    assert got[1].text == "Two.  Three." and not any(u in got[3].text for u in inner) and got[4].text == ""


# op 3


def model_bytes():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    rng = random.Random(3)
    texts = ODD + ["a  b", " lead", "▁x ▁", "<s> <0x0A> <unk>", "ab" * 500 + " " * 90, "日本🎉", "a\x00b"] + ["".join(rng.choice("ab \n▁é🎉<0x1>the ing") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    rows = pieces.encode(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model"), decoded=True, keep=("source",)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode(text)
        assert (list(r.ids), r.decoded, r.source) == (ids, library.decode(ids), "s")
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data


def character_map(pairs: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double array laid out by hand, every node's children in a block of their own."""
    texts, place = b"", {}
    for k, v in pairs.items():
        place[k] = len(texts)
        texts += v + b"\0"
    tree: dict = {}
    for k in pairs:
        node = tree
        for b in k:
            node = node.setdefault(b, {})
        node[None] = place[k]
    units = [0] * 256
    def lay(node, at):
        base = len(units)
        units.extend([0] * 256)
        offset = base ^ at
        leaf = None in node
        units[at] = (units[at] & 0xFF) | offset << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = 0x80000000 | node[None]
        for b, child in node.items():
            if b is not None:
                units[base ^ b] = b
                lay(child, base ^ b)
    lay(tree, 0)
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def test_normalising_takes_longest_prefixes_and_keeps_source_bytes():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model_bytes())
    proto.normalizer_spec.precompiled_charsmap = character_map({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "\u3000".encode(): b" "})
    model = pieces.PieceModel(proto.SerializeToString())
    assert model.library.encode("the ﬁne ab abc\u3000x") == model.encode("the ﬁne ab abc\u3000x")[0].tolist()
    normal, where = model.normalise("ﬁ abcd")
    assert normal == "▁fi▁YZd" and where.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 4, 7, 8]
    proto.normalizer_spec.remove_extra_whitespaces = True
    model = pieces.PieceModel(proto.SerializeToString())
    for text in ("  a  b  ", "", "   ", "a\u3000 \u3000b ", "ﬁ"):
        assert model.library.encode(text) == model.encode(text)[0].tolist()
    ids, starts, ends = model.encode("  the  ﬁne ")
    assert starts[0] == 0 and (ends[1:] >= ends[:-1]).all() and ends[-1] <= len("  the  ﬁne ".encode())


# op 5


def test_chats_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "a<next>b", "\\l\\b\\", "</turn>\n### user:\nx", "", None, "\n"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(("user", "assistant", "a:\n", None)), rng.choice(tricky)) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(99, None, "user", "x"), (99, 0, "user", "y"), (99, 0, "user", "y"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    done = chat.format_chats(df.withColumn("rows", F.lit(1)))
    got = done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), "loss").alias("learnt"), "formatted").collect()
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(got) == len(by)
    for g in got:
        want = [(r, x) for _, r, x in sorted(by[g.conv_id])]
        assert [tuple(t) for t in g.turns] == want
        assert g.learnt == "".join(x for r, x in want if r == "assistant")
        assert g.formatted.count(chat.HEAD) == sum(i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want)))
    assert chat.format_chats(df.limit(0)).collect() == []
    assert "Python" not in done._jdf.queryExecution().toString()


def test_long_conversation(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<é "), F.col("id")).alias("text"))
    done = chat.format_chats(rows)
    g = done.select(chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), "loss").alias("learnt"), "loss", "formatted").first()
    want = [("user" if i % 3 == 0 else "assistant", f"<é {i}") for i in range(n)]
    assert [tuple(t) for t in g.turns] == want and g.formatted.count(chat.HEAD) == 2 * n // 3
    assert g.learnt == "".join(x for r, x in want if r == "assistant")
    assert [g.formatted[s.start : s.end] for s in g.loss] == [x.replace("<", "\\l") for r, x in want if r == "assistant"]
    long = spark.createDataFrame([(2, 0, "assistant", "x" * 5_000_000)], rows.schema.simpleString()[7:-1].replace(":", " "))
    assert chat.format_chats(long).select(chat.loss_text(F.col("formatted"), "loss").alias("t")).first().t == "x" * 5_000_000


# op 8


def plain_table(shards, slots):
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    orders = [iter([(number(f"offset:{s}") + j * (number(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)]) for s in shards]
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = i
    return [table[i] for i in range(slots)]


def test_lookup_table_is_fair_and_moves_little():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 503)
    assert table == plain_table(shards, 503)
    count = collections.Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 503)
    stay = sum(a == b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert stay > 0.75 * sum(a != 6 for a in table)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError, match="shards"):
            sharding.lookup_table(bad, 503)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(shards, 500)


def test_placing_and_writing_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (None, "c", 6), (2, None, 7)], "key long, v string, slot int")
    shards = ["x", "y/é", "z"]
    placed = sharding.place(df, "key", shards, 503)
    got = placed.collect()
    assert placed.columns == ["key", "v", "slot", "shard"] and len(got) == 4
    table = plain_table(shards, 503)
    for r in got:
        slot = int(hashlib.md5(("" if r.key is None else str(r.key)).encode()).hexdigest()[:15], 16) % 503
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(df.limit(0), "key", shards, 503).collect() == []
    sharding.write_shards(df.drop("slot"), "key", ["x", "z"], str(tmp_path / "out"), files=2, slots=503)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert "Python" not in placed._jdf.queryExecution().toString()
