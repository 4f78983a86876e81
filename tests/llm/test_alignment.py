"""op13 against groups found byte by byte with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filmloom.llm import alignment
from filmloom.llm.alignment import aligned, byte_ranges, composed, fragment, groups
from filmloom.llm.q_packing import tokenizer_path
from filmloom.llm.q_token_counts import model_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    assert decoders.ByteLevel().decode(["Ġ"]) == " "

    def both(text):
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        return [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in a], [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in b for p in [sp.id_to_piece(i)]]

    return both


def plain_groups(both, text):
    if not text:
        return []
    a, b = both(text)
    if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
        return []
    out, i, j, pa_, pb_ = [], 0, 0, 0, 0
    while i < len(a):
        ga, gb = [], []
        while not (ga and gb and pa_ == pb_):
            if pa_ <= pb_ and i < len(a) and not (ga and pa_ == pb_):
                ga.append(a[i][0])
                pa_ += len(a[i][1])
                i += 1
            else:
                gb.append(b[j][0])
                pb_ += len(b[j][1])
                j += 1
        out.append((ga, gb))
    return out


def plain(both, docs):
    found = [(d, plain_groups(both, t)) for d, t in docs]
    held = Counter()
    for _, gs in found:
        held.update({(x, y) for ga, gb in gs for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for d, gs in found:
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        out.append((d, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    words = ["the", " quick", "Straße", "日本語のテキスト", "naïve", "3.14159", "\n", "  ", "\t", "foo_bar(baz)", "'s", "🙂", "internationalisation", "<|endoftext|>", "</s>", "xyzzyqwv", "ing", "　", "\x00"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 80])))) for k in range(60)]
    docs += [(5, "same text here"), (5, "same text here"), (None, "no id"), (70, None), (71, ""), (72, " "), (73, "mark ▁ inside"), (74, "a"), (75, "   lead and trail   ")]
    docs += [(80, "".join(rng.choices(words, k=600))), (81, "hello" * 400), (82, " ".join(rng.choices(words, k=900))), (83, "long ▁ " * 200), (84, "x " * 700), (84, "x " * 700)]
    return docs


@pytest.mark.parametrize(("chunk", "hot", "fan"), [(1 << 16, 2_000_000, 16), (64, 40, 2), (150, 0, 3), (7, 100, 16)])
def test_brute_force(spark, libraries, monkeypatch, chunk, hot, fan):
    monkeypatch.setattr(alignment, "FAN", fan)
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = aligned(d, tokenizer_path(), model_path(), chunk=chunk, hot_pairs=hot).documents
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, docs)


def test_empty(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), model_path()).documents.count() == 0


def test_large_groups_and_many_pairs(monkeypatch):
    from filmloom.llm._tokens import Vocabulary

    v = Vocabulary.of([b"", b"x", b"xx", b"xxx", b"y"])
    a, b = [np.array([1, 3, 3, 4]), np.array([1, 4])], [np.array([2, 2, 2, 1, 4]), np.array([1, 4])]
    want = groups(v, v, a, b)
    assert want.texts() == [b"1,3|2,2;3|2,1;4|4", b"1|1;4|4"]
    pairs = want.pairs()
    monkeypatch.setattr(alignment, "LARGE", 0)
    for x, y in zip(pairs, groups(v, v, a, b).pairs(), strict=True):
        assert x.tolist() == y.tolist()


def test_fragments_are_associative():
    from filmloom.llm._tokens import byte_bpe, piece_bpe

    ta, tb = byte_bpe(tokenizer_path(), True), piece_bpe(model_path())
    full = b" " + "internationalisation Straße xyzzyqwv 日本語のテキスト hello".encode() * 5
    spans = byte_ranges(full, 9)
    assert len(spans) > 8
    assert any(lo != s for s, _, lo, _ in spans)
    rows = []
    for k, (s, e, lo, hi) in enumerate(spans):
        cut, p, _, q = fragment(ta, tb, full[s:e], s, lo, hi)
        rows.append({"key": 1, "k": k, "at": k, "cut": cut, **dict(zip(("pa", "pb", "sa", "sb"), (x.astype("<u2").tobytes() for x in (*p, *q)), strict=True))})
    kinds = {"key": pa.int64(), "k": pa.int32(), "at": pa.int32(), "cut": pa.bool_(), "pa": pa.binary(), "pb": pa.binary(), "sa": pa.binary(), "sb": pa.binary()}

    def fold(size):
        now, seams = rows, []
        alignment_fan, alignment.FAN = alignment.FAN, size
        try:
            while len(now) > 1:
                after = []
                for x in range(0, len(now), size):
                    part = now[x : x + size]
                    out = composed(pa.table({n: pa.array([r[n] for r in part], t) for n, t in kinds.items()})).to_pylist()
                    seams += [(r["k"], r["pa"], r["pb"]) for r in out if r["part"] == 0]
                    after += [{n: r[n] for n in kinds} for r in out if r["part"] == -1]
                now = after
        finally:
            alignment.FAN = alignment_fan
        return sorted(seams), {n: now[0][n] for n in ("at", "cut", "pa", "pb", "sa", "sb")}

    assert fold(2) == fold(3) == fold(100)
    assert fold(2)[1]["sa"] == b""
