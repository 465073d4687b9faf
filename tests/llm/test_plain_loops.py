"""Sharding, quality and toxicity against plain loops over a few texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tokenizers
import pytest

from millrace.llm import bpe, pu, sharding, suffix
from millrace.llm.textbytes import BASE, LOWER_VALUES, utf8

MASK = (1 << 64) - 1


def some_texts():
    rng = random.Random(12)
    out = ["", " \n\t", "a", "A a a b!", "One. Two, three; four?\nfive ## six 12 é漢🙂", "|" * 30, "word " * 50, "x" * 400, "Ab9 c_ d@ ~ - (paren) end."]
    for _ in range(60):
        out.append(rng.choice([" ", "\n", "  "]).join("".join(rng.choice("abcXYZ019#*.,!éß_-") for _ in range(rng.randrange(1, 26))) for _ in range(rng.randrange(1, 40))))
    return out


def joined(texts):
    import pyarrow as pa

    return utf8(pa.array(texts))


def shape(text):
    """The features of a text, one after the other."""
    data = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    good = set([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
    symbols = set(pu.SYMBOLS)

    def share(test):
        return sum(test(b) for b in data) / max(len(data), 1)

    def word_share(test):
        return sum(test(i) for i in range(len(words))) / max(len(words), 1)

    run = best = 0
    for i in range(len(low)):
        run = run + 1 if i and low[i] == low[i - 1] else 0
        best = max(best, run)
    x = [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / max(len(words), 1) / 10,
        share(lambda b: b in symbols), share(lambda b: b not in good), share(lambda b: 48 <= b < 58), share(lambda b: 65 <= b < 91), share(lambda b: b == 10), share(lambda b: b >= 128),
        share(lambda b: b in b".!?"), share(lambda b: b in b",;:"),
        word_share(lambda i: i > 0 and low[i] == low[i - 1]), word_share(lambda i: i > 1 and low[i] == low[i - 2]), math.log1p(best), word_share(lambda i: words[i][-1] in symbols),
        word_share(lambda i: len(words[i]) == 1 and words[i][0] in symbols), word_share(lambda i: len(words[i]) > 20), word_share(lambda i: len(words[i]) <= 2),
        word_share(lambda i: 65 <= words[i][0] < 91), word_share(lambda i: words[i][-1] not in good and words[i][-1] not in symbols),
    ]
    return [*x, *(math.log(v + 1e-4) for v in x[3:]), *(float(v > 0) for v in x[3:])]


def slots(text):
    """Table slots of the words of a text and of their beginnings."""

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        return x ^ (x >> 31)

    def hashed(word):
        return mixed(sum(int(LOWER_VALUES[b]) * pow(int(BASE), i, 1 << 64) for i, b in enumerate(word)) & MASK)

    out = set()
    for w in re.split(rb"[\x20\x09-\x0D]+", text.encode()):
        if w:
            out.add(hashed(w) >> (64 - pu.TABLE_BITS))
            out |= {mixed((hashed(w[:n]) + i + 1) & MASK) >> (64 - pu.TABLE_BITS) for i, n in enumerate(pu.PREFIXES) if len(w) >= n}
    return out


def sigmoid(v):
    return 1 / (1 + math.exp(-max(-30, min(30, v))))


def test_quality_scores_are_those_of_a_plain_loop():
    texts, rng = some_texts(), np.random.default_rng(3)
    data, offsets = joined(texts)
    want = np.array([shape(t) for t in texts])
    assert np.allclose(pu.dense_features(data, offsets), want, atol=1e-5)
    k = want.shape[1]
    model = pu.Scorer("shape", rng.normal(size=k), 0.3, rng.normal(size=k), rng.random(k) + 0.5)
    for score, x in zip(model.scores(data, offsets), want):
        total = sum(w * max(-5, min(5, (v - m) / s)) for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + 0.3
        assert math.isclose(score, sigmoid(total), abs_tol=1e-4)


def test_toxicity_scores_are_those_of_a_plain_loop():
    texts, rng = some_texts(), np.random.default_rng(4)
    data, offsets = joined(texts)
    found = [slots(t) for t in texts]
    rows, cells = pu.word_features(data, offsets)
    for i, own in enumerate(found):
        assert set(cells[rows == i].tolist()) == own
    chosen = np.array(sorted(rng.choice(sorted(set().union(*found)), 80, replace=False)))
    model = pu.Scorer("words", rng.normal(size=len(chosen)), -0.2, slots=chosen)
    for score, own in zip(model.scores(data, offsets), found):
        assert math.isclose(score, sigmoid(sum(w for s, w in zip(chosen, model.weights) if s in own) - 0.2), rel_tol=1e-9)


def test_the_risk_is_minimised_as_a_plain_loop_does():
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (30, 3)), rng.normal(0, 1, (50, 3))
    weights, bias = pu.fit_pu(pu.Rows(30, 3, p), pu.Rows(50, 3, u), 0.3, steps=25)
    w, first, second = [0.0] * 4, [0.0] * 4, [0.0] * 4
    soft = lambda v: math.log1p(math.exp(v))
    for step in range(1, 26):
        sp, su = ([sum(a * b for a, b in zip(w, [*x, 1])) for x in part] for part in (p, u))
        covered = sum(map(soft, su)) / 50 >= 0.3 * sum(map(soft, sp)) / 30
        gp = [-0.3 / 30 if covered else 0.3 * sigmoid(v) / 30 for v in sp]
        gu = [sigmoid(v) / 50 * (1 if covered else -1) for v in su]
        for j in range(4):
            g = sum(a * [*x, 1][j] for a, x in zip(gp, p)) + sum(a * [*x, 1][j] for a, x in zip(gu, u)) + pu.DECAY / 30 * w[j]
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
        w = [v - 0.05 * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for v, a, b in zip(w, first, second)]
    assert np.allclose([*weights, bias], w, atol=1e-9)


@pytest.mark.parametrize("shards", [3, 8])
def test_sizes_sums_and_slots_of_every_row(spark, shards):
    rng = random.Random(3)
    texts = [rng.choice([None, "", "same", "é漢🙂", f"text {rng.randrange(40)}", "long " * rng.randrange(50)]) for _ in range(301)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(df, shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(301))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    cut = Counter((texts[i] or "") for i in range(301))
    whole = [t for t in cut if len({r.shard for r in rows if (texts[r.doc_id] or "") == t}) == 1]
    assert len(whole) >= len(cut) - 2 * shards - 4  # texts are cut at edges of shards, or if they fill over half a shard


def test_rows_of_one_id_with_other_texts_stay_apart(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(260)
    rows = [(1, shared + noise(50)), (1, noise(300)), (None, noise(20) + shared), (None, noise(310)), (2, None), (1, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 310, 260), (1, 300, 0), (0, 280, 260), (0, 310, 0), (2, 0, 0), (1, 0, 0)])


def test_tokens_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "the same text", "x"), (1, "the same text", "y"), (1, "another", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encode = lambda part: bpe.bpe_tokens(part, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode(), r.n_tokens > 0) for r in encode(df).collect())
    assert got == [(0, "", False), (1, "another", True), (1, "the same text", True), (1, "the same text", True)]
    assert encode(df.limit(0)).count() == 0
