"""The pipeline's stages against plain Python on small tables."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from millrace.llm.bpe import read_ranks
from millrace.llm.store import stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def norm(t):
    return re.sub(r"[ \t-\r]", "", t or "")


def survivors_of_exact(rows):
    """Of (id, text) rows, those that stay."""
    best = {}
    for i, t in rows:
        key = (-len(t or ""), i is None, i or 0)
        if norm(t) not in best or key < best[norm(t)][0]:
            best[norm(t)] = key, (i, t)
    return [row for _, row in best.values()]


def survivors_of_near(rows):
    sets, lower = [], str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i for k, (i, _) in enumerate(rows) if i == least[find(k)]}


def poisson_counts(rows):
    """doc_id to count, by the inverse of each source's distribution."""
    amount = Counter()
    for _, t, source in rows:
        amount[source] += len(t or "")
    roots = {s: math.sqrt(a) for s, a in amount.items()}
    out = {}
    for i, _, s in rows:
        rate = roots[s] / sum(roots.values()) * sum(amount.values()) / amount[s] if amount[s] else 0
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        n, p = 0, math.exp(-rate)
        c = p
        while rate and c <= u and n < 100:
            n += 1
            p *= rate / n
            c += p
        out[i] = n if rate else 0
    return {i: n for i, n in out.items() if n}


def test_stages_equal_brute_force(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    quality, exact, near, mixed, tokens = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good, bad = (set(labels[labels.quality == v].doc_id) for v in (1, 0))
    assert all(list(k.columns) == list(docs.columns) for k in kept[:4])
    assert len(good - set(quality.doc_id)) <= 0.03 * len(good) and len(bad & set(quality.doc_id)) <= 0.1 * len(bad)
    rows = lambda k: list(zip(k.doc_id, k.text))
    assert set(exact.doc_id) == {i for i, _ in survivors_of_exact(rows(quality))}
    assert set(near.doc_id) == survivors_of_near(rows(exact))
    assert Counter(mixed.doc_id) == poisson_counts(list(zip(near.doc_id, near.text, near.source)))
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = dict(rows(docs))
    assert sorted(zip(tokens.doc_id, tokens.ids)) == sorted((i, " ".join(map(str, real.encode_ordinary(text[i] or "")))) for i in mixed.doc_id)


def test_run_equals_its_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.ids_sha256)) == sorted(zip(kept[-1].doc_id, kept[-1].ids_sha256))


def test_stages_on_empty_tables_nulls_repeats_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["node", "sig", "rate", "m_source", "x_sha", "x_part", "c_id", "c_text", "mix_copy", "component_id"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", None, 0), (2, "a b", None, "s", 3), (2, "a b", None, "s", 3), (3, "w " * 60_000, "en", "s", 120_000)], docs.schema)
    odd = odd.select("*", *(F.lit(n).alias(c) for n, c in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {tuple(r[c] for c in names) for r in out.collect()} <= {tuple(range(len(names)))}, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in tokens) == [(0, False), (1, False), (1, False), (2, True), (2, True), (3, True)]
    exact = [(r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, odd, SF).collect()]
    assert sorted((i, norm(t)) for i, t in exact) == [(1, ""), (2, "ab"), (3, "w" * 60_000)]
