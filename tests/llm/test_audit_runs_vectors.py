"""Source divergence, periodic runs and near vectors against brute force and their SQL, and on odd tables."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import normal

from millrace.llm import divergence, periodic, queries, vectors

DOCS = "doc_id long, text string, lang string, source string, term long, gid string, KEY int, words int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, "x", 2, 3) for i, t, la, s in rows], DOCS)


def shares(rows, top=200):
    """The contract, row by row."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, in_docs, groups, out = defaultdict(Counter), defaultdict(Counter), defaultdict(set), []
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(words)
        in_docs[lang].update(set(words))
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 3]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(far)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out)


def skewed_rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ab", "Ba", "é", "漢", "zz", "Q") for b in ("", "x", "yy", "Zé")]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(60)))
        rows.append((i, text.replace(" ", rng.choice([" ", "1", ".\x7f", "_"])), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["hot", "hot", "b", "ç", None, ""])))
    return [*rows, (1, None, "en", "silent"), (None, "only here, twice twice", "xx", "s"), (None, "", "xx", "r"), rows[3], rows[3]]


def test_divergence_equals_the_contract(spark, monkeypatch):
    rows = skewed_rows()
    want = shares(rows)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs_of(spark, rows)).collect())
    assert got == want
    monkeypatch.setattr(divergence, "PAIR_BLOCK", 7)
    monkeypatch.setattr(divergence, "HELD_ROWS", 5)
    few = divergence.source_divergence(docs_of(spark, rows).repartition(5), top=3)
    assert sorted(tuple(r) for r in few.collect()) == shares(rows, 3)
    assert few.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert divergence.source_divergence(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("k", [1, 3, 40])
def test_skyband_keeps_what_fewer_than_k_dominate(k):
    rng = np.random.default_rng(k)
    gid, n, ln = rng.integers(0, 3, 2000), rng.integers(1, 12, 2000), rng.integers(1, 30, 2000)
    term = rng.permutation(2000)
    kept = set(divergence.skyband(gid, n, ln, term, k).tolist())
    above = (gid[:, None] == gid) & (n >= n[:, None]) & (ln <= ln[:, None]) & (term < term[:, None])
    assert kept == set(np.flatnonzero(above.sum(1) < k).tolist())


def test_terms_that_two_batches_cut_meet_once():
    import pyarrow as pa

    tid, gid = [1, 1, 2, 2, 2, 5, 7, 7], [0, 1, 0, 1, 2, 1, 1, 2]
    p, p0 = [50, 60, 10, 20, 30, 9, 80, 7], [5, 6, 5, 6, 7, 6, 6, 7]
    rows = list(zip(tid, gid, p, p0))

    def sums(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], ["tid", "gid", "p", "p0"]) for i in range(0, len(rows), size)]
        out = Counter()
        for b in divergence._met(iter(batches)):
            for r in b.to_pylist():
                out[r["a"], r["b"]] += r["total"]
        return out

    def f(a, b):
        return (a - b) ** 2 // b

    want = Counter()
    for t, a, x, x0 in rows:
        for u, b, y, y0 in rows:
            if t == u and a != b:
                want[a, b] += f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)
    assert sums(1) == sums(3) == sums(8) == want


def runs_of(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                best.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, q, n) for (s, n), q in best.items())


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = periodic.planted(doc_id, len(w))
    w = [w[i] for i in at] if at is not None else w
    runs = runs_of(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    values = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed, rest = "".join(f"{s},{n},{q}\n" for s, q, n in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *values, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest))), rest


def periodic_texts():
    rng = random.Random(6)
    texts = [None, "", " \t\n\x0b\x0c ", "one", "a " * 12, "a " * 11, "a b " * 6, "x " + "a b c d e f g " * 2 + "a", "thue", "é 漢\x85 é 漢\x85 " * 9, "w " * 700]
    thue = [0]
    while len(thue) < 600:
        thue += [1 - x for x in thue]
    texts.append(" ".join("pq"[x] for x in thue))
    fib = ["b", "a"]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    texts.append(" ".join(fib[-1]))
    for _ in range(80):
        w = [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(400))]
        for _ in range(rng.randrange(3)):
            if len(w) > 20:
                a, q = rng.randrange(len(w) - 10), rng.randrange(1, 60)
                for i in range(a + q, min(len(w), a + rng.randrange(2, 9) * q)):
                    w[i] = w[i - q]
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    return texts


def test_runs_equal_the_contract(spark, monkeypatch):
    texts = periodic_texts()
    rows = [(None if i % 17 == 3 else i * 7, t, "en", "s") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (rows[9][0], "other words", "en", "s"), (-4, "a b c " * 30, "en", "s")]
    assert sum(periodic.planted(i, 50) is not None for i, *_ in rows) > 3
    want = Counter(contract(i, t)[0] for i, t, *_ in rows)
    df = docs_of(spark, rows)
    got = periodic.periodic_runs(df)
    assert got.columns == [c.split()[0] for c in periodic.RESULT.split(", ")]
    assert Counter(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(periodic, "BLOCK_BYTES", 300)
    full = periodic.periodic_runs(df.repartition(3), with_text=True).collect()
    assert Counter(tuple(r)[:8] for r in full) == want
    texts_of = {contract(i, t)[0]: contract(i, t)[1] for i, t, *_ in rows}
    assert all(r.collapsed == texts_of[tuple(r)[:8]] for r in full if r.collapsed is not None)
    assert all(len(r.runs) == r.n_runs for r in full if r.runs is not None) and any(r.n_runs > 1 for r in full)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_runs_from_tiles_on_few_letters():
    rng = random.Random(9)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(130))]
        pieces = defaultdict(list)
        for _, q, s, e in periodic.fragments(np.array(w, np.int64), np.array([0, len(w)])):
            pieces[q].append((s, e))
        got = []
        for q, spans in pieces.items():
            covered = sorted({i for s, e in spans for i in range(s, e)})
            ends = [i for i in covered if i + 1 not in set(covered)]
            starts = [i for i in covered if i - 1 not in set(covered)]
            got += [(s, q, e + 1 - s + q) for s, e in zip(starts, ends) if e + 1 - s >= max(q, 12 - q)]
        assert sorted(got) == runs_of(w)


def test_runs_of_a_long_text(spark):
    rng = random.Random(2)
    page = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(2, page + " " + page + " tail", "en", "s"), (5, "a " * 100_000, "en", "s")]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in periodic.periodic_runs(docs_of(spark, rows)).collect()}
    assert got == {2: (1, 0, 60_000, 30_000), 5: (1, 0, 100_000, 1)}


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "STRIP_ROWS", 40)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = []
    for i in range(700):
        v = base[0 if i % 3 == 0 else rng.integers(60)]
        v = v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.35, 0.5])
        rows.append((i + 1000, [float(x) for x in v], int(rng.integers(2)) if i % 3 else 0))
    rows += [(5, rows[3][1], rows[3][2]), (6, None, 1), (7, [], 1), (8, [0.0] * 16, 1), (9, [1.0, None] * 8, 1), (10, [math.nan] * 16, 0), (11, [math.inf] + [1.0] * 15, 0)]
    rows += [(12, [1.0] * 16, None), (13, [1.0] * 16, None), (14, [2.0, 1.0], 1), (15, [4.0, 2.0], 1), (16, [1e-300] * 3, 1), (17, [1e300] * 3, 1), (18, [-1e300] * 3, 1)]
    rows += [(None, [9.0, -1.0, 2.0, 2.0], 7), (None, [9.0, -1.0, 2.0, 2.0], 7), (20, [0.0, 1.0], 3), (20, [-0.0, 1.0], 3), (20, [1.0, 0.0], 3)]

    def cosine(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())

    def fine(r):
        return r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    links = [(a, b) for a, x in enumerate(rows) for b, y in enumerate(rows) if a < b and fine(x) and fine(y) and x[2] == y[2] and len(x[1]) == len(y[1]) and cosine(x[1], y[1]) >= 0.93]
    part, degree = components_of(len(rows), links), Counter(i for pair in links for i in pair)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[part[i]] = min(r[0], least[part[i]] if least[part[i]] is not None else r[0])
    want = Counter((r[0], degree[i], least[part[i]], r[0] == least[part[i]]) for i, r in enumerate(rows))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, KEY string")
    assert Counter(tuple(r) for r in vectors.near_vectors(df).collect()) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0
    short = df.withColumn("embedding", F.col("embedding").cast("array<float>")).where("vec_id BETWEEN 14 AND 15")
    assert sorted(r.n_links for r in vectors.near_vectors(short).collect()) == [1, 1]


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    x = vectors._unit(rng.standard_normal((3000, 64)))
    other = rng.standard_normal((3000, 64))
    other = vectors._unit(other - (other * x).sum(1)[:, None] * x)
    y = 0.9301 * x + math.sqrt(1 - 0.9301**2) * other
    found = vectors.linked(x, y, 0.93)
    assert found.diagonal().mean() >= 0.995
    assert not (found & (x @ y.T < 0.93)).any()
    reach = vectors.calibrated(0.93)[0]
    first = vectors.directions(64)[:, 0]
    assert (np.abs(x @ first - y @ first) <= reach).mean() >= 0.995


def test_a_dense_group_leaves_tasks_as_a_forest(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = (rng.standard_normal(8) + rng.standard_normal((300, 8)) * 0.01).astype(np.float32)
    group = pa.table({"node": np.arange(300), "copies": np.full(300, 2), "vec": [r.tobytes() for r in rows], "dim": np.full(300, 8), "side": np.zeros(300, int), "a": np.zeros(300, int), "b": np.zeros(300, int)})
    out = vectors._met(group, 0.93).to_pylist()
    assert len(out) == 300 and {r["other"] for r in out} == {0} and {r["degree"] for r in out} == {598}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_periodic_runs", "op13_near_vectors"])
def test_new_queries_equal_their_sql(spark, name):
    got = normal(queries.QUERIES[name](spark, SF).toPandas())
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = normal(con.execute(queries.ORACLE_SQL[name]).df())
    assert got.equals(want)
