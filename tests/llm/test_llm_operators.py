"""The corpus operators against brute force, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe, exact, graph, html, jaccard, mixing, pu, sharding, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, node long"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en", f"s{n % 3}" if n % 7 else None, len(t or ""), 1, 2) for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 300]))] for _ in range(n)]
    for k in range(n // 2):
        copy = list(base[rng.randrange(n // 3)])
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        base.append(copy)
    out = [" ".join(b) for b in base]
    return out + [None, "", "  \t\n", out[5], out[5].upper(), out[9] + " ", "x" * 5000, "ab " * 900]


@pytest.fixture(scope="module")
def mixed(spark):
    return docs_of(spark, some_texts()).cache()


def shingle_sets(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        yield {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_components_equal_all_pairs(spark, mixed):
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    sets = dict(zip((i for i, _ in rows), shingle_sets(t for _, t in rows)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(mixed).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    left = {r.doc_id for r in jaccard.keep_one(mixed).collect()}
    assert left == {i for i in sets if find(i) == i}


def test_strips_of_a_group_all_meet(spark, mixed, monkeypatch):
    want = {r.doc_id: r.component_id for r in jaccard.near_components(mixed).collect()}
    monkeypatch.setattr(jaccard, "STRIP", 1)
    monkeypatch.setattr(jaccard, "STRIP_MEMBERS", 2)
    assert {r.doc_id: r.component_id for r in jaccard.near_components(mixed).collect()} == want


def test_one_signature_of_many_unrelated_sets_makes_no_pair_rows(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "STRIP_MEMBERS", 100)
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 1 << 63, (3000, 16), dtype=np.int64)
    sketch[1500] = sketch[40]
    rows = spark.createDataFrame([(7, i, 3000, i, 600, sketch[i].tolist()) for i in range(3000)], "sig long, node long, size long, comp long, n long, sketch array<long>")
    dealt = jaccard._strips(rows)
    assert dealt.count() == 30 * 3000 and dealt.groupBy("lo", "hi").count().agg(F.max("count")).first()[0] < 300
    near = dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(lambda b: jaccard._close(b, 80), "a long, b long")
    assert [tuple(r) for r in near.collect()] == [(40, 1500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part)], ["k", "m"]) for part in ([(1, 1), (1, 1)], [(1, 1), (1, 2), (2, 2)], [(2, 2)], [(3, 0)])]
    assert [[r["k"] * 10 + r["m"] for r in t.to_pylist()] for t in jaccard._whole_groups(iter(batches), ("k", "m"))] == [[11, 11, 11, 12], [22, 22], [30]]


def test_near_components_of_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    df = docs_of(spark, [text, text, other, other, "q r s t u v"], ids=[7, 3, 7, 5, None])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_components(df).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (7, 3), (5, 3), (None, None)], key=str)
    assert jaccard.near_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("deletions", [None, 1, 2])
def test_every_similar_pair_shares_more_signatures_than_slack(monkeypatch, deletions):
    if deletions is not None:  # the cost model takes none by itself

        def forced(largest, percent=80):
            differ = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
            own = min(deletions, (differ + 1) // 2)
            return differ + 2 - 2 * own, own, 1

        monkeypatch.setattr(jaccard, "allocation", forced)
    rng = np.random.default_rng(3)
    for size in (1, 2, 4, 5, 9, 30, 200, 700):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(10):
            drop, add = rng.integers(0, size // 9 + 1), rng.integers(0, size // 9 + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            sa, sb = (dict(zip(*jaccard.signatures(x))) for x in (a, b))
            shared = Counter(sa[s] >> 32 for s in sa if s in sb)
            slack = {t >> 32: t & 65535 for t in sa.values() if t & 65535}
            assert any(n > slack.get(band, 0) for band, n in shared.items())


def test_hot_signatures_pass_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    sig = [1, 2, 2, *[5] * 13, 6, 7, 7]
    batches = [pa.RecordBatch.from_arrays([pa.array(sig[i : i + 3]), pa.array(range(i, i + len(sig[i : i + 3]))), pa.array([0] * len(sig[i : i + 3]))], ["sig", "node", "tag"]) for i in range(0, len(sig), 3)]
    rows = [r for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
    assert [r["sig"] for r in rows] == [2, 2, *[5] * 13, 7, 7]
    assert {r["sig"]: r["count"] for r in rows} == {2: 2, 5: jaccard.HOT, 7: 2}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 300: 300, 301: 300}


def test_bpe_equals_tiktoken(spark, mixed):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abethinserodlz  '1é€\n\t漢🙂AT<|endoftext|>\x00") for _ in range(rng.randrange(50)))
        ids = codec.encode(text)
        assert [int(x) for x in ids.split()] == real.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    got = {r.doc_id: r for r in bpe.bpe_tokens(mixed, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for r in mixed.collect():
        ids = " ".join(map(str, real.encode_ordinary(r.text or "")))
        assert got[r.doc_id].ids == ids and bytes(got[r.doc_id].decoded) == (r.text or "").encode()
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert got[r.doc_id].n_tokens == len(ids.split())


def test_exact_groups(spark):
    df = docs_of(spark, ["a b", "ab", "a  b", None, "", " \t", "ab ", "A b", "a  b"], ids=[5, 4, 9, 3, 2, 8, 1, 6, 7])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df).collect()}
    assert got == {5: (7, 4, False), 4: (7, 4, False), 9: (7, 4, False), 7: (7, 4, True), 3: (8, 3, False), 2: (8, 3, False), 8: (8, 3, True), 1: (1, 1, True), 6: (6, 1, True)}
    twice = docs_of(spark, ["same", "same", "same ", "other"], ids=[1, 1, None, 1])
    assert sorted((r.doc_id or 0, r.text) for r in exact.drop_exact(twice).collect()) == [(0, "same "), (1, "other")]
    assert exact.exact_groups(docs_of(spark, [])).count() == 0
    assert exact.drop_exact(twice).columns == twice.columns


def test_exact_dedup_of_hot_texts_that_splitters_cut(spark):
    rng = random.Random(8)
    hot = "the same text of many rows"
    texts = [hot + " " * rng.randrange(4) if rng.random() < 0.5 else rng.choice(["", None, "x y", f"t{rng.randrange(40)}", hot + "!"]) for _ in range(600)] + ["w " * 300_000, "w " * 300_000 + " "]
    ids = [rng.choice([None, *range(900)]) if i < 600 else i + 400 for i in range(len(texts))]
    norm = [re.sub(r"[ \t-\r]", "", t or "") for t in texts]
    best, size = {}, Counter(norm)
    for i, t, n in zip(ids, texts, norm):
        best[n] = min(best.get(n, (1, True, 0)), (-len(t or ""), i is None, i or 0))
    df = docs_of(spark, texts, ids).withColumnsRenamed({"sig": "x_sha", "node": "X_part"}).withColumn("c_id", F.lit(3)).repartition(7)
    got = exact.exact_groups(df).collect()
    want = Counter((i, None if best[n][1] else best[n][2], size[n], (-len(t or ""), i is None, i or 0) == best[n], hashlib.sha256(n.encode()).hexdigest()) for i, t, n in zip(ids, texts, norm))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    left = exact.drop_exact(df)
    assert left.columns == df.columns
    rows = left.collect()
    assert sorted((re.sub(r"[ \t-\r]", "", r.text or ""), -len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((n, *k) for n, k in best.items())
    assert {(r.x_sha, r.X_part, r.c_id) for r in rows} == {(1, 2, 3)}
    assert exact.drop_exact(df.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    alphabet = "abcdefgh é"
    passage = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (199, 200, 201, 450)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50, 600))) for _ in range(25)]
    texts = [t[: rng.randrange(len(t))] + rng.choice(passage) + t[rng.randrange(len(t)) :] if i % 2 else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[1], None, "", "z" * 500, passage[3] + passage[3], passage[2]]
    df = docs_of(spark, texts)
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[j : j + 200] for b in raw for j in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(gone.sum()), spans, rest)
        assert got[i].kept_sha256 == hashlib.sha256(rest).hexdigest()
    assert suffix.remove_repeats(docs_of(spark, [])).count() == 0
    repeated = suffix.remove_repeats(docs_of(spark, [passage[3], passage[3], "q" * 100], ids=[1, 1, None])).collect()
    assert sorted(r.n_removed for r in repeated) == [0, len(passage[3].encode()), len(passage[3].encode())]


def test_line_of_many_texts_is_not_held_by_one_task(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, long_line = noise(150), noise(230)
    texts = [noise(220) + (line if i % 3 else long_line) + noise(220) for i in range(60)]
    texts += [texts[0], texts[1], texts[2][100:500], noise(90) + texts[4][170:420] + noise(90), noise(90) + texts[3][:300]]
    raw = [t.encode() for t in texts]
    seen = Counter(b[j : j + 200] for b in raw for j in range(len(b) - 199))
    want = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        want.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    compared = suffix._compared

    def watched(batches):
        held = list(batches)
        together = Counter(x.as_py() for batch in held for x in batch.column("lead"))
        assert max(together.values(), default=0) <= 10, together.most_common(1)
        yield from compared(iter(held))

    monkeypatch.setattr(suffix, "MOST", 10, raising=False)
    monkeypatch.setattr(suffix, "_compared", watched)
    assert [bytes(r.kept) for r in suffix.remove_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()] == want


def test_multikey_order():
    rows = np.random.default_rng(0).integers(0, 3, (500, 16), dtype=np.uint8)
    assert [bytes(r) for r in rows[suffix.multikey_order(rows)]] == sorted(bytes(r) for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a>Home, all</a></li></ul></nav><div class="notice">Accept our cookies, please.</div><div class="main-col"><h2>Big &amp; new</h2><p>First   <b>pa</b>ra with words, and commas, and more of them.</p>
<p>Short.<p>Last paragraph, of some length, as it should be.</div><div class="side-bar sidebar"><p>Related story, with many words. And more, as well.</p></div>
<div id="comments"><p>A reader says, at length, that this is a long comment, indeed.</p></div><form><p>Subscribe now, please, to our letter.</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "Big & new\nFirst para with words, and commas, and more of them.\nShort.\nLast paragraph, of some length, as it should be."
    assert html.main_text(PAGE) == want
    assert html.main_text("<html><body><article><h1>T &lt;x&gt;</h1><p>one<br>two</p></article><aside>no</aside></body></html>") == "T <x>\none\ntwo"
    for page in (None, "", "<", "<script>", "<nav>menu</nav>", "<!-- x", "<p"):
        assert html.main_text(page) in ("", "<", "<p")
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.n_chars for r in html.extract_main(rows).collect())) == [0, 0, len(want)]
    assert html.extract_main(rows.limit(0)).count() == 0


def test_main_text_without_article_keeps_all_content():
    long = "A sentence of the story, with a clause, and more of it. "
    page = "<html><body><div class=menu><a href=/>Home</a></div>{}<div id=footer>Imprint</div></body></html>".format
    items = [f"Item {i}: {long * 2}".strip() for i in range(6)]
    rows = "".join(f"<li>{x}</li>" for x in items)
    for kind in (f"<ul>{rows}</ul>", f"<ol>{rows}</ol>", f"<section>{rows}</section>", f"<dl>{rows.replace('li>', 'dd>')}</dl>", f"<table>{rows.replace('<li>', '<tr><td>').replace('</li>', '</td></tr>')}</table>"):
        for intro in ("An intro.", "An intro, of some length, to the list below, which follows."):
            assert html.main_text(page(f"<div id=content><p>{intro}</p>{kind}<p>The end.</p></div>")) == "\n".join([intro, *items, "The end."])
    lead, story = (long * 3).strip(), (long * 7).strip()
    assert html.main_text(page(f"<div class=lead><p>{lead}</p></div><div class=story><p>{story}</p></div>")) == f"{lead}\n{story}"
    assert html.main_text(page(f"<article class=first><p>{lead}</p></article><article><p>{story}</p></article>")) == f"{lead}\n{story}"
    assert html.main_text(page(f"<p>Home of news</p><article><h1>Title</h1><div><p>{story}</p></div></article>")) == f"Title\n{story}"


def test_main_text_of_the_given_pages_with_and_without_names():
    """The article element, less what is said not to be it, is the text of the given pages; class names are no help there."""
    import html as entities

    import pyarrow.parquet as pq

    whole = right = 0
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        pieces = re.split(r"<(?:/?p|/?h1|br)>", article)
        want = "\n".join(x for x in (" ".join(entities.unescape(re.sub(r"</?b>", "", p)).split()) for p in pieces) if x)
        assert html.main_text(row["html"]) == want
        whole += 1
        right += html.main_text(re.sub(r' (?:class|id)="[^"]*"', "", row["html"])) == want
    assert right >= 0.99 * whole


def test_main_text_without_any_telling_name():
    long = ("A sentence of the story, with a clause, and more of it. " * 4).strip()
    parts = "<div><a href=/>Home</a> <a href=/n>News</a></div><div><h2>Title</h2><p>{0}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul><p>{0}</p></div><div>Imprint of us</div>"
    assert html.main_text(f"<html><body>{parts.format(long)}</body></html>") == f"Title\n{long}\nShort.\nOne\nTwo\n{long}"


def test_main_text_in_wrappers_with_misleading_names():
    long = ("A sentence of the story, with a clause, and more of it. " * 6).strip()
    body = f'<div class="entry-header"><h1>Title</h1></div><p>{long}</p><p>Short.</p><p>{long}</p><div class="sidebar"><p>Related words, more.</p></div>'
    for opening in ('<div class="layout has-sidebar">', '<div class="post-content share-enabled">', "<form>", '<section id="comment-free">'):
        closing = f"</{opening[1:].split()[0].strip('>')}>"
        page = f"<html><body><nav><a>Home</a></nav>{opening}{body}{closing}<footer>x y</footer></body></html>"
        assert html.main_text(page) == f"Title\n{long}\nShort.\n{long}"
    for kind in ("article", "div class=post"):  # a discussion longer than its article
        page = f"<html><body><{kind}><h1>T</h1><p>{long}</p></{kind.split()[0]}><div id=comments>{f'<p>{long}</p>' * 3}</div></body></html>"
        assert html.main_text(page) == f"T\n{long}"


def test_main_text_takes_linear_time():
    import time

    for page in ("<a " * 100_000, "<div>" * 20_000 + "x, y." + "</div>" * 20_000, "<div>" * 20_000 + "</span>" * 20_000, '<a "' * 50_000, "<!--" * 50_000, "<a class" * 50_000 + ">", "<div><p>a, b." * 20_000):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 3


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 64)).astype(np.float32)
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(900, None, 1), (None, vectors[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    codes = vectors > 0
    for q in range(0, 400, 20):
        far = (codes != codes[q]).sum(1)
        want = [(int(far[i]), int(i)) for i in np.lexsort((np.arange(400), far)) if i != q][:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few, k=5).count() == 6
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(100, 64)).astype(np.float32)
    code = {i: sum(1 << b for b in range(64) if v[b] > 0) for i, v in enumerate(vectors)}
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] * 3 + [(0, vectors[0].tolist(), 1)] * 7 + [(5, (-vectors[5]).tolist(), 1), (6, None, 0)]
    code[5] = min(code[5], code[5] ^ ((1 << 64) - 1), key=signed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0 or vec_id = 5"), k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    assert set(got) == {0, 5, 20, 40, 60, 80}
    for q, hits in got.items():
        want = sorted((bin(code[q] ^ code[i]).count("1"), i) for i in code if i != q)[:3]
        assert sorted(hits) == [(n + 1, *w) for n, w in enumerate(want)]


def test_segments_and_masks_of_any_width(spark):
    for n in (1, 300, 50_000, 10**6, 10**9, 10**13):
        parts = topk.segments(n)
        assert parts[0][0] == 0 and sum(w for _, w in parts) == 64 and max(w for _, w in parts) <= max(6, np.log2(n) * 1.5 + 1)
    import math

    for width, radius in ((5, 2), (16, 3), (19, 4), (21, 1), (32, 3)):
        got = spark.range(1).select(topk._masks(width, radius)).first()[0]
        assert len(set(got)) == len(got) == math.comb(width, radius) and all(bin(x).count("1") == radius and x < 1 << width for x in got)
    with pytest.raises(Exception, match="64 components"):
        spark.range(1).select(topk.sign_code(F.array_repeat(F.lit(1.0), 65))).collect()


def test_mixing_hits_its_weights_and_does_not_depend_on_partitioning(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(10 + id % 5 as int)) as text", "case when id % 3 = 0 then null when id % 10 = 1 then 'small' else 'big' end as source", "id as mix_copy")
    weights = {"small": 2.0, "big": 1.0, None: 1.0}
    first = mixing.mix_sources(df, weights)
    size = {r.source: r.s for r in first.groupBy("source").agg(F.sum(F.length("text")).alias("s")).collect()}
    total = sum(size.values())
    assert abs(size["small"] / total - 0.5) < 0.05 and abs(size["big"] / total - 0.25) < 0.05 and abs(size[None] / total - 0.25) < 0.05
    rows = lambda d: sorted((r.doc_id, r.mix_copy) for r in d.collect())
    assert rows(first) == rows(mixing.mix_sources(df.repartition(7), weights))
    positions = [r.mix_position for r in first.collect()]
    assert positions == sorted(positions)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert mixing.mix_sources(docs_of(spark, [None, ""])).count() == 0
    plain = mixing.mix_sources(df, extras=False)
    assert plain.columns == df.columns and all(r.mix_copy == r.doc_id for r in plain.collect())


def test_mixing_returns_the_columns_of_the_caller(spark, monkeypatch):
    names = ["m_source", "m_rate", "m_number", "m_copy", "m_place", "m_salt", "rate", "Amount", "w", "mix_copy"]
    df = spark.range(900).selectExpr("if(id % 50 = 0, null, id) as doc_id", "if(id % 9 = 0, null, 'text of it') as text", "if(id % 4 = 0, null, 's') as source", *(f"id + {i} as {n}" for i, n in enumerate(names)))
    broadcast = mixing.mix_sources(df, {"s": 3.0, None: 40.0}, epochs=4.0, extras=False)
    assert broadcast.columns == df.columns
    rows = sorted(map(str, broadcast.collect()))
    own = {str(r) for r in df.collect()}
    assert rows and set(rows) <= own
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the salted join gives the same rows
    salted = mixing.mix_sources(df, {"s": 3.0, None: 40.0}, epochs=4.0, extras=False)
    assert salted.columns == df.columns and sorted(map(str, salted.collect())) == rows


def test_poisson_inverse(spark):
    import math

    for rate in (0.0, 0.3, 2.5, 16.5, 40.0, 150.0):
        got = spark.range(4000).select(mixing.hashed_poisson(F.col("id"), "t", F.lit(rate)).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(got[0] - rate) < 4 * math.sqrt(rate / 4000) + 1e-9
        assert rate == 0 or 0.8 < got[1] / rate < 1.25


def test_sharding_is_even_and_keeps_copies_together(spark, mixed):
    rows = sharding.shard_documents(mixed).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(rows) == len(texts)
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(8))
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "rows" and r.grown_shard is None for r in rows)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert sum(len(s) - 1 for s in shards.values()) <= 7
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0
    assert sharding.shard_documents(docs_of(spark, ["a", "a", None], ids=[1, 1, None])).count() == 3


def test_sharding_of_very_large_groups(spark):
    rng = random.Random(4)
    texts = ["hot"] * 700 + [f"g{i}" for i in range(40) for _ in range(rng.randrange(2, 30))] + [f"s{i}" for i in range(500)] + [None] * 5
    rng.shuffle(texts)
    rows = sharding.shard_documents(docs_of(spark, texts).withColumnsRenamed({"sig": "key", "node": "shard"})).collect()
    by, shards = Counter(r.shard for r in rows), {}
    assert len(rows) == len(texts) and max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(8))
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    for r in rows:
        shards.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert sum(len(s) - 1 for t, s in shards.items() if t != "hot") <= 2  # only the group of a third of the rows is cut at will


def test_propagation_gathers_linked_nodes_and_its_shards_stand(spark):
    nodes = spark.range(4000).selectExpr("id as node", "if(id < 1500, concat('k', id % 300), concat('s', id)) as key")
    rows = sharding.propagate(nodes, 8).collect()
    held = {}
    for r in rows:
        held.setdefault(r.key, set()).add(r.shard)
    assert all(len(s) == 1 for s in held.values()) and len(rows) == 4000
    start = {r.node: r.shard for r in sharding.propagate(nodes, 8, rounds=0).collect()}
    assert all(start[r.node] == r.shard for r in rows if not r.linked)
    assert 0 < sum(start[r.node] == r.shard for r in rows if r.linked) < 1500
    docs = nodes.selectExpr("node as doc_id", "key as text")
    got = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r.key, set()).add(got[r.node])
    assert all(len(s) == 1 for s in groups.values())


@pytest.mark.parametrize("sf,label,kind,threshold,precision,recall", [("0.01", "quality", "shape", 0.3, 0.97, 0.97), ("0.1", "toxic", "words", 0.5, 0.75, 0.9)])
def test_classifiers_on_held_out_rows(spark, sf, label, kind, threshold, precision, recall):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    scorer = pu.fit_scorer(docs, labels, label, kind)
    scored = pu.score_texts(docs, scorer, threshold)
    both = scored.join(labels, "doc_id").where("held_out")
    got = both.agg(F.avg(F.when(F.col("predicted") == 1, F.col(label))), F.avg(F.when(F.col(label) == 1, F.col("predicted"))), F.avg(label)).first()
    assert got[0] >= precision and got[1] >= recall
    assert abs(scorer.prior - got[2]) < 0.06  # estimated without a label of 0
    assert scored.count() == docs.count()
    odd = docs_of(spark, [None, "", "word " * 20000, "a b c", "d e f"], ids=[None, 1, 1, 7, 7])
    got = pu.score_texts(odd, scorer, threshold).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert pu.fit_scorer(docs, labels.limit(0), label, kind) is None and pu.fit_scorer(docs.limit(0), labels, label, kind) is None
    assert {r.score for r in pu.score_texts(odd, None, 0.5).collect()} == {0.5}
    assert pu.score_texts(odd.limit(0), scorer, threshold).count() == 0
    assert pu.passing(odd, scorer, threshold).columns == odd.columns


def test_scorer_reads_no_label_of_zero_and_no_held_out_row(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    plain = pu.fit_scorer(docs, labels, "quality", "shape")
    for changed in (labels.where("quality = 1"), labels.where(~(fold == 0)), labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality"))), labels.unionAll(labels)):
        again = pu.fit_scorer(docs.withColumn("c_y", F.lit(5)).unionByName(docs.withColumn("c_y", F.lit(5))), changed, "quality", "shape")
        assert np.array_equal(again.weights, plain.weights) and again.prior == plain.prior


def test_class_prior_from_scores():
    rng = np.random.default_rng(1)
    for share in (0.05, 0.3, 0.85):
        positive = rng.normal(2, 1, 3000)
        unlabelled = np.where(rng.random(9000) < share, rng.normal(2, 1, 9000), rng.normal(-2, 1, 9000))
        assert abs(pu.class_prior(positive, unlabelled) - share) < 0.04
