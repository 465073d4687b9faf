"""How far the vocabularies of sources differ: of every pair of sources, and the terms that set a source off from its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .textbytes import blocks

SCALE = 1_000_000_000
BLOCK_BYTES = 8_000_000
PAIR_BLOCK = 1_000_000  # pairs of present sources that a task evaluates at once
HELD_ROWS = 400_000  # rows that a task reduces to skybands at once
MERGE_WAYS = 16  # second-level skybands of a group
#: Letters A-Z become lower case; other bytes up to 0x7F end a term.
_TERM_BYTES = np.full(256, 32, np.uint8)
_TERM_BYTES[97:123] = np.arange(97, 123)
_TERM_BYTES[65:91] = np.arange(97, 123)
_TERM_BYTES[128:] = np.arange(128, 256)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of every term of a block of texts, its text's number and the term."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_TERM_BYTES[data])])
    words = pc.ascii_split_whitespace(texts)
    parents, words = pc.list_parent_indices(words), words.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    return parents.filter(full).to_numpy(), words.filter(full)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each (lang, source), block by block, and an empty term for every group that occurs."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", BLOCK_BYTES):
            lang, source = (part.column(c).cast(pa.string()).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            groups, group = np.unique(group, return_inverse=True)
            doc, words = _terms(data, offsets)
            words = words.dictionary_encode()
            n_terms = max(len(words.dictionary), 1)
            of_doc, count = np.unique(doc.astype(np.int64) * n_terms + words.indices.to_numpy(), return_counts=True)
            key, at = np.unique(group[of_doc // n_terms] * n_terms + of_doc % n_terms, return_inverse=True)
            n, df = np.bincount(at, count, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            owner = np.concatenate((groups[key // n_terms], groups))
            term = pa.concat_arrays([words.dictionary.take(pa.array(key % n_terms)).cast(pa.string()), pa.array([""] * len(groups), pa.string())])
            zeros = np.zeros(len(groups), np.int64)
            columns = lang.dictionary.take(pa.array(owner // len(source.dictionary))), source.dictionary.take(pa.array(owner % len(source.dictionary))), term
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((df, zeros)))], ["lang", "source", "term", "n", "df"])


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly; without kept terms any positive number will do."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) div CAST(greatest({total} + {kept}, 1) AS DECIMAL(19, 0))")


def _value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _pair_sums(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs of rows of the same term; row i's term has the rows first[i] to first[i] + size[i]."""
    ends = np.cumsum(size)
    start = 0
    while start < len(gid):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIR_BLOCK, "right")), start + 1)
        rows = np.arange(start, stop)
        a = np.repeat(rows, size[rows])
        b = np.arange(len(a)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + first[a]
        other = a != b
        a, b = a[other], b[other]
        pa_, pa0, pb, pb0 = p[a], p0[a], p[b], p0[b]
        gain = (pa_ - pb) ** 2 // pb - (pa_ - pb0) ** 2 // pb0 - (pa0 - pb) ** 2 // pb + (pa0 - pb0) ** 2 // pb0
        keys, at = np.unique(gid[a] << 32 | gid[b], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, gain)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["a", "b", "total"])
        start = stop


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows in the order of terms, what two groups that share a term add to the sums that count each of them alone."""
    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate((h, batch.column(c).to_numpy().astype(np.int64))) for h, c in zip(held, ("tid", "gid", "p", "p0"))]
        whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last term may go on
        yield from _terms_met(*(r[:whole] for r in rows))
        held = [r[whole:] for r in rows]
    yield from _terms_met(*held)


def _terms_met(tid: np.ndarray, gid: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, first, at, size = np.unique(tid, return_index=True, return_inverse=True, return_counts=True)
    if len(tid):
        yield from _pair_sums(gid, p, p0, first[at], size[at])


def skyband(gid: np.ndarray, n: np.ndarray, ln: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that fewer than k rows of their group dominate, by an n no lower, an ln no higher and an earlier term.

    Rows are taken in an order in which dominators come first, so a row is compared with what was kept before it: a row
    that k rows dominate is dominated by k rows of the skyband.
    """
    order = np.lexsort((term, -n, ln, gid))
    gid, n, ln, term = gid[order], n[order], ln[order], term[order]
    cell = np.ones(len(gid), bool)
    cell[1:] = (gid[1:] != gid[:-1]) | (n[1:] != n[:-1]) | (ln[1:] != ln[:-1])
    at = np.arange(len(gid))
    inside = at - np.maximum.accumulate(np.where(cell, at, 0)) < k  # equal counts: the first k terms
    order, gid, n, ln, term = (x[inside] for x in (order, gid, n, ln, term))
    out, cuts = [], np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True]) if len(gid) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        kept = np.arange(lo, min(lo + k, hi))
        for start in range(lo + k, hi, 512):
            new = np.arange(start, min(start + 512, hi))
            above = ((n[kept] >= n[new, None]) & (term[kept] < term[new, None])).sum(1)  # ln is in order
            new, above = new[above < k], above[above < k]
            above += np.tril((n[new] >= n[new, None]) & (term[new] < term[new, None]), -1).sum(1)
            kept = np.concatenate((kept, new[above < k]))
        out.append(order[kept])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _skybands(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The skyband of every group of the task's rows; of a task with many rows, of runs of them."""
    held: list[pa.RecordBatch] = []
    fresh = 0
    for batch in batches:
        held.append(batch)
        fresh += batch.num_rows
        if fresh >= HELD_ROWS:
            held = [_reduced(held, k)]
            fresh = 0
            if held[0].num_rows >= HELD_ROWS:  # so many groups that reducing does not bound them: later tasks do
                yield held.pop()
    if held:
        yield _reduced(held, k)


def _reduced(held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    terms = rows.column("term").combine_chunks()
    rank = np.empty(len(terms), np.int64)
    rank[pc.array_sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
    keep = skyband(*(rows.column(c).to_numpy() for c in ("gid", "n", "ln")), rank, k)
    return rows.take(pa.array(keep)).combine_chunks().to_batches()[0] if len(keep) else held[0].slice(0, 0)


def source_divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = 200, min_docs: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank): of each pair of a language's sources (`pair`) and of each source's own terms (`term`).

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case.  A language keeps the terms of at least
    min_docs documents.  A kept term's share is p = 1 + floor(10^9 (count + 1) / (N + V)), N the group's kept occurrences, V the
    language's kept terms; p against q is floor((p - q)^2 / q).  `pair` sums it over all kept terms, q the other source's share;
    `term` ranks the group's terms with p over the language's q, to `top`.

    Tasks count their texts by block, and Spark adds up: one row a group and term, then one row a kept term with its groups.  A
    sum over all kept terms is that of the groups alone (from how often each share occurs) and a correction by terms that two
    groups share, which tasks add up in blocks, so no pair of rows leaves a task.  For `term`, tasks keep the terms that fewer
    than `top` others dominate by a higher group count, a lower language count and an earlier term; skybands are merged
    and only then ranked.  Neither needs a cap: a term that `top` others dominate cannot be among the first.

    Null text, lang or source counts as ''.  A group without terms has shares like the others, a language that keeps none has
    pairs of value 0.  Rows that repeat an id are documents of their own (the id is not read), other columns are not read
    whatever their names.  An empty table gives an empty one.  Memory follows a block of texts or the longest text, and the
    number of sources of a language, of which the result has the square.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("groups"))
    terms = terms.where((F.col("df") >= min_docs) | (F.col("term") == "")).select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "ln", "groups")
    terms = stored(terms, "terms")
    real = F.col("term") != ""
    langs = terms.groupBy("lang").agg(F.sum(F.when(real, F.lit(1)).otherwise(0)).cast("long").alias("v"), F.sum(F.when(real, F.col("ln")).otherwise(0)).alias("lang_n"))
    present = terms.select("tid", "lang", "term", "ln", F.inline("groups"))
    sizes = present.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.when(real, 1)).alias("own_v"))
    number = F.row_number().over(Window.orderBy("lang", "source"))  # one row a source, of which the result has the square
    groups = stored(sizes.join(langs, "lang").select("lang", "source", number.alias("gid"), "group_n", "own_v", "v", "lang_n", _share("0", "group_n", "v").alias("p0")), "groups")
    shares = present.where(real).join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_n", "v"))

    both = shares.select("tid", "gid", "p", "p0").repartition("tid").sortWithinPartitions("tid")
    both = both.mapInArrow(_met, "a int, b int, total long")
    often = shares.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("m"), F.first("p0").alias("p0")).withColumnRenamed("gid", "h")
    others = groups.select("lang", F.col("gid").alias("o"), F.col("p0").alias("o_p0"), "own_v", "v")
    alone = often.join(others, "lang").where("h <> o")
    owns = alone.groupBy(F.col("h").alias("a"), F.col("o").alias("b")).agg(F.sum(F.col("m") * _value("p", "o_p0")).alias("total"))
    theirs = alone.groupBy(F.col("o").alias("a"), F.col("h").alias("b")).agg(F.sum(F.col("m") * _value("o_p0", "p")).alias("total"))
    mine = groups.select("lang", F.col("gid").alias("a"), F.col("p0").alias("a_p0"), F.col("own_v").alias("a_v"))
    none = mine.join(others, "lang").where("a <> o").select("a", F.col("o").alias("b"), ((F.col("v") - F.col("a_v") - F.col("own_v")) * _value("a_p0", "o_p0")).alias("total"))
    pairs = both.unionByName(owns).unionByName(theirs).unionByName(none).groupBy("a", "b").agg(F.sum("total").alias("value"))
    names = groups.select("gid", "lang", "source")
    pairs = pairs.join(names.withColumnRenamed("gid", "a"), "a").join(names.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")

    high = shares.withColumn("q", _share("ln", "lang_n", "v")).where("p > q")
    bands = high.select("gid", "n", "ln", "term", _value("p", "q").alias("value"))
    bands = bands.mapInArrow(lambda b: _skybands(b, top), bands.schema).withColumn("way", F.spark_partition_id() % MERGE_WAYS)
    bands = bands.repartition("gid", "way").drop("way")
    bands = bands.mapInArrow(lambda b: _skybands(b, top), bands.schema).join(names, "gid").withColumnRenamed("term", "item")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = "lang", "source", "part", "item", "value", "rank"
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(bands.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns))
