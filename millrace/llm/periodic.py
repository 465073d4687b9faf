"""Runs of words that repeat with a period, of any length, and the texts without their repetitions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .textbytes import blocks, mix, powers

BLOCK_BYTES = 2_000_000
LEAST = 12  # words of a run at least
#: Of each octave of periods: first, past the last, grid of the tiles, words that a tile must have in common with itself a period later.
#: A run has max(period, LEAST - period) positions at least that equal the word a period on, so such a block starts on the grid.
FIRST_OCTAVE = (1, 8, 4, 3)

SPLIT = "doc_id long, key binary, period long, begin long, finish long, words string, sha string"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def octaves(longest: int) -> Iterator[tuple[int, int, int, int]]:
    yield FIRST_OCTAVE
    low = FIRST_OCTAVE[1]
    while 2 * low <= longest:
        yield low, 2 * low, low // 2, low // 2
        low *= 2


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Original positions of the words of a text of n words into which a period is put; None where the text stays (a null id too)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def z_function(x: list, upto: int) -> list[int]:
    """z[i], for i below upto: how many items from i on equal those from the start on."""
    n, z, left, right = len(x), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return out + [n] * (n > 1)


def solve_tile(before: list, after: list, periods: list[int], octave: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int]]:
    """(period, back, forth) around the boundary between two stretches of words: so many positions before it and from it on
    equal the word a period later, back to the grid's last boundary and on to the end of the next one's block at most.

    before: up to a grid of words before the boundary; after: the words that `forth` needs from it on.  The Z-function of
    `after` gives what follows, that of the reversed words what comes before.  A period of which a proper divisor is one too
    is left out: it is no smallest period of any run through this boundary.
    """
    low, high, grid, block = octave
    z = z_function(after, min(high, len(after)))
    head = before[::-1]
    top = min(high - 1, len(after))
    turned = head + [None] + (before + after)[max(len(before) + low - grid, 0) : len(before) + top][::-1]
    y = z_function(turned, len(head) + 2 + top - low)
    for q in periods:
        if z[q] and not any(z[q // r] >= q - q // r for r in _primes(q) if q > 1):
            back = y[len(head) + 1 + top - q] if head and top >= q else 0
            yield q, min(back, len(head)), min(z[q], grid + block)


def tiles(codes: np.ndarray, first: np.ndarray, octave: tuple[int, int, int, int]) -> Iterator[tuple[int, int, list, list, list[int]]]:
    """(text, boundary, words before, words after, periods) of the tiles of all texts whose block at the boundary comes again a
    period later; first: offsets of the texts in codes.  Blocks are told apart by hashes, so a tile may be one too many."""
    low, high, grid, block = octave
    sizes = np.diff(first)
    chosen = np.flatnonzero(sizes >= max(LEAST, 2 * low))
    if not len(chosen):
        return
    rooms = -(-sizes[chosen] // grid) * grid  # every text begins on the grid
    starts = np.concatenate(([0], np.cumsum(rooms)))
    x = -1 - np.arange(starts[-1] + high + block)
    inner = np.arange(sizes[chosen].sum()) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
    x[np.repeat(starts[:-1], sizes[chosen]) + inner] = codes[np.repeat(first[chosen], sizes[chosen]) + inner]
    power, inverse = powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64)) * power, out=total[1:])
    hashes = (total[block:] - total[:-block]) * inverse[: len(x) - block + 1]
    at, period = np.nonzero(sliding_window_view(hashes[low:], high - low)[: starts[-1] : grid] == hashes[: starts[-1] : grid, None])
    at, period = at * grid, period + low
    text = np.searchsorted(starts, at, "right") - 1
    ends = (starts[:-1] + sizes[chosen])[text]
    inside = at + period + block <= ends
    at, period, text, ends = at[inside], period[inside], text[inside], ends[inside]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        c, t = int(at[lo]), int(text[lo])
        before = x[max(c - grid, int(starts[t])) : c].tolist()
        yield int(chosen[t]), c - int(starts[t]), before, x[c : min(c + high - 1 + grid + block, int(ends[lo]))].tolist(), period[lo:hi].tolist()


def fragments(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, period, begin, finish): positions, seen from one tile, that equal the word a period later."""
    for octave in octaves(int(np.diff(first).max(initial=0))):
        for text, boundary, before, after, periods in tiles(codes, first, octave):
            for q, back, forth in solve_tile(before, after, periods, octave):
                yield text, q, boundary - back, boundary + forth


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the texts that have any, and the words of those; of all other texts the hash of the words."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("period", pa.int64()), ("begin", pa.int64()), ("finish", pa.int64()), ("words", pa.string()), ("sha", pa.string())])
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", BLOCK_BYTES):
            ids = part.column("doc_id").to_pylist()
            texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
            words = pc.ascii_split_whitespace(texts)
            owner, words = pc.list_parent_indices(words), words.flatten()
            full = pc.greater(pc.binary_length(words), 0)
            sizes, words = np.bincount(owner.filter(full).to_numpy(), minlength=len(ids)), words.filter(full)
            first = np.concatenate(([0], np.cumsum(sizes)))
            order = np.arange(first[-1])
            for i, doc_id in enumerate(ids):
                at = planted(doc_id, int(sizes[i]))
                if at is not None:
                    order[first[i] : first[i + 1]] = first[i] + at
            words = words.take(pa.array(order))
            found = list(fragments(words.dictionary_encode().indices.to_numpy().astype(np.int64), first))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first), words), pa.scalar(" ", words.type))
            raw = [memoryview(data)[s:e] for s, e in zip(offsets[:-1], offsets[1:])] if len(data) else [b""] * len(ids)
            having = sorted({f[0] for f in found})
            key = {i: hashlib.blake2b(raw[i], digest_size=16, key=str(ids[i]).encode()).digest() for i in having}
            rows = [(ids[i], key[i], q, s, e, None, None) for i, q, s, e in found] + [(ids[i], key[i], None, None, None, joined[i].as_py(), None) for i in having]
            rows += [(ids[i], None, None, None, None, None, hashlib.sha256(joined[i].as_buffer() or b"").hexdigest()) for i in range(len(ids)) if i not in key]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _collapsed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "words", "runs"))):
            words = text.split(" ")
            runs = [(r["begin"], r["period"], r["length"]) for r in runs or ()]
            keep = np.ones(len(words), bool)
            for start, period, length in runs:
                keep[start + period : start + length] = False
            rest = " ".join(np.array(words, object)[keep])
            listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            start, period, length = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
            milli = 1000 * length // period if runs else None
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest)]
            out.append((doc_id, len(runs), start, length, period, milli, *shas, *([rest, [{"start": s, "length": n, "period": q} for s, q, n in runs]] if with_text else [])))
        if out:
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))] * with_text
            names = [c.split(" ")[0] for c in RESULT.split(", ")] + ["collapsed", "runs"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, number of runs, the longest one, and hashes of all runs and of the text without repetitions.

    A run is a longest stretch of at least max(12, 2 q) words with smallest period q; what follows its first q words goes.  Into one
    text of ten, chosen by the id, a period is put first (`planted`).  with_text: all runs and the collapsed text of texts with
    fragments, too (null: the text has no run and stays as it is).

    Texts are exploded into tiles on a grid of half the least period of each octave, so all octaves together cost n log n.  A
    tile is solved by itself if the block at its boundary comes again a period later: Z-functions from the boundary on
    and back give how far each period holds, to the next boundaries at most.  These fragments are shuffled by document and
    period, where overlapping and adjoining ones are stitched to intervals; those long enough are the runs.  Only fragments and the
    words of texts with any are shuffled.  Words are compared by number, so equal means equal.

    Null and empty texts have no words and no run; a null id plants nothing; rows that repeat both id and text get a row each,
    with the same result.  An empty table gives an empty one; other columns are not read, whatever their names.  Memory follows a
    block of texts or the longest text, about 200 bytes a word.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    solved = stored(rows.mapInArrow(_solved, SPLIT), "fragments")
    order = Window.partitionBy("key", "period").orderBy("begin", "finish")
    reach = F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = solved.where("period IS NOT NULL").select("key", "period", "begin", "finish").withColumn("fresh", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("long"))
    pieces = pieces.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = pieces.groupBy("key", "period", "stretch").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish"))
    runs = stretches.where(F.col("finish") - F.col("begin") >= F.greatest("period", F.lit(LEAST) - F.col("period")))
    runs = runs.groupBy(F.col("key").alias("run_key")).agg(F.sort_array(F.collect_list(F.struct("begin", "period", (F.col("finish") - F.col("begin") + F.col("period")).alias("length")))).alias("runs"))
    texts = solved.where("words IS NOT NULL").select("doc_id", "key", "words")
    schema = RESULT + (", collapsed string, runs array<struct<start: long, length: long, period: long>>" if with_text else "")
    done = texts.join(runs, F.col("key") == F.col("run_key"), "left").select("doc_id", "words", "runs").mapInArrow(lambda b: _collapsed(b, with_text), schema)
    none = {c: F.lit(None).cast("long") for c in ("start", "length", "period", "exponent_milli")}
    plain = solved.where("sha IS NOT NULL").select("doc_id", "sha").withColumns({"n_runs": F.lit(0).cast("long"), **none, "runs_sha256": F.sha2(F.lit(""), 256), "collapsed_sha256": F.col("sha")}).drop("sha")
    return done.unionByName(plain, allowMissingColumns=True).withColumnRenamed("doc_id", id_col)
