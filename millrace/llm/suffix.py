"""Removal of long repeated byte strings by a sparse suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .textbytes import BYTE_VALUES, SECOND_VALUES, blocks, prefix_hash, slice_hash

#: Bytes of a repeated string, and of the strings at which suffixes are sampled.
LENGTH, LEAD = 200, 32
#: Contexts of one lead that a task sorts in memory; the windows of a lead with more are counted one by one.
MOST = 10_000


def sampled_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> dict[str, np.ndarray]:
    """Runs of window starts that sample the same suffix, in texts that lie end to end.

    A window of `length` bytes samples the suffix at its leftmost `lead`-byte string of least hash.  Equal windows sample at
    the same place, so whatever repeats is found from sampled suffixes alone; neighbouring windows mostly share one.
    Gives per run: text, start (of its first window, in the text), n (windows), anchor (of the sampled suffix, from
    start), and hashes of the lead and of all bytes that its windows cover.
    """
    span_of = length - lead + 1
    if len(data) < length:
        return {k: np.zeros(0, np.int64 if k[0] != "h" else np.uint64) for k in ("text", "start", "n", "anchor", "h_lead", "h_all")}
    prefix = prefix_hash(data)
    at = np.arange(len(data) - lead + 1)
    least = hashes = slice_hash(prefix, at, at + lead)
    place, span = at, 1
    while span < span_of:
        step = min(span, span_of - span)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, np.minimum(offsets[:-1], len(place)), 1)
    np.add.at(change, np.minimum(np.maximum(offsets[:-1], offsets[1:] - length + 1), len(place)), -1)
    inside = np.cumsum(change[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    before = np.concatenate(([0], np.cumsum(inside)))
    n = np.diff(np.append(before[start], before[-1]))
    text = np.searchsorted(offsets, start, "right") - 1
    return {
        "text": text, "start": start - offsets[text], "n": n, "anchor": place[start] - start,
        "h_lead": hashes[place[start]], "h_all": slice_hash(prefix, start, start + n - 1 + length),
    }


def _runs(texts: DataFrame, combined: bool) -> DataFrame:
    """Rows of sampled runs; combined: one row for equal ones of a batch, with their number and the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rows, data, offsets in blocks(batch, "c_text"):
                r = sampled_runs(data, offsets)
                rid = rows.column("rid").to_numpy(zero_copy_only=False)[r["text"]]
                parts.append((r["h_lead"].view(np.int64), r["h_all"].view(np.int64), r["n"] << 16 | r["anchor"], rid, r["start"]))
            if not parts:
                continue
            lead, whole, shape, rid, start = (np.concatenate(x) for x in zip(*parts))
            count = np.ones(len(lead), np.int64)
            if combined and len(lead):
                order = np.lexsort((whole, lead))
                first = np.ones(len(order), bool)
                first[1:] = (lead[order][1:] != lead[order][:-1]) | (whole[order][1:] != whole[order][:-1])
                count = np.diff(np.append(np.flatnonzero(first), len(order)))
                lead, whole, shape, rid, start = (x[order[first]] for x in (lead, whole, shape, rid, start))
            arrays = lead, whole, shape.astype(np.int32), rid, start.astype(np.int32), count
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["h_lead", "h_all", "shape", "rid", "start", "count"])

    return texts.mapInArrow(run, "h_lead long, h_all long, shape int, rid long, start int, count long")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the sampled suffixes that are to be sorted, with the bytes at which they begin."""
    for batch in batches:
        for rows, data, offsets in blocks(batch, "c_text"):
            raw, lead, all_bytes, out = data.tobytes(), [], [], []
            for i, (rid, wanted) in enumerate(zip(rows.column("rid").to_pylist(), rows.column("wanted").to_pylist())):
                for w in wanted or ():
                    begin = int(offsets[i]) + w["start"]
                    n, anchor = w["shape"] >> 16, w["shape"] & 65535
                    lead.append(raw[begin + anchor : begin + anchor + LEAD])
                    all_bytes.append(raw[begin : begin + n - 1 + LENGTH])
                    out.append((rid, w["start"], w["shape"], w["single"]))
            if out:
                columns = [pa.array(lead, pa.binary()), pa.array(all_bytes, pa.binary()), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.bool_())))]
                yield pa.RecordBatch.from_arrays(columns, ["lead", "bytes", "rid", "start", "shape", "single"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 hash bits of every window of the wanted runs."""
    for batch in batches:
        for rows, data, offsets in blocks(batch, "c_text"):
            found = zip(offsets.tolist(), rows.column("rid").to_pylist(), rows.column("wanted").to_pylist())
            runs = [(begin, rid, w["start"], w["shape"] >> 16, w["single"]) for begin, rid, wanted in found for w in wanted or ()]
            if not runs:
                continue
            begin, rid, start, n, single = map(np.array, zip(*runs))
            s = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(begin, n) + s
            w1, w2 = (slice_hash(prefix_hash(data, values), at, at + LENGTH).view(np.int64) for values in (BYTE_VALUES, SECOND_VALUES))
            arrays = w1, w2, np.repeat(rid, n), s.astype(np.int32), np.repeat(single, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["w1", "w2", "rid", "s", "single"])


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix (width a multiple of 8): eight bytes at a time, only ties are sorted further."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    open_ = np.arange(len(rows))
    for j in range(words.shape[1]):
        if not len(open_):
            break
        key = words[order[open_], j]
        inner = np.lexsort((key, group[open_]))
        order[open_] = order[open_][inner]
        key, own = key[inner], group[open_]
        head = np.ones(len(open_), bool)
        head[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))]
        tied = ~head
        tied[:-1] |= ~head[1:]
        open_ = open_[tied]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in order; -1 for the first."""
    out = np.full(len(order), -1)
    for i in range(1, len(order), 20_000):
        end = min(i + 20_000, len(order))
        differ = rows[order[i - 1 : end - 1]] != rows[order[i:end]]
        out[i:end] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def repeated_windows(contents: list[bytes], n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For the windows of all runs, run after run: whether an equal window lies in another run.

    The suffixes at the anchors are sorted, and so are the bytes before them read backwards.  A window takes some bytes
    to the left of the anchor and the rest to the right; windows are equal if neither order has a shorter common prefix
    between them.
    """
    reach = LENGTH - LEAD + 8 - (LENGTH - LEAD) % 8
    right, left = np.zeros((len(contents), LENGTH), np.uint8), np.zeros((len(contents), reach), np.uint8)
    for i, content in enumerate(contents):
        b = np.frombuffer(content, np.uint8)
        after, before = b[anchor[i] : anchor[i] + LENGTH], b[max(0, anchor[i] - reach) : anchor[i]][::-1]
        right[i, : len(after)], left[i, : len(before)] = after, before
    ranks = []
    for rows in (right, left):
        order = multikey_order(rows)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks.append((place, _common(rows, order)))
    (r_place, r_common), (l_place, l_common) = ranks
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(first[-1], bool)
    for taken in range(int(anchor.max()) + 1 if len(anchor) else 0):
        own = np.flatnonzero((taken <= anchor) & (taken > anchor - n))
        if len(own) < 2:
            continue
        key = np.cumsum(r_common < LENGTH - taken)[r_place[own]] * (len(contents) + 1) + np.cumsum(l_common < taken)[l_place[own]]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        out[first[own] + anchor[own] - taken] = count[inverse] > 1
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of window starts that repeat, of the runs which occur once; input is sorted by lead."""

    def spans(table: pa.Table) -> pa.RecordBatch | None:
        shape = table.column("shape").to_numpy().astype(np.int64)
        n, anchor = shape >> 16, shape & 65535
        again = repeated_windows(table.column("bytes").to_pylist(), n, anchor) & np.repeat(table.column("single").to_numpy(zero_copy_only=False), n)
        run = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        head = again.copy()
        head[1:] &= ~again[:-1] | (run[1:] != run[:-1])
        tail = again.copy()
        tail[:-1] &= ~again[1:] | (run[1:] != run[:-1])
        head, tail = np.flatnonzero(head), np.flatnonzero(tail)
        if not len(head):
            return None
        start = table.column("start").to_numpy().astype(np.int64)[run[head]]
        arrays = table.column("rid").to_numpy()[run[head]], (start + offset[head]).astype(np.int32), (start + offset[tail] + 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rid", "s", "e"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("lead")[-1]
        same = np.array([x == last for x in batch.column("lead")])
        cut = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if cut or (waiting and waiting[-1].column("lead")[-1] != last):
            done = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            if (out := spans(done)) is not None:
                yield out
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting and (out := spans(pa.Table.from_batches(waiting))) is not None:
        yield out


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in blocks(batch, "c_text"):
            raw, out = data.tobytes(), []
            for i, found in enumerate(rows.column("spans").to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                kept, end, removed, n_spans = [], 0, 0, 0
                for s, e in sorted((f["s"], f["e"] - 1 + LENGTH) for f in found or ()):
                    if s > end or not n_spans:
                        kept.append(text[end:s])
                        n_spans += 1
                        removed += e - s
                    else:
                        removed += max(0, e - end)
                    end = max(end, e)
                kept.append(text[end:])
                rest = b"".join(kept)
                out.append((len(text), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            types = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([rows.column("c_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["c_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _numbered(texts: DataFrame) -> DataFrame:
    """c_id, rid, c_text: the same rid for rows of the same id and text, another one for all others."""
    keyed = texts.withColumn("c_key", F.unhex(F.md5("c_text")))
    numbers = stored(keyed.groupBy("c_id", "c_key").agg(F.lit(1).alias("one")).select(F.col("c_id").alias("n_id"), F.col("c_key").alias("n_key"), F.monotonically_increasing_id().alias("rid")), "numbers")
    return keyed.join(numbers, F.col("c_id").eqNullSafe(F.col("n_id")) & (F.col("c_key") == F.col("n_key"))).select("c_id", "rid", "c_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes, `kept`) of every row.

    Removed is every byte that lies in a 200-byte string which starts anywhere else too, in any text or the same one.

    Only sampled suffixes are sorted: each 200-byte window samples one by content, and a run of windows that share their
    suffix is one row.  Runs whose bytes occur twice as a whole are settled by counting, combined before the shuffle, so
    that thousands of copies are one row.  Where runs share the first bytes of their suffix and nothing more is known, one of
    each content is range-partitioned by these bytes (splitters are sampled, equal first bytes never part), sorted by
    suffix in its bucket, and compared with its neighbours.  First bytes with over MOST contents, as in a line that many
    texts share, are left out there: their windows are counted by 128 hash bits, so that no task holds them together.
    Spans then return to their texts.

    Null counts as empty.  Rows that repeat an id stay apart: if any id repeats or is null, each different pair of id and text
    (by 128 bits) gets a number, by which its rows are known, and wholly equal rows get equal results.  An empty table gives an
    empty one; other columns are not read, whatever their names.  Memory follows a block of texts or the longest text, about
    70 bytes a byte.
    """
    repeated = docs.groupBy(id_col).count().where(F.col("count") > 1).isEmpty() is False or not docs.where(F.col(id_col).isNull()).isEmpty()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("c_id"), text.alias("c_text"))
    texts = _numbered(texts) if repeated else texts.select("c_id", F.col("c_id").alias("rid"), "c_text")
    slim = texts.select("rid", "c_text")
    known = _runs(slim, True).repartition("h_lead").groupBy("h_lead", "h_all", "shape").agg(F.sum("count").alias("n"), F.min("rid").alias("rid"), F.min_by("start", "rid").alias("start"))
    lead = Window.partitionBy("h_lead")
    known = known.withColumns({
        "mixed": (F.min("h_all").over(lead) != F.max("h_all").over(lead)) & (F.min("n").over(lead) == 1), "hot": F.count(F.lit(1)).over(lead) > MOST,
    })
    known = stored(known.where("n > 1 or mixed"), "known")

    def wanted(which: str) -> DataFrame:
        runs = known.where(which).select("rid", "start", "shape", (F.col("n") == 1).alias("single"))
        return runs.groupBy("rid").agg(F.collect_list(F.struct("start", "shape", "single")).alias("wanted"))

    # All joins with the texts read the same columns of all rows, so that the texts are shuffled once.
    contexts = texts.join(wanted("mixed and not hot").hint("merge"), "rid", "left").mapInArrow(_contexts, "lead binary, bytes binary, rid long, start int, shape int, single boolean")
    compared = contexts.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_compared, "rid long, s int, e int")
    twice = known.where("n > 1").select("h_lead", "h_all")
    again = _runs(slim, False).join(twice.hint("merge"), ["h_lead", "h_all"], "left_semi")
    again = again.select("rid", F.col("start").alias("s"), (F.col("start") + F.shiftright("shape", 16)).alias("e"))
    found = again.unionByName(compared)
    if not known.where("mixed and hot").isEmpty():
        windows = texts.join(wanted("mixed and hot").hint("merge"), "rid", "left").mapInArrow(_windows, "w1 long, w2 long, rid long, s int, single boolean")
        many = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        found = found.unionByName(windows.where("single").join(many.hint("merge"), ["w1", "w2"], "left_semi").select("rid", "s", (F.col("s") + 1).alias("e")))
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = texts.join(spans.hint("merge"), "rid", "left").select("c_id", "c_text", "spans")
    out = joined.mapInArrow(lambda batches: _cut(batches, with_text), "c_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("c_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
