"""Near duplicates: an exact Jaccard join of word shingles by partitioned signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .store import dropped, stored
from .textbytes import blocks, mix, shingles

#: Similarity in hundredths, words of a shingle, and the growth of size bands.
PERCENT, WORDS, BAND_GROWTH = 80, 5, 1.4
SKETCH_BITS, GROUP_ROWS, HOT = 1024, 50_000, 1 << 40
#: Members of a strip of a group (about); a task compares two strips, or one.
STRIP_MEMBERS = 1024
#: Rows of a strip that are compared with the others at once.
STRIP = 64
_TAG = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def band_edges(growth: float = BAND_GROWTH) -> np.ndarray:
    """Smallest sizes of the bands."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
    return np.array(edges)


@lru_cache(maxsize=4096)
def allocation(largest: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, slack) for pairs whose smaller set has at most `largest` shingles.

    Two linked sets differ in at most D shingles.  An exact segment can be missed by one difference, a one-deletion segment
    by two; so D + 1 + slack misses over all segments leave more than `slack` worth of matches to every linked pair, and
    each set may leave out its `slack` most frequent exact segments in an order that all sets share.  Costs of a set are
    its signatures, and the thin segments (under two shingles, expected in a Poisson spread) that slack does not cover; a thin
    one-deletion segment costs most, as it meets every other one and cannot be left out.
    """
    differ = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
    best = None
    for slack in range(1, 4 + differ // 4):
        for deletions in range(min(3, differ + 1)):
            exact = differ + 1 + slack - 2 * deletions
            if exact < slack:
                continue
            per_segment = largest * 0.85 / (exact + deletions)
            thin = math.exp(-per_segment) * (1 + per_segment)
            cost = exact + deletions * (per_segment + 2 + 40 * thin) + 3 * max(0.0, exact * thin - slack)
            if best is None or cost < best[0]:
                best = cost, (exact, deletions, slack)
    return best[1]


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set (sorted distinct hashes) in the bands of all partners, and their tags: band, and slack or 0.

    Segments are equal ranges of the hash space, so a segment is a slice of the sorted set and its content a sum.
    """
    size, edges = len(hashes), band_edges()
    mixed = mix(hashes ^ np.uint64(0x243F6A8885A308D3))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    band = int(np.searchsorted(edges, size, "right")) - 1
    out, tags = [], []
    while band >= 0 and (edges[band + 1] - 1) * 100 >= percent * size:
        exact, deletions, slack = allocation(int(edges[band + 1]) - 1, percent)
        m = exact + deletions
        cuts = np.searchsorted(hashes, (np.arange(1, m) * (2.0**64 / m)).astype(np.uint64))
        cuts = np.concatenate(([0], cuts, [size]))
        content = total[cuts[1:]] - total[cuts[:-1]]
        label = (np.arange(m, dtype=np.uint64) + np.uint64(band << 40) + np.uint64(1)) * _TAG
        out.append(mix(content * np.uint64(2) + label))
        tags.append(np.where(np.arange(m) < deletions, band << 32, (band << 32) + slack))
        for i in range(deletions):
            rest = content[i] - mixed[cuts[i] : cuts[i + 1]]
            out.append(mix(rest * np.uint64(2) + label[i]))
            tags.append(np.full(len(rest), band << 32))
        band -= 1
    return np.concatenate(out), np.concatenate(tags)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker's memory does not follow the session's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in _slices(batches):
        for rows, data, offsets in blocks(batch, "c_text"):
            hashes, bounds = shingles(data, offsets, words)
            yield rows, [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("c_id"), F.col(text_col).cast("string").alias("c_text"))


def set_digests(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """c_id, n (shingles), h1, h2 (two 64-bit sums over the set), sketch (parities of SKETCH_BITS parts of the set, as longs).

    Each shingle in one set but not the other flips one parity, so two sketches differ in no more bits than the sets differ
    in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches, words):
            n = pa.array([len(s) for s in sets], pa.int64())
            digests = [pa.array(np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in (1, 2)]
            parity = [np.packbits(np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1) for s in sets]
            longs = np.concatenate(parity).astype(np.uint8).view(np.int64)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH_BITS // 64)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(longs))
            yield pa.RecordBatch.from_arrays([rows.column("c_id"), n, *digests, sketch], ["c_id", "n", "h1", "h2", "sketch"])

    return _read(docs, id_col, text_col).mapInArrow(run, "c_id long, n long, h1 long, h2 long, sketch array<long>")


def _signature_rows(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Signatures of the distinct sets of every batch, under the smallest id that has the set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            met: dict[bytes, list] = {}
            for rows, sets in _sets(iter([batch]), words):
                for node, own in zip(rows.column("c_id").to_pylist(), sets):
                    if len(own) and node is not None:
                        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        if digest in met:
                            met[digest][0] = min(met[digest][0], node)
                        else:
                            met[digest] = [node, *signatures(own, percent)]
            found = list(met.values())
            for i in range(0, len(found), 500):
                part = found[i : i + 500]
                nodes = np.repeat(np.array([node for node, _, _ in part], np.int64), [len(sig) for _, sig, _ in part])
                sigs, tags = np.concatenate([sig for _, sig, _ in part]).view(np.int64), np.concatenate([tag for _, _, tag in part]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(nodes), pa.array(tags)], ["sig", "node", "tag"])

    return texts.mapInArrow(run, "sig long, node long, tag long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature, those whose signature is not alone, with the size of their group.

    A group waits for its end in memory, but a group of over GROUP_ROWS goes on at once with the size HOT, as all its rows do.
    """

    def sized(table: pa.Table, hot: int | None) -> Iterator[pa.RecordBatch]:
        sig = table.column("sig").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        count = np.repeat(np.where(sig[first] == hot, HOT, size) if hot is not None else size, size)
        keep = count > 1
        out = table.filter(pa.array(keep)).append_column("count", pa.array(count[keep]))
        yield from out.combine_chunks().to_batches()

    waiting, hot = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("sig")[-1].as_py()
        sig = batch.column("sig").to_numpy()
        cut = int(np.searchsorted(sig, last))
        if cut or (waiting and waiting[-1].column("sig")[-1].as_py() != last):
            yield from sized(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), hot)
            waiting, hot = [], hot if hot == last else None
        waiting.append(batch.slice(cut))
        if sum(b.num_rows for b in waiting) > GROUP_ROWS:
            hot = last
            yield from sized(pa.Table.from_batches(waiting), hot)
            waiting = []
    if waiting:
        yield from sized(pa.Table.from_batches(waiting), hot)


def _set_rows(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches, words):
            lengths = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("c_id"), values], ["node", "items"])

    return texts.mapInArrow(run, "node long, items array<long>")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches leave room for a link: no linked pair is dropped."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("c_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
    flips = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    differ = F.greatest(flips.cast("long"), F.abs(F.col("a_n") - F.col("b_n")))
    return pairs.where(differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by keys in tables that cut no group."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for i, c in enumerate(columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= last is not None and c[0] != last[i]
        starts, last = np.flatnonzero(new), [c[-1] for c in columns]
        cut = int(starts[-1]) if len(starts) else 0
        if len(starts):
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group and pair of strips, the pairs of different components whose sketches leave room for a link: within a
    strip, or across two."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sig, lo, hi, mine, node, n, comp = (table.column(c).to_numpy() for c in ("sig", "lo", "hi", "mine", "node", "n", "comp"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        new = (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        first = np.flatnonzero(np.concatenate(([True], new)))
        found, size = [], 0
        for a, b in zip(first, np.append(first[1:], len(sig))):
            left = right = np.arange(a, b)
            if lo[a] != hi[a]:
                left, right = left[mine[a:b] == lo[a]], right[mine[a:b] == hi[a]]
            for i in range(0, len(left), STRIP):
                x = left[i : i + STRIP]
                flips = np.bitwise_count(sketch[x, None, :] ^ sketch[None, right, :]).sum(2, dtype=np.int64)
                room = flips * (100 + percent) <= (n[x, None] + n[None, right]) * (100 - percent)
                u, v = np.nonzero(room & (comp[x, None] != comp[None, right]))
                if len(u):
                    found.append(np.unique(np.sort(np.stack((node[x[u]], node[right[v]])), 0), axis=1))
                    size += found[-1].shape[1]
                if size > 100_000:  # what has been found leaves at once, so that memory does not follow the group
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for table in _whole_groups(batches, ("sig", "lo", "hi")):
        if table.num_rows:
            yield from pairs(table)


def _strips(pending: DataFrame) -> DataFrame:
    """sig, lo, hi, mine and the columns of pending: each member once for every strip of its group, with the two strips' numbers in order."""
    parts = F.ceil(F.col("size") / STRIP_MEMBERS)
    dealt = pending.withColumn("mine", F.pmod(F.xxhash64("node", F.lit("strip")), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "size")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, by their true intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return both.where(100 * common >= percent * (F.size("a_items") + F.size("b_items") - common)).select("a", "b")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id reachable by links, itself included.

    Rows of equal sets form a class, and its smallest id stands for it, so copies are never compared.  The hash space of
    shingles is cut into segments, as many as the size band needs by the pigeonhole principle with some slack; segments are
    the signatures, with one-deletion neighbourhoods where `allocation` finds these cheaper.  Signatures that two
    classes share are kept; each class leaves out its most frequent ones as far as the slack allows, so boilerplate that
    many documents share is not looked up.  Inside the groups that remain, all members are
    first compared with one leader, the member that shares most signatures with others (an original leads its copies).
    Groups that then still hold several components are cut into strips, and every pair of strips is a task's: it compares sizes
    and parity sketches, and only the pairs that may link leave it, whatever the size of the group.  For these the true sets
    are intersected.  Pairs within a component are never all made, yet no link between components can be missed.

    Null or blank texts have no shingles and link with nothing.  Rows that repeat an id are one document: whatever links
    with one of them is in its component.  A null id belongs to no component (null) unless its text is another's copy.  An empty
    table gives an empty one; other columns are not read, whatever their names.  Memory follows a block of texts or the longest
    text (about 40 bytes a byte).
    """
    digests = stored(set_digests(docs, id_col, text_col, words), "digests")
    full = digests.where("n > 0").select("c_id", "n", "h1", "h2")
    classes = stored(full.groupBy("n", "h1", "h2").agg(F.min("c_id").alias("rep")), "classes")  # written, so that a class of many copies is split in the join
    members = stored(full.join(classes, ["n", "h1", "h2"]).select("c_id", "n", "rep"), "members")
    reps = members.where("c_id = rep").select(F.col("rep").alias("node")).distinct()
    texts = _read(docs, id_col, text_col)
    rows = _signature_rows(texts, words, percent).repartition("sig").sortWithinPartitions("sig")
    met = rows.mapInArrow(_shared, "sig long, node long, tag long, count long").join(reps, "node", "left_semi")
    slack = F.expr("tag & 65535L")
    hottest = Window.partitionBy("node", "tag").orderBy(F.desc("count"), "sig")
    looked_up = stored(met.withColumn("place", F.row_number().over(hottest)).where(F.col("place") > slack).select("sig", "node").distinct(), "looked_up")
    # Sizes are counted before the shuffle and written, so that Spark can split the rows of a hot signature in the join.
    sizes = stored(looked_up.groupBy(F.col("sig").alias("s_sig")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    kept = looked_up.join(sizes, F.col("sig") == F.col("s_sig")).select("sig", "node", "size")
    kept = stored(kept.withColumn("weight", F.sum("size").over(Window.partitionBy("node"))).select("sig", "node", "weight", "size"), "kept")
    dropped(looked_up)
    dropped(sizes)
    nodes = kept.select(F.col("node").alias("c_id")).distinct()
    sketches = stored(digests.join(nodes, "c_id", "left_semi").select("c_id", "n", "sketch").distinct(), "sketches")

    twice = members.groupBy("c_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("c_id", "a")
    links = stored(members.join(twice, "c_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "links")
    def verified(near: DataFrame) -> DataFrame | None:
        if near.isEmpty():
            return None
        wanted = near.select(F.explode(F.array("a", "b")).alias("w_id")).distinct()
        sets = stored(_set_rows(texts.join(wanted, texts["c_id"] == wanted["w_id"], "left_semi"), words), "sets")
        return stored(_linked(near, sets, percent), "links")

    # Every member meets its group's leader.
    place = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("weight"), "node"))
    front = kept.withColumn("place", place).where(F.col("place") == 1)  # pruned in every task before the shuffle
    front = stored(front.select(F.col("sig").alias("f_sig"), F.col("node").alias("leader")), "front")
    pairs = front.join(kept, front["f_sig"] == kept["sig"]).where("leader <> node")
    pairs = stored(pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "pairs")
    more = verified(stored(_possible(pairs, sketches, percent), "near"))
    links = links if more is None else links.unionByName(more)
    labels = components(links)
    # A group is done when no two of its members, the leader aside, differ; strips of the others meet.
    named = kept.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").select("sig", "node", "size", F.coalesce("component", "node").alias("comp"))
    rest = named.join(front, (F.col("sig") == F.col("f_sig")) & (F.col("node") == F.col("leader")), "left_anti")
    open_groups = rest.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("sig")
    pending = stored(rest.join(open_groups, "sig", "left_semi"), "pending")
    dealt = _strips(pending.join(sketches.withColumnRenamed("c_id", "node"), "node").select("sig", "node", "size", "comp", "n", "sketch"))
    dealt = dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    more = verified(stored(dealt.mapInArrow(lambda batches: _close(batches, percent), "a long, b long").distinct(), "near"))
    if more is not None:
        labels = components(links.unionByName(more))
    for done in (pending, pairs, front):
        dropped(done)
    found = members.join(labels, members["rep"] == labels["node"], "left").select("c_id", "n", F.coalesce("component", "rep").alias("component_id"))
    empty = digests.where("n = 0").select("c_id", "n", F.col("c_id").alias("component_id"))
    return found.unionByName(empty).select(F.col("c_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component of near duplicates, columns as they are; rows without a component stay."""
    drop = near_components(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("c_drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["c_drop"], "left_anti")
