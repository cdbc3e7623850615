"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as components.

Equal sets are one class. A shingle that a single document holds cannot be shared, so a document with too many of
those has no link; an exchange of hashes finds the rest, the candidates. Their shingles are ordered by frequency, rare
ones first; two linked classes share one of their first few. Classes that meet there directly or through others are
joined together in one task, or in pairs of blocks where they are many.

The join within a task skips by set relations. Inverted lists are cut into blocks by position, and a block is skipped if
its position bounds the overlap below what a link needs. A set then asks its most similar earlier set: what that set's
computed answers exclude by the triangle inequality, and what the two already share a component with, is not verified.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import shards
from gridloom.llm.components import components
from gridloom.llm.words import mix, range_hashes, release_memory, row_slices, slice_hashes, split_words, spread
from gridloom.storage import broadcast_if_small, store

BLOCK_SETS, BLOCK_SHINGLES = 4096, 2_000_000
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their offsets. A-Z are lower-cased."""
    words = split_words(column)
    data = np.where((words.data >= 65) & (words.data <= 90), words.data | 32, words.data)
    hashes = slice_hashes(data, words.start, words.end)
    size = np.diff(words.first)
    count = np.where(size >= n_words, size - n_words + 1, size > 0)
    start = spread(np.arange(len(hashes) + 1), words.first[:-1], count)
    shingles = range_hashes(hashes, start, start + np.repeat(np.minimum(size, n_words), count))
    ends = np.cumsum(count)
    for low, high in zip((ends - count).tolist(), ends.tolist()):
        shingles[low:high].sort()
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = shingles[1:] != shingles[:-1]
    fresh[(ends - count)[count > 0]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    return shingles[fresh], before[np.append(0, ends)]


def signatures(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, whatever the order; 0 for empty sets."""
    sums = [np.append(np.uint64(0), np.cumsum(mix(shingles ^ c))) for c in (np.uint64(0), _OTHER)]
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def component_ids(df: DataFrame, key: str, text: str, n_words: int = 5, percent: int = 75) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key that links reach, of every row.

    Two rows link where 100 * intersection >= ``percent`` * union. Fewer than ``n_words`` words are one shingle; NULL and
    texts without words have no shingle and no link. Rows with equal texts, and repeated rows, are linked. A NULL key is
    never the smallest; a component of NULL keys has NULL. An empty table gives an empty table. Other columns are left
    out. ``df`` must give the same rows in the same order when a lost task reads it again, as a stored table does.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = store(count_unique(source, n_words), "sets")
    filled = counted.filter("n > 0")
    shared = filled.filter(100 * (F.col("n") - F.col("n_unique")) >= percent * F.col("n"))
    classes = shared.groupBy("s1", "s2").agg(F.min("key").alias("key"))
    sets = candidate_sets(source, classes, n_words)
    near = components(spanning_links(sets, percent))
    classed = filled.groupBy("s1", "s2").agg(F.min("key").alias("least"))
    labelled = classed.join(near.select("id.*", "label"), ["s1", "s2"], "left").withColumn(
        "label", F.coalesce("label", F.struct("s1", "s2"))
    )
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = labelled.filter(F.col("label") != F.struct("s1", "s2")).join(roots, "label")
    of_class = of_class.select("s1", "s2", "component_id").union(
        roots.select(F.col("label.s1"), F.col("label.s2"), "component_id")
    )
    joined = filled.join(of_class, ["s1", "s2"], "left").select("key", "n", "component_id")
    alone = counted.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return joined.union(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def count_unique(source: DataFrame, n_words: int) -> DataFrame:
    """Set size, signature, and the shingles that no other row holds, at most: hashes may hide some."""
    n_shards = shards.shard_count(source, F.col("text"))
    kind = source.schema["key"].dataType.simpleString()
    directory = f"key {kind}, n long, s1 long, s2 long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shards.batch_ids()
        for batch in batches:
            for part in row_slices(batch, "text", shards.BATCH_BYTES):
                for low in range(0, part.num_rows, shards.BATCH_TEXTS):
                    yield from _send(part.slice(low, shards.BATCH_TEXTS), next(numbers), n_shards, n_words)
        release_memory()

    def count(rows: pa.Table) -> pa.Table:
        listed = rows.filter(pc.is_valid(rows["n"])).select(names)
        listed = listed.append_column("unique", pa.nulls(listed.num_rows, pa.binary()))
        sent = rows.filter(pc.is_null(rows["n"]))
        if not sent.num_rows:
            return listed
        blobs = shards.unpack(sent["hashes"], np.uint32)
        hashes = np.concatenate(blobs)
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        single = np.ones(len(hashes), bool)
        single[order[1:]] &= ~same
        single[order[:-1]] &= ~same
        answers, at = [], 0
        for blob, runs in zip(blobs, shards.unpack(sent["runs"], np.uint32)):
            texts, sizes = runs[0::2], runs[1::2].astype(np.int64)
            before = np.append(0, np.cumsum(single[at : at + len(blob)]))
            ends = np.cumsum(sizes)
            answers.append(np.column_stack([texts, before[ends] - before[ends - sizes]]).astype(np.uint32).tobytes())
            at += len(blob)
        del hashes, order, single, same
        release_memory()
        empty = {n: pa.nulls(sent.num_rows, rows.schema.field(n).type) for n in names}
        made = pa.table(empty | {"batch": sent["batch"], "unique": pa.array(answers, pa.binary())})
        return pa.concat_tables([listed, made.select(listed.column_names).cast(listed.schema)])

    def add_up(rows: pa.Table) -> pa.Table:
        listed = rows.filter(pc.is_valid(rows["n"]))
        text = listed["text"].to_numpy()
        total = np.zeros(text.max() + 1 if len(text) else 0, np.int64)
        for pairs in shards.unpack(rows["unique"].drop_null(), np.uint32):
            total[pairs[0::2]] += pairs[1::2]
        return listed.select(["key", "n", "s1", "s2"]).append_column("n_unique", pa.array(total[text]))

    names = ["batch", "text", "key", "n", "s1", "s2"]
    sent = source.mapInArrow(send, f"part long, batch long, text long, {directory}, runs binary, hashes binary")
    answered = sent.groupBy("part").applyInArrow(count, f"batch long, text long, {directory}, unique binary")
    return answered.groupBy("batch").applyInArrow(add_up, f"{directory}, n_unique long")


def _send(part: pa.RecordBatch, number: int, n_shards: int, n_words: int) -> Iterator[pa.RecordBatch]:
    n = part.num_rows
    found = [shingle_sets(piece.column("text"), n_words) for piece in row_slices(part, "text")]
    shingles = np.concatenate([s for s, _ in found])
    sizes = np.concatenate([np.diff(f) for _, f in found])
    first = np.append(0, np.cumsum(sizes))
    doc = np.repeat(np.arange(n), sizes)
    s1, s2 = signatures(shingles, first)
    fields = ["part", "batch", "text", "key", "n", "s1", "s2", "runs", "hashes"]
    longs = [np.full(n, number % n_shards + n_shards), np.full(n, number), np.arange(n)]
    none = pa.nulls(n, pa.binary())
    listed = [*map(pa.array, longs), part.column("key"), pa.array(sizes), pa.array(s1), pa.array(s2), none, none]
    yield pa.RecordBatch.from_arrays(listed, fields)
    for shard, at in shards.by_shard(shingles, n_shards):
        texts, counts = np.unique(doc[at], return_counts=True)
        runs = np.column_stack([texts, counts]).astype(np.uint32).tobytes()
        blank = [pa.nulls(1, t) for t in (pa.int64(), part.column("key").type, *[pa.int64()] * 3)]
        sent = [pa.array([runs], pa.binary()), pa.array([shards.low_bits(shingles[at]).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), *blank, *sent], fields)


def candidate_sets(source: DataFrame, classes: DataFrame, n_words: int) -> DataFrame:
    """One stored row per class: ``id`` (its signature), ``n`` and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                shingles, first = shingle_sets(part.column("text"), n_words)
                s1, s2 = signatures(shingles, first)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(shingles.view(np.int64)))
                arrays = [pa.array(s1), pa.array(s2), pa.array(np.diff(first)), lists]
                right = pa.array((s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy()))
                yield pa.RecordBatch.from_arrays(arrays, ["s1", "s2", "n", "shingles"]).filter(right)
        release_memory()

    chosen = broadcast_if_small(store(classes, "classes").withColumnRenamed("key", "rep"))
    texts = source.join(chosen, F.col("key").eqNullSafe(F.col("rep"))).select("text", "s1", "s2")
    made = texts.mapInArrow(run, "s1 long, s2 long, n long, shingles array<long>")
    once = made.groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    return store(once.select(F.struct("s1", "s2").alias("id"), "n", "shingles"), "candidates")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``id`` and ``shingle`` for the first shingles of each set, rare ones first, that other sets hold too."""
    held = sets.select("id", "n", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = (
        held.join(common, "shingle")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    )
    needed = F.ceil(F.col("n") * percent / 100)
    length = F.greatest(F.lit(0), F.col("n") - needed + 1 - (F.col("n") - F.size("own"))).cast("int")
    return ordered.select("id", F.explode(F.slice("own", F.lit(1), length)).alias("e")).select("id", "e.shingle")


def spanning_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that connect what all links of the candidate sets connect."""
    entries = store(prefixes(sets, percent), "prefixes")
    heads = entries.groupBy("shingle").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    meeting = entries.join(heads, "shingle").select(F.col("id").alias("a"), F.col("head").alias("b"))
    coarse = components(meeting)
    placed = sets.join(coarse, "id")
    sizes = coarse.join(sets.select("id", "n"), "id").groupBy("label")
    sizes = store(sizes.agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")), "sizes")
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    total = sizes.agg(F.sum("shingles")).first()[0] or 0
    bins = max(1, -(-total // BLOCK_SHINGLES))
    small = F.struct(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.xxhash64("label").alias("bin"), (F.least(own, other) + 1).alias("i"), (F.greatest(own, other) + 1).alias("j")
        ),
    )
    dealt = (
        placed.join(sizes.select("label", blocks.alias("blocks")), "label")
        .withColumn("task", F.explode(F.when(F.col("blocks") > 1, tasks).otherwise(F.array(small))))
        .select("task.*", "id.s1", "id.s2", "shingles")
    )

    def run(rows: pa.Table) -> pa.Table:
        lists = rows["shingles"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        links = link_sets(lists.flatten().to_numpy(), first.astype(np.int64), percent)
        release_memory()
        sides = [rows.select(["s1", "s2"]).take(pa.array(side)) for side in links]
        names = ("a1", "a2", "b1", "b2")
        return pa.table(dict(zip(names, (sides[0]["s1"], sides[0]["s2"], sides[1]["s1"], sides[1]["s2"]))))

    found = dealt.groupBy("bin", "i", "j").applyInArrow(run, "a1 long, a2 long, b1 long, b2 long")
    one, two = (F.struct(F.col(x + "1").alias("s1"), F.col(x + "2").alias("s2")) for x in "ab")
    return found.select(one.alias("a"), two.alias("b"))


class _Forest:
    """Disjoint sets of small integers, all labels current."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        one, two = int(self.label[a]), int(self.label[b])
        if one == two:
            return False
        if len(self.members[one]) < len(self.members[two]):
            one, two = two, one
        self.label[self.members[two]] = one
        self.members[one] += self.members.pop(two)
        return True


def link_sets(shingles: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the sets ``shingles[first[i]:first[i + 1]]``."""
    n = len(first) - 1
    size = np.diff(first)
    by_size = np.argsort(size, kind="stable")  # a set meets the smaller ones before it
    rank = np.empty(n, np.int64)
    rank[by_size] = np.arange(n)
    _, token, df = np.unique(shingles, return_inverse=True, return_counts=True)
    owner = rank[np.repeat(np.arange(n), size)]
    order = np.lexsort((token, df[token], owner))
    token, df = token[order], df[token[order]]
    size = size[by_size]
    at = np.append(0, np.cumsum(size))
    lists: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    forest, answers, links = _Forest(n), {}, []
    mark = np.zeros(token.max() + 1 if len(token) else 0, bool)
    for y in range(n):
        own = token[at[y] : at[y + 1]]
        prefix = int(size[y] + (-int(size[y]) * percent // 100) + 1)
        hits: dict[int, int] = defaultdict(int)
        for i in np.flatnonzero(df[at[y] : at[y] + prefix] > 1).tolist():
            _probe(lists[int(own[i])], i, int(size[y]), size, percent, hits)
            lists[int(own[i])][i].append(y)
        if not hits:
            continue
        mark[own] = True
        near = np.fromiter(hits, np.int64, len(hits))
        answers[y] = _answer(y, near, hits, mark, token, at, size, percent, forest, answers, links)
        mark[own] = False
    pairs = by_size[np.array(links, np.int64).reshape(-1, 2)]
    return pairs[:, 0], pairs[:, 1]


def _probe(blocks: dict[int, list[int]], i: int, n: int, size: np.ndarray, percent: int, hits: dict[int, int]) -> None:
    """Count the sets of one inverted list that may still link. ``blocks`` holds them by position, sizes ascending."""
    for j, block in blocks.items():
        # The shared shingle is at positions i and j: at most the rest of the shorter remainder overlaps with it. The
        # largest set of the block has the best bound on its own side, the smallest needs the least overlap.
        large, small = int(size[block[-1]]), int(size[block[0]])
        most = min(i, j) + 1 + min(n - i - 1, large - j - 1)
        if most * (100 + percent) < percent * (n + small) or 100 * large < percent * n:
            continue
        for x in block:
            if 100 * int(size[x]) >= percent * n:
                hits[x] += 1


def _answer(y, near, hits, mark, token, at, size, percent, forest, answers, links) -> tuple[np.ndarray, np.ndarray]:
    """Verify what is needed of ``near``; returns the sets verified, and their distances, ascending by set."""
    limit = 1 - percent / 100
    pivot = max(near.tolist(), key=lambda x: (hits[x], -x))
    known = [_distance(y, np.array([pivot]), mark, token, at, size)]
    done = [np.array([pivot])]
    if _linked(known[0], percent)[0]:
        links.append((y, pivot))
        forest.join(y, pivot)
    rest = near[near != pivot]
    rest = rest[forest.label[rest] != forest.label[y]]
    if pivot in answers and len(rest):
        sets, far = answers[pivot]
        place = np.minimum(np.searchsorted(sets, rest), len(sets) - 1)
        bound = np.where(sets[place] == rest, far[place, 0] / far[place, 1], 0) - known[0][0, 0] / known[0][0, 1]
        rest = rest[bound <= limit + 1e-9]
    if len(rest):
        found = _distance(y, rest, mark, token, at, size)
        for x in rest[_linked(found, percent)].tolist():
            if forest.join(y, x):
                links.append((y, x))
        known.append(found)
        done.append(rest)
    sets, far = np.concatenate(done), np.concatenate(known)
    order = np.argsort(sets)
    return sets[order], far[order]


def _distance(y: int, others: np.ndarray, mark: np.ndarray, token: np.ndarray, at: np.ndarray, size: np.ndarray):
    """Union less intersection, and union, of set ``y`` with each of ``others``."""
    held = mark[spread(token, at[others], size[others])]
    shared = np.add.reduceat(held, np.append(0, np.cumsum(size[others])[:-1]), dtype=np.int64)
    union = size[y] + size[others] - shared
    return np.column_stack([union - shared, union])


def _linked(far: np.ndarray, percent: int) -> np.ndarray:
    return 100 * (far[:, 1] - far[:, 0]) >= percent * far[:, 1]
