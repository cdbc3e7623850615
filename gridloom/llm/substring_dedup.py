"""Removal of word passages that occur elsewhere, by suffix automata of reference shards.

Every window of ``window`` words is exchanged as a hash. Where a hash occurs twice, its first place becomes reference,
and runs of windows that agree with a run of reference ask for it. Reference regions are dealt to shards of bounded
size; each shard is a suffix automaton, and the passages that ask for it stream through. Their matching statistics, not
the hashes, tell which windows occur there; these are removed, and so are the windows of the reference they met.

A window may share its hash with another one that came first, and then finds itself nowhere in the reference, though it
may occur again with the same fate. Those windows, of which there are few, are compared with each other word by word.

The reference grows with the corpus, so an automaton is not broadcast: it is built in the task that the passages of its
shard are dealt to, and again in further tasks where one shard draws many passages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import shards
from gridloom.llm.words import range_hashes, release_memory, row_slices, split_words, spread, word_hashes
from gridloom.storage import broadcast_if_small, store

REFERENCE_WORDS = 1 << 16  # per automaton
STREAM_WORDS = 1 << 19  # per task


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts fare alike, so passages are kept once for all copies."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def deduplicate(
    df: DataFrame,
    key: str,
    text: str,
    window: int = 35,
    rejoin: bool = True,
    carry: Sequence[str] = (),
    bits: int = 32,
) -> DataFrame:
    """``key``, the columns ``carry``, ``n_words``, ``n_removed`` and the kept ``text`` of every row.

    A word goes if a window that covers it starts anywhere else too, be it in the same row, by the texts as given. Kept
    words are joined by one space; with ``rejoin`` off, a text that loses nothing stays as it is. NULL is the empty text
    (NULL again with ``rejoin`` off). Texts shorter than the window lose nothing. Keys may be NULL or repeated; equal
    rows are repetitions of each other. An empty table gives an empty table. Other columns are left out. ``df`` must give
    the same rows in the same order when a lost task reads it again, as a stored table does. ``bits`` of the hashes are
    exchanged within a shard; fewer leave more windows to the comparison by words, and the result as it is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    extra = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *text_key(body), *extra)
    matches = store(find_matches(source, window, bits), "matches")
    verified = store(verify_matches(source, matches, window), "spans")
    spans = verified.filter("window IS NULL").select("k1", "k2", "low", "high")
    open_ = verified.filter("window IS NOT NULL")
    if open_.limit(1).count():
        spans = store(spans.union(repeated_windows(open_)), "all_spans")
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    cut = remove_spans(source, by_text if _large(spans) else F.broadcast(by_text), rejoin)
    names = {"key": key, **{f"_{i}": c for i, c in enumerate(carry)}, "n_words": "n_words", "n_removed": "n_removed"}
    return cut.select(*(F.col(old).alias(new) for old, new in names.items()), F.col("text").alias(text))


def _large(rows: DataFrame) -> bool:
    """Too many rows to broadcast what they are grouped to."""
    return broadcast_if_small(rows) is rows


def repeated_windows(open_: DataFrame) -> DataFrame:
    """Spans of the windows that stand at two places or more: ``window`` is the words of one, ``copies`` counts its text."""
    once = open_.dropDuplicates(["k1", "k2", "low"])
    twice = once.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window")
    return once.join(twice, "window").select("k1", "k2", "low", "high")


def find_matches(source: DataFrame, window: int, bits: int = 32) -> DataFrame:
    """Runs of ``length`` windows from word ``start`` of a text that have the hashes of a run of the reference text.

    Columns ``d1``, ``d2``, ``start``, ``length``, ``c1``, ``c2``, ``c_start``. Equal texts give equal rows, kept once.
    """
    n_shards = shards.shard_count(source, F.col("text"))
    listing = "k1 long, k2 long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shards.batch_ids()
        for batch in batches:
            for part in row_slices(batch, "text", shards.BATCH_BYTES):
                for low in range(0, part.num_rows, shards.BATCH_TEXTS):
                    yield from _send(part.slice(low, shards.BATCH_TEXTS), next(numbers), n_shards, window, bits)
        release_memory()

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("batch")
        listed = rows.filter(pc.is_valid(rows["k1"])).select(["batch", "text", "k1", "k2"])
        sent = rows.filter(pc.is_null(rows["k1"]))
        replies = _first_places(sent) if sent.num_rows else []
        release_memory()
        blank = {n: pa.nulls(len(replies), pa.int64()) for n in ("text", "k1", "k2")}
        made = {"batch": pa.array([b for b, _ in replies], pa.int64()), "reply": pa.array([r for _, r in replies], pa.binary())}
        listed = listed.append_column("reply", pa.nulls(listed.num_rows, pa.binary()))
        return pa.concat_tables([listed, pa.table(made | blank).select(listed.column_names).cast(listed.schema)])

    def runs(rows: pa.Table) -> pa.Table:
        listed = rows.filter(pc.is_valid(rows["k1"])).select(["batch", "text", "k1", "k2"])
        blobs = rows["reply"].drop_null().to_pylist()
        at = np.concatenate([np.frombuffer(b, PLACES) for b in blobs]) if blobs else np.empty(0, PLACES)
        at = np.sort(at, order=["text", "word"], kind="stable")
        broken = np.ones(len(at), bool)
        for name, step in (("text", 0), ("word", 1), ("c_batch", 0), ("c_text", 0), ("c_word", 1)):
            moved = at[name][1:].astype(np.int64) - at[name][:-1].astype(np.int64) != step
            broken[1:] = moved if name == "text" else broken[1:] | moved
        first = np.flatnonzero(broken)
        length = np.diff(np.append(first, len(at)))
        batch = rows["batch"][0].as_py()
        found = {
            "batch": pa.array(np.full(len(first), batch)),
            "text": pa.array(at["text"][first].astype(np.int64)),
            "start": pa.array(at["word"][first].astype(np.int64)),
            "length": pa.array(length.astype(np.int64)),
            "c_batch": pa.array(at["c_batch"][first]),
            "c_text": pa.array(at["c_text"][first].astype(np.int64)),
            "c_start": pa.array(at["c_word"][first].astype(np.int64)),
        }
        names = ("batch", "text", "k1", "k2", "start", "length", "c_batch", "c_text", "c_start")
        parts = [listed.to_pydict() and {n: listed[n] for n in listed.column_names}, found]
        size = (listed.num_rows, len(first))
        full = [{n: p.get(n, pa.nulls(k, pa.int64())) for n in names} for p, k in zip(parts, size)]
        return pa.concat_tables([pa.table(f) for f in full])

    sent = source.select("text", "k1", "k2").mapInArrow(
        send, f"part long, batch long, text long, {listing}, runs binary, hashes binary, words binary"
    )
    answered = sent.groupBy("part").applyInArrow(answer, f"batch long, text long, {listing}, reply binary")
    found = answered.groupBy("batch").applyInArrow(
        runs, f"batch long, text long, {listing}, start long, length long, c_batch long, c_text long, c_start long"
    )
    found = store(found, "runs")
    texts = found.filter("length IS NULL").select("batch", "text", "k1", "k2")
    own = texts.toDF("batch", "text", "d1", "d2")
    other = texts.toDF("c_batch", "c_text", "c1", "c2")
    joined = found.filter("length IS NOT NULL").drop("k1", "k2").join(own, ["batch", "text"])
    return joined.join(other, ["c_batch", "c_text"]).select(
        "d1", "d2", "start", "length", "c1", "c2", "c_start"
    ).distinct()


#: A window that is not the first of its hash, and the place of the first.
PLACES = np.dtype([("text", "<u4"), ("word", "<u4"), ("c_text", "<u4"), ("c_word", "<u4"), ("c_batch", "<i8")])


def _send(part: pa.RecordBatch, number: int, n_shards: int, window: int, bits: int) -> Iterator[pa.RecordBatch]:
    n = part.num_rows
    pieces = [split_words(p.column("text")) for p in row_slices(part, "text")]
    hashes = np.concatenate([word_hashes(w) for w in pieces])
    first = np.append(0, np.cumsum(np.concatenate([np.diff(w.first) for w in pieces])))
    count = np.maximum(np.diff(first) - window + 1, 0)
    start = spread(np.arange(len(hashes) + 1), first[:-1], count)
    doc = np.repeat(np.arange(n), count)
    keys = range_hashes(hashes, start, start + window)
    fields = ["part", "batch", "text", "k1", "k2", "runs", "hashes", "words"]
    none = pa.nulls(n, pa.binary())
    longs = [np.full(n, number % n_shards + n_shards), np.full(n, number), np.arange(n)]
    listed = [*map(pa.array, longs), part.column("k1"), part.column("k2"), none, none, none]
    yield pa.RecordBatch.from_arrays(listed, fields)
    word = (start - first[doc]).astype(np.uint32)
    for shard, at in shards.by_shard(keys, n_shards):
        texts, counts = np.unique(doc[at], return_counts=True)
        sent = [np.column_stack([texts, counts]).astype(np.uint32), shards.low_bits(keys[at], bits), word[at]]
        blobs = [pa.array([b.tobytes()], pa.binary()) for b in sent]
        blank = [pa.nulls(1, pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), *blank, *blobs], fields)


def _first_places(sent: pa.Table) -> list[tuple[int, bytes]]:
    """For each batch, its windows that repeat an earlier hash of the shard. Order: batch, then place."""
    batches = sent["batch"].to_numpy()
    blobs = shards.unpack(sent["hashes"], np.uint32)
    hashes = np.concatenate(blobs)
    row = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(b) for b in blobs])
    runs = np.concatenate(shards.unpack(sent["runs"], np.uint32)).reshape(-1, 2)
    text = np.repeat(runs[:, 0], runs[:, 1])
    word = np.concatenate(shards.unpack(sent["words"], np.uint32))
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    again, first = order[~fresh], first[~fresh]
    back = np.argsort(again)
    again, first = again[back], first[back]
    places = np.empty(len(again), PLACES)
    places["text"], places["word"] = text[again], word[again]
    places["c_text"], places["c_word"], places["c_batch"] = text[first], word[first], batches[row[first]]
    edges = np.searchsorted(row[again], np.arange(len(blobs) + 1))
    return [(int(batches[i]), places[edges[i] : edges[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(edges))]


class SuffixAutomaton:
    """Of a sequence of integers. ``first_end[v]`` is where the strings of state v end first."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]

    def extend(self, symbols: list[int]) -> None:
        step, link, length, first_end = self.next, self.link, self.length, self.first_end
        last = len(step) - 1 if len(step) == 1 else self._last
        for symbol in symbols:
            state = len(step)
            step.append({})
            length.append(length[last] + 1)
            first_end.append(length[last])
            link.append(0)
            p = last
            while p >= 0 and symbol not in step[p]:
                step[p][symbol] = state
                p = link[p]
            if p >= 0:
                q = step[p][symbol]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    first_end.append(first_end[q])
                    link.append(link[q])
                    while p >= 0 and step[p].get(symbol) == q:
                        step[p][symbol] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        self._last = last

    def matches(self, symbols: list[int], least: int) -> Iterator[tuple[int, int]]:
        """Places i where the longest suffix of ``symbols[: i + 1]`` known here has ``least`` symbols or more, each
        with the first end of its last ``least`` symbols in the automaton's own sequence."""
        step, link, length, first_end = self.next, self.link, self.length, self.first_end
        state = size = 0
        for i, symbol in enumerate(symbols):
            while state and symbol not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(symbol, 0)
            size = size + 1 if state else 0
            while size > least and length[link[state]] >= least:
                state = link[state]
                size = length[state]
            if size >= least:
                yield i, first_end[state]


def verify_matches(source: DataFrame, matches: DataFrame, window: int) -> DataFrame:
    """Word spans ``low``..``high`` to remove from the texts ``k1``, ``k2``; and the windows of passages that met nothing.

    These come with the hashes of their words as ``window`` and the number of rows of their text as ``copies``.
    """
    extra = window - 1
    total = matches.agg(F.sum(F.col("length") + extra)).first()[0] or 0
    n_shards = max(1, -(-total // REFERENCE_WORDS))  # more than the reference needs, as passages repeat
    asked = cut_at_blocks(matches).withColumn("shard", F.pmod(F.xxhash64("c1", "c2", "block"), F.lit(n_shards)))
    load = asked.groupBy("shard").agg(F.ceil(F.sum(F.col("length") + extra) / STREAM_WORDS).cast("int").alias("subs"))
    asked = store(asked.join(broadcast_if_small(store(load, "load")), "shard"), "asked")
    stream = asked.select(
        F.col("d1").alias("k1"),
        F.col("d2").alias("k2"),
        F.struct(
            F.lit(False).alias("reference"), "start", (F.col("length") + extra).alias("words"), "shard",
            F.pmod(F.xxhash64("d1", "d2", "start"), F.col("subs")).cast("int").alias("sub"),
        ).alias("cut"),
    ).distinct()
    # Regions of one text are merged when they are cut; distinct ones only are counted here.
    regions = asked.select("c1", "c2", "c_start", "length", "shard", "subs").distinct()
    regions = regions.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(
        F.col("c1").alias("k1"),
        F.col("c2").alias("k2"),
        F.struct(
            F.lit(True).alias("reference"), F.col("c_start").alias("start"), (F.col("length") + extra).alias("words"),
            "shard", "sub",
        ).alias("cut"),
    )
    wanted = stream.union(regions)
    cuts = wanted.groupBy("k1", "k2").agg(F.collect_list("cut").alias("cuts"))
    reps = source.groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    cuts = cuts.join(reps, ["k1", "k2"])
    side = cuts if _large(asked) else F.broadcast(cuts)
    chosen = source.join(side, ["k1", "k2"]).filter(F.col("key").eqNullSafe(F.col("rep"))).select("text", "k1", "k2", "copies", "cuts")
    passages = chosen.mapInArrow(
        lambda batches: cut_passages(batches, window),
        "shard long, sub int, reference boolean, k1 long, k2 long, start long, copies long, asked binary, words binary",
    ).dropDuplicates(["shard", "sub", "reference", "k1", "k2", "start"])
    return passages.groupBy("shard", "sub").applyInArrow(
        lambda rows: match_shard(rows, window), "k1 long, k2 long, low long, high long, copies long, window binary"
    )


def cut_at_blocks(matches: DataFrame) -> DataFrame:
    """The matches cut where their reference starts a new ``block`` of REFERENCE_WORDS windows of its text.

    Each window belongs to the block in which it starts, so neighbouring pieces share window - 1 words.
    """
    last = F.col("c_start") + F.col("length") - 1
    blocks = F.sequence(F.floor(F.col("c_start") / REFERENCE_WORDS), F.floor(last / REFERENCE_WORDS))
    cut = matches.withColumn("block", F.explode(blocks))
    low = F.greatest("c_start", F.col("block") * REFERENCE_WORDS)
    high = F.least(last, (F.col("block") + 1) * REFERENCE_WORDS - 1)
    return cut.select(
        "d1", "d2", (F.col("start") + low - F.col("c_start")).alias("start"), (high - low + 1).alias("length"),
        "c1", "c2", low.alias("c_start"), "block",
    )


def cut_passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the words of the wanted passages; overlapping ones for the same task are one.

    Reference becomes one only where runs of windows touch. Where words alone do, the windows between may not be first
    places, and the automaton would hold them twice. Of a passage, ``asked`` lists the runs of windows that ask: one in
    between may itself be a first place, and must not meet itself.
    """
    names = ["shard", "sub", "reference", "k1", "k2", "start", "copies", "asked", "words"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
    for batch in batches:
        for part in row_slices(batch, "text"):
            words = split_words(part.column("text"))
            hashes = word_hashes(words)
            out = []
            rows = zip(words.first.tolist(), *(part.column(n).to_pylist() for n in ("k1", "k2", "copies", "cuts")))
            for base, k1, k2, copies, cuts in rows:
                merged: list[list] = []
                for c in sorted(cuts, key=lambda c: (c["shard"], c["sub"], c["reference"], c["start"])):
                    task, low, high = (c["shard"], c["sub"], c["reference"]), c["start"], c["start"] + c["words"]
                    inner = window - 1 if c["reference"] else 0
                    if merged and merged[-1][0] == task and low <= merged[-1][2] - inner:
                        merged[-1][2] = max(high, merged[-1][2])
                    else:
                        merged.append([task, low, high, []])
                    merged[-1][3] += (low - merged[-1][1], high - window + 1 - merged[-1][1])
                for task, low, high, runs in merged:
                    asked = b"" if task[2] else np.array(runs, np.uint32).tobytes()
                    out.append((*task, k1, k2, low, copies, asked, hashes[base + low : base + high].tobytes()))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
    release_memory()


def match_shard(rows: pa.Table, window: int) -> pa.Table:
    """Build the automaton of the shard's reference and stream the passages through it.

    The reference holds first places only, so a window occurs once in it and ``first_end`` is its only end. Windows that
    ask and that the automaton does not hold are given back with the hashes of their words.
    """
    keys = list(zip(*(rows[n].to_pylist() for n in ("reference", "k1", "k2", "start"))))
    words = shards.unpack(rows["words"], np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    _, symbols = np.unique(np.concatenate(words), return_inverse=True)
    copies, asked = rows["copies"].to_pylist(), shards.unpack(rows["asked"], np.uint32)
    automaton, origin, spans, alone = SuffixAutomaton(), [], [], []
    base = int(symbols.max()) + 1
    reference = [i for i, k in enumerate(keys) if k[0]]
    for i in reference:
        part = symbols[ends[i] - sizes[i] : ends[i]].tolist()
        automaton.extend([*part, base + i])  # the last symbol occurs once, so no match crosses it
        origin.append(len(automaton.first_end) and automaton.length[automaton._last])
    met = np.zeros(origin[-1] if origin else 0, bool)
    for i, (is_reference, k1, k2, start) in enumerate(keys):
        if is_reference:
            continue
        low = high = -1
        asks = np.zeros(int(sizes[i]) - window + 1, bool)
        for a, b in asked[i].reshape(-1, 2).tolist():
            asks[a:b] = True
        for at, end in automaton.matches(symbols[ends[i] - sizes[i] : ends[i]].tolist(), window):
            if not asks[at - window + 1]:
                continue
            met[end] = True
            asks[at - window + 1] = False
            if at - window + 1 > high:
                if high >= 0:
                    spans.append((k1, k2, start + low, start + high))
                low = at - window + 1
            high = at + 1
        if high >= 0:
            spans.append((k1, k2, start + low, start + high))
        for at in np.flatnonzero(asks).tolist():
            alone.append((k1, k2, start + at, start + at + window, copies[i], words[i][at : at + window].tobytes()))
    for i, last in zip(reference, origin):
        begin = last - 1 - int(sizes[i])
        _, k1, k2, start = keys[i]
        hits = np.flatnonzero(met[begin : last - 1])
        breaks = np.flatnonzero(np.diff(hits) > window) + 1
        for group in np.split(hits, breaks) if len(hits) else []:
            spans.append((k1, k2, start + int(group[0]) - window + 1, start + int(group[-1]) + 1))
    found = [(*s, None, None) for s in spans] + alone
    columns = list(zip(*found)) if found else [[]] * 6
    del automaton, words, symbols
    release_memory()
    names, kinds = ("k1", "k2", "low", "high", "copies", "window"), [pa.int64()] * 5 + [pa.binary()]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})


def remove_spans(source: DataFrame, spans: DataFrame, rejoin: bool) -> DataFrame:
    """Cut the spans; the columns of ``source`` but for the text's key stay."""
    kept = [f for f in source.schema.fields if f.name not in ("k1", "k2", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                words = split_words(part.column("text"))
                gone = np.zeros(len(words.start) + 1, np.int64)
                for base, found in zip(words.first.tolist(), part.column("spans").to_pylist()):
                    for span in found or ():
                        gone[base + span["low"]] += 1
                        gone[base + span["high"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                before = np.append(0, np.cumsum(keep))
                n_words, n_kept = np.diff(words.first), np.diff(before[words.first])
                texts = _joined(words, keep, before)
                if not rejoin:
                    given = part.column("text").to_pylist()
                    texts = [g if k == n else t for g, t, k, n in zip(given, texts, n_kept, n_words)]
                made = [pa.array(n_words), pa.array(n_words - n_kept), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *made], names)
        release_memory()

    names = [*(f.name for f in kept), "n_words", "n_removed", "text"]
    longs = [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")]
    joined = source.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    return joined.mapInArrow(run, T.StructType([*kept, *longs, T.StructField("text", T.StringType())]))


def _joined(words, keep: np.ndarray, before: np.ndarray) -> list[str]:
    """Kept words of each text, joined by one space."""
    size = (words.end - words.start + 1)[keep]
    raw = spread(np.append(words.data, np.uint8(32)), words.start[keep], size)
    ends = np.append(0, np.cumsum(size))
    raw[ends[1:] - 1] = 32
    body = raw.tobytes()
    at = ends[before[words.first]].tolist()
    return [body[a : b - 1].decode() if b > a else "" for a, b in zip(at, at[1:])]
