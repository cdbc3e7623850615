"""Transcripts to chat turns: a hidden Markov model over speaker markers and line features, decoded by Viterbi.

A state is a role and whether the line opens a turn. Lines are seen through a few categorical features; their counts in
labelled transcripts, added to prior counts, make the model. A transcript becomes its likeliest states, lines of one turn
are joined without their marker, and turns are rendered in one canonical form. A transcript may come in parts, in as many rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.storage import broadcast_if_small, store

ROLES = ("user", "assistant", "system")
N_STATES = 2 * len(ROLES)  # role r opens a turn in state 2r and goes on in state 2r + 1

# Names that transcripts give to the speakers.
NAMES = {
    "user": "user human you me question q customer client prompt inst".split(),
    "assistant": "assistant ai bot answer a model agent response chatbot helper".split(),
    "system": "system instructions instruction context setting sys".split(),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(
    r"\s*(?:<\|(?:im_start\|>)?|\[/?|\(|[#>*_\-]+\s*)?\s*(?P<name>[^\W\d_]+)"
    r"(?P<close>\s*(?:\|>|\]|\)|[*_]+)?\s*)(?P<colon>:|>|-\s)?(?:[*_]+)?\s*"
)
_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")
SIZES = (5, 5, 5, 3, 3)  # values of each feature
FAN = 64  # parts, or nodes above them, that one node joins


class Model(NamedTuple):
    """Logarithms of the probabilities of first states, of steps, and of each feature's values by state."""

    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]


def find_marker(line: str) -> tuple[int, int]:
    """Kind (0 none, 1 to 3 a role, 4 another name) and length of the speaker marker that opens a line."""
    found = MARKER.match(line)
    if not found:
        return 0, 0
    opened = line[: found.start("name")].strip()
    closed = found["close"].strip()
    role = _ROLE_OF.get(found["name"].lower())
    framed = bool(found["colon"]) or bool(opened and closed) or opened.startswith("<|")
    alone = found.end() == len(line)
    if role is not None and (framed or opened.startswith("#") and alone):
        return 1 + role, found.end()
    if found["colon"] == ":" and found["name"][0].isupper() and (alone or line[found.end("colon") :][:1].isspace()):
        return 4, found.end()
    return 0, 0


def line_features(lines: list[str], first: bool = True) -> tuple[np.ndarray, list[int]]:
    """One row of feature values per line, and the length of its marker. Lines that are not the first follow a blank one."""
    out, cuts, blank_before = np.empty((len(lines), len(SIZES)), np.int8), [], not first
    for i, line in enumerate(lines):
        kind, cut = find_marker(line)
        n = len(line.split())
        blank = n == 0
        end = line.rstrip()[-1:]
        shape = 2 if line.startswith(("```", "    ", "\t")) else 1 if _LIST.match(line) else 0
        size = 0 if n == 0 else 1 if n <= 5 else 2 if n <= 20 else 3 if n <= 60 else 4
        place = 0 if first and i == 0 else 1 if blank else 2 if blank_before else 3 if kind else 4
        out[i] = kind, place, size, 1 if end == "?" else 2 if end == ":" else 0, shape
        cuts.append(cut)
        blank_before = blank
    return out, cuts


def prior() -> list[np.ndarray]:
    """Counts before any transcript is seen: a role's marker opens its turns, other lines go on, roles alternate."""
    start = np.full(N_STATES, 0.1)
    start[[0, 4]] = 4.0, 2.0
    step = np.full((N_STATES, N_STATES), 0.1)
    kind = np.full((N_STATES, SIZES[0]), 0.05)
    place = np.ones((N_STATES, SIZES[1]))
    for r in range(len(ROLES)):
        opens, goes_on = 2 * r, 2 * r + 1
        step[opens : goes_on + 1, goes_on] = 6.0
        following = 2 if r == 0 else 0  # the assistant answers the user; the user follows the others
        step[opens : goes_on + 1, following] = 2.0
        kind[opens, [0, 1 + r, 4]] = 1.0, 8.0, 2.0
        kind[goes_on, 0] = 12.0
        place[goes_on, 0] = 0.05
        place[opens, 1] = 0.05
    return [start, step, kind, place, *(np.ones((N_STATES, n)) for n in SIZES[2:])]


def fit(counts: list[np.ndarray]) -> Model:
    shares = [np.log(c / c.sum(axis=-1, keepdims=True)) for c in counts]
    return Model(shares[0], shares[1], tuple(shares[2:]))


def count_states(lines: list[str], states: np.ndarray, first: bool = True) -> list[np.ndarray]:
    """Counts of one labelled transcript, in the shapes of ``prior``. A state of -1 is unknown and counts nothing."""
    seen, _ = line_features(lines, first)
    known = states >= 0
    out = [np.zeros(N_STATES), np.zeros((N_STATES, N_STATES)), *(np.zeros((N_STATES, n)) for n in SIZES)]
    if first and len(states) and known[0]:
        out[0][states[0]] += 1
    pairs = known[1:] & known[:-1]
    np.add.at(out[1], (states[:-1][pairs], states[1:][pairs]), 1)
    for f in range(len(SIZES)):
        np.add.at(out[2 + f], (states[known], seen[known, f]), 1)
    return out


def _scores(seen: np.ndarray, model: Model) -> np.ndarray:
    return sum(emit[:, seen[:, f]] for f, emit in enumerate(model.emit)).T


def viterbi(seen: np.ndarray, model: Model, enter: int | None = None, leave: int | None = None) -> np.ndarray:
    """The likeliest states after the state ``enter``, if given, and up to ``leave``; of equal ones, the lower state."""
    score = _scores(seen, model)
    back = np.empty(score.shape, np.int8)
    best = (model.start if enter is None else model.step[enter]) + score[0]
    for i in range(1, len(score)):
        ways = best[:, None] + model.step
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + score[i]
    states = np.empty(len(score), np.int64)
    states[-1] = best.argmax() if leave is None else leave
    for i in range(len(score) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def ways_through(seen: np.ndarray, model: Model, first: bool) -> np.ndarray:
    """Score of the best way through these lines, from each state before them to each state of the last."""
    score = _scores(seen, model)
    best = np.broadcast_to((model.start if first else model.step) + score[0], (N_STATES, N_STATES))
    for line in score[1:]:
        best = join_ways(best, model.step) + line
    return best


def join_ways(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (before[:, :, None] + after).max(axis=1)


def borders(ways: list[np.ndarray], enter: int, leave: int | None = None) -> list[tuple[int, int]]:
    """For each of ``ways`` in a row, the states before it and at its end, on the best way from ``enter`` to ``leave``."""
    best = [ways[0][enter]]
    for way in ways[1:]:
        best.append((best[-1][:, None] + way).max(axis=0))
    ends = [int(best[-1].argmax()) if leave is None else leave]
    for way, before in zip(ways[:0:-1], best[-2::-1]):
        ends.append(int((before + way[:, ends[-1]]).argmax()))
    ends.reverse()
    return list(zip([enter, *ends], ends))


def render(turns: list[dict], goes_on: bool = False, first: bool = True, last: bool = True) -> str:
    """One canonical form; what looks like its own marks within a turn is escaped.

    Of a part, what it adds to the form of the parts before it: a part that does not go on with their turn closes it.
    """
    out = []
    for i, turn in enumerate(turns):
        content = turn["content"].replace("<|", "<\\|")
        if i == 0 and goes_on:
            out.append("\n" + content)
        else:
            out.append(("" if first and i == 0 else "<|im_end|>\n") + f"<|im_start|>{turn['role']}\n{content}")
    return "".join(out) + ("<|im_end|>\n" if turns and last else "")


def parse(text: str, model: Model) -> tuple[list[str], list[dict]]:
    """Role of every line, and the turns. A text without a visible character has no turn."""
    return parse_part(text, model)[:2]


def parse_part(
    text: str, model: Model, enter: int | None = None, leave: int | None = None
) -> tuple[list[str], list[dict], bool]:
    """Role of every line, the turns, and whether the first of them goes on with that of the state ``enter``."""
    lines = text.split("\n")
    if enter is None and leave is None and not text.strip():
        return ["" for _ in lines], [], False
    seen, cuts = line_features(lines, enter is None)
    states = viterbi(seen, model, enter, leave)
    roles = [ROLES[s // 2] for s in states]
    speaking = None if enter is None else ROLES[enter // 2]
    goes_on = states[0] % 2 == 1 and roles[0] == speaking
    turns: list[dict] = []
    for line, cut, role, state, kind in zip(lines, cuts, roles, states, seen[:, 0]):
        opens = state % 2 == 0 or role != speaking
        if opens or not turns:
            turns.append({"role": role, "lines": []})
        turns[-1]["lines"].append(line[cut:] if opens and kind else line)
        speaking = role
    return roles, [{"role": t["role"], "content": "\n".join(t["lines"]).strip()} for t in turns], bool(goes_on)


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def parse_transcripts(df: DataFrame, key: str, text: str, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``carry``, ``line_roles``, ``turns`` and ``rendered`` of every transcript.

    NULL and blank transcripts have no turn and render empty. Keys may be NULL or repeated; repeated rows are parsed
    each. Transcripts of any length are parsed whole. Other columns are left out. An empty table gives an empty table.
    """
    names = [key, *carry]
    source = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(names)))
    return _parse_rows(source.selectExpr(*_ALONE), df, names, model).drop("goes_on")


# What a transcript of one row says of its place.
_ALONE = ("*", "true AS _first", "true AS _last", "CAST(NULL AS int) AS _enter", "CAST(NULL AS int) AS _leave")


def _parse_rows(rows: DataFrame, given: DataFrame, kept: list[str], model: Model) -> DataFrame:
    """Texts with the states around them; ``kept`` are columns of ``given``, in ``rows`` under their numbers."""
    names = [*kept, "line_roles", "turns", "goes_on", "rendered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = batch.column("_first").to_pylist(), batch.column("_last").to_pylist()
            around = zip(*(batch.column(c).to_pylist() for c in ("_text", "_enter", "_leave")))
            found = [parse_part(t or "", model, enter, leave) for t, enter, leave in around]
            made = [
                pa.array([r for r, _, _ in found], pa.list_(pa.string())),
                pa.array([t for _, t, _ in found], pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))),
                pa.array([g for _, _, g in found], pa.bool_()),
                pa.array([render(t, g, *at) for (_, t, g), at in zip(found, zip(first, last))], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(kept))), *made], names)

    fields = [T.StructField(c, given.schema[c].dataType) for c in kept]
    kinds = (T.ArrayType(T.StringType()), TURNS, T.BooleanType(), T.StringType())
    made = [T.StructField(n, kind) for n, kind in zip(names[-4:], kinds)]
    return rows.mapInArrow(run, T.StructType([*fields, *made]))


def parse_parts(
    df: DataFrame, key: str, part: str, text: str, model: Model, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``parse_transcripts`` for transcripts cut into numbered parts, decoded as one text each, a row per part.

    A transcript is its parts in order of their numbers, joined by a line end; a part before another must end in a blank
    line. Gives ``key``, ``part``, ``carry``, ``line_roles``, ``turns``, ``goes_on`` (the first turn goes on with the last
    one of the part before) and ``rendered``; what the parts of a transcript render, one after another, is its canonical
    form, with the blank lines at a border within a turn made one line end.

    A part gives the best score from each state before it to each state at its end; such tables are joined ``FAN`` at a
    time up to one per transcript, the best last state goes back down, and every part is decoded between the two states
    that its borders got. So a task holds ``FAN`` small tables or single parts, however long a transcript is. The states
    are the likeliest ones up to rounding. NULL texts are empty, a NULL number is 0, NULL is a key like any other. Rows
    of a transcript with only one number are parsed each, as by ``parse_transcripts``; elsewhere rows with an equal
    number follow each other. Other columns are left out. An empty table gives an empty table.
    ``df`` must give the same rows when it is read again, as a stored table does.
    """
    kept = [key, part, *carry]
    number = F.coalesce(F.col(part), F.lit(0)).cast("long")
    columns = (F.col(c).alias(f"_{i}") for i, c in enumerate(kept))
    source = df.select(F.col(text).alias("_text"), number.alias("_part"), *columns)
    spans = source.groupBy(F.col("_0").alias("_of")).agg(F.min("_part").alias("_least"), F.max("_part").alias("_most"))
    spans = store(spans.filter("_most > _least"), "spans")
    most = spans.agg(F.max(F.col("_most") - F.col("_least"))).first()[0]
    if most is None:
        return _parse_rows(source.selectExpr(*_ALONE), df, kept, model)
    side, same = broadcast_if_small(spans), F.col("_0").eqNullSafe(F.col("_of"))
    alone = source.join(side, same, "left_anti").drop("_part").selectExpr(*_ALONE)
    cut = source.join(side, same).withColumns(
        {
            "_at": F.col("_part") - F.col("_least"),
            "_first": F.col("_part") == F.col("_least"),
            "_last": F.col("_part") == F.col("_most"),
            "_row": F.monotonically_increasing_id(),
        }
    )
    cut = store(cut.drop("_part", "_of", "_least", "_most"), "parts")
    states = broadcast_if_small(store(_border_states(cut, most, model), "borders"))
    enter = F.when(~F.col("_first"), F.col("enter")).alias("_enter")
    placed = cut.join(states.withColumnRenamed("row", "_of"), F.col("_row") == F.col("_of"))
    placed = placed.select("*", enter, F.col("leave").alias("_leave")).select(*alone.columns)
    return _parse_rows(alone.union(placed), df, kept, model)


def _border_states(parts: DataFrame, most: int, model: Model) -> DataFrame:
    """``row``, and the states before (``enter``) and at the end (``leave``) of every part."""
    kind = parts.schema["_0"].dataType.simpleString()
    node = f"key {kind}, at long, row long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("_text").to_pylist(), batch.column("_first").to_pylist())
            seen = [(line_features((t or "").split("\n"), first)[0], first) for t, first in texts]
            ways = pa.array([ways_through(s, model, first).ravel() for s, first in seen], pa.list_(pa.float64()))
            arrays = [*map(batch.column, ("_0", "_at", "_row")), ways]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "at", "row", "ways"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [reduce(join_ways, _tables(below)).ravel() for below in batch.column("below").to_pylist()]
            none = pa.array(np.zeros(batch.num_rows, np.int64))
            arrays = [batch.column("key"), batch.column("node"), none, pa.array(joined, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "at", "row", "ways"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("below").to_pylist()
            ends = zip(batch.column("enter").to_pylist(), batch.column("leave").to_pylist())
            found = [borders(_tables(below), *end) for below, end in zip(lists, ends)]
            key = batch.column("key").take(pa.array(np.repeat(np.arange(len(lists)), [len(b) for b in lists])))
            flat = [(c["at"], c["row"], *f) for below, some in zip(lists, found) for c, f in zip(below, some)]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*flat), [pa.int64()] * 2 + [pa.int32()] * 2)]
            yield pa.RecordBatch.from_arrays([key, *columns], ["key", "at", "row", "enter", "leave"])

    nodes = parts.select("_0", "_at", "_row", "_text", "_first").mapInArrow(measure, f"{node}, ways array<double>")
    levels = []
    while True:
        listed = F.array_sort(F.collect_list(F.struct("at", "row", "ways"))).alias("below")
        levels.append(store(nodes.groupBy("key", F.expr(f"at div {FAN}").alias("node")).agg(listed), "nodes"))
        most //= FAN
        if not most:
            break
        nodes = levels[-1].mapInArrow(join, f"{node}, ways array<double>")
    asked = levels.pop().withColumns({"enter": F.lit(0), "leave": F.lit(None).cast("int")})
    while True:
        settled = asked.mapInArrow(settle, f"{node}, enter int, leave int")
        if not levels:
            return settled.select("row", "enter", "leave")
        above = store(settled.select(F.col("key").alias("_of"), F.col("at").alias("_at"), "enter", "leave"), "settled")
        same = F.col("key").eqNullSafe(F.col("_of")) & (F.col("node") == F.col("_at"))
        asked = levels.pop().join(broadcast_if_small(above), same).drop("_of", "_at")


def _tables(below: list[dict]) -> list[np.ndarray]:
    return [np.array(b["ways"]).reshape(N_STATES, N_STATES) for b in below]


def train(df: DataFrame, text: str, states: str, first: Column | None = None) -> Model:
    """Counts over all labelled transcripts; ``states`` is an array with the state of every line, -1 where unknown.

    ``first`` tells which rows open a transcript; others go on after a blank line, and the step over that border is not
    counted. Each task adds up its own; the driver gets a few hundred sums.
    """
    shapes = [c.shape for c in prior()]
    size = sum(int(np.prod(s)) for s in shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for t, s, opens in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (t or "").split("\n")
                if s is not None and len(s) == len(lines):
                    total += np.concatenate([c.ravel() for c in count_states(lines, np.array(s, np.int64), opens)])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    opens = F.lit(True) if first is None else F.coalesce(first, F.lit(True))
    rows = df.select(F.col(text).alias("text"), F.col(states).alias("states"), opens.alias("opens"))
    sums = rows.mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    flat = np.concatenate([c.ravel() for c in prior()])
    for row in sums.collect():
        flat[row["slot"]] += row["n"]
    cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    return fit([flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes)])
