"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words count as they are written and by their form (the classes of their characters, and whether the word or the pair it
ends occurred before in the text), each alone and together with the word before. The weights are one table of fixed
size, so a score is a sparse dot product: one look-up for every n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import carrying, mix, release_memory, row_slices, slice_hashes, split_words, word_hashes

SLOTS = 1 << 18
_SALT = np.uint64(0x9E3779B97F4A7C15)

_FORM = np.arange(256, dtype=np.uint8)  # a symbol stands for itself
_FORM[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("0") : ord("9") + 1] = ord("0")


class Settings(NamedTuple):
    """``sample_rows`` bounds the labelled texts that are learned, for each label; the rest are of the training."""

    sample_rows: int = 2000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 20.0  # an n-gram enters by its count times this, divided by the text's words and ``calm`` more,
    calm: float = 10.0  # so a few words alone decide little


class Model(NamedTuple):
    weights: np.ndarray  # of SLOTS n-grams
    bias: float


def ngram_slots(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text's words begin, and for each kind of n-gram the slot of every word's; SLOTS where it has none."""
    words = split_words(column)
    n = len(words.start)
    if not n:
        return words.first, []
    opens = np.zeros(n, bool)
    opens[words.first[:-1][words.first[:-1] < words.first[1:]]] = True
    text = np.repeat(np.arange(len(words.first) - 1, dtype=np.uint64), np.diff(words.first))
    spelled = word_hashes(words)
    pairs = _pairs(spelled)
    seen = _seen_before(mix(pairs + text * _SALT), opens)
    seen[1:][spelled[1:] == spelled[:-1]] = 2
    seen[opens] = 0
    forms = _form_hashes(words) + seen.astype(np.uint64)
    kinds = [spelled, pairs, mix(forms), _pairs(forms)]
    salts = np.arange(len(kinds), dtype=np.uint64) * _SALT
    slots = [(mix(h + salt) >> np.uint64(46)).astype(np.int32) for h, salt in zip(kinds, salts)]
    for k in (1, 3):
        slots[k][opens] = SLOTS
    return words.first, slots


def _pairs(hashes: np.ndarray) -> np.ndarray:
    out = hashes.copy()
    out[1:] += mix(hashes[:-1] ^ _SALT)
    return mix(out)


def _seen_before(hashes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """1 where an earlier place holds the same hash."""
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), np.int8)
    again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    return again


def _form_hashes(words) -> np.ndarray:
    """Hash of each word with its characters replaced by their classes, repeated classes once."""
    classes = _FORM[words.data]
    keep = np.ones(len(classes), bool)
    np.not_equal(classes[1:], classes[:-1], out=keep[1:])
    keep[words.start] = True
    kept = np.cumsum(keep)
    return slice_hashes(classes[keep], kept[words.start] - 1, kept[words.end - 1])


def text_features(column: pa.Array, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of each text, and how much each enters."""
    first, kinds = ngram_slots(column)
    out = []
    for low, high in zip(first[:-1], first[1:]):
        slots = np.concatenate([s[low:high] for s in kinds]) if high > low else np.empty(0, np.int32)
        used, counts = np.unique(slots[slots < SLOTS], return_counts=True)
        out.append((used, counts * (settings.scale / (high - low + settings.calm))))
    return out


def train_sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, settings: Settings) -> DataFrame:
    """``text``, ``label`` and ``order`` of at most ``sample_rows`` labelled ids for each of the labels 0 and 1.

    The ids are those of least hash, so the choice depends on neither order nor partitions, and only chosen texts
    move. An id with both labels is left out, as is one without; of the texts of a repeated id, the least stays.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id")
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    known = known.select("id", "label", F.xxhash64("id").alias("order"))
    least = [known.filter(F.col("label") == v).orderBy("order", "id").limit(settings.sample_rows) for v in (0, 1)]
    chosen = F.broadcast(least[0].union(least[1]))  # 2 * sample_rows at most
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    return rows.groupBy("id", "label", "order").agg(F.min("text").alias("text"))


def collect_features(sample: DataFrame, settings: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label and sparse features of the sample, in an order of its own; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                found = text_features(part.column("text"), settings)
                slots = pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary())
                shares = pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("order"), slots, shares], ["label", "order", "slots", "shares"]
                )

    rows = sample.mapInArrow(run, "label int, order long, slots binary, shares binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["order"], r["label"], r["slots"]))
    return [(r["label"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> Model:
    """FTRL-proximal over the rows, each label with the same total weight. Without both labels, every score is 0.5."""
    ones = sum(label for label, *_ in rows)
    if not 0 < ones < len(rows):
        return Model(np.zeros(SLOTS + 1, np.float32), 0.0)
    share = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(settings.epochs):
        for label, slots, x in rows:
            slots, x = np.append(slots, SLOTS), np.append(x, 1.0).astype(np.float64)  # the last is the bias
            w = _weights(z[slots], n[slots], settings)
            g = x * ((_sigmoid(x @ w) - label) * share[label])
            grown = n[slots] + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(n[slots])) / settings.alpha * w
            n[slots] = grown
    weights = _weights(z, n, settings)
    table = weights.astype(np.float32)
    table[SLOTS] = 0
    return Model(table, float(weights[SLOTS]))


def _weights(z: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """The closed-form minimum of the gradients so far with both penalties."""
    pull = np.sign(z) * settings.l1 - z
    return np.where(np.abs(z) > settings.l1, pull / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2), 0.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def score_texts(column: pa.Array, model: Model, settings: Settings) -> np.ndarray:
    """Probability of label 1 for each text."""
    first, kinds = ngram_slots(column)
    counts = np.diff(first)
    total = np.zeros(len(counts))
    filled = np.flatnonzero(counts)
    for slots in kinds:
        total[filled] += np.add.reduceat(model.weights[slots], first[:-1][filled], dtype=np.float64)
    return _sigmoid(total * settings.scale / (counts + settings.calm) + model.bias)


def predict(
    df: DataFrame, key: str, text: str, model: Model, settings: Settings = Settings(), carry: Sequence[str] = ()
) -> DataFrame:
    """``key``, the columns ``carry`` and ``score``, the probability of label 1, for every row's whole text.

    NULL is the empty text; a text without words gets the score of the bias alone. Equal texts get equal scores. Keys
    may be NULL or repeated, and are not read. Other columns are left out, so their names cannot clash.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers
    source, carried = carrying(df, text, [key, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_text"):
                score = pa.array(score_texts(part.column("_text"), shared.value, settings))
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), score], [key, *carry, "score"])
        release_memory()

    kept = [T.StructField(c, df.schema[c].dataType) for c in (key, *carry)]
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
