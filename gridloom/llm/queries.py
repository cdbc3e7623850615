"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import chat, html_text, jaccard, langid, packing, periodic_runs, piece_codec, quality, quality_model
from gridloom.llm import substring_dedup, token_alignment, tokens, topk, warc
from gridloom.llm.registry import query, table
from gridloom.operators.indexing import dense_index
from gridloom.storage import store


def id_hash(key: str) -> Column:
    """crc32 of an id in decimals; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def byte_vocabulary() -> packing.Vocabulary:
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return packing.Vocabulary(ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, 1)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("span_bytes", T.LongType()),
    ]
)


def piece_digests(encoded: piece_codec.Encoded) -> list[pa.Array]:
    raw, first = encoded.ids.astype("<u4").tobytes(), encoded.first
    ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(first[:-1], first[1:])]
    texts = encoded.codec.decode(encoded.ids, first)
    decoded = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    spans = np.concatenate([[0], np.cumsum(encoded.end - encoded.begin)])
    return [pa.array(np.diff(first), pa.int64()), pa.array(ids), pa.array(decoded), pa.array(np.diff(spans[first]))]


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text; ``span_bytes`` sums the source spans, which tile the text."""
    documents = table(spark, sf_dir, "documents")
    return piece_codec.encode(documents, "doc_id", "text", piece_model(), DIGESTS, piece_digests)


def packed(documents: DataFrame) -> DataFrame:
    crc = ("ids_crc32", T.LongType())
    return packing.pack(documents, "doc_id", "text", byte_vocabulary(), 2048, crc, packing.crc_pieces)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


# Forms in which the speakers of a transcript are marked; one per conversation.
MARKERS = [
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "### Human:\n", "assistant": "### Assistant:\n", "system": "### System:\n"},
    {"user": "Q: ", "assistant": "A: ", "system": "Context: "},
    {"user": "[user] ", "assistant": "[assistant] ", "system": "[system] "},
    {"user": "**You**: ", "assistant": "**Bot**: ", "system": "**Instructions**: "},
    {"user": "<|user|>\n", "assistant": "<|assistant|>\n", "system": "<|system|>\n"},
]
PART_TURNS = 256  # a longer transcript comes in parts of so many turns; it is decoded as a whole


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written down as plain text, with the true state of every line.

    Turns are separated by a blank line. Every tenth turn after the first, by hash, lacks its marker. Turns are numbered
    first, so a conversation that holds most of the table is many parts of bounded length, joined by a line end.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    numbered = dense_index(turns, ["turn", "role", "text"], ["conv_id"], "at", unique=False)
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(MARKERS)))
    forms = F.array(*(F.create_map(*(F.lit(x) for pair in m.items() for x in pair)) for m in MARKERS))
    bare = (F.col("at") > 0) & (F.pmod(F.xxhash64("conv_id", "at"), F.lit(10)) == 0)
    marker = F.when(bare, "").otherwise(F.coalesce(F.get(forms, style.cast("int"))[F.col("role")], F.lit("")))
    body = F.concat(marker, F.coalesce("text", F.lit("")), F.lit("\n"))
    known = F.coalesce(F.array_position(F.array(*map(F.lit, chat.ROLES)), F.col("role")), F.lit(0)).cast("int")
    first = F.when(known > 0, 2 * (known - 1)).otherwise(-1)
    rest = F.when(known > 0, 2 * known - 1).otherwise(-1)
    n_more = F.size(F.split("body", "\n", -1)) - 1
    lined = numbered.withColumn("body", body).select(
        "conv_id",
        F.floor(F.col("at") / PART_TURNS).alias("part"),
        F.struct("at", "body", F.concat(F.array(first), F.array_repeat(rest, n_more)).alias("states")).alias("t"),
    )
    parts = lined.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return parts.select(
        "conv_id",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.body", "\n").alias("transcript"),
        F.flatten("turns.states").alias("states"),
    )


@query()
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from the transcripts of all conversations; the model learns from four fifths of the ids.

    ``n_right`` of ``n_lines`` lines got their true role. One row per conversation and 256 turns of it; ``n_found`` turns
    open there, and ``goes_on`` tells that the first of ``roles`` goes on from the row before.
    """
    written = store(transcripts(spark, sf_dir), "transcripts")
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = chat.train(written.filter(~held_out), "transcript", "states", F.col("part") == 0)
    parsed = chat.parse_parts(written, "conv_id", "part", "transcript", model, ("n_turns", "states"))
    names = F.array(*map(F.lit, chat.ROLES))
    right = F.zip_with("states", "line_roles", lambda s, r: (s >= 0) & (F.get(names, (s / 2).cast("int")) == r))
    return parsed.select(
        "conv_id",
        "part",
        held_out.alias("held_out"),
        "n_turns",
        (F.size("turns") - F.col("goes_on").cast("int")).cast("long").alias("n_found"),
        F.size("line_roles").cast("long").alias("n_lines"),
        F.size(F.filter(right, lambda ok: ok)).cast("long").alias("n_right"),
        F.array_join("turns.role", ",").alias("roles"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
        "goes_on",
    )


@query(
    """WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    whole = F.when(topk.usable(F.col("embedding")), topk.quantise(F.col("embedding")))
    rows = embeddings.select("vec_id", whole.alias("v"))
    return topk.top_k(rows, "vec_id", "v", F.col("vec_id") % 50 == 0, 5)


@query()
def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query(
    """WITH sized AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM sized WHERE strlen(body) >= 100 GROUP BY digest)
SELECT page_id, strlen(body)::bigint AS payload_bytes, s.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized s LEFT JOIN firsts f ON s.digest = f.digest"""
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html", payloads=False)
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), "doc_id", "text")


def language_model(documents: DataFrame) -> langid.Model:
    """Learned from rows whose crc32 of the id is not divisible by 5."""
    learn = documents.filter(id_hash("doc_id") % 5 != 0)
    settings = langid.Settings()
    sample = langid.train_sample(learn, F.col("doc_id"), "text", "lang", settings)
    return langid.fit(langid.collect_features(sample), settings)


@query()
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    predicted = langid.predict(documents, "doc_id", "text", language_model(documents))
    held_out = id_hash("doc_id") % 5 == 0
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = html_text.extract(table(spark, sf_dir, "pages"), "page_id", "html", ("url",))
    return extracted.select("*", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    settings = quality_model.Settings()
    learn = labels.filter(id_hash("doc_id") % 5 != 0)
    sample = quality_model.train_sample(documents, learn, "doc_id", "text", "quality", settings)
    model = quality_model.fit(quality_model.collect_features(sample, settings), settings)
    scored = quality_model.predict(documents, "doc_id", "text", model, settings)
    held_out = id_hash("doc_id") % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def repeated_tails(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of every tenth id, by hash, a unit of the words is repeated to the end.

    Rows without an id stay as they are.
    """
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(id_hash("doc_id") / 10).cast("long")
    some = documents.select("doc_id", "text", F.when(F.col("doc_id").isNotNull() & (id_hash("doc_id") % 10 == 0), words).alias("w"), g.alias("g"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    unit = F.slice("w", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    head = F.slice("w", F.lit(1), a.cast("int"))
    return some.select("doc_id", F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(repeated_tails(table(spark, sf_dir, "documents")), "doc_id", "text")
    none = F.lit(None).cast(periodic_runs.RUN)
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(longer(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", "runs", best.alias("best"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


class TwoTokenizers:
    """Tokens of a space and the text by a byte-level vocabulary, and of the text by a sentencepiece model."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        self.bytes, self.pieces = tokens.ByteBpe(ranks, pattern, {}), piece_codec.PieceCodec(model)
        known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
        self.byte_table = token_alignment.byte_table([known.get(i, b"") for i in range(max(known) + 1)])
        whole = self.pieces.whole
        names = [whole.id_to_piece(i) for i in range(whole.get_piece_size())]
        entries = [bytes([int(n[3:-1], 16)]) if whole.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        self.piece_table = token_alignment.byte_table(entries)

    def __call__(self, column: pa.Array) -> tuple[token_alignment.Tokens, token_alignment.Tokens]:
        ids, first = self.bytes.encode(token_alignment.spaced(column))
        encoded = self.pieces.encode(column)
        inner = np.ones(len(encoded.ids), bool)
        inner[encoded.first[:-1]] = inner[encoded.first[1:] - 1] = False
        rest = encoded.first - 2 * np.arange(len(encoded.first))
        return token_alignment.Tokens(ids, first, self.byte_table), token_alignment.Tokens(encoded.ids[inner], rest, self.piece_table)


GROUP_DIGESTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")] + [T.StructField("groups_sha256", T.StringType())])


def group_digests(found: token_alignment.Aligned) -> list[pa.Array]:
    """Counts of each text, and the hash of its groups written as ``a1,a2|b1;a3|b2,b3``."""
    sizes_a, sizes_b = np.diff(found.a_cut), np.diff(found.b_cut)
    ids = np.empty(len(found.a_ids) + len(found.b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[np.arange(len(found.a_ids)) + np.repeat(found.b_cut[:-1], sizes_a)] = found.a_ids
    ids[np.arange(len(found.b_ids)) + np.repeat(found.a_cut[1:], sizes_b)] = found.b_ids
    mark[found.a_cut[1:] + found.b_cut[:-1] - 1] = ord("|")
    ends = found.a_cut[1:] + found.b_cut[1:]
    mark[ends - 1] = ord(";")
    written = np.array([str(i) for i in range(int(ids.max(initial=0)) + 1)], "S")
    width = written.dtype.itemsize
    cells = np.zeros((len(ids), width + 1), np.uint8)
    cells[:, :width] = written.view(np.uint8).reshape(-1, width)[ids]
    size = np.char.str_len(written).astype(np.int64)[ids]
    cells[np.arange(len(ids)), size] = mark
    raw = cells[np.arange(width + 1) <= size[:, None]].tobytes()
    at = np.append(0, np.cumsum(size + 1))
    text_at = at[np.append(0, ends)[found.first]].tolist()
    digests = [hashlib.sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(text_at[:-1], text_at[1:])]
    counts = [np.diff(cut[found.first]) for cut in (found.a_cut, found.b_cut)]
    return [*(pa.array(c.astype(np.int64)) for c in (*counts, np.diff(found.first))), pa.array(digests, pa.string())]


@query()
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    shared = spark.sparkContext.broadcast((ranks, public_tokenizers.PATTERN, model))
    documents = table(spark, sf_dir, "documents")
    return token_alignment.align_texts(
        documents, "doc_id", "text", lambda: TwoTokenizers(*shared.value), (50257, 32000), GROUP_DIGESTS, group_digests
    )
