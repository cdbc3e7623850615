"""Queries over text tables: manifests, grids, vocabularies, profiles, batches, sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import batching, manifest, profile, render, vocab
from gridloom.operators.indexing import dense_index, with_dense_index
from gridloom.operators.normalize import clean_text, normalize_grid
from gridloom.plans.registry import csv, query, table
from gridloom.sources.artifacts import load_artifacts, save_artifacts
from gridloom.sources.manifest import read_manifest, write_manifest
from gridloom.sources.texts import read_corpus, write_corpus
from gridloom.storage import scratch_path, store

W, H = 20, 10
ROOT, RECORDED_WIDTH = "/corpus", 80
BATCH, EVAL_BATCHES, FEW_BATCHES, SEED = 32, 50, 3, 42
RECORDS = (20, 50)
RUN = {"W": W, "H": H, "L": W * H, "emb_dim": 16, "steps": 400, "betas": [1e-4, 2e-2]}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their split: every fifth id is held out."""
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"), "text")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_grid(documents(spark, sf_dir), "text", "grid", W, H).drop("text")


def stored_grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Grids written once, as both the vocabulary and the encoding read them, with the train vocabulary."""
    stored = store(grids(spark, sf_dir), "grids")
    train = stored.filter(F.col("split") == "train")
    return stored, vocab.vocab_chars(vocab.build_vocab(train, "grid"))


def train_vocab(spark: SparkSession, sf_dir: str) -> list[str]:
    train = grids(spark, sf_dir).filter(F.col("split") == "train")
    return vocab.vocab_chars(vocab.build_vocab(train, "grid"))


def manifest_rows(spark: SparkSession, sf_dir: str, limits=None) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "split", tx.text_height(F.col("text")).alias("height"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    keep = manifest.within_limits(limits) if limits else None
    records = with_dense_index(sized, "doc_id", ["split"], keep=keep).join(marks, "doc_id", "left")
    return manifest.build_manifest(records, ROOT, RECORDED_WIDTH)


# --- SQL building blocks -------------------------------------------------------------------------

DOCS = """docs AS (
  SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)"""


def sql_clean(text: str) -> str:
    folded = f"translate({text}, chr(8722) || chr(8211) || chr(8212) || chr(8208), '----')"
    return f"regexp_replace(replace({folded}, chr(13), ''), '[^\\x20-\\x7E\\n]', ' ', 'g')"


def sql_grid(text: str) -> str:
    lines = f"string_split({sql_clean(text)}, chr(10))[1:{H}]"
    return f"rpad(array_to_string(list_transform({lines}, lambda l: rpad(l, {W}, ' ')), ''), {W * H}, ' ')"


GRIDS = f"{DOCS}, grids AS (SELECT doc_id, split, {sql_grid('text')} AS grid FROM docs)"
VOCAB = f"""{GRIDS}, chars AS (
  SELECT unnest(string_split(grid, '')) AS ch FROM grids WHERE split = 'train' UNION SELECT ' '),
vocab AS (SELECT (row_number() OVER (ORDER BY ascii(ch)) - 1)::int AS tok_id, ch FROM chars)"""
TOKENS = f"""{VOCAB}, cells AS (
  SELECT doc_id, split, unnest(string_split(grid, '')) AS ch, generate_subscripts(string_split(grid, ''), 1) AS pos
  FROM grids),
tokens AS (
  SELECT doc_id, split, list(coalesce(tok_id, 0) ORDER BY pos) AS ids, list(coalesce(v.ch, ' ') ORDER BY pos) AS chs
  FROM cells LEFT JOIN vocab v USING (ch) GROUP BY doc_id, split)"""
INDEXED = "row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1"
HEIGHT = """CASE WHEN trim(text, chr(10)) = '' THEN 0
  ELSE length(trim(text, chr(10))) - length(replace(trim(text, chr(10)), chr(10), '')) + 1 END::int"""
MANIFEST = f"""{DOCS}, records AS (
  SELECT d.doc_id, split, {INDEXED} AS idx, quality AS label, {HEIGHT} AS height
  FROM docs d LEFT JOIN labels USING (doc_id)),
manifest AS (
  SELECT split || '-' || lpad(idx::varchar, greatest(6, length(idx::varchar))::int, '0') AS id, * FROM records)"""
MANIFEST_COLUMNS = f"""id, split, label::int AS label,
  '{ROOT}/' || split || '/orig_imgs/' || id || '.png' AS orig_img_path,
  '{ROOT}/' || split || '/ascii_txt/' || id || '-ascii-art.txt' AS ascii_txt_path,
  {RECORDED_WIDTH}::int AS ascii_width, height AS ascii_height"""


# --- manifests and texts -------------------------------------------------------------------------


@query(f"WITH {MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest")
def manifest_build(spark, sf_dir):
    return manifest_rows(spark, sf_dir)


@query(f"""WITH {MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest
WHERE idx < CASE split WHEN 'train' THEN 100 ELSE 10 END""")
def manifest_capped(spark, sf_dir):
    return manifest_rows(spark, sf_dir, {"train": 100, "test": 10})


@query(f"""WITH {MANIFEST} SELECT id, 'label is missing' AS problem FROM manifest WHERE label IS NULL
UNION ALL SELECT id, 'payload is missing' FROM manifest m
WHERE NOT EXISTS (FROM pages p WHERE p.page_id = m.doc_id)""")
def manifest_check(spark, sf_dir):
    """Labels come from one table, payloads from another: a record may lack either, both or none."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    records = with_dense_index(documents(spark, sf_dir).select("doc_id", "split"), "doc_id", ["split"])
    named = records.withColumn("id", manifest.record_id(F.col("split"), F.col("idx"))).join(marks, "doc_id", "left")
    pages = table(spark, sf_dir, "pages").select("page_id")
    return manifest.check_manifest(named.select("id", "label", "doc_id"), pages, "doc_id", "page_id")


@query("""WITH marked AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS idx FROM marked""")
def label_index(spark, sf_dir):
    """Documents numbered within their label; those without one are a group of their own."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left")
    return dense_index(rows, ["doc_id"], ["quality"])


@query(f"WITH {MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest")
def manifest_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    write_manifest(manifest_rows(spark, sf_dir), path)
    return read_manifest(spark, path)


@query(f"""WITH {DOCS} SELECT doc_id, split, length(t)::bigint AS n_chars, md5(t) AS digest FROM (
  SELECT doc_id, split, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM docs)""")
def text_scan(spark, sf_dir):
    """Corpus written as raw bytes, read back, joined to its records by path and decoded."""
    corpus = scratch_path(spark, "corpus")
    uid = F.col("doc_id").cast("string")
    rows = documents(spark, sf_dir).withColumn("ascii_txt_path", manifest.text_path(ROOT, F.col("split"), uid))
    blobs = rows.select("split", F.concat(F.lit("file:"), "ascii_txt_path").alias("path"), F.encode("text", "UTF-8").alias("content"))
    write_corpus(blobs, corpus, overwrite=True)
    decoded = read_corpus(spark, corpus, blobs.schema).select("path", tx.decode_text(F.col("content")).alias("t"))
    measured = decoded.select("path", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))
    joined = manifest.attach_texts(rows.drop("text"), measured, "n_chars", "digest")
    return joined.select("doc_id", "split", "n_chars", "digest")


# --- grids ---------------------------------------------------------------------------------------


@query(f"WITH {GRIDS} SELECT doc_id, grid FROM grids")
def grid_normalize(spark, sf_dir):
    return grids(spark, sf_dir).select("doc_id", "grid")


@query(f"""WITH cleaned AS (SELECT conv_id, turn, string_split({sql_clean("text")}, chr(10)) AS lines FROM conversations),
led AS (SELECT *, coalesce(list_min(list_transform(list_filter(lines, lambda l: trim(l, ' ') <> ''),
  lambda l: length(l) - length(ltrim(l, ' ')))), 0) AS lead FROM cleaned)
SELECT conv_id, turn, rpad(array_to_string(list_transform(lines[1:{H}],
  lambda l: rpad(substr(l, lead + 1), {W}, ' ')), ''), {W * H}, ' ') AS grid FROM led""")
def grid_normalize_left(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return normalize_grid(turns, "text", "grid", W, H, shift_left=True).select("conv_id", "turn", "grid")


@query(f"""WITH cleaned AS (SELECT page_id, rtrim({sql_clean("html")}, ' ' || chr(10)) AS t FROM pages)
SELECT page_id, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END::int AS n_lines,
  md5(CASE WHEN t = '' THEN '' ELSE regexp_replace(t, ' +$', '') END) AS digest FROM cleaned""")
def trimmed_lines(spark, sf_dir):
    cleaned = clean_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "t")
    lines = cleaned.select("page_id", tx.trimmed_lines(F.col("t")).alias("lines"))
    joined = F.rtrim(F.array_join("lines", "\n"))
    return lines.select("page_id", F.size("lines").alias("n_lines"), F.md5(joined).alias("digest"))


# --- vocabulary and tokens -----------------------------------------------------------------------


@query(f"WITH {VOCAB} SELECT tok_id, ch FROM vocab")
def vocab_build(spark, sf_dir):
    return vocab.build_vocab(grids(spark, sf_dir).filter(F.col("split") == "train"), "grid")


@query(f"WITH {TOKENS} SELECT doc_id, split, array_to_string(ids, ',') AS ids_csv FROM tokens")
def token_encode(spark, sf_dir):
    rows, chars = stored_grids(spark, sf_dir)
    return rows.select("doc_id", "split", csv(vocab.encode(F.col("grid"), chars)).alias("ids_csv"))


@query(f"""WITH {TOKENS}, flat AS (SELECT doc_id, array_to_string(chs, '') AS s FROM tokens)
SELECT doc_id, array_to_string(list_transform(range({H}), lambda r: substr(s, r * {W} + 1, {W})), chr(10)) AS art,
  replace(substr(s, 1, 200), ' ', chr(183)) AS preview FROM flat""")
def token_decode(spark, sf_dir):
    rows, chars = stored_grids(spark, sf_dir)
    flat = rows.select("doc_id", vocab.decode(vocab.encode(F.col("grid"), chars), chars).alias("s"))
    return flat.select("doc_id", tx.to_lines(F.col("s"), W).alias("art"), tx.preview(F.col("s")).alias("preview"))


@query(f"""WITH {VOCAB}, page_chars AS (SELECT unnest(string_split({sql_grid("html")}, '')) AS ch FROM pages)
SELECT ch, count(*) AS n FROM page_chars ANTI JOIN vocab USING (ch) GROUP BY ch""")
def oov_report(spark, sf_dir):
    pages = normalize_grid(table(spark, sf_dir, "pages").select("html"), "html", "grid", W, H)
    return vocab.unknown_chars(pages, "grid", train_vocab(spark, sf_dir))


@query(f"""WITH {TOKENS} SELECT doc_id,
  array_to_string(list_transform(ids, lambda i: CASE WHEN i <> 0 THEN 10 ELSE 3 END), ',') AS tenths FROM tokens""")
def position_weights(spark, sf_dir):
    rows, chars = stored_grids(spark, sf_dir)
    weights = vocab.position_weights(vocab.encode(F.col("grid"), chars))
    tenths = F.transform(weights, lambda w: F.floor(w * 10 + 0.5))
    return rows.select("doc_id", csv(tenths).alias("tenths"))


@query(f"""WITH {TOKENS} SELECT doc_id, array_to_string(list_sort(list_distinct(ids)), ',') AS distinct_ids FROM tokens""")
def record_token_set(spark, sf_dir):
    rows, chars = stored_grids(spark, sf_dir)
    ids = vocab.encode(F.col("grid"), chars)
    return rows.select("doc_id", csv(F.array_sort(F.array_distinct(ids))).alias("distinct_ids"))


@query(f"""WITH {TOKENS}, numbered AS (SELECT *, {INDEXED} AS idx FROM tokens)
SELECT split, idx, doc_id, array_to_string(ids, ',') AS ids_csv FROM numbered WHERE idx IN {RECORDS}""")
def record_by_index(spark, sf_dir):
    rows, chars = stored_grids(spark, sf_dir)
    chosen = with_dense_index(rows, "doc_id", ["split"], keep=batching.at(RECORDS))
    ids = vocab.encode(F.col("grid"), chars)
    return chosen.select("split", "idx", "doc_id", csv(ids).alias("ids_csv"))


# --- profiles ------------------------------------------------------------------------------------


@query(f"""WITH {DOCS}, parts AS (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p
  FROM docs WHERE split = 'train'),
sizes AS (SELECT doc_id, 'width' AS dimension, list_max(list_transform(p, lambda l: length(l)))::int AS value FROM parts
  UNION ALL SELECT doc_id, 'height', (len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END)::int FROM parts),
counted AS (SELECT dimension, value, count(*) AS n, min(doc_id) AS first FROM sizes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, first)::int AS rank FROM counted)
SELECT dimension, rank, value, n FROM ranked WHERE rank <= 5""")
def dims_top5(spark, sf_dir):
    return profile.dimension_histogram(documents(spark, sf_dir).filter(F.col("split") == "train"), "text", "doc_id", 5)


@query("""WITH chars AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, ascii(ch)::int AS cp, '0x' || lower(to_hex(ascii(ch))) AS hex, count(*) AS n_records
FROM chars WHERE ch NOT IN (chr(10), chr(13), '') GROUP BY ch""")
def codepoint_inventory(spark, sf_dir):
    return profile.codepoints(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {DOCS} SELECT split, count(*) AS n FROM docs GROUP BY split")
def split_counts(spark, sf_dir):
    return profile.split_counts(documents(spark, sf_dir))


# --- batches -------------------------------------------------------------------------------------

BATCHES = f"""{TOKENS}, numbered AS (
  SELECT t.*, coalesce(quality, -1)::int AS label, {INDEXED} AS idx FROM tokens t LEFT JOIN labels USING (doc_id)),
batches AS (SELECT split, (idx // {BATCH})::bigint AS batch_id, count(*)::int AS n,
  string_agg(array_to_string(ids, ','), ';' ORDER BY idx) AS ids,
  string_agg(label::varchar, ',' ORDER BY idx) AS labels FROM numbered GROUP BY ALL)"""


def _labelled(stored: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return stored.join(marks, "doc_id", "left").withColumn("label", F.coalesce("quality", F.lit(-1)))


def _assembled(numbered: DataFrame, chars: list[str], idx_col: str) -> DataFrame:
    # Grids are one byte per position; they are encoded after the shuffle, not before it.
    made = batching.assemble(numbered, BATCH, ["grid", "label"], idx_col, ["split"])
    encoded = made.withColumn("ids", vocab.encode(F.array_join("grid", ""), chars))
    ids = F.transform(batching.rows_of(F.col("ids"), W * H), csv)
    return encoded.select("split", "batch_id", "n", F.array_join(ids, ";").alias("ids"), csv(F.col("label")).alias("labels"))


def _batches(spark, sf_dir, n_batches=None, split=None):
    stored, chars = stored_grids(spark, sf_dir)
    rows = stored if split is None else stored.filter(F.col("split") == split)
    keep = None if n_batches is None else batching.in_first(n_batches, BATCH)
    numbered = with_dense_index(rows, "doc_id", ["split"], keep=keep)
    return _assembled(_labelled(numbered, spark, sf_dir), chars, "idx")


@query(f"WITH {BATCHES} SELECT * FROM batches")
def batch_assemble(spark, sf_dir):
    return _batches(spark, sf_dir)


@query(f"WITH {BATCHES} SELECT * FROM batches WHERE batch_id < {EVAL_BATCHES}")
def batch_head(spark, sf_dir):
    return _batches(spark, sf_dir, EVAL_BATCHES)


@query(f"WITH {BATCHES} SELECT * FROM batches WHERE split = 'test' AND batch_id < {FEW_BATCHES}")
def batch_head_test(spark, sf_dir):
    """The first few batches of the held-out split, which has more."""
    return _batches(spark, sf_dir, FEW_BATCHES, "test")


@query(f"""WITH {DOCS} SELECT doc_id, split,
  row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS pos FROM docs""")
def shuffle_order(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "split")
    return batching.shuffled_index(rows, "doc_id", SEED, ["split"])


@query(f"""WITH {TOKENS}, numbered AS (
  SELECT t.*, coalesce(quality, -1)::int AS label, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS pos
  FROM tokens t LEFT JOIN labels USING (doc_id) WHERE split = 'train')
SELECT split, (pos // {BATCH})::bigint AS batch_id, count(*)::int AS n,
  string_agg(array_to_string(ids, ','), ';' ORDER BY pos) AS ids,
  string_agg(label::varchar, ',' ORDER BY pos) AS labels FROM numbered GROUP BY ALL""")
def shuffled_batches(spark, sf_dir):
    """Training batches: the train split in seeded shuffle order."""
    stored, chars = stored_grids(spark, sf_dir)
    train = batching.shuffled_index(stored.filter(F.col("split") == "train"), "doc_id", SEED, ["split"])
    return _assembled(_labelled(train, spark, sf_dir), chars, "pos")


# --- sheets and artifacts ------------------------------------------------------------------------


@query(f"""WITH turns AS (SELECT conv_id, turn, {sql_grid("text")} AS grid FROM conversations),
items AS (SELECT conv_id, grid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, grid) - 1 AS item FROM turns),
lines AS (SELECT conv_id, item, unnest(range({H})) AS row, grid FROM items)
SELECT conv_id, (item // 10)::bigint AS strip, row::int AS row,
  string_agg(substr(grid, row * {W} + 1, {W}) || '  ', '' ORDER BY item) AS line FROM lines GROUP BY ALL""")
def contact_sheet(spark, sf_dir):
    """Conversations as sheets. Turns are numbered first: a repeated turn must not overfill a strip."""
    turns = normalize_grid(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "grid", W, H)
    items = dense_index(turns.drop("text"), ["turn", "grid"], ["conv_id"], "item", unique=False)
    return render.contact_sheet(items, ["conv_id"], "item", "grid", W, H)


@query(f"""WITH {VOCAB} SELECT tok_id, ch, {W}::int AS w, {H}::int AS h, {W * H}::int AS l, 16::int AS emb_dim,
  400::int AS steps, 0.0001::double AS beta_first, 0.02::double AS beta_last FROM vocab""")
def config_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "run")
    train = grids(spark, sf_dir).filter(F.col("split") == "train")
    save_artifacts(vocab.build_vocab(train, "grid"), RUN, path)
    saved, config = load_artifacts(spark, path)
    whole = {"w": "W", "h": "H", "l": "L", "emb_dim": "emb_dim", "steps": "steps"}
    return saved.select(
        "*",
        *[F.lit(config[name]).cast("int").alias(alias) for alias, name in whole.items()],
        F.lit(config["betas"][0]).alias("beta_first"),
        F.lit(config["betas"][1]).alias("beta_last"),
    )
