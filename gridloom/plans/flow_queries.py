"""The end-to-end runs over the given tables; 8 x 8 embeddings stand in for labelled images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import vectors as vec
from gridloom.operators import codebook, render
from gridloom.operators.indexing import dense_index, with_dense_index
from gridloom.plans import flows
from gridloom.plans.registry import csv, query
from gridloom.plans.text_queries import SEED
from gridloom.plans.vector_queries import (
    RENDERED,
    SCORES,
    SETTINGS,
    SHEET_H,
    SHEET_W,
    SIDE,
    SWEEP,
    images,
    label_codebook,
    sql_best,
    sql_heated,
    vectors,
)
from gridloom.sources.manifest import read_manifest
from gridloom.storage import scratch_path

GRID = SHEET_W * SHEET_H
ROOT = "/dataset"


def _dataset(spark, sf_dir):
    """Every fifth image is held out; the images are numbered within their split."""
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    rows = images(spark, sf_dir).withColumn("split", split)
    labelled = with_dense_index(rows, "vec_id", ["split"]).withColumns({"w": F.lit(SIDE), "h": F.lit(SIDE)})
    out = scratch_path(spark, "dataset")
    flows.build_dataset(labelled, out, SHEET_W, SHEET_H)
    return out


BUILT = f"""{RENDERED}, splits AS (
  SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings),
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY vec_id) - 1 AS idx FROM splits),
named AS (SELECT vec_id, split, label, split || '-' || lpad(idx::varchar, greatest(6, length(idx::varchar))::int, '0') AS id
  FROM numbered),
texts AS (SELECT vec_id, string_agg(line, '' ORDER BY r) AS grid FROM lines GROUP BY vec_id)"""


@query(f"""WITH {BUILT} SELECT id, split, label,
  '{ROOT}/' || split || '/orig_imgs/' || id || '.png' AS orig_img_path,
  '{ROOT}/' || split || '/ascii_txt/' || id || '-ascii-art.txt' AS ascii_txt_path,
  {SHEET_W}::int AS ascii_width, {SHEET_H}::int AS ascii_height FROM named""")
def dataset_build(spark, sf_dir):
    out = _dataset(spark, sf_dir)
    rows = read_manifest(spark, f"{out}/manifest")
    paths = [F.replace(F.col(c), F.lit(out), F.lit(ROOT)).alias(c) for c in ("orig_img_path", "ascii_txt_path")]
    return rows.select("id", "split", "label", *paths, "ascii_width", "ascii_height")


@query(f"""WITH {BUILT}, placed AS (SELECT id, split, label, unnest(string_split(grid, '')) AS ch,
  generate_subscripts(string_split(grid, ''), 1) AS pos FROM named JOIN texts USING (vec_id)),
chars AS (SELECT ch FROM placed WHERE split = 'train' UNION SELECT ' '),
vocab AS (SELECT ch, row_number() OVER (ORDER BY ascii(ch)) - 1 AS tok_id FROM chars)
SELECT id, label, string_agg(coalesce(tok_id, 0)::varchar, ',' ORDER BY pos) AS ids_csv
FROM placed LEFT JOIN vocab USING (ch) GROUP BY id, label""")
def dataset_encode(spark, sf_dir):
    grids = flows.load_grids(spark, _dataset(spark, sf_dir), SHEET_W, SHEET_H)
    encoded, _ = flows.encode_splits(grids)
    return encoded.select("id", "label", csv(F.col("ids")).alias("ids_csv"))


@query(f"""WITH {SCORES}, {SETTINGS},
guided AS (SELECT vec_id, setting, strength, temperature,
  list_transform(logits, lambda x: list_avg(logits) + strength * (x - list_avg(logits))) AS g FROM scored, settings),
drawn AS (SELECT *, {sql_heated("g", "temperature", "vec_id", "setting")} AS s FROM guided),
chosen AS (SELECT vec_id, strength, temperature, substr('{render.DEFAULT_RAMP}', {sql_best("s")} + 1, 1) AS ch FROM drawn),
numbered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
grids AS (SELECT strength, temperature, idx // {GRID} AS item, rpad(string_agg(ch, '' ORDER BY idx), {GRID}, ' ') AS grid
  FROM chosen JOIN numbered USING (vec_id) GROUP BY ALL)
SELECT strength, temperature, (item // 10)::bigint AS strip, r.row::int AS row,
  string_agg(substr(grid, (r.row * {SHEET_W})::int + 1, {SHEET_W}) || '  ', '' ORDER BY item) AS line
FROM grids, range({SHEET_H}) r(row) GROUP BY ALL""")
def sample_sheets(spark, sf_dir):
    """Vectors decoded under each guidance setting; 15 consecutive ones make a grid, ten grids a strip."""
    codes = label_codebook(spark, sf_dir)
    rows = vectors(spark, sf_dir).select("vec_id", "e")
    scored = rows.select("vec_id", codebook.scores(F.col("e"), codes).alias("cond"))
    flat = vec.let(vec.total(F.col("cond")) / F.size("cond"), lambda m: F.transform("cond", lambda _: m))
    swept = codebook.guidance_sweep(scored.withColumn("uncond", flat), "cond", "uncond", SWEEP)
    tok = codebook.sample_code(
        F.col("guided"), F.col("temperature"), len(codes), SEED, F.col("vec_id"), F.col("setting")
    )
    tokens = swept.select("vec_id", "strength", "temperature", tok.alias("tok_id"))
    numbered = tokens.join(dense_index(rows.select("vec_id"), ["vec_id"]), "vec_id")
    return flows.sample_sheets(numbered, list(render.DEFAULT_RAMP), SHEET_W, SHEET_H, ["strength", "temperature"])
