"""Queries over vector tables: schedules, noising, codebook scoring, metrics, images.

Embeddings serve as vectors with 64 components and as 8 x 8 images. The codebook is the mean
vector of each label, so label and token id coincide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import vectors as vec
from gridloom.operators import batching, codebook, metrics, render, schedule, vocab
from gridloom.operators.indexing import with_dense_index
from gridloom.plans.registry import micro_csv, query, rounded, sql_micro_csv, sql_rounded, sql_uniform, sql_word, table
from gridloom.plans.text_queries import BATCH, EVAL_BATCHES, H, SEED, TOKENS, W, stored_grids

DIM, SIDE = 64, 8  # components of an embedding; side of the same 64 values seen as an image
FEATURES = 16  # width of time and token features
SEQUENCE = W * H  # vectors per sequence
SWEEP = [(3.0, 1.0), (4.0, 0.7), (4.5, 0.7), (4.5, 0.0), (7.6, 0.1)]  # guidance strength and temperature
SHEET_W, SHEET_H = 5, 3  # does not divide the image side, so cells differ in size


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vec.doubles(F.col("embedding")).alias("e"), schedule.draw_timestep(schedule.STEPS, SEED, F.col("vec_id")).alias("t")
    )


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tok_id, vec)``. Sums are combined per task, so a hot label moves 64 sums per task."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(F.col("label").alias("tok_id")).agg(F.transform(ordered, lambda part: part["m"]).alias("vec"))


def label_codebook(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return codebook.load_codebook(label_means(spark, sf_dir))


def noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("eps", schedule.gaussian(DIM, SEED, F.col("vec_id")))
    return schedule.add_noise(rows, schedule.noise_schedule(spark), "e", "eps")


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noised vectors with the logits, and the expected clean vector, of a codebook as their model."""
    codes = label_codebook(spark, sf_dir)
    scored = noised(spark, sf_dir).withColumn("logits", codebook.scores(F.col("x_t"), codes))
    return scored.withColumn("x0_hat", codebook.expected_vector(F.col("logits"), codes))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scaled per row to [0, 1] and quantised to 8 bits."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", "e", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"))
    unit = F.transform("e", lambda x: F.when(F.col("hi") > F.col("lo"), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    return rows.select("vec_id", "label", render.quantise(unit).alias("pixels"))


# --- SQL building blocks -------------------------------------------------------------------------

SEED_SQL = f"'{SEED}'"
VECTORS = f"""vecs AS (SELECT vec_id, label, embedding::double[] AS e,
  floor({sql_uniform(SEED_SQL, "'t'", "vec_id")} * {schedule.STEPS})::int AS t FROM embeddings)"""
SLOPE = (schedule.BETA_LAST - schedule.BETA_FIRST) / (schedule.STEPS - 1)
SCHEDULE = f"""betas AS (SELECT r.t::int AS t, 1e-4 + {SLOPE!r} * r.t AS beta FROM range({schedule.STEPS}) r(t)),
sched AS (SELECT t, beta, 1 - beta AS alpha, product(1 - beta) OVER (ORDER BY t) AS alpha_bar FROM betas)"""
POSTERIOR = f"""{SCHEDULE}, prevs AS (SELECT *, lag(alpha_bar, 1, 1.0) OVER (ORDER BY t) AS ab_prev FROM sched),
post AS (SELECT t, ab_prev, sqrt(ab_prev) * beta / (1 - alpha_bar) AS c_x0,
  sqrt(alpha) * (1 - ab_prev) / (1 - alpha_bar) AS c_x,
  greatest(beta * (1 - ab_prev) / (1 - alpha_bar + 1e-8), 1e-20) AS var FROM prevs)"""


def sql_normals(name: str, source: str, key: str, what: str, dim: int) -> str:
    """CTE ``name(key, z)`` of standard normal vectors; the same md5 words as the Spark side."""
    return f"""{name}_hash AS (SELECT {key}, i, md5(concat_ws(':', {SEED_SQL}, '{what}', {key}, i // 4)) AS h
  FROM {source}, range({dim}) r(i)),
{name}_polar AS (SELECT {key}, i, sqrt(-2 * ln({sql_word("h", "(16 * ((i % 4) // 2) + 1)")})) AS radius,
  2 * pi() * {sql_word("h", "(16 * ((i % 4) // 2) + 9)")} AS angle FROM {name}_hash),
{name} AS (SELECT {key}, list(radius * CASE WHEN i % 2 = 0 THEN cos(angle) ELSE sin(angle) END ORDER BY i) AS z
  FROM {name}_polar GROUP BY {key})"""


def sql_zip(expr: str, *lists: str) -> str:
    """Combine lists component by component; ``expr`` names them a, b, c."""
    body = expr
    for letter, values in zip("abc", lists):
        body = body.replace(f"${letter}", f"({values})[i]")
    return f"list_transform(range(1, {DIM + 1}), lambda i: {body})"


CODES = f"""{VECTORS}, comps AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vecs),
means AS (SELECT label, i, avg(x) AS m FROM comps GROUP BY ALL),
codes AS (SELECT label AS tok_id, list(m ORDER BY i) AS c FROM means GROUP BY label)"""


def sql_scores(name: str, source: str, column: str) -> str:
    return f"""{name} AS (SELECT vec_id, list(list_inner_product({column}, c) ORDER BY tok_id) AS logits
  FROM {source}, codes GROUP BY vec_id)"""


SCORES = f"{CODES}, {sql_scores('scored', 'vecs', 'e')}"
SOFTMAX = """shares AS (SELECT vec_id, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS w FROM scored),
soft AS (SELECT vec_id, logits, list_transform(w, lambda x: x / list_sum(w)) AS probs FROM shares),
parts AS (SELECT vec_id, i, sum(probs[tok_id + 1] * c[i]) AS x FROM soft, codes, range(1, 65) r(i) GROUP BY ALL),
expected AS (SELECT vec_id, list(x ORDER BY i) AS x0 FROM parts GROUP BY vec_id)"""
NOISED = f"""{CODES}, {SCHEDULE}, {sql_normals("noise", "vecs", "vec_id", "eps", DIM)},
noised AS (SELECT v.vec_id, v.label, v.t, s.alpha_bar, n.z AS eps,
  {sql_zip("sqrt(s.alpha_bar) * $a + sqrt(1 - s.alpha_bar) * $b", "v.e", "n.z")} AS x_t
  FROM vecs v JOIN noise n USING (vec_id) JOIN sched s USING (t))"""
DENOISED = f"""{NOISED}, {sql_scores('scored', 'noised', 'x_t')}, {SOFTMAX},
denoised AS (SELECT n.*, logits, x0,
  {sql_zip("($a - sqrt(n.alpha_bar) * $b) / sqrt(1 - n.alpha_bar + 1e-8)", "n.x_t", "x.x0")} AS eps_hat
  FROM noised n JOIN expected x USING (vec_id) JOIN scored USING (vec_id))"""


def sql_best(scores: str) -> str:
    return f"(list_position({scores}, list_max({scores})) - 1)::int"


def sql_gumbel(logits: str, temperature: str, *keys: str) -> str:
    keyed = ", ".join([SEED_SQL, "'gumbel'", *keys])
    u = sql_word(f"md5(concat_ws(':', {keyed}, (i - 1) // 4))", "8 * ((i - 1) % 4) + 1")
    return f"list_transform(range(1, len({logits}) + 1), lambda i: ({logits})[i] / {temperature} - ln(-ln({u})))"


def sql_heated(logits: str, temperature: str, *keys: str) -> str:
    """Scores to draw by; at a temperature of 0 the logits themselves."""
    return f"CASE WHEN {temperature} <= 0 THEN {logits} ELSE {sql_gumbel(logits, temperature, *keys)} END"


SETTINGS = "settings(setting, strength, temperature) AS (VALUES {})".format(
    ", ".join(f"({i}, {s}::double, {t}::double)" for i, (s, t) in enumerate(SWEEP))
)


# --- schedule and noise --------------------------------------------------------------------------


@query(f"""WITH {VECTORS}, {SCHEDULE}, drawn AS (SELECT t, count(*) AS n FROM vecs GROUP BY t)
SELECT t, {sql_rounded("beta")} AS beta, {sql_rounded("alpha")} AS alpha, {sql_rounded("alpha_bar")} AS alpha_bar,
  coalesce(n, 0) AS n_drawn FROM sched LEFT JOIN drawn USING (t)""")
def noise_schedule(spark, sf_dir):
    """Every step of the schedule with the number of vectors that drew it."""
    drawn = vectors(spark, sf_dir).groupBy("t").agg(F.count("*").alias("n"))
    steps = schedule.noise_schedule(spark)
    values = [rounded(F.col(c)).alias(c) for c in ("beta", "alpha", "alpha_bar")]
    return steps.join(drawn, "t", "left").select("t", *values, F.coalesce("n", F.lit(0)).alias("n_drawn"))


@query(f"""WITH {VECTORS}, {POSTERIOR} SELECT vec_id, t, {sql_rounded("ab_prev")} AS alpha_bar_prev,
  {sql_rounded("c_x0")} AS c_x0, {sql_rounded("c_x")} AS c_x, {sql_rounded("var")} AS var FROM vecs JOIN post USING (t)""")
def posterior_coefs(spark, sf_dir):
    at = schedule.posterior(schedule.noise_schedule(spark))
    values = [rounded(F.col(c)).alias(c) for c in ("alpha_bar_prev", "c_x0", "c_x", "var")]
    return vectors(spark, sf_dir).join(at, "t").select("vec_id", "t", *values)


@query(f"WITH {NOISED} SELECT vec_id, t, {sql_micro_csv('eps')} AS eps, {sql_micro_csv('x_t')} AS x_t FROM noised")
def forward_noise(spark, sf_dir):
    rows = noised(spark, sf_dir)
    return rows.select("vec_id", "t", micro_csv(F.col("eps")).alias("eps"), micro_csv(F.col("x_t")).alias("x_t"))


@query(f"""SELECT vec_id, CASE WHEN {sql_uniform(SEED_SQL, "'drop'", "vec_id")} < 0.1 THEN 10 ELSE label END::int AS label_in
FROM embeddings""")
def label_dropout(spark, sf_dir):
    kept = schedule.drop_labels(F.col("label"), SEED, F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("label_in"))


# --- features ------------------------------------------------------------------------------------

FREQS = f"list_transform(range({FEATURES // 2}), lambda i: exp(ln(1e-4) + (ln(1.0) - ln(1e-4)) / {FEATURES // 2 - 1} * i))"


@query(f"""WITH {VECTORS}, waves AS (SELECT vec_id, t, {FREQS} AS f FROM vecs)
SELECT vec_id, t, {sql_micro_csv("list_concat(list_transform(f, lambda q: sin(t * q)), list_transform(f, lambda q: cos(t * q)))")}
  AS features FROM waves""")
def sinusoidal_features(spark, sf_dir):
    features = vec.sinusoidal(F.col("t"), FEATURES)
    return vectors(spark, sf_dir).select("vec_id", "t", micro_csv(features).alias("features"))


def sql_positional(pos: str, i: str, dim: int) -> str:
    """Component ``i`` (from 0) of the positional features."""
    angle = f"{pos} * exp(-ln(10000.0) * (({i}) - ({i}) % 2) / {dim})"
    return f"CASE WHEN ({i}) % 2 = 0 THEN sin({angle}) ELSE cos({angle}) END"


@query(f"""WITH {VECTORS}, placed AS (SELECT vec_id, e, vec_id % {SEQUENCE} AS pos FROM vecs)
SELECT vec_id, pos, {sql_micro_csv(sql_zip("$a + " + sql_positional("pos", "i - 1", DIM), "e"))} AS x FROM placed""")
def positional_features(spark, sf_dir):
    """Vectors read as sequences of 200, each with the features of its place added."""
    placed = vectors(spark, sf_dir).select("vec_id", "e", (F.col("vec_id") % SEQUENCE).alias("pos"))
    x = vec.add(F.col("e"), vec.positional(F.col("pos"), DIM))
    return placed.select("vec_id", "pos", micro_csv(x).alias("x"))


# --- codebook ------------------------------------------------------------------------------------


@query(f"WITH {CODES} SELECT vec_id, {sql_micro_csv('c')} AS code FROM vecs JOIN codes ON label = tok_id")
def codebook_lookup(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.array("label").alias("ids"))
    found = codebook.embed_tokens(rows, "ids", label_codebook(spark, sf_dir), "vecs")
    return found.select("vec_id", micro_csv(F.flatten("vecs")).alias("code"))


def _checksum(vectors: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Per record, millionths of all components weighed by their place, from 1."""
    width = vectors.shape[1]
    place = np.arange(len(vectors)) - np.repeat(offsets[:-1], np.diff(offsets))
    weights = place[:, None] * width + np.arange(1, width + 1)
    sums = np.append(0, np.cumsum((np.floor(vectors * 1e6 + 0.5).astype(np.int64) * weights).sum(axis=1)))
    return pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64(), mask=missing)


@query(f"""WITH {TOKENS}, {sql_normals("code", "vocab", "tok_id", "code", FEATURES)},
places AS (SELECT doc_id, unnest(ids) AS tok_id, unnest(range(len(ids))) AS pos FROM tokens),
comps AS (SELECT doc_id, pos, unnest(z) AS z, unnest(range({FEATURES})) AS i FROM places JOIN code USING (tok_id))
SELECT doc_id, sum(floor((0.02 * z + {sql_positional("pos", "i", FEATURES)}) * 1e6 + 0.5)::bigint
  * (pos * {FEATURES} + i + 1))::bigint AS checksum FROM comps GROUP BY doc_id""")
def token_embed(spark, sf_dir):
    """Document tokens looked up in a seeded normal codebook (spread 0.02), positional features added."""
    rows, chars = stored_grids(spark, sf_dir)
    ids = spark.range(len(chars)).select(F.col("id").cast("int").alias("tok_id"))
    drawn = vec.scale(F.lit(0.02), schedule.gaussian(FEATURES, SEED, F.col("tok_id"), "code"))
    codes = codebook.load_codebook(ids.select("tok_id", drawn.alias("vec")))
    tokens = rows.select("doc_id", vocab.encode(F.col("grid"), chars).alias("ids"))
    summed = codebook.reduce_embedded(tokens, "ids", codes, T.StructField("checksum", T.LongType()), _checksum, places=True)
    return summed.select("doc_id", "checksum")


GAP = 4  # a label that the second codebook leaves out


@query(f"""WITH {CODES.replace("FROM means GROUP BY label", f"FROM means WHERE label <> {GAP} GROUP BY label")},
names AS (SELECT list(tok_id ORDER BY tok_id) AS names FROM codes), {sql_scores("scored", "vecs", "e")}
SELECT s.vec_id, names[{sql_best("logits")} + 1] AS best, {sql_micro_csv("c")} AS code
FROM scored s JOIN vecs v USING (vec_id) CROSS JOIN names LEFT JOIN codes ON label = tok_id""")
def codebook_gap(spark, sf_dir):
    """Best label, and the code of the own label, with a codebook that lacks one label."""
    names, codes = codebook.load_named_codes(label_means(spark, sf_dir).filter(F.col("tok_id") != GAP))
    own = codebook.code_of(F.col("label"), names)
    ids = F.when(own.isNotNull(), F.array(own))
    rows = vectors(spark, sf_dir).select("vec_id", ids.alias("ids"), codebook.scores(F.col("e"), codes).alias("l"))
    found = codebook.embed_tokens(rows, "ids", codes, "vecs")
    best = codebook.name_of(codebook.nearest_code(F.col("l")), names)
    return found.select("vec_id", best.cast("int").alias("best"), micro_csv(F.flatten("vecs")).alias("code"))


@query(f"WITH {SCORES} SELECT vec_id, {sql_best('logits')} AS tok_id FROM scored")
def codebook_argmax(spark, sf_dir):
    logits = codebook.scores(F.col("e"), label_codebook(spark, sf_dir))
    return vectors(spark, sf_dir).select("vec_id", logits.alias("l")).select("vec_id", codebook.nearest_code(F.col("l")).alias("tok_id"))


@query(f"""WITH {SCORES}, drawn AS (SELECT vec_id, {sql_gumbel("logits", "0.7", "vec_id")} AS g FROM scored)
SELECT vec_id, {sql_best("g")} AS tok_id FROM drawn""")
def codebook_sample(spark, sf_dir):
    codes = label_codebook(spark, sf_dir)
    scored = vectors(spark, sf_dir).select("vec_id", codebook.scores(F.col("e"), codes).alias("l"))
    return scored.select("vec_id", codebook.sample_code(F.col("l"), 0.7, len(codes), SEED, F.col("vec_id")).alias("tok_id"))


@query(f"""WITH {SCORES}, {SOFTMAX}
SELECT vec_id, {sql_micro_csv("probs")} AS probs, {sql_micro_csv("x0")} AS x0_hat FROM soft JOIN expected USING (vec_id)""")
def softmax_expected(spark, sf_dir):
    codes = label_codebook(spark, sf_dir)
    scored = vectors(spark, sf_dir).select("vec_id", codebook.scores(F.col("e"), codes).alias("l"))
    mixed = scored.withColumn("x0", codebook.expected_vector(F.col("l"), codes))
    return mixed.select("vec_id", micro_csv(vec.softmax(F.col("l"))).alias("probs"), micro_csv(F.col("x0")).alias("x0_hat"))


@query(f"WITH {DENOISED} SELECT vec_id, t, {sql_micro_csv('eps_hat')} AS eps_hat FROM denoised")
def noise_recover(spark, sf_dir):
    eps_hat = schedule.recover_noise(F.col("x_t"), F.col("x0_hat"), F.col("alpha_bar"))
    return denoised(spark, sf_dir).select("vec_id", "t", micro_csv(eps_hat).alias("eps_hat"))


@query(f"""WITH {DENOISED}, prevs AS (SELECT *, lag(alpha_bar, 1, 1.0) OVER (ORDER BY t) AS ab_prev FROM sched),
post AS (SELECT t, sqrt(ab_prev) * beta / (1 - alpha_bar) AS c_x0, sqrt(alpha) * (1 - ab_prev) / (1 - alpha_bar) AS c_x,
  CASE WHEN t > 0 THEN sqrt(greatest(beta * (1 - ab_prev) / (1 - alpha_bar + 1e-8), 1e-20)) ELSE 0 END AS spread FROM prevs),
{sql_normals("fresh", "vecs", "vec_id", "z", DIM)}
SELECT vec_id, t, {sql_micro_csv(sql_zip("p.c_x0 * $a + p.c_x * $b + p.spread * $c", "d.x0", "d.x_t", "f.z"))} AS x_prev
FROM denoised d JOIN fresh f USING (vec_id) JOIN post p USING (t)""")
def reverse_step(spark, sf_dir):
    rows = denoised(spark, sf_dir).withColumn("z", schedule.gaussian(DIM, SEED, F.col("vec_id"), "z"))
    at = schedule.posterior(schedule.noise_schedule(spark))
    stepped = schedule.reverse_step(rows, at, "x_t", "x0_hat", "z")
    return stepped.select("vec_id", "t", micro_csv(F.col("x_prev")).alias("x_prev"))


@query(f"""WITH {SCORES}, {SETTINGS},
guided AS (SELECT vec_id, setting, strength, temperature,
  list_transform(logits, lambda x: list_avg(logits) + strength * (x - list_avg(logits))) AS g FROM scored, settings),
drawn AS (SELECT *, {sql_heated("g", "temperature", "vec_id", "setting")} AS s FROM guided)
SELECT vec_id, strength, temperature, {sql_micro_csv("g")} AS guided, {sql_best("s")} AS tok_id FROM drawn""")
def guidance_sweep(spark, sf_dir):
    """Scores guided away from their mean, decoded once per strength and temperature."""
    codes = label_codebook(spark, sf_dir)
    scored = vectors(spark, sf_dir).select("vec_id", codebook.scores(F.col("e"), codes).alias("cond"))
    flat = vec.let(vec.total(F.col("cond")) / F.size("cond"), lambda m: F.transform("cond", lambda _: m))
    swept = codebook.guidance_sweep(scored.withColumn("uncond", flat), "cond", "uncond", SWEEP)
    tok = codebook.sample_code(F.col("guided"), F.col("temperature"), len(codes), SEED, F.col("vec_id"), F.col("setting"))
    return swept.select("vec_id", "strength", "temperature", micro_csv(F.col("guided")).alias("guided"), tok.alias("tok_id"))


# --- metrics -------------------------------------------------------------------------------------

LOSSES = f"""{DENOISED}, rows AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // {BATCH} AS batch_id,
  list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1] AS ce,
  list_sum({sql_zip("($a - $b) * ($a - $b)", "eps_hat", "eps")}) AS sq_err FROM denoised),
losses AS (SELECT batch_id::bigint AS batch_id, count(*) AS n, avg(ce) AS ce, sum(sq_err) / sum({DIM}) AS mse,
  sum(sq_err) / sum({DIM}) + 0.5::double * avg(ce) AS loss FROM rows GROUP BY batch_id)"""


def _losses(spark, sf_dir):
    rows = denoised(spark, sf_dir)
    eps_hat = schedule.recover_noise(F.col("x_t"), F.col("x0_hat"), F.col("alpha_bar"))
    # Vectors are reduced to two numbers per row before the rows are numbered and grouped.
    narrow = rows.select(
        "vec_id",
        metrics.cross_entropy(F.col("logits"), F.col("label")).alias("ce"),
        vec.squared_error(eps_hat, F.col("eps")).alias("sq_err"),
        F.size("eps").alias("size"),
    )
    keys = table(spark, sf_dir, "embeddings").select("vec_id")
    batched = with_dense_index(narrow, "vec_id", keys=keys).withColumn("batch_id", batching.batch_id("idx", BATCH))
    return metrics.batch_losses(batched, "ce", "sq_err", "size", ["batch_id"])


@query(f"""WITH {LOSSES} SELECT batch_id, n, {sql_rounded("ce")} AS ce, {sql_rounded("mse")} AS mse,
  {sql_rounded("loss")} AS loss FROM losses""")
def eval_batches(spark, sf_dir):
    return _losses(spark, sf_dir).select("batch_id", "n", *[rounded(F.col(c)).alias(c) for c in ("ce", "mse", "loss")])


@query(f"""WITH {LOSSES} SELECT coalesce(sum(n), 0)::bigint AS n,
  {", ".join(f"{sql_rounded(f'coalesce(sum({c} * n), 0) / greatest(1, coalesce(sum(n), 0))')} AS {c}" for c in ("ce", "mse", "loss"))}
FROM losses""")
def eval_metrics(spark, sf_dir):
    means = metrics.weighted_mean(_losses(spark, sf_dir), ["ce", "mse", "loss"])
    return means.select("n", *[rounded(F.col(c)).alias(c) for c in ("ce", "mse", "loss")])


SEQUENCES = f"""{TOKENS}, {SCHEDULE}, {sql_normals("code", "vocab", "tok_id", "code", FEATURES)},
chosen AS (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
  floor({sql_uniform(SEED_SQL, "'t'", "doc_id")} * {schedule.STEPS})::int AS t FROM tokens WHERE split = 'test'),
held AS (SELECT doc_id, ids, idx // {BATCH} AS batch_id, alpha_bar AS ab FROM chosen JOIN sched USING (t)
  WHERE idx < {EVAL_BATCHES * BATCH}),
hashes AS (SELECT doc_id, pos, i, md5(concat_ws(':', {SEED_SQL}, 'eps', doc_id, pos, i // 4)) AS h
  FROM held, range({SEQUENCE}) p(pos), range({FEATURES}) r(i)),
polar AS (SELECT doc_id, pos, i, sqrt(-2 * ln({sql_word("h", "(16 * ((i % 4) // 2) + 1)")})) AS radius,
  2 * pi() * {sql_word("h", "(16 * ((i % 4) // 2) + 9)")} AS angle FROM hashes),
drawn AS (SELECT doc_id, pos, list(radius * CASE WHEN i % 2 = 0 THEN cos(angle) ELSE sin(angle) END ORDER BY i) AS eps
  FROM polar GROUP BY doc_id, pos),
noised AS (SELECT d.doc_id, pos, ids[pos + 1] AS tok_id, ab, eps, batch_id, list_transform(range(1, {FEATURES + 1}),
  lambda i: sqrt(ab) * c.z[i] + sqrt(1 - ab) * eps[i]) AS x
  FROM drawn d JOIN held USING (doc_id) JOIN code c ON c.tok_id = ids[pos + 1]),
every AS (SELECT list(z ORDER BY tok_id) AS codes FROM code),
scored AS (SELECT n.*, codes, list_transform(codes, lambda c: list_inner_product(x, c)) AS logits FROM noised n, every),
shares AS (SELECT *, list_transform(logits, lambda l: exp(l - list_max(logits))) AS w FROM scored),
errors AS (SELECT doc_id, batch_id, list_max(logits) + ln(list_sum(w)) - logits[tok_id + 1] AS ce,
  list_sum(list_transform(range(1, {FEATURES + 1}), lambda i: power((x[i] - sqrt(ab)
    * list_inner_product(w, list_transform(codes, lambda c: c[i])) / list_sum(w)) / sqrt(1 - ab + 1e-8) - eps[i], 2))) AS sq_err
  FROM shares),
records AS (SELECT doc_id, batch_id, avg(ce) AS ce, sum(sq_err) AS sq_err FROM errors GROUP BY doc_id, batch_id),
losses AS (SELECT batch_id, count(*) AS n, avg(ce) AS ce, sum(sq_err) / (count(*) * {SEQUENCE * FEATURES}) AS mse
  FROM records GROUP BY batch_id)"""


@query(f"""WITH {SEQUENCES} SELECT sum(n)::bigint AS n, {sql_rounded("sum(ce * n) / sum(n)")} AS ce,
  {sql_rounded("sum(mse * n) / sum(n)")} AS mse, {sql_rounded("sum((mse + 0.5 * ce) * n) / sum(n)")} AS loss FROM losses""")
def sequence_eval(spark, sf_dir):
    """Held-out documents as sequences of 200 vectors: noised, scored against their ids, over the first batches."""
    rows, chars = stored_grids(spark, sf_dir)
    ids = spark.range(len(chars)).select(F.col("id").cast("int").alias("tok_id"))
    codes = codebook.load_codebook(ids.select("tok_id", schedule.gaussian(FEATURES, SEED, F.col("tok_id"), "code").alias("vec")))
    test = rows.filter(F.col("split") == "test")
    held = with_dense_index(test, "doc_id", keep=batching.in_first(EVAL_BATCHES, BATCH), keys=test.select("doc_id"))
    t = schedule.draw_timestep(schedule.STEPS, SEED, F.col("doc_id"))
    tokens = held.select("doc_id", "idx", t.alias("t"), vocab.encode(F.col("grid"), chars).alias("ids"))
    errors = metrics.sequence_errors(tokens, "ids", codes, schedule.noise_schedule(spark), SEED, "doc_id")
    batched = errors.withColumn("batch_id", batching.batch_id("idx", BATCH))
    losses = metrics.batch_losses(batched, "ce", "sq_err", "size", ["batch_id"])
    means = metrics.weighted_mean(losses, ["ce", "mse", "loss"])
    return means.select("n", *[rounded(F.col(c)).alias(c) for c in ("ce", "mse", "loss")])


# --- images --------------------------------------------------------------------------------------

IMAGES = f"""{VECTORS}, images AS (SELECT vec_id, label, list_transform(e, lambda x:
  CASE WHEN list_max(e) > list_min(e) THEN floor((x - list_min(e)) / (list_max(e) - list_min(e)) * 255) ELSE 0 END::int) AS px
  FROM vecs)"""
RENDERED = f"""{IMAGES}, cells AS (SELECT vec_id, label, r, c, px, r * {SIDE} // {SHEET_H} AS top, c * {SIDE} // {SHEET_W} AS lft,
  (r + 1) * {SIDE} // {SHEET_H} AS bottom, (c + 1) * {SIDE} // {SHEET_W} AS rgt
  FROM images, range({SHEET_H}) a(r), range({SHEET_W}) b(c)),
sums AS (SELECT vec_id, label, r, c, (bottom - top) * (rgt - lft) AS area, list_sum(list_transform(range(top, bottom), lambda y:
  list_sum(px[y * {SIDE} + lft + 1 : y * {SIDE} + rgt]))) AS total FROM cells),
shades AS (SELECT vec_id, label, r, c, substr('{render.DEFAULT_RAMP}', (total * {len(render.DEFAULT_RAMP)} // (256 * area))::int + 1, 1) AS ch
  FROM sums),
lines AS (SELECT vec_id, label, r, string_agg(ch, '' ORDER BY c) AS line FROM shades GROUP BY ALL)"""


@query(f"WITH {IMAGES} SELECT vec_id, array_to_string(px, ',') AS pixels FROM images")
def pixel_quantise(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


@query(f"WITH {RENDERED} SELECT vec_id, string_agg(line, chr(10) ORDER BY r) AS art FROM lines GROUP BY vec_id")
def render_grid(spark, sf_dir):
    art = render.render_grid(F.col("pixels"), F.lit(SIDE), F.lit(SIDE), SHEET_W, SHEET_H)
    return images(spark, sf_dir).select("vec_id", art.alias("art"))


@query(f"""WITH {RENDERED}, numbered AS (
  SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS item FROM embeddings)
SELECT label, (item // 10)::bigint AS strip, r::int AS row, string_agg(line || '  ', '' ORDER BY item) AS line
FROM lines JOIN numbered USING (vec_id) GROUP BY ALL""")
def label_sheets(spark, sf_dir):
    """All images of a label side by side, ten to a strip; a hot label only has more strips."""
    art = render.render_grid(F.col("pixels"), F.lit(SIDE), F.lit(SIDE), SHEET_W, SHEET_H)
    rendered = images(spark, sf_dir).select("vec_id", "label", F.replace(art, F.lit("\n"), F.lit("")).alias("grid"))
    items = with_dense_index(rendered, "vec_id", ["label"])
    return render.contact_sheet(items, ["label"], "idx", "grid", SHEET_W, SHEET_H)
