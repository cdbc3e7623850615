"""Schedules, noise, codebooks, metrics, rendering, sheets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import random as rnd
from gridloom.functions import vectors as vec
from gridloom.operators import codebook, metrics, render, schedule, vocab

CODES = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [-1.0, -1.0]])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


@pytest.mark.parametrize("steps", [1, 2, 400])
def test_schedule(spark, steps):
    rows = schedule.posterior(schedule.noise_schedule(spark, steps)).orderBy("t").collect()
    beta = np.linspace(1e-4, 2e-2, steps)
    ab = np.cumprod(1 - beta)
    prev = np.concatenate([[1.0], ab[:-1]])
    columns = {name: np.array([r[name] for r in rows]) for name in rows[0].asDict()}
    assert columns["t"].tolist() == list(range(steps))
    assert np.allclose(columns["beta"], beta, rtol=1e-12) and np.allclose(columns["alpha_bar"], ab, rtol=1e-12)
    assert np.allclose(columns["c_x0"], np.sqrt(prev) * beta / (1 - ab), rtol=1e-9)
    assert np.allclose(columns["c_x"], np.sqrt(1 - beta) * (1 - prev) / (1 - ab), rtol=1e-9)
    assert np.allclose(columns["var"], np.maximum(beta * (1 - prev) / (1 - ab + 1e-8), 1e-20), rtol=1e-9)
    assert math.isclose(columns["c_x0"][0], 1.0, rel_tol=1e-9) and columns["c_x"][0] == 0.0
    assert (np.diff(columns["alpha_bar"]) < 0).all()


def test_schedule_joins_are_broadcast_by_size(spark):
    rows = spark.range(1000).withColumn("t", (F.col("id") % 400).cast("int"))
    plan = rows.join(schedule.noise_schedule(spark), "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_draws_do_not_depend_on_partitioning(spark):
    rows = spark.range(300)
    draw = lambda p: rows.repartition(p).select("id", rnd.normals(7, 42, "eps", F.col("id")).alias("z")).orderBy("id").collect()
    assert draw(1) == draw(8)


def test_uniforms_and_normals_look_right(spark):
    row = spark.range(4000).select(
        rnd.uniform(1, F.col("id")).alias("u"), rnd.uniforms(6, 1, F.col("id")).alias("us"), rnd.normals(9, 1, F.col("id")).alias("z")
    )
    got = row.toPandas()
    us, z = np.stack(got["us"]), np.stack(got["z"])
    assert us.shape == (4000, 6) and z.shape == (4000, 9)
    assert 0 < us.min() and us.max() < 1 and abs(us.mean() - 0.5) < 0.01
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert np.abs(np.corrcoef(z.T) - np.eye(9)).max() < 0.08
    assert 0 < got["u"].min() and got["u"].max() < 1


def test_timesteps_cover_the_range(spark):
    drawn = spark.range(5000).select(schedule.draw_timestep(10, 3, F.col("id")).alias("t")).groupBy("t").count().collect()
    assert sorted(r["t"] for r in drawn) == list(range(10)) and min(r["count"] for r in drawn) > 400


def test_label_dropout_rate(spark):
    kept = spark.range(5000).select(schedule.drop_labels(F.lit(3), 3, F.col("id")).alias("y"))
    share = kept.filter("y = 10").count() / 5000
    assert 0.08 < share < 0.12 and kept.filter("y not in (3, 10)").count() == 0


def test_noise_is_recovered_from_the_true_vector(spark):
    rows = spark.range(200).select(
        "id", schedule.draw_timestep(400, 1, F.col("id")).alias("t"),
        schedule.gaussian(4, 1, F.col("id"), "e").alias("e"), schedule.gaussian(4, 1, F.col("id")).alias("eps"),
    )
    noisy = schedule.add_noise(rows, schedule.noise_schedule(spark), "e", "eps")
    back = noisy.select("eps", schedule.recover_noise(F.col("x_t"), F.col("e"), F.col("alpha_bar")).alias("hat")).toPandas()
    assert len(back) == 200 and np.allclose(np.stack(back["eps"]), np.stack(back["hat"]), atol=1e-3)


def test_reverse_step_adds_no_noise_at_zero(spark):
    rows = frame(spark, [(0, [2.0, 3.0], [5.0, 7.0], [9.0, 9.0]), (1, [2.0, 3.0], [5.0, 7.0], [9.0, 9.0])], "t int, x array<double>, x0 array<double>, z array<double>")
    at = schedule.posterior(schedule.noise_schedule(spark))
    got = {r["t"]: r["x_prev"] for r in schedule.reverse_step(rows, at, "x", "x0", "z").collect()}
    row = at.filter("t = 1").first()
    assert np.allclose(got[0], [5.0, 7.0])
    want = row["c_x0"] * np.array([5.0, 7.0]) + row["c_x"] * np.array([2.0, 3.0]) + math.sqrt(row["var"]) * 9.0
    assert np.allclose(got[1], want)


def test_softmax_and_log_sum_exp(spark):
    logits = [[0.0, 1.0, 2.0], [1000.0, 1000.0, -1000.0], [-5.0, -5.0, -5.0]]
    rows = frame(spark, [(x,) for x in logits], "l array<double>")
    got = rows.select(vec.softmax(F.col("l")).alias("p"), vec.log_sum_exp(F.col("l")).alias("s")).collect()
    for row, x in zip(got, np.array(logits)):
        shifted = np.exp(x - x.max())
        assert np.allclose(row["p"], shifted / shifted.sum()) and math.isclose(sum(row["p"]), 1.0)
        assert math.isclose(row["s"], x.max() + math.log(shifted.sum()))


def test_scores_ties_and_nulls(spark):
    rows = frame(spark, [([2.0, 1.0],), (None,), ([-1.0, -3.0],)], "e array<double>")
    scored = rows.select(codebook.scores(F.col("e"), CODES).alias("l"))
    got = scored.select("l", codebook.nearest_code(F.col("l")).alias("tok")).collect()
    assert [r["l"] for r in got] == [[2.0, 1.0, 2.0, -3.0], None, [-1.0, -3.0, -1.0, 4.0]]
    assert [r["tok"] for r in got] == [0, None, 3]


def test_expected_vector(spark):
    logits = np.array([[0.0, 0.0, 0.0, 0.0], [50.0, 0.0, 0.0, 0.0], [1.0, -2.0, 0.5, 3.0]])
    rows = frame(spark, [(x.tolist(),) for x in logits], "l array<double>")
    got = [r[0] for r in rows.select(codebook.expected_vector(F.col("l"), CODES)).collect()]
    weights = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(got, weights / weights.sum(1, keepdims=True) @ CODES)


def test_embed_tokens(spark):
    ids = [[0, 3], [], None, [1]] * 200  # more than one slice
    rows = frame(spark, [(x,) for x in ids], "ids array<int>")
    found = [r["v"] for r in codebook.embed_tokens(rows, "ids", CODES, "v").collect()]
    assert found == [None if x is None else [CODES[i].tolist() for i in x] for x in ids]
    moved = [r["v"] for r in codebook.embed_tokens(rows, "ids", CODES, "v", places=True).collect()]
    at = lambda p: np.array([math.sin(p), math.cos(p)])
    for k in (0, 796):
        assert np.allclose(moved[k], [CODES[0] + at(0), CODES[3] + at(1)]) and moved[k + 1 : k + 3] == [[], None]
        assert np.allclose(moved[k + 3], [CODES[1] + at(0)])


def test_positional_column_agrees_with_the_sequence_form(spark):
    single = spark.range(5).orderBy("id").select(vec.positional(F.col("id"), 6)).collect()
    assert np.allclose(codebook.place_features(5, 6), [r[0] for r in single])
    with pytest.raises(ValueError):
        vec.positional(F.col("id"), 5)
    with pytest.raises(ValueError):
        codebook.place_features(5, 3)


@pytest.mark.parametrize("dim", [2, 7, 16])
def test_sinusoidal(spark, dim):
    half = dim // 2
    freqs = np.exp(np.linspace(math.log(1e-4), 0.0, half))
    for t, row in enumerate(spark.range(4).orderBy("id").select(vec.sinusoidal(F.col("id"), dim)).collect()):
        want = np.concatenate([np.sin(t * freqs), np.cos(t * freqs), np.zeros(dim % 2)])
        assert np.allclose(row[0], want)


def test_codebook_table_is_checked(spark, monkeypatch):
    good = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.0])], "tok_id int, vec array<double>")
    assert codebook.load_codebook(good).tolist() == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        codebook.load_codebook(good.filter("tok_id = 1"))
    many = spark.range(96).selectExpr("cast(id as int) as tok_id", "array(0.0d) as vec")
    assert codebook.load_codebook(many).shape == (96, 1)  # bound in bytes, not by the printable characters
    monkeypatch.setattr(codebook, "MAX_CODEBOOK_BYTES", 95 * 8)
    with pytest.raises(ValueError):
        codebook.load_codebook(many)
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "tok_id int, vec array<double>")
    with pytest.raises(ValueError):
        codebook.load_codebook(ragged)


def fails(frame, message):
    with pytest.raises(Exception, match=message):
        frame.collect()


def test_wrong_vectors_and_ids_fail(spark):
    codes = np.array([[1.0, 0.0], [0.0, 1.0]])
    for wrong in ([1.0], [1.0, 2.0, 3.0], [1.0, None]):
        rows = spark.createDataFrame([([1.0, 2.0],), (wrong,), (None,)], "v array<double>")
        fails(rows.select(codebook.scores(F.col("v"), codes)), "vectors must")
        fails(rows.select(codebook.expected_vector(F.col("v"), codes)), "vectors must")
    for wrong in ([-1], [2], [0, None]):
        ids = spark.createDataFrame([([0, 1],), (wrong,)], "ids array<int>")
        fails(codebook.embed_tokens(ids, "ids", codes, "out"), "ids must")
        fails(ids.select(vocab.decode(F.col("ids"), [" ", "a"])), "ids must")


def test_names_with_gaps(spark):
    table = spark.createDataFrame([(7, [1.0]), (2, [2.0]), (-3, [3.0])], "tok_id int, vec array<double>")
    names, codes = codebook.load_named_codes(table)
    assert names == [-3, 2, 7] and codes.ravel().tolist() == [3.0, 2.0, 1.0]
    rows = spark.createDataFrame([(7,), (4,), (None,)], "label int")
    found = rows.select(codebook.code_of(F.col("label"), names).alias("i")).collect()
    assert [r.i for r in found] == [2, None, None]


def test_sampling_follows_softmax(spark):
    logits = [0.0, 1.0, 2.0]
    rows = spark.range(20_000).withColumn("l", F.array(*[F.lit(x) for x in logits]))
    for heat in (0.5, 1.0):
        drawn = rows.select(codebook.sample_code(F.col("l"), heat, 3, 5, F.col("id")).alias("k")).groupBy("k").count().collect()
        want = np.exp(np.array(logits) / heat)
        want /= want.sum()
        for row in drawn:
            assert abs(row["count"] / 20_000 - want[row["k"]]) < 0.012
    cold = rows.select(codebook.sample_code(F.col("l"), 0.0, 3, 5, F.col("id")).alias("k")).distinct().collect()
    assert [r["k"] for r in cold] == [2]


def test_guidance_sweep(spark):
    rows = frame(spark, [([1.0, 2.0], [0.0, 1.5])], "c array<double>, u array<double>")
    got = codebook.guidance_sweep(rows, "c", "u", [(3.0, 1.0), (0.0, 0.1)]).collect()
    assert {(r["strength"], r["temperature"]): r["guided"] for r in got} == {(3.0, 1.0): [3.0, 3.0], (0.0, 0.1): [0.0, 1.5]}


def test_metrics(spark):
    logits = np.array([[0.0, 1.0], [2.0, 2.0], [5.0, -5.0]])
    targets, batches = [1, 0, 0], [0, 0, 1]
    errors = [4.0, 2.0, 6.0]
    rows = frame(spark, [(b, x.tolist(), t, e, 2) for b, x, t, e in zip(batches, logits, targets, errors)], "b int, l array<double>, y int, sq double, size int")
    scored = rows.withColumn("ce", metrics.cross_entropy(F.col("l"), F.col("y")))
    losses = metrics.batch_losses(scored, "ce", "sq", "size", ["b"])
    ce = [math.log(np.exp(x).sum()) - x[t] for x, t in zip(logits, targets)]
    got = {r["b"]: r for r in losses.collect()}
    assert math.isclose(got[0]["ce"], (ce[0] + ce[1]) / 2) and math.isclose(got[0]["mse"], 1.5)
    assert math.isclose(got[1]["loss"], 3.0 + 0.5 * ce[2])
    total = metrics.weighted_mean(losses, ["mse"]).first()
    assert total["n"] == 3 and math.isclose(total["mse"], 2.0)
    empty = metrics.weighted_mean(losses.limit(0), ["mse", "ce"]).first()
    assert (empty["n"], empty["mse"], empty["ce"]) == (0, 0.0, 0.0)


def test_quantise_truncates(spark):
    rows = frame(spark, [([0.0, 0.5, 0.999, 1.0],)], "x array<double>")
    assert rows.select(render.quantise(F.col("x"))).first()[0] == [0, 127, 254, 255]


def brute_render(pixels, w, h, width, height, ramp):
    image = np.array(pixels).reshape(h, w)
    lines = []
    for r in range(height):
        line = ""
        for c in range(width):
            y, x = r * h // height, c * w // width
            cell = image[y : max((r + 1) * h // height, y + 1), x : max((c + 1) * w // width, x + 1)]
            line += ramp[int(cell.sum()) * len(ramp) // (256 * cell.size)]
        lines.append(line)
    return "\n".join(lines)


def test_render_grid_over_mixed_shapes(spark):
    rng = np.random.default_rng(2)
    shapes = [(8, 8), (3, 5), (28, 28), (1, 1), (3, 5)]
    images = [(rng.integers(0, 256, w * h).tolist(), w, h) for w, h in shapes] + [([255] * 16, 4, 4), ([0] * 16, 4, 4)]
    rows = frame(spark, images + [(None, 2, 2)], "p array<int>, w int, h int")
    got = [r[0] for r in rows.select(render.render_grid(F.col("p"), F.col("w"), F.col("h"), 6, 4)).collect()]
    assert got[:-1] == [brute_render(p, w, h, 6, 4, render.DEFAULT_RAMP) for p, w, h in images]
    assert got[-1] is None and set(got[5]) == {"@", "\n"} and set(got[6]) == {" ", "\n"}


def test_contact_sheet_strips(spark):
    items = [("s", i, chr(97 + i) * 6) for i in range(5)]
    rows = spark.createDataFrame(items, "s string, i int, g string").repartition(3)
    got = {(r["strip"], r["row"]): r["line"] for r in render.contact_sheet(rows, ["s"], "i", "g", 3, 2, columns=3).collect()}
    assert got == {
        (0, 0): "aaa  bbb  ccc  ", (0, 1): "aaa  bbb  ccc  ",
        (1, 0): "ddd  eee  ", (1, 1): "ddd  eee  ",
    }


def test_sequence_errors(spark):
    codes = np.array([[0.5, -1.0, 2.0], [0.0, 1.0, -1.0]])
    rows = frame(spark, [(1, 2, [0, 1, 1]), (2, 0, []), (3, 1, None), (4, 3, [1])], "k int, t int, ids array<int>")
    steps = schedule.noise_schedule(spark, 4)
    bars = {r.t: r.alpha_bar for r in steps.collect()}
    got = {r.k: r for r in metrics.sequence_errors(rows, "ids", codes, steps, 9, "k").collect()}
    assert got[2].ce is None and got[3].sq_err is None and [got[k].size for k in (1, 2, 3, 4)] == [9, 0, 0, 3]
    draws = spark.range(3).select(rnd.normals(3, 9, "eps", F.lit(1), F.col("id")).alias("z")).collect()
    noise = np.array([r.z for r in draws])
    ab = bars[2]
    x = math.sqrt(ab) * codes[[0, 1, 1]] + math.sqrt(1 - ab) * noise
    shares = np.exp(x @ codes.T)
    shares /= shares.sum(axis=1, keepdims=True)
    guess = (x - math.sqrt(ab) * shares @ codes) / math.sqrt(1 - ab + 1e-8)
    assert got[1].ce == pytest.approx(-np.log(shares[range(3), [0, 1, 1]]).mean())
    assert got[1].sq_err == pytest.approx(((guess - noise) ** 2).sum())
    fails(metrics.sequence_errors(rows.filter("k = 1"), "ids", codes[:1], steps, 9, "k"), "ids must")
