"""What must hold at any size: tiles, exact sums, computed orders, single files, zipped pairs, appends, commits."""

import gzip
import math
import os
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import exact, permute
from gridloom.operators import batching, codebook, metrics, wide_codebook
from gridloom.operators.indexing import append_index
from gridloom.plans import scale_queries
from gridloom.sources import artifacts, images, texts

# --- wide codebooks ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def product(spark):
    draw = np.random.default_rng(4)
    codes = draw.integers(-4, 5, (90, 3)) / 4  # many ties
    rows = draw.integers(-4, 5, (70, 3)) / 4
    names = sorted(draw.choice(1000, 90, replace=False).tolist())
    frame = spark.createDataFrame([(n, c) for n, c in zip(names, codes.tolist())], "tok_id int, vec array<double>")
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())] + [(70, None)], "id int, v array<double>")
    return names, codes, rows, frame.repartition(3), wanted.repartition(4)


@pytest.mark.parametrize("tile", [(16, 7), (1000, 1000), (1000, 20), (9, 1000)])
def test_tiles_of_any_shape_give_the_whole_product(product, tile):
    names, codes, rows, frame, wanted = product
    found = {r.id: r for r in wide_codebook.score_codes(wanted, "v", frame, tile=tile).collect()}
    logits = rows @ codes.T
    for i, row in enumerate(logits):
        assert found[i].best == names[int(row.argmax())] and found[i].score == row.max()
        shares = np.exp(row - row.max())
        assert found[i].log_total == pytest.approx(row.max() + math.log(shares.sum()), abs=1e-12)
        assert found[i].expected == pytest.approx(shares / shares.sum() @ codes, abs=1e-12)
    assert found[70].best is None and found[70].expected is None and len(found) == 71


def test_tiles_agree_with_a_collected_codebook(product):
    names, _, _, frame, wanted = product
    known, codes = codebook.load_named_codes(frame)
    logits = wanted.withColumn("l", codebook.scores(F.col("v"), codes))
    best = codebook.name_of(codebook.nearest_code(F.col("l")), known)
    small = {r.id: r for r in logits.select("id", best.alias("best"), codebook.expected_vector(F.col("l"), codes).alias("x")).collect()}
    for r in wide_codebook.score_codes(wanted, "v", frame, tile=(16, 32)).collect():
        assert r.best == small[r.id].best and (r.expected or []) == pytest.approx(small[r.id].x or [], abs=1e-12)


@pytest.mark.parametrize("scale", [1, 0.3, 40])
def test_exponentials_looked_up_or_computed(scale, monkeypatch):
    draw = np.random.default_rng(8)
    codes, rows = np.floor(draw.normal(size=(3000, 8)) * 8) / 8 * scale, np.floor(draw.normal(size=(700, 8)) * 8) / 8
    names, logits = np.arange(3000) * 3, rows @ codes.T
    tables = []
    monkeypatch.setattr(wide_codebook, "_table", lambda *grids, made=wide_codebook._table: tables.append(made(*grids)) or tables[-1])
    tile = wide_codebook._Tile(8, 0.0)
    for low in (0, 400):
        tile.add(np.arange(700)[low : low + 400], np.zeros(700, np.int64)[low : low + 400], rows[low : low + 400])
    for low in range(0, 3000, 1300):
        tile.meet(names[low : low + 1300], codes[low : low + 1300])
    assert [t is not None for t in tables] == {1: [True] * 3, 0.3: [], 40: [False] * 3}[scale]
    shares = np.exp(logits - logits.max(axis=1)[:, None])
    assert (tile.code == names[logits.argmax(axis=1)]).all() and tile.lead == pytest.approx(logits.max(axis=1), abs=1e-12)
    assert tile.top + np.log(tile.total) == pytest.approx(logits.max(axis=1) + np.log(shares.sum(axis=1)), abs=1e-11)
    assert tile.mixed / tile.total[:, None] == pytest.approx(shares / shares.sum(axis=1)[:, None] @ codes, abs=1e-11)


def test_sums_of_a_batch_are_scaled_once(monkeypatch):
    draw = np.random.default_rng(9)
    rows, codes = draw.integers(-63, 64, (700, 8)) / 1024, draw.integers(-63, 64, (1500, 8)) / 1024
    rows[0], codes[1400] = 63 / 1024, 63 / 1024  # the greatest product is near the end of the table
    scaled = []
    monkeypatch.setattr(wide_codebook._Tile, "_gather", lambda self, *a, made=wide_codebook._Tile._gather: scaled.append(1) or made(self, *a))
    tile = wide_codebook._Tile(8, 0.0)
    tile.add(np.arange(700), np.zeros(700, np.int64), rows)
    for low in range(0, 1500, 900):
        tile.meet(np.arange(1500)[low : low + 900], codes[low : low + 900])
    assert len(scaled) == 2  # batches; each is many blocks
    logits = rows @ codes.T
    shares = np.exp(logits - logits.max(axis=1)[:, None])
    assert tile.code.tolist() == logits.argmax(axis=1).tolist() and tile.code[0] == 1400 and (tile.top == logits.max(axis=1)).all()
    assert tile.top + np.log(tile.total) == pytest.approx(logits.max(axis=1) + np.log(shares.sum(axis=1)), abs=1e-12)
    assert tile.mixed / tile.total[:, None] == pytest.approx(shares / shares.sum(axis=1)[:, None] @ codes, abs=1e-12)


def test_tiles_grow_before_they_multiply():
    assert wide_codebook._cut(2000, 512_000, None) == (1, 16)
    n_bands, n_strips = wide_codebook._cut(102_560, 102_560 * 256, None)
    assert n_bands * n_strips <= 256 and n_bands * 102_560 * 256 + n_strips * 102_560 < 70_000_000  # rows dealt out
    assert wide_codebook._cut(70, 90, (16, 7)) == (5, 13)


def test_draws_follow_the_softmax_and_no_tile(spark):
    codes = spark.createDataFrame([(1, [0.0]), (5, [1.0]), (9, [2.0])], "tok_id int, vec array<double>")
    rows = spark.range(4000).select("id", F.array(F.lit(1.0)).alias("v"))
    draws = [
        {r.id: r.best for r in wide_codebook.score_codes(rows, "v", codes, wide_codebook.Draw(F.col("id"), heat, 3), tile).collect()}
        for heat, tile in ((1.0, (1000, 2)), (1.0, (5000, 1)), (0.0, (5000, 5)))
    ]
    assert draws[0] == draws[1] and set(draws[2].values()) == {9}
    weights = np.exp([0.0, 1.0, 2.0])
    for name, share in zip((1, 5, 9), weights / weights.sum()):
        assert abs(sum(b == name for b in draws[0].values()) / 4000 - share) < 0.03


def test_wide_codebook_bounds(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    none = spark.createDataFrame([], "tok_id int, vec array<double>")
    (row,) = wide_codebook.score_codes(rows, "v", none).collect()
    assert row.best is None and row.expected is None
    assert wide_codebook.score_codes(rows.limit(0), "v", none).collect() == []
    for bad in ([(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(None, [1.0])], [(1, [None])]):
        with pytest.raises(ValueError, match="one vector per name"):
            wide_codebook.score_codes(rows, "v", spark.createDataFrame(bad, "tok_id int, vec array<double>"))


def test_vectors_of_ids_by_a_join(spark):
    codes = spark.createDataFrame([(3, [1.0]), (700, [2.0])], "tok_id int, vec array<double>")
    rows = spark.createDataFrame([(1, [700, 3, 700]), (2, []), (3, None), (1, [3])], "id int, ids array<int>")
    found = wide_codebook.embed_codes(rows, "ids", codes, "x").collect()
    assert sorted((r.id, r.x) for r in found if r.x) == [(1, [[1.0]]), (1, [[2.0], [1.0], [2.0]])]
    assert {r.id: r.x for r in found if not r.x} == {2: [], 3: None}
    for bad in ([4], [None]):
        with pytest.raises(Exception, match="must be in the codebook"):
            wide_codebook.embed_codes(spark.createDataFrame([(1, bad)], "id int, ids array<int>"), "ids", codes, "x").collect()


def test_names_with_gaps(spark):
    names = [*range(0, 200_000, 3)]
    rows = spark.createDataFrame([(0,), (1,), (199_998,), (None,), (-1,), (10**9,)], "n int")
    code = codebook.code_of(F.col("n"), names)
    plan = rows.select(code.alias("c"))._jdf.queryExecution().toString()
    assert len(plan) < 5000
    found = rows.select("n", code.alias("c")).select("n", "c", codebook.name_of(F.col("c"), names).alias("back")).collect()
    assert [(r.c, r.back) for r in found] == [(0, 0), (None, None), (66_666, 199_998), (None, None), (None, None), (None, None)]
    assert rows.select(codebook.code_of(F.col("n"), []).alias("c")).distinct().collect()[0].c is None


# --- exact sums ----------------------------------------------------------------------------------

FLOATS = st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=20)


@settings(max_examples=300)
@given(FLOATS)
def test_limbs_hold_every_bit(values):
    _, limb, part = exact._cut(np.array(values, np.float64))
    found = exact._value([{"limb": int(a), "part": int(b)} for a, b in zip(limb, part)], None)
    total = sum(map(Fraction, values), Fraction(0))
    try:
        assert found == float(total)
    except OverflowError:
        assert math.isinf(found)


def test_sums_have_the_same_bits_however_they_are_parted(spark):
    draw = random.Random(8)
    rows = [(i % 3, draw.gauss(0, 1) * 10.0 ** draw.randint(-12, 12)) for i in range(3000)] + [(1, None), (4, None)]
    frame = spark.createDataFrame(rows, "g int, x double")
    found = []
    for n in (1, 8, 211):
        sums = exact.exact_sums(frame.repartition(n), ["g"], {"x": F.col("x")}, {"n": F.col("x").isNotNull().cast("int")})
        found.append(sorted((r.g, r.s, r.m, r.n) for r in sums.select("g", exact.nearest(F.col("x")).alias("s"), exact.nearest(F.col("x"), F.col("n")).alias("m"), "n").fillna(-1.0, ["m"]).collect()))
    assert found[0] == found[1] == found[2]
    for g, s, m, n in found[0]:
        values = [x for k, x in rows if k == g and x is not None]
        assert s == math.fsum(values) and n == len(values) and m == (float(sum(map(Fraction, values)) / n) if n else -1.0)


@pytest.mark.parametrize("values, want", [([math.inf, 1.0], math.inf), ([math.inf, -math.inf], math.nan), ([math.nan], math.nan), ([-math.inf], -math.inf), ([1e308, 1e308], math.inf), ([], 0.0)])
def test_sums_that_are_not_finite(spark, values, want):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    (row,) = exact.exact_sums(frame, [], {"x": F.col("x")}, {}).select(exact.nearest(F.col("x")).alias("s")).collect()
    assert row.s == want or math.isnan(row.s) and math.isnan(want)


def test_losses_do_not_depend_on_partitions(spark):
    draw = random.Random(2)
    rows = [(i // 40, draw.random() * 10, draw.random() / 3, 64) for i in range(400)] + [(2, None, 0.1, 64)]
    frame = spark.createDataFrame(rows, "batch_id int, ce double, sq double, size int")
    found = []
    for n in (1, 8, 211):
        losses = metrics.batch_losses(frame.repartition(n), "ce", "sq", "size", ["batch_id"])
        found.append((sorted(map(tuple, losses.collect())), tuple(metrics.weighted_mean(losses.repartition(n), ["ce", "mse", "loss"]).first())))
    assert found[0] == found[1] == found[2]
    assert metrics.weighted_mean(losses.limit(0), ["ce"]).first().asDict() == {"n": 0, "ce": 0.0}


# --- computed orders -----------------------------------------------------------------------------


@settings(max_examples=80)
@given(st.integers(1, 400), st.integers(0, 5), st.integers(0, 3))
def test_orders_are_permutations(n, seed, epoch):
    keys, size = permute.round_keys(seed, epoch), np.full(n, n)
    places = permute.permuted(np.arange(n), size, keys)
    assert sorted(places.tolist()) == list(range(n))
    assert permute.permuted(places, size, keys, inverse=True).tolist() == list(range(n))


def test_orders_of_large_numbers():
    n = (1 << 59) + 12345
    x = np.array([0, 1, 2, n - 1, n // 2], np.int64)
    keys = permute.round_keys(1, 1)
    places = permute.permuted(x, np.full(5, n), keys)
    assert ((places >= 0) & (places < n)).all() and permute.permuted(places, np.full(5, n), keys, True).tolist() == x.tolist()


def test_epochs_differ_and_batches_are_found_alone(spark):
    rows = spark.range(101).select("id", F.col("id").alias("idx"))
    found = batching.epoch_orders(rows, [0, 1, 7], 5).collect()
    orders = {e: [i for _, i in sorted((r.pos, r.id) for r in found if r.epoch == e)] for e in (0, 1, 7)}
    assert all(sorted(o) == list(range(101)) for o in orders.values()) and len({tuple(o) for o in orders.values()}) == 3
    assert [i for b in range(4) for i in batching.epoch_batch(101, 7, b, 32, 5)] == orders[7]
    drift = np.corrcoef(orders[0], range(101))[0, 1]
    assert abs(drift) < 0.3


# --- appends -------------------------------------------------------------------------------------


def test_appends_number_on(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, g string")
    first, state = append_index(frame([(5, "a"), (1, "a"), (2, None)]), "k", ["g"], None)
    assert sorted((r.k, r.idx) for r in first.collect()) == [(1, 0), (2, 0), (5, 1)]
    state = spark.createDataFrame(state.collect(), state.schema)
    second, state = append_index(frame([(9, "a"), (3, None), (1, "b")]), "k", ["g"], state)
    assert sorted((r.k, r.idx) for r in second.collect()) == [(1, 0), (3, 1), (9, 2)]
    assert {r.g: (r.n, r.last_key) for r in state.collect()} == {"a": (3, 9), None: (2, 3), "b": (1, 1)}
    state = spark.createDataFrame(state.collect(), state.schema)
    for late in ([(9, "a")], [(4, "a")], [(None, "a")], [(11, "a"), (11, "a")]):
        with pytest.raises(Exception, match="too late|not unique"):
            append_index(frame(late), "k", ["g"], state)[0].collect()


# --- single files --------------------------------------------------------------------------------


def test_scan_by_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "TASK_BYTES", 300)
    monkeypatch.setattr(texts, "OPEN_BYTES", 10)
    monkeypatch.setattr(texts, "BATCH_BYTES", 64)
    bodies = {f"{tmp_path}/in/{i}.txt": f"text {i}\r\n" * (i % 5) for i in range(40)}
    rows = [(str(i), p, b.encode()) for i, (p, b) in enumerate(bodies.items())]
    frame = spark.createDataFrame(rows, "id string, p string, b binary")
    assert texts.write_texts(frame, "p", "b") == 40
    assert texts.write_texts(spark.createDataFrame([("x", f"{tmp_path}/in/bad.txt", b"a\xffb")], frame.schema), "p", "b") == 1
    more = [("41", f"file:{tmp_path}/in/bad.txt", None), ("42", f"{tmp_path}/none", None), ("43", None, None), ("44", rows[3][1], None)]
    asked = spark.createDataFrame([(i, p, "x") for i, p, _ in rows + more], "id string, p string, found string").repartition(3)
    found = {r.id: (r.found, r.text) for r in texts.scan_texts(asked, "p", carry=["id"]).collect()}
    for i, p, b in rows:
        assert found[i] == (True, b.decode().replace("\r\n", "\n"))
    assert found["41"] == (True, "ab") and found["42"] == found["43"] == (False, None) and found["44"] == found["3"]
    scanned = texts.scan_texts(asked, "p", carry=["id"])
    assert scanned.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, texts.missing_texts(scanned).collect())) == [("42", "payload is missing"), ("43", "payload is missing")]
    for bad, match in (("id = '41'", "UTF|utf"), ("id = '42'", "payload is missing")):
        with pytest.raises(Exception, match=match):
            texts.scan_texts(asked.filter(bad), "p", strict=True, carry=["id"]).collect()
    assert texts.scan_texts(asked.filter("id = '41'"), "p").select("id").count() == 1
    assert texts.scan_texts(asked.limit(0), "p", carry=["id"]).collect() == []


def test_files_travel_in_small_batches(spark, tmp_path):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    frame = spark.createDataFrame([(f"{tmp_path}/a/x", b"x"), (f"{tmp_path}/b/x", b"y"), (f"{tmp_path}/a/y", None)], "p string, b binary")
    for use in (lambda: texts.write_texts(frame, "p", "b"), lambda: texts.scan_texts(frame, "p", carry=["p"]).count()):
        spark.conf.set(size, "64m")
        assert use() in (2, 3) and spark.conf.get(size) == "4m"


def test_files_of_documents_lie_in_many_folders(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows.union(rows.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")  # a repeated id names one file
    paths = scale_queries._written(spark, str(tmp_path), F.encode("text", "UTF-8")).collect()
    folders = {r.ascii_txt_path.rpartition("/")[0] for r in paths}
    assert len(paths) == 3005 and len({r.ascii_txt_path for r in paths}) == 3000
    assert len(folders) > 1000 and all(len(os.listdir(f)) < 20 for f in folders)


# --- zipped pairs --------------------------------------------------------------------------------


def pair(folder, n, zipped, side=(3, 2), name="x", members=1):
    pixels = np.random.default_rng(n).integers(0, 256, n * side[0] * side[1]).astype(np.uint8).tobytes()
    bodies = [struct.pack(">4I", 0x803, n, side[1], side[0]) + pixels, struct.pack(">2I", 0x801, n) + bytes(i % 10 for i in range(n))]
    paths = []
    for kind, body in zip("il", bodies):
        path = folder / f"{name}-{kind}{'.gz' if zipped else ''}"
        cut = [body[len(body) * i // members : len(body) * (i + 1) // members] for i in range(members)]
        path.write_bytes(b"".join(map(gzip.compress, cut)) if zipped else body)
        paths.append(str(path))
    return tuple(paths)


@pytest.mark.parametrize("n, members", [(1000, 1), (1000, 3), (1, 1), (0, 1)])
def test_zipped_pairs_read_like_plain_ones(spark, tmp_path, monkeypatch, n, members):
    monkeypatch.setattr(images, "PIECE_BYTES", 600)
    plain = images.read_idx(spark, *pair(tmp_path, n, False), "train", 100)
    zipped = images.read_idx(spark, *pair(tmp_path, n, True, members=members), "train", 100)
    assert plain.schema == zipped.schema
    assert sorted(map(tuple, zipped.collect())) == sorted(map(tuple, plain.collect())) and zipped.count() == n
    if n == 1000:
        assert zipped.rdd.getNumPartitions() > 1


def test_pairs_number_through(spark, tmp_path):
    pairs = [pair(tmp_path, n, z, name=str(n)) for n, z in ((20, True), (0, True), (7, False))]
    found = images.read_idx_pairs(spark, pairs, "test").collect()
    assert sorted(r.idx for r in found) == list(range(27)) and {r.split for r in found} == {"test"}


def test_written_pairs(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("idx"), (F.col("id") % 7).cast("int").alias("label"), F.array(*[(F.col("id") * i % 256).cast("int") for i in range(4)]).alias("pixels"))
    for zipped in (True, False):
        pairs = images.write_idx(rows.repartition(4), f"{tmp_path}/{zipped}", 2, 2, 10, zipped=zipped)
        assert len(pairs) == 3
        found = images.read_idx_pairs(spark, pairs, "train").select("idx", "label", "pixels")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="4 pixels"):
        images.write_idx(rows.withColumn("pixels", F.array(F.lit(1))), f"{tmp_path}/bad", 2, 2)


@pytest.mark.parametrize("damage", ["cut", "sum", "byte", "count", "magic", "short"])
def test_damaged_streams_fail(spark, tmp_path, damage):
    a, b = pair(tmp_path, 500, True)
    raw = bytearray(open(a, "rb").read())
    if damage == "cut":
        raw = raw[: len(raw) // 2]
    elif damage == "sum":
        raw[-6] ^= 1
    elif damage == "byte":
        raw[len(raw) // 2] ^= 255
    elif damage == "magic":
        raw = gzip.compress(struct.pack(">4I", 0x802, 500, 2, 3) + bytes(3000))
    elif damage == "short":
        raw = gzip.compress(struct.pack(">4I", 0x803, 500, 2, 3) + bytes(2990))
    elif damage == "count":
        b = pair(tmp_path, 499, True, name="y")[1]
    open(a, "wb").write(raw)
    with pytest.raises(Exception, match="ends early|incorrect|invalid|magic|fewer|labels|Error -3"):
        images.read_idx(spark, a, b, "train").count()


# --- one commit ----------------------------------------------------------------------------------

CONFIG = {"W": 2, "H": 3, "L": 6, "emb_dim": 4, "steps": 5, "betas": [0.1, 0.2]}


def test_a_failed_save_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    vocab = spark.createDataFrame([(0, " "), (1, "a")], "tok_id int, ch string")
    with pytest.raises(ValueError, match="no complete"):
        artifacts.load_artifacts(spark, str(tmp_path))
    artifacts.save_artifacts(vocab, CONFIG, str(tmp_path))
    with pytest.raises(KeyError):
        artifacts.save_artifacts(vocab.limit(1), {"W": 9}, str(tmp_path))  # vocabulary written, configuration not
    found, config = artifacts.load_artifacts(spark, str(tmp_path))
    assert found.count() == 2 and config == CONFIG

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(artifacts, "make_mark", fail)
        with pytest.raises(OSError):
            artifacts.save_artifacts(vocab.limit(1), {**CONFIG, "W": 9}, str(tmp_path))
    assert artifacts.load_artifacts(spark, str(tmp_path))[1] == CONFIG
    versions = [artifacts.save_artifacts(vocab, {**CONFIG, "W": w}, str(tmp_path)) for w in (7, 8, 9)]
    assert artifacts.committed_versions(spark, str(tmp_path)) == versions[1:]
    assert artifacts.load_artifacts(spark, str(tmp_path))[1]["W"] == 9
    assert artifacts.load_artifacts(spark, str(tmp_path), versions[1])[1]["W"] == 8
