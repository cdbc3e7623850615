"""Near duplicates, repeated passages, quality rules, languages: against plain versions and on odd rows."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from gridloom.llm import jaccard, langid, quality, queries, shards, substring_dedup
from gridloom.llm.components import components

import brute

ODD = [
    (1, None), (None, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "One two three four"), (None, "one"),
    (6, "One two three four"), (7, "\xa0 a\xa0b \x1c"), (8, "word " * 4000),
]


def near_texts(seed, n=120):
    """Families of edited copies, exact copies, passages in many texts, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randint(3, 130))] for _ in range(6)]
    out = []
    for _ in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text[at:at] = passage[rng.randint(0, 8) :]
        if rng.random() < 0.1:
            text = text + text
        out.append(rng.choice([" ", "\n", "  "]).join(text).title() if rng.random() < 0.5 else " ".join(text))
    return out


def rows_of(seed):
    rows = [(100 + i, t) for i, t in enumerate(near_texts(seed))] + ODD
    random.Random(seed).shuffle(rows)
    return rows


def table_of(spark, rows, extra="n long"):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], f"doc_id long, text string, {extra}").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, monkeypatch, seed):
    if seed == 2:  # many batches, shards and blocks
        monkeypatch.setattr(shards, "BATCH_BYTES", 2000)
        monkeypatch.setattr(shards, "SHARD_BYTES", 4000)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    rows = rows_of(seed)
    path_free = table_of(spark, rows).cache()  # a fixed order of rows
    found = jaccard.component_ids(path_free, "doc_id", "text").collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute.components(rows), key=str)
    path_free.unpersist()


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.component_ids(empty, "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(jaccard.component_ids(nulls, "doc_id", "text").collect(), key=str) == [(1, 0, 1), (None, 0, None)]


def test_link_sets_spans_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**6, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 10**6, 60), base)) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 80, rng.integers(1, 40))) for _ in range(150)]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    a, b = jaccard.link_sets(np.concatenate(sets), first, 75)

    def jac(x, y):
        both = len(np.intersect1d(x, y))
        return both / (len(x) + len(y) - both)

    def labels(links):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in links:
            parent[find(x)] = find(y)
        return [min(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))]

    links = list(zip(a.tolist(), b.tolist()))
    assert all(jac(sets[x], sets[y]) >= 0.75 for x, y in links)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jac(sets[i], sets[j]) >= 0.75]
    assert labels(links) == labels(every) and len(links) < len(every)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200 + i, 200) for i in range(9)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(9)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, monkeypatch, seed):
    if seed > 1:
        monkeypatch.setattr(shards, "BATCH_BYTES", 2000)
        monkeypatch.setattr(shards, "SHARD_BYTES", 4000)
        monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 300)
        monkeypatch.setattr(substring_dedup, "STREAM_WORDS", 400)
    rows = rows_of(seed)
    table = table_of(spark, rows, "words long").cache()
    window = 35 if seed < 3 else 4
    found = substring_dedup.deduplicate(table, "doc_id", "text", window).collect()
    want = [(k, *d) for (k, _), d in zip(rows, brute.dedup([t for _, t in rows], window))]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert any(r.n_removed for r in found)
    table.unpersist()


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_substring_dedup_where_hashes_collide(spark, bits):
    """Windows that share their hash with another that came first are found all the same."""
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = [f"a b {run('v', 35)} c", f"d {run('v', 35)} e f"]
    rows = [(i, t) for i, t in enumerate([run("w", 60), *twice, run("u", 40), run("u", 40), None, f"x {run('s', 35)}"])]
    for given in (rows, rows[::-1], rows + rows_of(2)):
        table = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        found = substring_dedup.deduplicate(table, "doc_id", "text", bits=bits).collect()
        want = [(k, *d) for (k, _), d in zip(given, brute.dedup([t for _, t in given]))]
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_substring_dedup_keeps_untouched_texts(spark):
    table = spark.createDataFrame([(1, "a \n b", "x"), (2, None, None)], "doc_id long, text string, key string")
    found = substring_dedup.deduplicate(table, "doc_id", "text", rejoin=False, carry=("key",)).collect()
    assert sorted(map(tuple, found)) == [(1, "x", 2, 0, "a \n b"), (2, None, 0, 0, None)]
    assert substring_dedup.deduplicate(table.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("order", ["ascending", "descending"])
def test_substring_dedup_first_place_between_regions(spark, monkeypatch, order):
    """The middle of text 2 has its first place in text 1; the reference of text 2 lies on both sides of it."""
    match = substring_dedup.match_shard
    monkeypatch.setattr(substring_dedup, "match_shard", lambda rows, w: match(rows.sort_by([("k1", order)]), w))
    run = lambda name, n: [f"{name}{i}" for i in range(n)]
    middle = [*run("x", 60), *run("w", 50), *run("y", 60)]
    texts = [[*run("a", 20), *run("w", 50), *run("b", 20)], middle, [*middle, *run("z", 9)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = substring_dedup.deduplicate(table, "doc_id", "text").collect()
    assert sorted(map(tuple, found)) == [(k, *d) for (k, _), d in zip(rows, brute.dedup([t for _, t in rows]))]


def test_substring_dedup_deals_the_reference_of_one_text(spark, monkeypatch):
    """Two copies of a long passage: its reference goes to several shards, each of bounded size."""
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 100)

    def sizes(rows, window):
        words = sum(len(w) // 8 for w, r in zip(rows["words"].to_pylist(), rows["reference"].to_pylist()) if r)
        none = {"copies": pa.nulls(1, pa.int64()), "window": pa.nulls(1, pa.binary())}
        return pa.table({c: [words] for c in ("k1", "k2", "low", "high")} | none)

    passage = " ".join(f"p{i}" for i in range(3000))
    table = spark.createDataFrame([(1, passage), (2, f"{passage} more")], "doc_id long, text string").coalesce(1)
    source = table.select(table.doc_id.alias("key"), "text", *substring_dedup.text_key(table.text))
    matches = substring_dedup.find_matches(source, 35).cache()
    spans = substring_dedup.verify_matches(source, matches, 35).collect()
    gone = {(r.k1, i) for r in spans for i in range(r.low, r.high)}
    assert len(gone) == 6000
    monkeypatch.setattr(substring_dedup, "match_shard", sizes)
    held = [r.low for r in substring_dedup.verify_matches(source, matches, 35).collect()]
    assert len(held) > 10 and max(held) < 1000 and sum(held) >= 3000
    matches.unpersist()


def test_automaton_against_search():
    rng = random.Random(5)
    text = [rng.randrange(3) for _ in range(300)]
    automaton = substring_dedup.SuffixAutomaton()
    automaton.extend(text)
    query = [rng.randrange(3) for _ in range(400)]
    found = dict(automaton.matches(query, 5))
    starts = {}
    for i in range(len(text) - 4):
        starts.setdefault(tuple(text[i : i + 5]), i + 4)
    want = {i: starts[tuple(query[i - 4 : i + 1])] for i in range(4, len(query)) if tuple(query[i - 4 : i + 1]) in starts}
    assert found == want


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(4)
    noise = "".join(rng.choice(string.printable) for _ in range(9000))
    rows = rows_of(7) + [(900, "a b c\na b c\n\n x\n x"), (901, "#$ <b> & |\n" * 60), (902, noise)]
    found = quality.judge(table_of(spark, rows, "kept long"), "doc_id", "text").collect()
    want = [(k, *brute.base_counts(t)) for k, t in rows]
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
    compressor = zstandard.ZstdCompressor(level=3)
    texts = {k: t for k, t in rows if k is not None}
    for r in found:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.n_bytes, r.zstd_bytes) == (len(raw), len(compressor.compress(raw)))
    kept = {r.doc_id: r.kept for r in found}
    assert not kept[902] and not kept[901]
    assert quality.judge(table_of(spark, rows).limit(0), "doc_id", "text").count() == 0


def test_bands_depend_on_length():
    bands = quality.Bands()
    assert not quality.out_of_band(100, 5, bands)
    assert quality.out_of_band(300, 120, bands) and not quality.out_of_band(20000, 8000, bands)


def test_language_model_on_held_out_rows(spark):
    found = queries.op9_langid(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    right = [r.lang_pred == r.lang for r in rows]
    assert len(rows) > 150 and np.mean(right) > 0.97
    loss = -np.mean([np.log(max(r.score if ok else 1 - r.score, 1e-6)) for r, ok in zip(rows, right)])
    assert all(0 <= r.score <= 1 for r in rows) and loss < 0.2


def test_language_of_odd_texts(spark):
    learn = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr") for i in range(60)]
    table = spark.createDataFrame([*learn, (1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    sample = langid.train_sample(table, table.doc_id, "text", "lang", langid.Settings(sample_rows=40))
    assert sample.count() == 40
    model = langid.fit(langid.collect_features(sample))
    odd = [None, "", "123 !?", "\n", "the dog", "le chien", "İ" * 5, "the dog " * 20000]
    names, score = langid.score_texts(pa.array(odd), model)
    assert names[:4] == ["und"] * 4 and names[4:6] == ["en", "fr"] and names[7] == "en" and (score[:4] == 0).all()
    nothing = langid.fit([])
    assert langid.score_texts(pa.array(odd), nothing)[0] == ["und"] * len(odd)
    assert langid.predict(table.limit(0), "doc_id", "text", model).count() == 0
    twice = spark.createDataFrame([(None, "the dog", 1), (None, "the dog", 1)], "doc_id long, text string, score long")
    assert [r.lang_pred for r in langid.predict(twice, "doc_id", "text", model).collect()] == ["en", "en"]


def test_every_language_is_learned(spark):
    """Many languages share a table of bounded size; one that holds nearly all rows fills its part and no more."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 9, f"l{i % 90:02d}") for i in range(900)]
    rows += [(1000 + i, "zz yy xx " * 3, "zz") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sample = langid.train_sample(table, table.doc_id, "text", "lang", langid.Settings(sample_rows=910))
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert len(counts) == 91 and set(counts.values()) == {10}
    model = langid.fit(langid.collect_features(sample))
    assert len(model.languages) == 91 and model.table.shape == (1 + (1 << 15), 91)
    assert langid.slot_shift(64) == 0 and langid.slot_shift(10**6) == 6
    assert langid.score_texts(pa.array(["zz yy xx " * 3]), model)[0] == ["zz"]


def test_language_training_against_plain_updates():
    """FTRL-proximal weight by weight, and the temperature against a grid."""
    draw = np.random.default_rng(3)
    settings = langid.Settings(epochs=2, l1=0.02, l2=0.05, alpha=0.4)
    examples = []
    for i in range(30):
        slots = np.append(np.sort(draw.choice(12, 4, replace=False)), 12)
        examples.append((i % 3, slots, np.append(draw.random(4), 1.0)))
    found = langid._follow_leader(examples, 3, 12, settings)
    z, n = np.zeros((13, 3)), np.zeros((13, 3))

    def weight(i, c):
        if abs(z[i, c]) <= settings.l1:
            return 0.0
        rate = (settings.beta + n[i, c] ** 0.5) / settings.alpha + settings.l2
        return -(z[i, c] - np.sign(z[i, c]) * settings.l1) / rate

    for _ in range(2):
        for truth, slots, x in examples:
            w = {(i, c): weight(i, c) for i in slots.tolist() for c in range(3)}
            logits = [sum(w[i, c] * v for i, v in zip(slots.tolist(), x)) for c in range(3)]
            p = np.exp(logits) / np.exp(logits).sum()
            for i, v in zip(slots.tolist(), x):
                for c in range(3):
                    g = v * (p[c] - (c == truth))
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / settings.alpha * w[i, c]
                    n[i, c] += g * g
    assert np.allclose(found, [[weight(i, c) for c in range(3)] for i in range(13)], atol=1e-12)
    logits, truth = draw.normal(size=(200, 3)) * 4, draw.integers(0, 3, 200)
    logits[np.arange(200), truth] += 3

    def loss(t):
        scaled = logits / t
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(200), truth]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4001))
    assert loss(langid._temperature(logits, truth)) <= min(map(loss, grid)) + 1e-9


def test_language_training_averages_its_steps():
    draw = np.random.default_rng(4)
    settings = langid.Settings(epochs=2, l1=0.02, l2=0.05, alpha=0.4)
    examples = [(i % 3, np.append(np.sort(draw.choice(12, 4, replace=False)), 12), np.append(draw.random(4), 1.0)) for i in range(20)]
    twice = examples * 2
    once = settings._replace(epochs=1)
    seen = [langid._follow_leader(twice[:k], 3, 12, once) for k in range(len(twice))]  # what each step started from
    assert np.allclose(langid._follow_leader(examples, 3, 12, settings, averaged=True), np.mean(seen, axis=0), atol=1e-12)
    assert not langid._follow_leader([], 3, 12, settings, averaged=True).any()


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_two_languages_that_come_last(seed):
    """Five texts of a language that hold a long passage of another, learned last, leave clean texts right and sure."""
    rng = random.Random(seed)
    parts = {"de": ["ung", "ä", "sch", "ei", "en", "ß"], "en": ["th", "he", "an", "ou", "en", "re"], "fr": ["é", "è", "ou", "eau", "en", "re"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))

    rows = [(lang, text(lang, 120)) for _ in range(100) for lang in parts]
    rng.shuffle(rows)
    rows += [("fr", f"{text('fr', 5)} {text('en', 115)}") for _ in range(5)]
    found = langid.text_features(pa.array([t for _, t in rows]))
    model = langid.fit([(lang, i, slots, shares) for i, ((lang, _), (slots, shares)) in enumerate(zip(rows, found))])
    for lang in parts:
        names, score = langid.score_texts(pa.array([text(lang, 100) for _ in range(60)]), model)
        assert names == [lang] * 60 and (score >= 0.6).all()
