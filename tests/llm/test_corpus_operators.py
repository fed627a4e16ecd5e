"""Sampling, sharding, joins, searches and classifiers against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import language, mixing, near_dedup, neighbours, quality, sharding

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size_ string, taken_ string"


def brute_components(texts, words=4):
    """component per row by comparing all pairs: [(doc_id, text)]"""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(texts)]


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    texts = ["", " \n ", "One two", "one TWO", "one two three four", "one  two\nthree four", "x"]
    for n in (40, 80, 200):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randrange(0, 1 + n // 20)):
                other[rng.randrange(n)] = word()
            texts.append(" ".join(other))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(10, 60))]) for _ in range(20)]
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)] + [texts[7]] * 5
    order = list(range(1, len(texts) + 1))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


def test_near_duplicates_agree_with_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "clash", "", "") for d, t in rows], SCHEMA).repartition(5)
    got = near_dedup.link(docs, words=4).collect()
    want = brute_components(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    """Of 150 documents that share most of their text but not enough, no pair is looked at; the real copies among them are found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(19))])) for i in range(150)]
    for i in range(0, 40, 2):  # copies with a word changed
        words = rows[i][1].split()
        words[110] = word()
        rows.append((1000 + i, " ".join(words)))
    met, across = [], near_dedup._across

    def watched(*a):
        out = across(*a)
        met.append(out.distinct().count())
        return out

    monkeypatch.setattr(near_dedup, "_across", watched)
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows))
    assert met and met[0] <= 150


def test_copies_of_copies_do_not_become_their_pairs(spark, monkeypatch):
    """Of 221 linked texts 80 are too far from most others, with which they share every change: few pairs are left for the shingle lists."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    base, other = ([word() for _ in range(120)] for _ in range(2))
    changes = [[], *([i] for i in range(4, 116, 4) for _ in range(5)), *(rng.sample(range(4, 116, 4), 4) for _ in range(80))]
    texts = [[other[i] if i in at else w for i, w in enumerate(base)] + [word()] for at in changes]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    met, across = [], near_dedup._across

    def watched(*a):
        out = across(*a)
        met.append(out.distinct().count())
        return out

    monkeypatch.setattr(near_dedup, "_across", watched)
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    want = sorted(brute_components(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(c == 0 for _, _, c in want) > 200 and sum(met) <= len(rows), met


def test_near_duplicates_edges(spark):
    rows = [(5, None), (6, ""), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A  B c D e f"), (None, "alone and without id")]
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got)
    assert found == [(-1, 1, -1, True), (-1, 2, 7, False), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]
    assert near_dedup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_count_equal_values(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 32, (2, 2 * near_dedup.HASHES), dtype=np.uint32)
    values[1, :60] = values[0, :60]
    agree = int(((values[0] & 15) == (values[1] & 15)).sum())
    packed = near_dedup.sketches(values)
    rows = [tuple(int(p[i]) for p in packed) for i in range(2)]
    df = spark.createDataFrame(rows, ", ".join(f"{s} long" for s in near_dedup.SKETCH))
    left = df.limit(1).alias("x")
    kept = left.join(df.alias("y"), F.expr(near_dedup._alike("x", "y"))).count()
    assert agree >= near_dedup.LEAST_EQUAL and kept == 2


def plain_mix(rows, weights=mixing.WEIGHTS, most=3):
    """Targets by repeated resharing: {source: target}"""
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * size[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = float(most * size[s])
            left -= target[s]
        free -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    sources = ["a"] * 60 + ["b"] * 5 + ["c"] * 20 + ["é"] * 10 + [None] * 5
    rows = [(i, s, rng.choice([0, 3, 10, 40]), rng.choice([0.5, 1.0])) for i, s in enumerate(sources)] + [(3, "a", 7, 1.0), (3, "a", 7, 1.0), (None, "c", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double").withColumn("level", F.lit("clash"))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows) and "level" in got[0].asDict()
    for source, target in plain_mix(rows).items():
        mine = [r for r in got if r["source"] == source]
        assert mine[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in mine) - target) <= 40 / 2 + 1
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_prefers_weight(spark):
    rows = [(i, s, 10, 4.0 if i % 2 else 0.25) for s in ("a", "b", "c") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")).where("source = 'c'").collect()
    heavy, light = ([r["taken"] for r in got if r["weight"] == w] for w in (4.0, 0.25))
    assert sum(heavy) > 3 * sum(light)


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 3000)) for i in range(2000)] + [(7, "twice"), (7, "twice"), (None, None), (None, "é")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    loads, slots = {}, {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(loads) == 24 and max(loads.values()) <= 1.02 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plain = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == plain
    by_slot = {}
    for r in got:
        by_slot.setdefault(r["vslot"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_slot.values())  # a virtual slot is in one shard
    for shard in range(24):
        mine = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        keys = [(r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in mine]
        assert keys == sorted(keys)
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_with_hot_and_null_ids(spark):
    text = "one text that half of all rows hold " * 4
    rows = [(i if i % 2 else None, text) for i in range(6000)] + [(77, "a repeated row")] * 3000 + [(i, "x" * (i % 90)) for i in range(10000, 13000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs.repartition(7)).select("doc_id", "size", "text_crc32", "shard", "slot").toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(loads) == 24 and loads.max() <= 1.02 * loads.min()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.assign(docs.repartition(3)).select("doc_id", "size", "text_crc32", "shard", "slot").toPandas()
    key = ["size", "text_crc32", "shard", "slot"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_mix_of_rows_alike(spark):
    rows = [(None, "a", 5)] * 4000 + [(i, "a", 7) for i in range(300)] + [(i, "b", 11) for i in range(900)] + [(None, None, 3)] * 100 + [(9, "c", 0)] * 3
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, size long, weight double").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source, target in plain_mix(rows_of := [(*r, 1.0) for r in rows]).items():
        mine = [r for r in got if r["source"] == source]
        assert mine[0]["target"] == pytest.approx(target) and abs(sum(r["taken"] for r in mine) - target) <= 7 and all(r["taken"] <= 3 * r["size"] for r in mine)
    assert len(rows_of) == len(got)


def test_mix_is_a_prefix_of_the_order_of_keys(spark):
    """Against a sort of all keys in plain Python."""
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.randrange(0, 50), rng.choice([0.1, 0.5, 1.0])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    u = {r[0]: r[1] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"))).collect()}
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    for source, target in plain_mix(rows).items():
        mine = sorted((1 - u[i] ** (1 / w), str(i), n, i) for i, s, n, w in rows if s == source)
        whole = sum(x[2] for x in mine)
        epochs, before = int(target // whole), 0
        for _, _, n, i in mine:
            assert got[i] == epochs * n + (n if before + n / 2 <= target - epochs * whole else 0)
            before += n


def test_map_edits_move_little():
    rng = random.Random(2)
    load = [rng.randrange(1000, 2000) for _ in range(sharding.SLOTS)]
    first = sharding.rebalance(sharding.first_map(24), load, 24)
    grown = sharding.rebalance(first, load, 25)
    assert sum(a != b for a, b in zip(first, grown, strict=True)) < sharding.SLOTS / 8
    assert set(grown) == set(range(25))


def test_hilbert_curve_is_continuous():
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = neighbours.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert len(set(keys.tolist())) == 512 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[40:400] = x[40]  # one vector many times
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    odd = [(9001, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0] * 3), (9400, [None] * 16), (None, [1.0] * 16), (100, [float(v) for v in x[100]])]
    got = neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted(range(1500), key=lambda i: (d[i], i))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want))
        total += 10
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert neighbours.recall(spark.createDataFrame(got), table) >= 0.9
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 1500, 100))
    few = neighbours.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] != [] and len(few) == 3
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest tables, with odd rows and columns added."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", None, 0), (90002, "", "en", "s", 0), (90003, "12 + 34 = 46", "de", "s", 0), (None, "the and of", None, "s", 0)], docs.schema)
    return docs.union(odd).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))


def test_language(spark, documents):
    got = language.identify(documents).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 90000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (90001, 90002, 90003)}
    assert set(odd.values()) == {("und", 0.0)} and all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(documents.limit(0)).count() == 0
    kept = language.keep_known(documents)
    assert kept.columns == documents.columns and kept.where("doc_id >= 90001").count() == 0 and kept.count() >= 190


def test_language_training_is_sparse_and_calibrated():
    rng = random.Random(1)
    say = {"x": "aeiou", "y": "bcdfg"}
    idf = np.ones(language.FEATURES)
    samples = [(*language.vector("".join(rng.choice(say[k]) for _ in range(30)), idf), k) for k in ("x", "y") for _ in range(60)]
    rng.shuffle(samples)
    model = language.train(samples, idf)
    assert model.predict("aeaeae")[0] == "x" and model.predict("bcbcbc")[0] == "y" and (model.weights == 0).mean() > 0.5
    assert language.train([], idf).predict("a") == ("und", 0.0)


def test_quality(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (90002, None, None), (77777777, 0, 0)], "doc_id long, quality int, toxic int"))
    got = quality.score_documents(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    marked = [r for r in got if truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in marked]) >= 0.9
    assert quality.score_documents(documents.limit(0), labels).count() == 0
    none = quality.score_documents(documents, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert quality.keep_good(documents, labels).columns == documents.columns


def test_quality_agrees_with_plain_arithmetic(spark, documents):
    """The discriminant from scratch: means, shrunk covariances, log densities by solving instead of factors."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in documents.where("doc_id IS NOT NULL").collect()}
    taught = [i for i in x if i in truth and zlib.crc32(str(i).encode()) % 5]
    every = np.array([x[i] for i in taught])
    scale = np.sqrt(np.maximum(every.var(axis=0), 1e-9))
    parts = {}
    for label in (0, 1):
        z = np.array([x[i] for i in taught if truth[i] == label]) / scale
        d, shrink = z.shape[1], max(quality.SHRINKAGE, min(1.0, z.shape[1] / len(z)))
        cov = np.cov(z.T, bias=True)
        cov = (1 - shrink) * cov + (shrink * np.trace(cov) / d + quality.FLOOR) * np.eye(d)
        parts[label] = (z.mean(axis=0), cov, np.log(len(z) / len(taught)) - 0.5 * np.linalg.slogdet(cov)[1])
    density = lambda v, k: parts[k][2] - 0.5 * (v / scale - parts[k][0]) @ np.linalg.solve(parts[k][1], v / scale - parts[k][0])
    for r in quality.score_documents(documents, labels).collect():
        if r["doc_id"] is not None:
            v = x[r["doc_id"]]
            assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip((density(v, 0) - density(v, 1)) / quality.TEMPERATURE, -700, 700))), abs=1e-6)


def test_language_weights_agree_with_one_coordinate_at_a_time():
    """Follow-the-regularised-leader in plain loops, a coordinate at a time."""
    rng = random.Random(3)
    idf = np.ones(language.FEATURES)
    samples = [(*language.vector("".join(rng.choice("abcde"[k : k + 3]) for _ in range(12)), idf), "xyz"[k]) for k in (0, 1, 2) for _ in range(8)]
    rng.shuffle(samples)
    model = language.train(samples, idf)
    used, names = [s for i, s in enumerate(samples) if i % 5 or len(samples) < 25], "xyz"
    z, n = {}, {}

    def weight(key):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zi) <= language.L1 else (np.sign(zi) * language.L1 - zi) / ((language.BETA + ni**0.5) / language.ALPHA + language.L2)

    order = np.random.default_rng(5)
    for _ in range(language.EPOCHS):
        for i in order.permutation(len(used)):
            at, value, name = used[i]
            x = [*zip(at.tolist(), value.tolist(), strict=True), (-1, 1.0)]
            w = {(f, k): weight((f, k)) for f, _ in x for k in range(3)}
            raw = [sum(v * w[f, k] for f, v in x) for k in range(3)]
            e = np.exp(np.array(raw) - max(raw))
            error = e / e.sum() - np.array([name == c for c in names])
            for f, v in x:
                for k in range(3):
                    g = v * error[k]
                    z[f, k] = z.get((f, k), 0.0) + g - ((n.get((f, k), 0.0) + g * g) ** 0.5 - n.get((f, k), 0.0) ** 0.5) / language.ALPHA * w[f, k]
                    n[f, k] = n.get((f, k), 0.0) + g * g
    for f, k in z:
        assert (model.bias[k] if f < 0 else model.weights[f, k]) == pytest.approx(weight((f, k)), abs=1e-9)


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the common words of text number {i} and others", "aa") for i in range(3000)] + [(i, "zyx wvu żółć qqq", "bb") for i in range(3000, 3006)] + [(3006, "łąk śnieg ćma", "cc"), (3007, "łąk śnieg ćma", "cc"), (3008, "łąk śnieg ćma", "cc")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert model.languages == ("aa", "bb", "cc")
    assert [model.predict(t)[0] for t in ("the words of others", "zyx wvu żółć", "łąk śnieg ćma")] == ["aa", "bb", "cc"]


@pytest.mark.parametrize("other", [{"percent": 60}, {"hashes": 24}, {"rows": 8}])
def test_untuned_links_are_refused(spark, other):
    with pytest.raises(ValueError, match="bands and sketches"):
        near_dedup.link(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), **other)
