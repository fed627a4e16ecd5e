"""The pipeline's stages: each one's decisions take effect on all that came before, on the smallest tables."""

import hashlib

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import near_dedup

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from ledgerflow.session import materialize

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, docs, DATA), "test-" + name.replace(" ", "-"))
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "language", "near duplicates", "mixing", "encoding"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_filters_only_take_away(stages):
    for _, before, after in stages[:2]:
        assert after.exceptAll(before).isEmpty() and after.count() >= 0.7 * before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    linked = near_dedup.link(before).collect()
    groups = {r["component_id"] for r in linked}
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(groups)
    assert after.exceptAll(before).isEmpty()


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    counts = after.groupBy("doc_id").count().collect()
    assert all(1 <= r["count"] <= 3 for r in counts)
    words = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    assert abs(words(after) - words(before)) <= 0.15 * words(before)


def test_encoding_decodes_to_the_texts(stages):
    _, before, after = stages[4]
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before.collect())
    assert sorted(r["decoded_sha256"] for r in after.collect()) == want


def test_rows_that_are_alike_or_odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    twice = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0)], docs.schema))
    kept = pipeline.drop_near_copies(spark, twice, DATA)
    ids = [r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()]
    assert len(ids) == len(set(ids))
    assert pipeline.mix_sources(spark, twice, DATA).where("text IS NULL OR text = ''").count() == 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_agrees_with_plain_python(spark):
    """run() on the smallest tables against stages in plain Python: brute-force copies, a sort of keys, the library's ids."""
    import public_tokenizers
    import tiktoken
    from test_corpus_operators import brute_components, plain_mix

    from ledgerflow.llm import bpe, language, mixing, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["doc_id"] for r in quality.score_documents(docs, labels).collect() if r["score"] >= quality.THRESHOLD}
    kept = [i for i in rows if i in good]
    model = language.fit(docs.where(F.col("doc_id").isin(kept)))
    kept = [i for i in kept if model.predict(rows[i]["text"])[1] >= language.LEAST_SCORE]
    groups = brute_components([(i, rows[i]["text"]) for i in kept], words=5)
    kept = sorted(i for i, _, least in groups if i == least)
    drawn = docs.where(F.col("doc_id").isin(kept)).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORDS)), F.lit(0)).alias("size"), "text")
    drawn = drawn.select("doc_id", "source", "size", mixing.quality_weight(F.col("text"), F.col("size")).alias("w"), mixing.uniform(F.col("doc_id").cast("string")).alias("u")).collect()
    assert all(r["size"] == len((rows[r["doc_id"]]["text"] or "").encode().split()) for r in drawn)
    times = {}
    for source, target in plain_mix([(r["doc_id"], r["source"], r["size"], 1.0) for r in drawn]).items():
        mine = sorted((1 - r["u"] ** (1 / r["w"]), str(r["doc_id"]), r["size"], r["doc_id"]) for r in drawn if r["source"] == source)
        whole = sum(x[2] for x in mine)
        epochs, before = int(target // whole) if whole else 0, 0
        for _, _, n, i in mine:
            times[i] = (epochs + (before + n / 2 <= target - epochs * whole)) if n else 0
            before += n
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, n in times.items():
        text = rows[i]["text"] or ""
        ids = library.encode_ordinary(text)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want += [(i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * n
    assert sorted(tuple(r) for r in pipeline.run(spark, DATA).collect()) == sorted(want)


def test_columns_with_clashing_names_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    names = ["row_key", "kept_key", "group_key", "N_WORDS", "mix_weight", "drawn_by", "mix_taken", "score", "label", "key", "bands"]
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and all(r[n] == "clash" for r in out.collect() for n in names)
