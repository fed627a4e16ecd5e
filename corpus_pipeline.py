"""From documents to token ids: quality, language, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, which may
have any others besides doc_id, text, lang and source. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, language, mixing, near_dedup, quality
from ledgerflow.session import keep, materialize, scratch


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_poor(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier predicts as good, all columns.

    Rows alike are kept or dropped alike; a null or empty text is judged as a text whose statistics are all 0; rows with a
    null id are judged, but nothing is learned from them.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_unknown_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined with a fair score, all columns.

    Null texts and texts without a letter are dropped, as is everything where no language can be learned; rows alike are
    kept or dropped alike; null languages and null ids are not learned from.
    """
    return language.keep_known(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; texts without words all stay, once per id and text.

    Texts are near duplicates by sets of five-word shingles, the rule of a stage (op2 is fixed to four). A null id is the
    largest; of rows alike in id and text one stays, with its other columns.
    """
    linked = near_dedup.link(docs)
    worded, group, alone = F.col("n_shingles") > 0, fresh(docs, "group_key"), fresh(docs, "alone_key")
    row = near_dedup.row_key(F.col("doc_id"), F.col("key"))
    keepers = linked.where("kept").withColumn("row", row).groupBy(F.when(worded, F.col("component_key")).alias(group), F.when(~worded, F.col("row")).alias(alone)).agg(F.min("row").alias("row"))
    own, kept = fresh(docs, "row_key"), fresh(docs, "kept_key")
    with scratch():
        keepers = keep(materialize(keepers.select(F.col("row").alias(kept)), "keepers"))
    keyed = docs.withColumn(own, near_dedup.row_key(F.col("doc_id"), near_dedup.text_key(F.col("text"))))
    return keyed.join(keepers.hint("merge"), F.col(own) == F.col(kept), "left_semi").dropDuplicates([own]).select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, all columns; texts without words are never taken.

    A null source is a source; a null id is drawn by its text; rows alike are each drawn, and at the edge of a source's
    budget as many of them are taken as fit.
    """
    size, weight, drawn, time, *out = (fresh(docs, n) for n in ("n_words", "mix_weight", "drawn_by", "mix_time", "of_source", "mix_target", "mix_taken"))
    sized = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(mixing.WORDS)), F.lit(0)).cast("long"))
    sized = sized.withColumn(weight, mixing.quality_weight(F.col("text"), F.col(size))).withColumn(drawn, mixing.drawn_by(F.col("doc_id"), F.col("text")))
    mixed = mixing.mix(sized, id_col=drawn, size_col=size, weight_col=weight, out=tuple(out)).where(F.col(out[2]) > 0)
    return mixed.withColumn(time, F.explode(F.sequence(F.lit(1), (F.col(out[2]) / F.col(size)).cast("int")))).select(*docs.columns)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's token ids and of the bytes decoded from them; a null text counts as empty, rows alike give rows alike."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality", drop_poor),
    ("language", drop_unknown_language),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifiers, the components and the merges are not expressible in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; only the last stage's input is left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
