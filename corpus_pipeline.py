"""A corpus from documents: language, lines, near-duplicates, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, common, langid, line_dedup, mixing, near_dup


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that was learned go: null ones, those without a letter, and those whose best language has a score under the model's floor, far below that of any training document that is told right. Where nothing can be learned, only null texts and those without a letter go. Rows that repeat an id are told each for itself."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = (common.free(c, docs.columns) for c in ("lang_pred", "lang_score"))
    found = langid.predict(docs, model, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= model.floor)).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier one go, short ones too; every document stays. n_chars is that of what is left. Nulls, repeats and ties: see line_dedup.removed_lines."""
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id and, of several texts with that id, of the smallest hash. Rows without an id or a word stay, as they link with nothing. Of rows that are alike in id and text one stays."""
    found = common.written(near_dup.near_duplicates(docs), "near")
    linked = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = linked.where("kept").groupBy("component_id").agg(F.min("th").alias("least"))
    linked = linked.groupBy("doc_id", "th").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).join(first, "component_id")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("least"))
    gone = linked.where(~stays).select(F.col("doc_id").alias("id"), "th")
    again = linked.where(stays & (F.col("rows") > 1)).select(F.col("doc_id").alias("id"), "th")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    rows = rows.join(gone, ["id", "th"], "left_anti")
    if again.take(1):
        rows = rows.join(again, ["id", "th"], "left_anti").unionByName(rows.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes: none, one or two. Null sources are a source, texts without words go with their hash, as all do; rows that repeat an id are rows of their own."""
    taken = mixing.mix(docs, keep=True)
    out = taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with their number; the text goes, and columns that have the names of the new ones. A null text has no ids, as an empty one."""
    return bpe.encode_documents(docs, common.vocabulary("word_bpe_49k.json")).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded", "text")


STAGES = [("language ID", languages), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mix", mix), ("BPE", encode)]

ORACLE_SQL = None  # trained and iterated stages: each is tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
