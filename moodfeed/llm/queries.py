"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodfeed.llm import (
    decontaminate,
    html,
    infill,
    langid,
    licenses,
    mixture,
    near,
    resample,
    scoring,
    shards,
    substring,
    topk,
    vectors,
)
from moodfeed.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


#: All of these follow from the text, so that equal texts stay together.
SHARD_DIMENSIONS = ["size", "n_chars", "lang"]


def op1_kd_shards(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("size", shards.doc_size())
    placed = shards.kd_shards(docs, SHARD_DIMENSIONS, "shard", shards.SHARDS)
    rows = placed.select(
        "doc_id",
        "size",
        shards.text_crc32().alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return shards.with_slots(rows, "shard", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    out = langid.held_out(3)
    model = langid.train(docs.where(~out))
    return langid.identify(docs.drop("lang"), model, "predicted").select(
        "doc_id", out.alias("held_out"), "predicted.lang_pred", "predicted.score"
    )


def op3_near_vectors(spark, sf_dir):
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_near_texts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return near.near_classes(docs).select("doc_id", "class_id", "kept")


def op5_gru_scores(spark, sf_dir):
    return scoring.score(documents(spark, sf_dir), langid.held_out(5))


def op6_repeated_windows(spark, sf_dir):
    return substring.remove_repeated(documents(spark, sf_dir), digest=True)


def op7_main_text(spark, sf_dir):
    pages = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), "text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixture(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixture.mix(docs, "mixed").select(
        "doc_id",
        "mixed.size",
        "mixed.source_size",
        "mixed.target",
        "mixed.taken",
    )


def licence_path() -> F.Column:
    """A tree of directories over the documents: those whose number is divisible by 4096 or by 64 are
    the licence files of their source's part or folder."""
    number = F.col("doc_id")
    part, folder = F.floor(number / 4096), F.floor(number / 64)
    return F.concat_ws(
        "/",
        F.coalesce("source", F.lit("unknown")),
        part.cast("string"),
        F.when(number % 4096 != 0, folder.cast("string")),
        F.when(number % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(number.cast("string"), F.lit(".txt"))),
    )


def op9_licenses(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("path", licence_path())
    own = licenses.declared(files, "own").select("doc_id", "path", "own")
    own = stage(own, "declared")
    return licenses.inherit(own, "own", "found").select(
        "doc_id",
        "path",
        F.col("own.license").alias("own_license"),
        F.col("own.score").alias("own_score"),
        "found.license",
        "found.origin",
        "found.sources",
    )


def op10_decontaminate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    verdicts = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), "verdict")
    return verdicts.select(
        "doc_id",
        *(f"verdict.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")),
    )


def op11_top_products(spark, sf_dir):
    return topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cut = infill.transform(docs, "cut").select("doc_id", "cut.*")
    back = infill.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op13_resample(spark, sf_dir):
    docs, target = documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    drawn = resample.resample(docs, target, "drawn", keep=["doc_id"])
    return drawn.select("doc_id", *(f"drawn.{c}" for c in ("n_features", "weight", "score", "rank")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_shards,
        op2_language_id,
        op3_near_vectors,
        op4_near_texts,
        op5_gru_scores,
        op6_repeated_windows,
        op7_main_text,
        op8_mixture,
        op9_licenses,
        op10_decontaminate,
        op11_top_products,
        op12_fill_in_middle,
        op13_resample,
    )
}
