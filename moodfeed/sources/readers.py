"""Readers and writers of the external formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.operators.ranking import with_position
from moodfeed.staging import stage

# A missing key reads as NULL.
BACKUP_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("tweet-lang", T.StringType()),
        T.StructField("timestamp", T.StructType([T.StructField("$numberLong", T.StringType())])),
    ]
)


def backup_schema(id_field: str | None = None) -> T.StructType:
    """The schema above, with a number that the objects hold, if one is named."""
    more = [T.StructField(id_field, T.LongType())] if id_field else []
    return T.StructType([*BACKUP_SCHEMA.fields, *more])

POLARITY_DDL = "target int, id bigint, date string, flag string, user string, text string"

CSV_OPTIONS = {"quote": '"', "escape": '"'}

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)

VOCABULARY_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("term_id", T.LongType()),
        T.StructField("df", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("idf", T.DoubleType()),
        T.StructField("lang", T.StringType()),
    ]
)


def backup_columns(source: str) -> list:
    """``lang``, ``text`` and the epoch milliseconds, still a string."""
    field = f"{source}." if source else ""
    return [
        F.col(f"{field}`tweet-lang`").alias("lang"),
        F.col(f"{field}text").alias("text"),
        F.col(f"{field}timestamp.`$numberLong`").alias("ts_ms"),
    ]


def row_key() -> Column:
    """128 bits, as hexadecimal digits, of a row's file and values; NULL differs from empty."""
    return F.md5(F.to_json(F.struct("file_path", "lang", "text", "ts_ms")))


def read_backup(spark: SparkSession, path: str, id_field: str | None = None) -> DataFrame:
    """JSON-lines backup files, plain or compressed.

    ``tweet_id`` is the named field of the objects, or else a text of 32 hexadecimal digits, hashed from the
    file, the row's values, and which of the equal rows of its file it is. It does not depend on how the
    file is split or read, so that loads agree, and files stay apart. Only rows that repeat are sorted to
    number them; a row that fills much of a file is dealt over several tasks.
    """
    rows = spark.read.schema(backup_schema(id_field)).json(path)
    if id_field:
        return rows.select(F.col(f"`{id_field}`").alias("tweet_id"), *backup_columns(""))
    values = ["lang", "text", "ts_ms"]
    keyed = rows.select("_metadata.file_path", *backup_columns("")).withColumn("_key", row_key())
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    repeated = stage(repeated.select("_key"), "repeated")
    once = keyed.join(repeated, "_key", "left_anti").select(F.col("_key").alias("tweet_id"), *values)
    # equal rows are interchangeable: any order numbers them
    again = keyed.join(repeated, "_key", "left_semi").select(
        "_key", *values, F.monotonically_increasing_id().alias("_tie")
    )
    placed = with_position(again, ["_key", "_tie"], "_place")
    starts = stage(placed.groupBy("_key").agg(F.min("_place").alias("_first")), "starts")
    turn = F.col("_place") - F.col("_first")
    number = F.md5(F.concat_ws(":", "_key", turn.cast("string")))
    return once.unionByName(placed.join(starts, "_key").select(number.alias("tweet_id"), *values))


def parse_backup(lines: DataFrame, json_col: str = "json") -> DataFrame:
    """The same for a column of JSON objects; other columns stay."""
    others = [c for c in lines.columns if c != json_col]
    parsed = lines.select(*others, F.from_json(json_col, BACKUP_SCHEMA).alias("_doc"))
    return parsed.select(*others, *backup_columns("_doc"))


def read_polarity(spark: SparkSession, path: str) -> DataFrame:
    """Labelled corpus as CSV: ``tweet_id, target, text``."""
    rows = spark.read.schema(POLARITY_DDL).options(**CSV_OPTIONS).csv(path)
    return rows.select(F.col("id").alias("tweet_id"), "target", "text")


def parse_polarity(lines: DataFrame, line_col: str = "line") -> DataFrame:
    others = [c for c in lines.columns if c != line_col]
    parsed = lines.select(
        *others, F.from_csv(line_col, POLARITY_DDL, CSV_OPTIONS).alias("_r")
    )
    return parsed.select(*others, "_r.target", "_r.text")


def write_corpus(tweets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Collected texts, a folder per language."""
    tweets.select("tweet_id", "text", "lang").write.partitionBy("lang").mode(mode).parquet(path)


def read_corpus(
    spark: SparkSession, path: str, lang: str | None = None, id_type: str = "bigint"
) -> DataFrame:
    """``lang`` reads the folder of that language only. Ids that ``read_backup`` made are of type string."""
    schema = [f"tweet_id {id_type}", *(f"{f.name} string" for f in CORPUS_SCHEMA.fields[1:])]
    corpus = spark.read.schema(", ".join(schema)).parquet(path)
    return corpus if lang is None else corpus.filter(F.col("lang") == lang)


def write_vocabulary(vocabulary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vocabulary.write.option("compression", "zstd").partitionBy("lang").mode(mode).parquet(path)


def read_vocabulary(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    vocabulary = spark.read.schema(VOCABULARY_SCHEMA).parquet(path)
    return vocabulary if lang is None else vocabulary.filter(F.col("lang") == lang)


def write_matrix(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long-form TF-IDF or feature matrix."""
    matrix.write.option("compression", "zstd").mode(mode).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
