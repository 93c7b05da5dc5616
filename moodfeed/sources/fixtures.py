"""The tweet table and its JSON and CSV forms, derived from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodfeed.staging import spread

DECORATIONS = [
    " :)",
    " :(",
    " not good :)",
    " soooo happy!!! :D",
    " @user_1 see http://t.co/abc1 =)",
    " #fail :-(",
    " why?! ;(",
    " (:",
    " not not good",
    " RT @bob: ok ^_^",
    " www.foo.com =(",
    " price 1000 at 12:30 ):",
    " not",
    " (#tag) very &amp; go",
    " :)) ^___^",
    "",
]

FIRST_MS = 1704067200000  # 2024-01-01 UTC
DAY_MS = 86400000
AS_OF_YEAR = 2025


def decorate(documents: DataFrame) -> DataFrame:
    """One tweet per non-empty line, whole, with emoticons and marks appended."""
    lines = documents.select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).filter(F.length("line") > 0)
    step = F.col("doc_id") * 7 + F.col("pos")
    decorations = F.array(*[F.lit(d) for d in DECORATIONS])
    return lines.select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("tweet_id"),
        "lang",
        F.concat("line", F.get(decorations, (step % len(DECORATIONS)).cast("int"))).alias("text"),
        (F.lit(FIRST_MS) + (step % 1500) * DAY_MS).alias("ts_ms"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, of a table that is one file or a folder of files."""
    folder, name = sf_dir.rstrip("/"), "documents.parquet"
    reader = spark.readStream.schema(documents(spark, sf_dir).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return decorate(spread(texts, "doc_id"))


def backup_json(tweets: DataFrame) -> DataFrame:
    """``(tweet_id, json)``; some objects lack the language, some the time."""
    fields = F.struct(
        F.col("text"),
        F.when(F.col("tweet_id") % 11 != 0, F.col("lang")).alias("tweet-lang"),
        F.when(
            F.col("tweet_id") % 13 != 0,
            F.struct(F.col("ts_ms").cast("string").alias("$numberLong")),
        ).alias("timestamp"),
        F.col("tweet_id").alias("id"),
    )
    return tweets.select("tweet_id", F.to_json(fields).alias("json"))


def polarity_lines(tweets: DataFrame) -> DataFrame:
    """``(tweet_id, line)``: the six quoted fields of the labelled corpus."""
    fields = [
        ((F.col("tweet_id") % 3) * 2).cast("string"),
        F.col("tweet_id").cast("string"),
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss"),
        F.lit("NO_QUERY"),
        F.concat(F.lit("user"), (F.col("tweet_id") % 97).cast("string")),
        F.replace("text", F.lit('"'), F.lit('""')),
    ]
    quoted = [F.concat(F.lit('"'), f, F.lit('"')) for f in fields]
    return tweets.select("tweet_id", F.concat_ws(",", *quoted).alias("line"))
