"""A corpus pipeline of five stages over ``documents``; see STAGES.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their
columns (doc_id, text, lang, source, n_chars); the last returns the encoded documents.
Null and empty texts, texts without letters and garbage go in the first stage; an empty table
gives an empty result.  Stages join back by a hash of id and text in small tables, so texts are not shuffled unless
a checked size says that they must be.  Ids may be null or repeated: a row is a document of
its own, and of several rows with the same id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provmart.llm import common as C
from provmart.llm import decontaminate, language_id, ngram_jaccard, sentencepiece_codec, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language shares next to nothing with it is rejected like one without letters.
#: The least score of a document with letters is 0.38 on sf0.1 and 0.36 on the 51,282 of check_s.
MIN_SCORE = 0.25
DROP_BYTES = 32 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, substring_dedup.row_key("doc_id", "text").alias("_key"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is not in a work table of keys, which is broadcast if its counted size allows."""
    return keyed.join(C.small_side(keys, DROP_BYTES, 16), "_key", "left_anti").select(*keyed.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; texts without a language go."""
    profiles = language_id.train(language_id.training_rows(docs).select("lang", "text"))
    found = language_id.predict(docs.select(*COLUMNS), profiles)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; of each component the row of the smallest id stays, with null ids last."""
    keyed = _keyed(docs)
    found = ngram_jaccard.components_of(keyed.select(F.col("_key").alias("doc_id"), "text"))
    found = C.materialize(found.groupBy(F.col("doc_id").alias("_key")).agg(F.first("component_id").alias("part"), F.count("*").alias("n")), "parts")
    ids = keyed.select("_key", "doc_id").join(found, "_key").select("part", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key").alias("row"))
    kept = ids.groupBy("part").agg(F.min("row").alias("row")).select("row._key")
    gone = C.materialize(found.join(kept, "_key", "left_anti").select("_key"), "copies")
    again = C.materialize(found.where("n > 1").join(gone, "_key", "left_anti").select("_key"), "again")
    # rows with the same id and text, of which one stays
    twice = keyed.join(C.small_side(again, DROP_BYTES, 16), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)
    return _without(_without(keyed, gone), again).select(*COLUMNS).unionByName(twice)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup; passages that also occur elsewhere are cut, and texts that were nothing else go."""
    cut = substring_dedup.dedup(docs.select(*COLUMNS))
    cut = cut.where("n_removed = 0 OR text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; texts that cover a benchmark item go."""
    keyed = _keyed(docs)
    found = decontaminate.tiled(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_key")
    return _without(keyed, C.materialize(found.select(F.col("doc_id").alias("_key")).distinct(), "leaks")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and the text decoded from them; round_trip says whether it is the same."""
    out = sentencepiece_codec.encode_decode(docs.select("doc_id", "text", "lang", "source"), sentencepiece_codec.default_model())
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").alias("text"), same.alias("round_trip"))


STAGES = [
    ("language_id", keep_languages),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode),
]

#: Profiles, tilings and merges cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, C.materialize(stage(spark, docs, sf_dir), name)
        if i:
            C.drop(before)
    return docs
