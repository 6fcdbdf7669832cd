"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a table; each is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._text import kept
from millrace.llm.langid import UNKNOWN, identify, learn
from millrace.llm.mixing import mix_sources
from millrace.llm.near_dedup import keep_one, within
from millrace.llm.packing import pack_documents
from millrace.llm.queries import MIX_WEIGHTS, crc_mod, tokenizer_path

#: Share of a document's words that its language must have.
MIN_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of which at least half is one learned language. Those without a letter, or mixed of more, go."""
    names = docs.columns
    model = learn(docs, crc_mod("id", 4) != 2)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = plain.columns[names.index("text")]
    found = identify(plain, model, ids=plain.columns[names.index("doc_id")], text=text, keep=[c for c in plain.columns if c != plain.columns[names.index("doc_id")]])
    good = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return good.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class. Rows without an id stay only if no row of their class has
    one, and then one of them; equal texts of one id are one document."""
    return keep_one(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its copies in the mixture: none, one or more rows. A row without an id stays once."""
    copies = kept(mix_sources(docs, list(MIX_WEIGHTS)).groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    one = within(docs, copies.filter("copies = 1").select("doc_id"), "doc_id", "left_semi")
    many = copies.filter("copies > 1")
    more = docs.join(F.broadcast(many) if many.count() <= 1_000_000 else many, "doc_id")
    more = more.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
    return one.select(*docs.columns).unionByName(more).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture's documents in sequences of several context sizes."""
    pieces = pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

#: SQL can express neither Viterbi decoding, weighted sampling nor tokenisation; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
