"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm import language, linededup, ngramjoin, packing, secrets
from triagegrid.llm.common import materialize, number_texts, table, text_digest
from triagegrid.llm.queries import tokenizer_path

ORACLE_SQL = None  # language and secret models and the tokenizer are beyond SQL; tests/llm holds run() against a brute-force version


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. The model learns from the labelled rows among them.

    Null texts and those without letters go, as nothing tells their language; rows
    with a null id are judged like any other, repeated rows alike.
    """
    model = language.fit_languages(docs)
    known = language.identify(spark, docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="__")
    return known.where(~F.col("__rejected")).select(docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; those of which no word is left go.

    A text without words that lost no line stays, as do null texts and rows with a
    null id, whole. Rows that repeat an id and its text lose the same lines.
    """
    gone = linededup.repeated_lines(spark, docs, least=1)
    left = linededup.drop_lines(docs, gone, dropped="__dropped").where((F.col("__dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_length(left.drop("__dropped"), docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the smallest id; of rows that repeat an id and its text, one.

    Different texts of one id are documents of their own. Rows with a null id stay.
    """
    names = number_texts(spark, docs)
    if names is not None:
        unnamed = docs.where("doc_id is null")
        own = docs.withColumn("__digest", text_digest())
        told = names.select(F.col("hi").alias("__hi"), F.col("digest").alias("__named"), F.col("uid").alias("__uid"))
        own = own.join(told, (F.col("doc_id").cast("bigint") == F.col("__hi")) & (F.col("__digest") == F.col("__named"))).dropDuplicates(["__uid"])
        own = materialize(spark, own.select(*docs.columns, "__uid"), "copies-told-apart")
        classes = ngramjoin.near_duplicates(spark, own.select(F.col("__uid").alias("doc_id"), "text"))
        losers = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
        return own.join(losers, own["__uid"] == F.col("__gone"), "left_anti").select(docs.columns).unionByName(unnamed)
    classes = ngramjoin.near_duplicates(spark, docs)
    losers = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(losers, docs["doc_id"] == F.col("__gone"), "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mask; null texts stay null, n_chars follows the text."""
    found = secrets.scan(docs, secrets.train(spark, docs), keep=tuple(c for c in docs.columns if c != "doc_id"), prefix="__")
    return _with_length(found.withColumn("text", secrets.redacted(F.col("text"), F.col("__spans"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, cut into sequences: one row per piece. Null text is the end id alone; repeated rows are packed again."""
    return packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"), added=True)


def _with_length(df: DataFrame, docs: DataFrame) -> DataFrame:
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return df.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES = [
    ("language", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram join", keep_one_of_each_class),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents table, each stage's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
