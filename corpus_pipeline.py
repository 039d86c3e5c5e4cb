"""Training-data pipeline over ``documents``; each stage's rows are written and read again by the next.

All stages but the last return the columns of their input, and each states its own cases. Over the
whole pipeline: null and empty texts have no language and go in the first stage; a document with a
null id is kept like any other (near duplicates: unless its group has a document with an id);
rows repeated with one id and text count once from the second stage on, rows that share an id but
no text are documents of their own; an empty table passes through all stages; further columns of
the documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linespark.llm import languages, mixing, sentencepieces, shingles, substrings
from linespark.llm.common import new_path, remove_path, scratch, shipped
from linespark.llm.queries import MIXING_TARGETS, domain_labels

#: Wanted tokens after mixing over those before it; above 1 so that good texts are kept and rare domains repeated.
MIXING_BUDGET = 1.25


def _name_beside(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _columns(docs: DataFrame, source: str, **new: Column) -> list[Column]:
    """The documents' columns in order: the new ones given, the others from a struct."""
    return [(new[c] if c in new else F.col(f"{source}.`{c}`")).alias(c) for c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: those without a letter, so null and empty texts too. A missing ``lang`` is filled in.

    Without labelled rows no language is known; then the letters alone decide. Repeated rows stay.
    """
    model = languages.learn(docs)
    if not model.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = languages.identify(docs, model, with_spans=False, with_text=True).filter(F.col("lang_pred") != languages.UNKNOWN)
    return found.select(*_columns(docs, "key", text=F.col("text"), lang=F.coalesce("key.lang", "lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles overlap by 0.8 or more: the one with the smallest id.

    Candidates come from SimHash fingerprints by anchor points and from least hashes, and are checked
    exactly. A null id counts as the largest. Of rows that share the smallest id one text
    stays, the first by its hash; of equal rows one.
    """
    classes = shingles.near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    one = classes.groupBy("component").agg(F.min(order).alias("one"))
    first, version, nth = (_name_beside(docs, n) for n in ("first_id", "version", "nth"))
    stays = one.select(F.col("one.doc_id").alias(first), F.col("one.version").alias(version)).distinct()
    own = F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(first)) & (own == F.col(version)), "left_semi")
    same = Window.partitionBy("doc_id", own).orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that came earlier, and documents of which nothing is left.

    A text without a window stays as it is; a null id counts as the largest; a removed text's ``n_chars`` is counted anew.
    """
    found = substrings.remove_repeats(docs).filter("n_words = 0 or n_removed < n_words")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*_columns(docs, "row", **new))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains' tokens come near their targets.

    Without labels every document's rate is the budget. How the rate is rounded depends on id and text, so equal rows fare alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domains = mixing.learn(docs, domain_labels(docs, labels))
    fit = mixing.fit_rates(mixing.memberships(docs.select("doc_id", "text"), domains), domains, MIXING_TARGETS, MIXING_BUDGET)
    times = mixing.copies(F.col("rate"), "key.doc_id", "text").cast("int")
    return mixing.rated(docs, domains, fit).select("key", "text", F.explode(F.array_repeat(F.lit(0), times))).select(*_columns(docs, "key", text=F.col("text")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether the original library gives the same; all null for a null text."""
    found = sentencepieces.encode(docs)
    return found.select("key.doc_id", "key.lang", "key.source", "token_ids", "n_tokens", "parity", "round_trip")


#: Stages as (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("language", shipped(identify_languages)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("substrings", shipped(drop_repeated_passages)),
    ("mixing", shipped(mix_domains)),
    ("sentencepiece", shipped(encode_tokens)),
]

#: SQL can't express the classifiers or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        # What a stage has written for itself goes when its rows are there, and so do the rows of the stage before.
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.schema(rows.schema).parquet(path), path
    return docs
