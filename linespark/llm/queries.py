"""Queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, languages, media, mixing, neighbours, oracles, pages, periodic, sentencepieces, simhash, substrings, toxicity, variants, warc
from .common import new_path, shipped, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.with_revisits(_table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = languages.learn(docs.filter(~languages.held_out()))
    rows = docs.select("doc_id", languages.held_out().alias("held_out"), "text")
    found = languages.identify(rows, model, with_spans=False)
    return found.select("key.doc_id", "key.held_out", "lang_pred", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top_k(_table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("key.doc_id", "token_ids", "n_tokens", "parity", "round_trip")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("key.page_id", "key.url", "text", "n_chars")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Images are rendered where they are read, twice, so that no copy of them is kept; vectors are dealt evenly for that.
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return media.copy_classes(media.rendered(vectors))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.filter(~languages.held_out()), _table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", languages.held_out().alias("held_out"), "text")
    found = toxicity.score(rows, model)
    return found.select("key.doc_id", "key.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Wanted token weights of the domains: languages of good texts, and texts of low quality.
MIXING_TARGETS = {"en": 0.50, "fr": 0.19, "de": 0.19, "es": 0.10, "low": 0.02}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of documents labelled as good, ``low`` for the others."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "lang").join(known, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    domains = mixing.learn(docs, domain_labels(docs, _table(spark, sf_dir, "labels")))
    members = written(mixing.memberships(docs.select("doc_id", "text"), domains), "mixing")
    fit = mixing.fit_rates(members, domains, MIXING_TARGETS)
    rated = mixing.with_rates(members, fit, domains)
    return rated.select("key.doc_id", "n_tokens", "posterior", "rate", mixing.copies(F.col("rate"), "key.doc_id").alias("copies"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents, each tenth of which by the checksum of its id repeats a stretch of its words with a period up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))))

    # The words are bound as the one element of a list, so that they are split once for all places.
    words = F.array(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    planted = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, again(w))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, "text")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(_table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    longest = F.struct(first["start"].alias("start"), (-first["minus"]).alias("length"), first["period"].alias("period"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256)
    rows = found.select("key.doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), digest.alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "r.start", "r.length", "r.period", exponent, "runs_sha256", "collapsed_sha256")


def with_slips(docs: DataFrame) -> DataFrame:
    """(word): the words of all texts; where the checksum of document and word is a multiple of 97 a letter is left out."""
    words = docs.select("doc_id", F.explode(variants.words_of(F.col("text"))).alias("word"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")))
    at = (h % F.length("word")).cast("int")
    slip = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return words.select(F.when(h % 97 == 0, slip).otherwise(F.col("word")).alias("word"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.vocabulary(with_slips(_table(spark, sf_dir, "documents"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(decontamination.index_shards(_table(spark, sf_dir, "documents").select("doc_id", "text")), "shards")
    found = decontamination.occurrences(index, _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = found.select("key.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc, op2_simhash, op3_languages, op4_neighbours, op5_sentencepiece, op6_substrings, op7_pages, op8_media, op9_toxicity, op10_mixing]
    found += [op11_periodic, op12_variants, op13_decontamination]
    return {f.__name__: shipped(f) for f in found}


ORACLES = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end last_id from p)
select page_id, payload_bytes, payload_digest, case when last_id > page_id then 'revisit' else 'response' end record_type,
       case when last_id > page_id then last_id end refers_to, true digest_ok
from k
""",
    "op4_neighbours": """
with e as (select vec_id, pos, floor(256 * x::double)::bigint x
           from (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) pos from embeddings)),
s as (select q.vec_id query_id, d.vec_id, sum(q.x * d.x)::bigint score
      from e q join e d on q.pos = d.pos and q.vec_id <> d.vec_id where q.vec_id % 50 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int rank, vec_id, score from r where rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op11_periodic": oracles.OP11, "op12_variants": oracles.OP12, "op13_decontamination": oracles.OP13}
