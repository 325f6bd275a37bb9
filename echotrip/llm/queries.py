"""Registered queries of the subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrip.llm import clusters, host_rules, mixing, near_dups, packing, perspectives, pieces, quality, repeats, token_counts, url_filter
from echotrip.llm import vector_codes, vector_dups
from echotrip.llm.dictionaries import total_as_long
from echotrip.session import stage

# The rules of the pages query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
MIX_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from positives and unlabelled texts outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs.where(~held_out()), labels.where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: five words, similarity 0.75."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the digest of what they decode to."""
    model = pieces.read_model()
    # Written between, so that a task has one Python worker at a time.
    encoded = stage(pieces.encode(table(spark, sf_dir, "documents"), model), "pieces")
    decoded = pieces.decode(encoded, model)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without strings of 400 bytes that start anywhere else."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep="none")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it; masks as text ``begin-end begin-end``."""
    seen = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat_ws("-", x["begin"], x["end"]))
    return seen.withColumn("mask", F.array_join(spans, " "))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every document, and the verdict on its source."""
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length of the documents with its suffix sums."""
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, else by a model learnt from urls that the rules label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    verdict = url_filter.rule_for(url_filter.host_of(url), url_filter.path_of(url), URL_RULES)["verdict"]
    model = url_filter.train(pages.select("url", verdict.alias("verdict")))
    return url_filter.judge(pages, URL_RULES, model)


def op9_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 among all embeddings."""
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for target shares of four languages, by posteriors from their texts."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs, MIX_WEIGHTS)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distances and the digest of the centroid of every embedding of 64 components."""
    rows = clusters.described(clusters.cluster_vectors(table(spark, sf_dir, "embeddings")))
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, the errors of its label, and the digest of the codebooks."""
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    labels = codes.coded.groupBy("label").agg(total_as_long("error").alias("label_error"))
    labels = stage(labels, "labels").alias("l")
    books = codes.table().groupBy("width").agg(F.sort_array(F.collect_list(F.struct("part", "entry", "components"))).alias("book"))
    joined = F.array_join(F.flatten(F.col("book.components")), ",")
    digests = books.select("width", F.sha2(joined, 256).alias("codebooks_sha256"))
    rows = codes.coded.alias("c").join(labels, F.expr("c.label <=> l.label"))
    rows = rows.join(F.broadcast(digests), "width")  # one row per width
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens, with the checksum of their ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_pu": op1_quality_pu,
    "op2_minhash": op2_minhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_repeats": op4_repeats,
    "op5_perspectives": op5_perspectives,
    "op6_host_rules": op6_host_rules,
    "op7_token_histogram": op7_token_histogram,
    "op8_url_filter": op8_url_filter,
    "op9_vector_dups": op9_vector_dups,
    "op10_mixing": op10_mixing,
    "op11_clusters": op11_clusters,
    "op12_vector_codes": op12_vector_codes,
    "op13_packing": op13_packing,
}
