"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, language, licenses, mtree, quality, secrets, simhash, spellings, toxicity, vptree, wrappers
from .oracles import ORACLES
from .texts import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels with crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    model = quality.fit(labels, docs)
    scored = quality.score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 4-word shingles, links at 4 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[secrets.count_of("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.digest("base"), 256).alias("base_sha256"),
        secrets.digest("spans").alias("spans"),
    )


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    vocabulary = bpe.Vocabulary.load(bpe.default_path())
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    network = language.fit(docs.filter(~held_out))
    found = language.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document; labels with crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    sample = quality.training_rows(table(spark, sf_dir, "labels").filter(~held_out), docs, "toxic", toxicity.TRAIN_ROWS)
    chain = toxicity.fit(toxicity.with_categories(sample))
    found = toxicity.score(docs.select("doc_id", "text"), chain)
    return found.select(
        "doc_id", held_out.alias("held_out"), *[f"p_{c}" for c in toxicity.SEEDS],
        F.col("p_toxic").alias("score"), (F.col("p_toxic") >= toxicity.TOXIC_AT).alias("toxic"),
    )


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license)))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_units"), F.array_join(names, ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m.dice)), F.lit(0.0)), 6).alias("best_dice"),
    )


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector with all others."""
    vectors = mtree.usable(table(spark, sf_dir, "embeddings"))
    return mtree.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = wrappers.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    found = spellings.variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, one_in=97, ratio=2)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by cosine of every 50th vector."""
    vectors = vptree.usable(table(spark, sf_dir, "embeddings"))
    return vptree.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)
