"""The registered queries of this subpackage, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdeck.llm import decontamination, fixity, neighbours, oracle_sql, packing, pages, pieces, quality, simhash, substrings, tokenfile, toxicity, tries, variants
from corpusdeck.llm.common import table
from corpusdeck.llm.shipping import ship
from corpusdeck.session import scratch_path

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(run: Run) -> Run:
    @wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def op6_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Routes.pigeonhole(2), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op10_fm_index_substrings"] = oracle_sql.REPEATED_WINDOWS


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, "blank_free", end=1, with_ids=False).drop("ids")


@query
def op7_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), target, tokenizer_file("byte_bpe_50k.json"), "blank_led", end=2)
    return tokenfile.read_tokens(spark, target)


@query
def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


@query
def op2_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a WARC store, audited against a replica in which about one record in 256 has another
    byte and as many are gone."""
    target = scratch_path(spark, "archives")
    fixity.write_archives(table(spark, sf_dir, "pages"), target)
    store = spark.read.schema(fixity.STORE).parquet(target)
    sign = F.substr(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit(1), F.lit(2))
    replica = fixity.damaged(store, sign == "00", sign == "01")
    found = fixity.audit(fixity.tree(store, "fixity-a"), fixity.tree(replica, "fixity-b"))
    return found.select("page_id", "url", "n_bytes", "status")


ORACLES["op1_merkle_fixity"] = """
SELECT page_id, url,
       CAST(strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
            || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
            || html || chr(13) || chr(10) || chr(13) || chr(10)) AS BIGINT) AS n_bytes,
       CASE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) WHEN '00' THEN 'altered' ELSE 'missing' END AS status
FROM pages WHERE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) IN ('00', '01')
"""


@query
def op11_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    found = pieces.encode_texts(table(spark, sf_dir, "documents"), path, decoded=True)
    digests = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("ids", "decoded"))
    return found.select("doc_id", "n_tokens", *digests)


@query
def op12_centroid_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = tries.rebuilt(tries.turns_of(table(spark, sf_dir, "conversations")))
    return tries.prefix_trie(turns, convs)


ORACLES["op12_centroid_prefix_trie"] = oracle_sql.PREFIX_TRIE


@query
def op13_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents")))


ORACLES["op13_trie_pair_variants"] = oracle_sql.SPELLING_VARIANTS


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
