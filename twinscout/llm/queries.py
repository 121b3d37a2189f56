"""The registered queries of the subpackage: each applies one operator to a whole table with
production parameters and derives the columns its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscout.llm import bpe, conversations, exact_dedup, line_dedup, merkle, mixing, packing, quality, secrets, simhash, token_files, toxicity, url_filter
from twinscout.llm.common import table
from twinscout.sources.shared import new_shared_path

REGISTRY = {}


def registered(function):
    REGISTRY[function.__name__] = function
    return function


def held_out() -> Column:
    """Rows whose labels are never learned from; a null id, which no label names, is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@registered
def op1_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, shingle=3, radius=3, parts=3, words=1, total=None)
    fingerprint = F.lpad(F.lower(F.hex("f0")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


@registered
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


#: The URL rules of the contract, as (verdict, host and path).
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@registered
def op3_url_filter(spark, sf_dir):
    """Labels of a page are those of the document of its number: bad if toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("blocked"))
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@registered
def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@registered
def op5_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of_kind(kind: str) -> Column:
        return F.filter("secrets", lambda span: span.kind == kind)

    all_base = F.filter("secrets", lambda s: s.order < len(secrets.BASE_RULES))
    return found.select(
        "doc_id",
        *[F.size(of_kind(rule.kind)).cast("bigint").alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES],
        F.sha2(secrets.spans_text(all_base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")).alias("spans"),
    )


@registered
def op6_token_files(spark, sf_dir):
    folder = new_shared_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, folder, shards)


@registered
def op7_exact_dedup(spark, sf_dir):
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@registered
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@registered
def op9_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *quality.METRICS, "base_failed", "kept")


@registered
def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.take(docs).select("doc_id", "size", "source_size", "target", "taken")


@registered
def op11_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", "n_tokens", F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@registered
def op12_merkle(spark, sf_dir):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


def damaged(turns):
    """Conversations as a careless crawl leaves them, by the CRC of ``conv_id:turn`` (nulls: one space)."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(named.cast("binary")), F.lit(20)).cast("int")
    text = F.coalesce("text", space)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        text.alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


@registered
def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    report, repaired = conversations.repair(damaged(turns))
    every = turns.select("conv_id").distinct()
    found = conversations.transcript_digests(repaired)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One row per conversation and side; an aggregate joins null ids too.
    both = every.unionByName(report, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    joined = both.groupBy("conv_id").agg(*[F.max(name).alias(name) for name in [*counts, "audit", "repaired_sha256"]])
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(
        "conv_id", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts],
        *[F.coalesce(name, value).alias(name) for name, value in nothing.items()],
    )
