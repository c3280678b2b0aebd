"""The ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, interactions, jaccard, mixing, mpegts, packed, pieces, ppm, quality, secrets, suffixes, toxicity, tries
from .sample import crc_of_id, read

#: A folder with the public tokenizers' files, in place of the installed package's.
TOKENIZERS = os.environ.get("TALLYSPARK_TOKENIZERS")


def tokenizer(name: str) -> str:
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else str(public_tokenizers.path(name))


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a transport stream of its own, read back: payload and stream digests, counts and time stamps."""
    return mpegts.digests(mpegts.transport_streams(read(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine fitted on labelled ones that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_of_id(5) != 0)
    return toxicity.toxicity(docs, machine).select("doc_id", (crc_of_id(5) == 0).alias("held_out"), "score", "predicted", "n_terms")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of all documents under contexts of those that train, beside the token baseline."""
    out = ppm.score(read(spark, sf_dir, "documents"), crc_of_id(10) != 0)
    return out.select("doc_id", (crc_of_id(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts decoded from them, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, by the fixed patterns and the formats inferred from what they find."""
    docs = read(spark, sf_dir, "documents")
    return secrets.spans(docs, secrets.learn(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_auto", "n_scored", "n_likely")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts of all documents and the verdict of the line labels."""
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op7_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match pieces of all documents' words. The vocabulary is a byte-level list, which has no form of its own for word continuations: a piece is cut alike at a word's start (led in by a blank) and inside it."""
    return pieces.piece_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def tree() -> tuple[dict[str, Column], dict[str, Column]]:
    """Levels and weights of the mix of ``documents``: four domains, dealt by the number in the source's name and wanted alike; English three times as much as another language; sources alike."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d+)$", 1), F.lit("999999999"))
    levels = {"domain": F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("int").cast("string")), "lang": F.col("lang"), "source": F.col("source")}
    return levels, {"domain": F.lit(1), "lang": F.when(F.col("mix_lang") == "en", 3).otherwise(1), "source": F.lit(1)}


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mix by domain, language and source, with how often each is taken."""
    levels, weights = tree()
    mixed = mixing.mix(read(spark, sf_dir, "documents"), levels, weights, share=0.8, epochs=3)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each document's shingle set and the least id that it is tied to by links."""
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the bytes that a repeated 200-byte string covers."""
    return suffixes.dedup(read(spark, sf_dir, "documents"))


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into files in the order of doc_id and read back from them."""
    return packed.read_back(packed.write(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that those of a group of five share first turns."""
    return tries.rebuilt_trie(read(spark, sf_dir, "conversations"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove from each source at every step of all their 120 orders."""
    return interactions.audit(interactions.flags(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), list("ABCDE"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_transport_streams, op2_toxicity, op3_ppm, op4_bpe, op5_secrets, op6_quality, op7_word_pieces, op8_mixture, op9_ngram_jaccard, op10_suffix_dedup, op11_packed_ids, op12_prefix_trie, op13_filter_interactions)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The mixture, the trie and the audit of filters; the others can't be put in SQL as a whole, and tests/llm holds them against brute force."""
    levels = {"domain": r"'domain' || (try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4)", "lang": "lang", "source": "source"}
    weights = {"domain": "1", "lang": "CASE WHEN mix_lang = 'en' THEN 3 ELSE 1 END", "source": "1"}
    mixed = mixing.mix_sql(("doc_id", "text", "lang", "source", "n_chars"), levels, weights, share=0.8, epochs=3)
    return {"op8_mixture": f"{mixed}\nSELECT doc_id, mix_domain AS domain, mix_lang AS lang, mix_source AS source, mix_tokens AS n_tokens, mix_copies AS copies FROM mixed", "op12_prefix_trie": tries.trie_sql(), "op13_filter_interactions": interactions.audit_sql()}
