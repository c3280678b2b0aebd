"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Each stage works on all that the one before kept. ``run`` writes each stage's rows as Parquet in the
shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, jaccard, mixing, queries, secrets
from tallyspark.llm import quality as rules
from tallyspark.llm.sample import read
from tallyspark.llm.store import kept
from tallyspark.session import prepared

#: SQL can't express a trained model's verdicts, so the stages are tested against brute force.
ORACLE_SQL = None
REDACTED = "[SECRET]"
#: Ids up to this many (some 16 bytes each) are sent to all tasks.
FEW = 2_000_000


def _quoted(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """``apart`` as columns of their own, all others in one struct, so that no name clashes with what an operator adds."""
    never = "_" * (1 + max([0, *map(len, docs.columns)]))  # a struct needs a field; this one has a name that no column has
    return docs.select(*apart, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in apart], F.lit(0).alias(never)).alias("__row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them ``new``."""
    return rows.select(*[new.get(c, F.col(c) if c in rows.columns and c in ("doc_id", "text", "lang", "source") else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns; the model learns from the labelled ones among ``docs``.

    Null, empty and blank texts have no words and go. Each row is judged by its text alone, so
    repeated rows stay or go together, null ids no less. Without labels every line is content and the counts decide. An
    empty table stays one. Columns may have any names.
    """
    model = rules.train(docs, read(prepared(spark), sf_dir, "labels"))
    rows = _packed(docs, "doc_id", "text")
    return _unpacked(rules.quality(rows, model, carry=("text", "__row")).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest id.

    Of rows that share an id one stays: the first by its columns as JSON text (equal rows are one).
    Rows of null id all stay, as do empty and null texts, which link with nothing. Ids that go are sent to all
    tasks if they are few, so that texts aren't shuffled; else the tables are joined by shuffle.
    """
    prepared(spark)
    found = kept(jaccard.join(docs))
    sent = lambda ids: F.broadcast(ids) if ids.count() <= FEW else ids
    out = docs.join(sent(kept(found.where("doc_id <> component_id").select("doc_id").distinct())), "doc_id", "left_anti").select(*_quoted(docs))
    twice = kept(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if twice.isEmpty():
        return out
    twice = sent(twice)
    row = F.struct(*_quoted(docs))
    one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return out.join(twice, "doc_id", "left_anti").select(*_quoted(docs)).unionByName(one)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars to match.

    Null and empty texts stay as they are, and so does n_chars of texts without a secret. Formats are
    learned from ``docs``; an empty table stays one. Columns may have any names.
    """
    prepared(spark)
    found = secrets.spans(_packed(docs, "doc_id", "text"), secrets.learn(docs), redact=REDACTED, carry=("__row",))
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans") != "", F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return _unpacked(found, docs, **new)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, by domain, language and source; no document twice.

    Documents without words go. Null languages and sources are leaves of their own. Wholly equal rows
    stay or go together. Columns may have any names.
    """
    levels, weights = queries.tree()
    rows = _packed(docs, "doc_id", "text", "lang", "source").withColumnRenamed("__row", "row")
    return _unpacked(mixing.mix(rows, levels, weights, share=0.8, epochs=1).withColumnRenamed("row", "__row"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the decoded text, and whether decoding gave the text back, for each row; null and empty texts have no tokens."""
    prepared(spark)
    return bpe.round_trip(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("no_secrets", no_secrets), ("mixture", mixture), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on the rows of the one before, read back from the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
