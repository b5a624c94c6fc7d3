"""Documents to tokens: toxic documents out, one of each near-duplicate group, repeats cut, a mixture taken, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm import bpe, chosenpath, mixing, suffixes, toxicity
from corpusql.llm.learning import held_out
from corpusql.llm.queries import LEVELS, WEIGHTS, tokenizer
from corpusql.session import load, materialize

MIX_SEED = 29
MIX_SHARE = (9, 10)
# A passage of over 50 words has more bytes than this, unless its words are very short.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labels that learning may see; the rest is untouched."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    gone = chosenpath.join(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` bytes or more that stand elsewhere too are cut out; n_chars follows. No row goes, even if nothing is left of it."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    own = [f"column_{i}" for i in range(len(others))]  # so that no extra column has the name of a result
    plain = docs.select("doc_id", "text", *[F.col(c).alias(o) for c, o in zip(others, own)])
    cut = suffixes.remove_repeats(plain, min_bytes=PASSAGE_BYTES, keep=own, as_text=True)
    count = F.length("kept").cast(docs.schema["n_chars"].dataType)
    back = cut.select("doc_id", F.col("kept").alias("text"), count.alias("n_chars"), *[F.col(o).alias(c) for c, o in zip(others, own)])
    return back.select(*docs.columns)


def take_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by domain, language and source weights, one epoch at most; texts as they are."""
    return mixing.select(docs, LEVELS, WEIGHTS, MIX_SHARE, max_epochs=1, seed=MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    import public_tokenizers

    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", take_mixture),
    ("tokens", encode),
]

# Classifiers, set joins and suffix arrays are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
