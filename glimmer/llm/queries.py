"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from .bpe import DEFAULT_FILE, Vocabulary, encode_decode_digests

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode_digests(docs, Vocabulary.load(DEFAULT_FILE())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@_query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by two-word shingles, with the component of every document."""
    from .minhash import near_duplicates

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line deduplication: its lines left and a digest of its text."""
    from .linededup import deduplicate_lines

    out = deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@_query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and statements of every document."""
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation as canonical JSON, with its calls linked, checked and in order."""
    from .derived import with_tools
    from .toolcalls import TOOLS, format_chats

    return format_chats(with_tools(_table(spark, sf_dir, "conversations")), TOOLS)


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated so that every source weighs the same, shuffled."""
    from .mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_copy").alias("copy"), "source", F.col("_shuffle").alias("shuffle_key"), "text")


@_query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others."""
    from .ann import search

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@_query
def op10_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    from .embeddup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    from .langid import fit, held_out, predict

    docs = _table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document, and whether it is kept."""
    from .quality import KEEP, fit, grades_of, rate

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades_of(_table(spark, sf_dir, "labels")))
    last = F.element_at("tails", -1)
    return rate(docs, model).select("doc_id", "expected_grade", F.element_at("tails", 1).alias("p_1"), last.alias("p_best"), (last >= KEEP).alias("kept"))


@_query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which are made to repeat themselves."""
    from .derived import with_repeats
    from .periodic import digests, find_runs

    return digests(find_runs(with_repeats(_table(spark, sf_dir, "documents"))))


@_query
def op12_suffixdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that a document with a smaller id holds, as numbers and a digest."""
    from .suffixdup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=50)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", (F.length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of each language is from the others, and by which terms from its language."""
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def _oracles() -> None:
    from . import derived, divergence, mixing, oracles

    LLM_ORACLES["op6_minhash"] = oracles.MINHASH
    LLM_ORACLES["op7_linededup"] = oracles.LINES
    LLM_ORACLES["op8_toolcalls"] = derived.ORACLE
    LLM_ORACLES["op9_mixing"] = mixing.ORACLE
    LLM_ORACLES["op10_embeddup"] = oracles.EMBEDDINGS
    LLM_ORACLES["op11_periodic"] = derived.REPEATS_ORACLE
    LLM_ORACLES["op12_suffixdup"] = oracles.REPEATS
    LLM_ORACLES["op13_divergence"] = divergence.ORACLE


_oracles()
