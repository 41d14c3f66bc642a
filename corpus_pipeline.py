"""The corpus pipeline: documents through five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, decontam, langid, lines, setjoin
from siftline.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is surer than this stay; ``und`` never does.
SURE = 0.5


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no or an unsure language; lang becomes the predicted one.

    Null and empty texts and texts without a letter have no language and go. Rows
    are judged one by one, so repeated ids and null ids don't matter; an empty
    table, or one without any lang to learn from, gives no rows.
    """
    model = langid.fit(docs)
    kept = langid.identify(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; all documents stay, null and empty texts as they are.

    Null ids come first in the order of occurrences; rows that agree in id and
    text keep the same lines.
    """
    return _columns(lines.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates (five words, 0.8): that of the smallest id, null ids last.

    Rows are told apart by id and text: of rows with one id only those that are
    linked go, and of rows that agree in both one stays. Null and empty texts are
    linked with nothing and stay.
    """
    return _columns(setjoin.one_of_each(docs, 5, 0.8))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item; other rows of the same id, null and empty texts stay."""
    return _columns(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row left; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.digests(docs, bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: Language ID, the join's components and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
