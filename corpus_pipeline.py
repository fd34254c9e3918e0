"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Nothing of the result can be written as SQL (n-gram
models, fingerprints, rolling hashes, token ids), so ORACLE_SQL is None and the stages are tested against brute force.

1. language: documents without a recognised language go (no letter, or no codeword near).
2. near_dedup: of documents linked by a Jaccard similarity of 0.8 or more of their sets of 5-word shingles, the one of the
   smallest doc_id stays.
3. substring_dedup: repeated passages are cut out of the text, all but their first occurrence; documents stay.
4. secrets: found spans are masked in the text; documents stay.
5. packing: the texts that are left as sequences of token ids; one row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plusminus.llm import language, packing, secrets, simhash, substring_dedup
from plusminus.llm.common import saved

#: Near duplicates: five-word shingles and a similarity of 0.8 or more. Candidates are pairs within RADIUS of 256 bits: at
#: a Jaccard similarity of 0.8 they differ by 39 on average (standard deviation 6; up to 48 for texts of four or five
#: shingles), unrelated ones by 128 (8). Each candidate's similarity is then computed from its sets of shingles.
SHINGLE, WORDS64, RADIUS, SIMILAR = 5, 4, 72, (4, 5)
MASK = "[secret]"
#: Python workers outlive a stage: packing remembers words, a few MB of them, for the length of a task alone.
KEPT_WORDS = 4 << 20


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a null or empty text has none. The model learns from docs itself.

    Repeated rows share one answer; where no row has a label, no language is known and every document goes. An empty table
    stays empty. All columns stay as they are.
    """
    return language.recognised(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of the smallest doc_id, and of equal ids the first in the files.

    A null doc_id comes last. Null, empty and blank texts are one group. A document in no group stays. An empty table
    stays empty. All columns stay as they are.
    """
    return simhash.one_of_each(docs, SHINGLE, RADIUS, WORDS64, similar=SIMILAR)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; of equal texts the one of the smallest doc_id keeps them.

    A null text stays null, and a text that is a repeat as a whole becomes empty. An empty table stays empty. Other columns
    stay as they are.
    """
    return substring_dedup.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with MASK in place of each span that holds a secret; overlapping spans get one.

    Null and empty texts stay as they are, and repeated rows are masked alike. An empty table stays empty. Other columns
    stay as they are.
    """
    return secrets.masked(docs, MASK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence; a null or empty text is the end id alone.

    Repeated rows are packed each on its own. An empty table gives no rows.
    """
    return packing.pack(docs, kept=KEPT_WORDS, forgets=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_dedup", near_dedup),
    ("substring_dedup", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
