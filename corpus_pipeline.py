"""Corpus pipeline: toxicity, language, exact copies, near copies, packing. Each stage is written and read again.

Every stage takes an empty table, nulls in any column, texts of any length and extra columns whatever their names; what it
makes of them stands at the stage. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import op06_language_id as language
from larder.llm import op10_toxicity as toxicity
from larder.llm.common import stored, table
from larder.llm.op02_stream_dedup import distinct_documents
from larder.llm.op07_packing import pack, token_pieces
from larder.llm.op09_minhash import near_duplicates

#: From this score on a document goes; the lowest share of the belief at which a language counts as told; Jaccard, percent.
TOXIC, TOLD, NEAR = 0.3, 0.5, 80


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many `_` before it as keep it from being one of docs' columns."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC by a model of this input's labels.

    A null or empty text scores by the intercept alone and stays where most labelled texts are clean; without labels all
    stay. Repeated rows are judged alike, each on its own; a null id is judged, and not learned from.
    """
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), _free(docs, "toxic_score")
    return toxicity.scores(docs, model, *docs.columns, into=score).filter(F.col(score) < TOXIC).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and whose language is told with a share of at least TOLD. `lang` becomes the language
    told, so a null or wrong one is mended and later stages and readers can rely on it.

    A null text, one without letters, and one torn between languages go; so does everything if no row has a lang to learn
    from. A tie goes to the first language by name. Repeated rows are judged alike, each on its own; a null id is judged, and
    not learned from once the table exceeds the model's sample.
    """
    name, share = _free(docs, "lang_told"), _free(docs, "lang_share")
    told = language.predictions(docs, language.fit(docs), *docs.columns, into=(name, share))
    known = told.filter((F.col(name) != "und") & (F.col(share) >= TOLD))
    return known.withColumn("lang", F.col(name)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that is equal without white space: the one of most code points, then smallest id.

    Null and empty texts are copies of each other. Of rows repeated whole one stays. A null id comes after all others.
    """
    return distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, linked by steps of NEAR percent or more.

    A text without words is linked with nothing and stays. Rows of one id are one document, judged by its smallest text, and
    stay or go together. A row without id can't be named in a group and stays.
    """
    gone = near_duplicates(docs, NEAR).filter("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096: every row of docs, a null text as its end id alone, a long one cut,
    a null id kept, repeated rows each on their own; other columns are not read."""
    import public_tokenizers

    pieces = stored(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", packed),
]

#: Trained models, MinHash and packing are beyond SQL; tests/llm/test_queries.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
