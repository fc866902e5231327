"""The corpus pipeline: documents in, packed sequences out, one operator a stage.

Every stage takes all documents that the one before it kept. Null texts count as empty; an
empty table stays empty, but the first stage needs labelled rows of both kinds to learn from.
Columns besides ``doc_id`` and ``text`` travel as one, whatever their names, so none can clash with a column that an operator makes.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard, packing, quality, secret_scan
from tablewright.llm.chunks import small_batches
from tablewright.llm.queries import tokenizer_path
from tablewright.scratch import written


def _held(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and all other columns in one."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def _given(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``_held`` was given, in their order."""
    return frame.select(*[c if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3; labels of held-out ids are not learned from."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality.fit_quality(docs, learned)
    return _given(quality.score_quality(_held(docs), model).where(F.col("score") >= 0.3), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by three quarters of their five-word shingles, the one with the smallest id.

    Rows that repeat an id and a text are one document. Rows with a null id stay.
    """
    keyed = _held(docs).withColumn("_text_hash", F.xxhash64("text"))
    groups = jaccard.jaccard_components(keyed, keep=["_text_hash"])
    others = groups.where("component_id < doc_id").select("doc_id", "_text_hash").distinct()
    # Each task keeps one row of a document before the shuffle, and the join below needs no other.
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy("_text_hash"))
    once = keyed.withColumn("_nth", nth).where("_nth = 1")
    return _given(once.join(others, ["doc_id", "_text_hash"], "left_anti"), docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a fifth of its words edited."""
    kept = decontaminate.drop_contaminated(_held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _given(kept, docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and the number of characters brought up to date."""
    found = secret_scan.scan_secrets(_held(docs))
    text = secret_scan.mask_spans(F.coalesce("text", F.lit("")), F.col("spans"))
    masked = _given(found.withColumn("text", text), docs.columns)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with the sequence and the place each gets."""
    pieces = packing.tokenized_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)
    return packing.pack(pieces, max_tokens=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, a similarity join and a packing have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
