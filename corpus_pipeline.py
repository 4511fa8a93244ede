"""A training corpus from raw documents, in five stages.

Every stage gets what the one before kept, as a table, and returns the columns of documents;
the last returns the encoded texts. Stages keep clean documents: only toxic documents,
all but one of each group of near copies, and texts that are mostly benchmark items go.

Defined results: a null text stays null through all stages and has no ids; an empty or wordless
text stays and is nobody's copy; of rows that repeat (id and text) one stays, as of other near
copies; texts of any length are read whole; invalid UTF-8 stays as it is until a secret in the
text is hidden, which makes it U+FFFD, and encodes as U+FFFD; further columns are carried to
the last stage whatever their names; an empty table gives an empty result. Without labels no
text is toxic, without a benchmark none is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkline.llm import decontam, jaccard, pieces, secrets, toxicity
from arkline.llm.columns import set_aside
from arkline.llm.workspace import Workspace

#: A text goes whole if more than this share of its words is benchmark text.
MAX_COVERAGE = 0.5
_open: list[Workspace] = []


def _small_batches(spark: SparkSession) -> None:
    """The pipeline's own setting for its session: what Python workers and Arrow buffers hold at once stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _space(spark: SparkSession, label: str) -> Workspace:
    """A workspace for one stage; those of stages before, whose results are written by now, end."""
    while _open:
        _open.pop().release()
    _open.append(Workspace(spark, label))
    return _open[-1]


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_chars again for texts that have changed in length."""
    if "n_chars" not in before.columns:
        return after
    return after.withColumn("n_chars", F.coalesce(F.length("text").cast(before.schema["n_chars"].dataType), F.col("n_chars"))).select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rest, own = set_aside(docs, ["score", "threshold"])
    scored = toxicity.score(rest, model)
    return own(scored.where(F.col("score") < F.col("threshold")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, _space(spark, "pipeline-join"))


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _counted(docs, decontam.decontaminate(docs, benchmark, max_coverage=MAX_COVERAGE))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    space = _space(spark, "pipeline-secrets")
    return _counted(docs, secrets.redact(docs, secrets.Ledger(spark, space.subdir("ledger")), space))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.default_model()).select("doc_id", "n_ids", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmarks),
    ("secrets", hide_secrets),
    ("encoding", encode),
]

#: The first stage's trained classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    space = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir))
        if before is not None:  # a stage's table goes when the next one is written
            space.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
