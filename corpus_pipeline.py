"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage works on all rows that the one before it kept, in tables of the shared folder, so that a lost executor costs a task and not a stage.

Defined cases are those of the stages. Put together: a null text passes four stages and has no piece in the last; an empty one is a piece of its
separator; texts of any length are read whole; rows repeated in full become one at the third stage, and documents read several times from the fourth
on are packed as often. Documents with a null doc_id keep their lines and come after all others. Without labels nothing is rejected. Other columns,
of whatever name, pass the first four stages unchanged. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.core import shared_dir, table
from lexweave.llm.linededup import without_duplicates
from lexweave.llm.mixing import mixed
from lexweave.llm.packing import packed
from lexweave.llm.quality import keep_good
from lexweave.llm.simhash import near_dedup

STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", without_duplicates),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
