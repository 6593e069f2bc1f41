"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again for the next, and deletes what only the stages need.
The last stage returns the packing.

Defined results: null texts count as empty, are never toxic or contaminated, and one of them stays; null
doc_ids take part and give way to others; rows that repeat doc_id and text end up as one; an empty
table gives an empty result in each stage; further columns, whatever their names, pass
unchanged up to the packing, which leaves them behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table, work
from tessera.llm.decontaminate import decontamination_stage
from tessera.llm.exact_dedup import dedup_stage
from tessera.llm.near_dup import near_dup_stage
from tessera.llm.packing import pack_stage
from tessera.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", dedup_stage),
    ("ngram_jaccard", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", pack_stage),
]

#: Fitted scores and a genetic search are not SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with work(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
