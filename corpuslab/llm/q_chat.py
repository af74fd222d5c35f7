"""op5: formatted conversations, read back from the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat
from .registry import query, table

CONFLICT = "</s>[INST] ok [/INST]"


@query("op5_chat_format")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))
