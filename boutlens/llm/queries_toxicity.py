"""The query on toxicity."""

from __future__ import annotations

from boutlens.llm import toxicity
from boutlens.llm.queries import F, query, table


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select("doc_id", (~toxicity.in_training()).alias("held_out"), "score", predicted.alias("predicted"), "threshold", F.col("toxic").alias("toxic_by_language"))
