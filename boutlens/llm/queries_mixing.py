"""The query on mixing sources."""

from __future__ import annotations

from boutlens.llm import mixing
from boutlens.llm.queries import query, table


@query("op9_source_mixing")
def op9_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
