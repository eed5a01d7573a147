"""The query on benchmark leaks."""

from __future__ import annotations

from boutlens.llm import decontaminate
from boutlens.llm.queries import query, table


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
