"""All queries and SQL twins of the subpackage."""

from boutlens.llm import queries_leaks, queries_manifest, queries_mixing, queries_pages, queries_repeats, queries_rows, queries_shards, queries_similar, queries_threads, queries_toxicity, queries_trie  # noqa: F401
from boutlens.llm.queries import ORACLES, QUERIES  # noqa: F401
