"""The query on web pages."""

from __future__ import annotations

from boutlens.llm import pages
from boutlens.llm.queries import query, table


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(rows, pages.fit(rows)).select("page_id", "url", "text", "n_chars")
