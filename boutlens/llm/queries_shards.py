"""The query on shards."""

from __future__ import annotations

from boutlens.llm import shards
from boutlens.llm.queries import CRC_TABLE, query, table

SHARDS = 8


def _pick(tree: shards.Tree) -> str:
    """The shard as nested CASE expressions of one draw per child."""
    below = shards.children(tree)
    size = float(16**shards.DIGITS)

    def at(node: str) -> str:
        if node not in below:
            return node.rsplit("/", 1)[1]
        draws = {p: f"(-ln((('0x' || substr(md5(key || '|{p}'), 1, {shards.DIGITS}))::BIGINT + 0.5::DOUBLE) / {size!r}::DOUBLE) / {w!r}::DOUBLE)" for p, w in below[node].items()}
        if len(draws) == 1:
            return at(next(iter(draws)))
        least = f"least({', '.join(draws.values())})"
        return f"CASE {least} {' '.join(f'WHEN {d} THEN {at(p)}' for p, d in draws.items())} END"

    return at("")


SHARDS_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '-') AS key, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
      ({_pick(shards.layout(SHARDS))})::INTEGER AS shard, ({_pick(shards.layout(SHARDS + 1))})::INTEGER AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


@query("op13_sharding", SHARDS_SQL)
def op13_sharding(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents"), shards.layout(SHARDS), shards.layout(SHARDS + 1))
