"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .sharding import BLOCKS, Leaf, balanced, children, grown

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
j AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM j)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _nearest(key: str, kids: dict[str, float]) -> str:
    """The child with the smallest draw."""
    draws = {c: f"(-ln((CAST('0x' || substr(md5({key} || '|{c}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {w!r})" for c, w in kids.items()}
    if len(draws) == 1:
        return f"'{next(iter(draws))}'"
    least = "least(" + ", ".join(draws.values()) + ")"
    return f"CASE {least} " + " ".join(f"WHEN {d} THEN '{c}'" for c, d in draws.items()) + " END"


def _levels(tree: list[Leaf], name: str) -> tuple[str, str, str, str]:
    """Expressions for region, rack, leaf and shard number, each from the one before."""
    top, racks, leaves = children(tree)

    def below(parent: str, table: dict) -> str:
        return f"CASE {parent} " + " ".join(f"WHEN '{p}' THEN {_nearest('k', kids)}" for p, kids in table.items()) + " END"

    number = f"CASE {name}_leaf " + " ".join(f"WHEN '{x.path()[2]}' THEN {x.shard}" for x in tree) + " END"
    return _nearest("k", top[""]), below(f"{name}_region", racks), below(f"{name}_rack", leaves), number


def sharding_sql(shards: int = 16) -> str:
    a, b = _levels(balanced(shards), "a"), _levels(grown(balanced(shards)), "b")
    crc = "list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1]))"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null key') AS k, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS tie,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
l1 AS (SELECT *, {a[0]} AS a_region, {b[0]} AS b_region FROM d),
l2 AS (SELECT *, {a[1]} AS a_rack, {b[1]} AS b_rack FROM l1),
l3 AS (SELECT *, {a[2]} AS a_leaf, {b[2]} AS b_leaf FROM l2),
s AS (SELECT doc_id, tie, size, bytes, CAST({a[3]} AS INTEGER) AS shard, CAST({b[3]} AS INTEGER) AS grown_shard,
  CAST('0x' || substr(md5(k || '|' || tie), 1, 8) AS BIGINT) % {BLOCKS} AS block FROM l3)
SELECT doc_id, size, CAST(xor({crc}, 4294967295) AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, tie) - 1 AS slot, grown_shard FROM s, t"""


SHARDING = sharding_sql()
