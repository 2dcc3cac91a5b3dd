"""Small SQL snippets shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations


def key(id_expr: str, seed) -> str:
    """md5 sampling key, same text as ``rampart.functions.scalar.hash_key``."""
    return f"md5(CAST({id_expr} AS VARCHAR) || ':{seed}')"


def unit_of(md5_expr: str) -> str:
    """Uniform [0, 1) value from the first 60 bits of a hex md5."""
    return f"(CAST(CAST(('0x' || substr({md5_expr}, 1, 15)) AS BIGINT) AS DOUBLE) / 1152921504606846976.0e0)"


# label map + encoded flows, shared by several families
LABEL_MAP = ("lm", """SELECT label, CAST(CASE WHEN upper(label) = 'BENIGN' THEN 0 ELSE row_number() OVER (ORDER BY upper(label) <> 'BENIGN', label)
  - count(*) FILTER (WHERE upper(label) = 'BENIGN') OVER ()
  - CASE WHEN count(*) FILTER (WHERE upper(label) = 'BENIGN') OVER () = 0 THEN 1 ELSE 0 END END AS INTEGER) AS label_id
FROM (SELECT DISTINCT trim(label) AS label FROM flows) d""")
FLOWS_ENC = ("fl", """SELECT f.*, lm.label_id FROM flows f JOIN lm ON trim(f.label) = lm.label""")
