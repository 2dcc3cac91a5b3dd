"""The fixture views of ``rampart.sources.tables`` as plain SQL (DuckDB dialect).

Used to build the oracle SQL of every registered query: ``with_fixtures("flows", "...")``
prefixes the needed fixture definitions as CTEs.
"""

from __future__ import annotations

# Fixture definitions (must stay equal to rampart.sources.tables).
FIXTURES: dict[str, str] = {
    "flows": """
SELECT event_id AS row_id,
       CASE WHEN event_type = 'view' THEN 'BENIGN' ELSE upper(event_type) END AS label,
       user_id % 5 AS org,
       value AS f_value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS f_k,
       CAST(hour(ts) AS DOUBLE) AS f_hour,
       CAST(7.0 AS DOUBLE) AS f_const
FROM events""",
    "dirty": """
SELECT event_id AS row_id,
       CASE WHEN event_id % 11 = 0 THEN concat(' ', event_type, ' ') ELSE event_type END AS label,
       CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN event_id % 89 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN event_id % 83 = 0 THEN NULL ELSE value END AS flow_bytes_s,
       CASE WHEN event_id % 79 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value * 2 END AS flow_packets_s,
       CASE WHEN event_id % 73 = 0 THEN -1.0e0 WHEN event_id % 71 = 0 THEN 0.0e0 ELSE value END AS flow_duration,
       CASE WHEN event_id % 61 = 0 THEN 'bad' ELSE CAST(CAST(event_id % 50 AS INT) AS VARCHAR) END AS raw_text
FROM events""",
    "wide_long": """
SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label_id,
       CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos,
       CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings""",
    "splits": """
SELECT doc_id AS row_id, text AS feats, lang AS label,
       CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split
FROM documents""",
    "bpreds": """
SELECT doc_id, quality AS y_true, toxic AS y_pred FROM labels""",
    "updates": """
SELECT label_id AS client_id, pos, avg(value) AS value FROM wide_long GROUP BY label_id, pos""",
    "clients": """
SELECT client_id, num_examples, train_loss,
       CAST(client_id < round_even(0.2 * count(*) OVER (), 0) AS INTEGER) AS malicious
FROM (SELECT CAST(label AS INTEGER) AS client_id, count(*) AS num_examples,
             avg(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 64.0) AS train_loss
      FROM embeddings GROUP BY label) c""",
    "global_params": """
SELECT pos, avg(value) AS value FROM wide_long GROUP BY pos""",
    "rounds": """
SELECT concat('run_', CAST(u8 AS VARCHAR)) AS run_name,
       CASE u4 WHEN 0 THEN 'fedavg' WHEN 1 THEN 'median' WHEN 2 THEN 'krum' ELSE 'multikrum' END AS aggregation,
       CASE WHEN u8 < 4 THEN 'none' ELSE 'label_flip' END AS attack,
       CASE WHEN u8 < 4 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS malicious_fraction,
       CAST(d - 1 AS INTEGER) AS round,
       CASE WHEN d = 1 THEN NULL ELSE 10 END AS clients,
       av / 500 AS f1, mx / 500 AS recall, mn / 500 AS fpr,
       av / 400 AS val_macro_f1, sm / 1000 AS agg_time_s,
       CAST(cnt * 512 AS BIGINT) AS bytes_up,
       CASE WHEN d = 1 THEN NULL WHEN u8 < 4 THEN 0 ELSE 2 END AS malicious_in_round,
       CASE WHEN d > 1 AND u4 >= 2 THEN CAST(cnt % 3 AS INTEGER) END AS malicious_kept,
       last_ts AS logged_at
FROM (SELECT user_id % 8 AS u8, CAST(user_id % 4 AS INTEGER) AS u4, day(ts) AS d,
             avg(value) AS av, max(value) AS mx, min(value) AS mn, sum(value) AS sm, count(*) AS cnt, max(ts) AS last_ts
      FROM events GROUP BY 1, 2, 3) g""",
}

# fixture -> fixtures it reads
DEPENDS = {"updates": ["wide_long"], "global_params": ["wide_long"]}


def with_fixtures(names: list[str] | str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with ``WITH`` definitions of the named fixtures (dependencies first)."""
    if isinstance(names, str):
        names = [names]
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURES[n]}\n)" for n in order]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body
