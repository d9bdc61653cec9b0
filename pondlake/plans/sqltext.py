"""Shared DuckDB SQL fragments for the oracle texts (fixture shapes as CTEs)."""

# E: events as readings.
E = """readings AS (
  SELECT event_type AS pond_id, ts AS created_at, event_id AS entry_id, value,
         try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k
  FROM events)"""

# E with positions and pond length.
E_POS = E + """,
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY pond_id ORDER BY created_at, entry_id) - 1 AS pos,
         count(*) OVER (PARTITION BY pond_id) AS n_rows
  FROM readings)"""


def e_cursor(tick: int, size: int = 100, horizon: int = 10) -> str:
    """E positions with the window start at ``tick`` for ponds long enough."""
    return E_POS + f""",
cursored AS (
  SELECT *, {tick} % (n_rows - {size + horizon - 1}) AS start
  FROM positioned WHERE n_rows >= {size + horizon})"""


def e_halves(n: int) -> str:
    h = (n + 1) // 2
    return E + f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pond_id
                               ORDER BY created_at DESC NULLS FIRST, entry_id DESC NULLS LAST) AS rn
  FROM readings),
halves AS (
  SELECT *, CASE WHEN rn <= {h} THEN 'current' ELSE 'reference' END AS half
  FROM ranked WHERE rn <= {n})"""


def psi_ctes(columns: list[str]) -> str:
    """CTEs ``long .. psi`` over a ``halves`` CTE (see operators.drift)."""
    long = "\n  UNION ALL ".join(
        f"SELECT pond_id, half, '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM halves"
        for c in columns)
    return f""",
long AS (
  {long}),
stats AS (
  SELECT pond_id, column_name, min(x) AS mn, max(x) AS mx, count(x) AS n,
         count(CASE WHEN half = 'current' THEN x END) AS n_current,
         count(CASE WHEN half = 'reference' THEN x END) AS n_reference,
         CASE WHEN count(x) > 0 THEN CAST(ceil(log2(count(x)) + 1) AS BIGINT) END AS bins
  FROM long GROUP BY pond_id, column_name),
binned AS (
  SELECT l.pond_id, l.column_name, l.half, s.n_current, s.n_reference, s.bins,
         CASE WHEN l.x IS NULL THEN NULL
              WHEN s.mx > s.mn THEN least(CAST(floor((l.x - s.mn) / (s.mx - s.mn) * s.bins) AS BIGINT),
                                          s.bins - 1)
              ELSE 0 END AS bin
  FROM long l JOIN stats s ON l.pond_id IS NOT DISTINCT FROM s.pond_id AND l.column_name = s.column_name),
per_bin AS (
  SELECT pond_id, column_name, n_current, n_reference, bins, bin,
         count(CASE WHEN half = 'current' THEN 1 END) AS c_cur,
         count(CASE WHEN half = 'reference' THEN 1 END) AS c_ref
  FROM binned GROUP BY pond_id, column_name, n_current, n_reference, bins, bin),
shares AS (
  SELECT *, greatest(c_ref / n_reference, 1e-4) AS rs, greatest(c_cur / n_current, 1e-4) AS cs
  FROM per_bin),
psi AS (
  SELECT pond_id, column_name, n_current, n_reference, bins,
         CAST(CASE WHEN n_current = 0 OR n_reference = 0 THEN NULL
              ELSE round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN (rs - cs) * ln(rs / cs) END),
                                  0.0), 9) END AS DOUBLE) AS psi
  FROM shares GROUP BY pond_id, column_name, n_current, n_reference, bins)"""


def report_ctes(columns: list[str], col_t: float = 0.25, cutoff: float = 0.3,
                share: float = 0.5) -> str:
    """CTEs ``tests``, ``drifted``, ``verdict``, ``report`` over a ``psi`` CTE."""
    order = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(columns))
    return f""",
tests AS (
  SELECT pond_id, column_name, psi, CAST({col_t} AS DOUBLE) AS threshold,
         CASE WHEN psi IS NULL THEN 'INSUFFICIENT' WHEN psi < {col_t} THEN 'PASS' ELSE 'FAIL' END
           AS status
  FROM psi),
drifted AS (
  SELECT pond_id, count(*) AS n_columns, count(CASE WHEN psi >= {cutoff} THEN 1 END) AS n_drifted,
         round(count(CASE WHEN psi >= {cutoff} THEN 1 END) / count(*), 9) AS share
  FROM psi GROUP BY pond_id),
verdict AS (
  SELECT *, share >= {share} AS drift, CASE WHEN share >= {share} THEN 'FAIL' ELSE 'PASS' END AS status
  FROM drifted),
report AS (
  SELECT pond_id, 0 AS test_order, 'drifted_columns_share' AS metric,
         CAST(NULL AS VARCHAR) AS column_name, CAST(share AS DOUBLE) AS value,
         CAST({share} AS DOUBLE) AS threshold, status
  FROM verdict
  UNION ALL
  SELECT pond_id, CASE column_name {order} END AS test_order, 'psi' AS metric, column_name,
         psi AS value, threshold, status
  FROM tests)"""
