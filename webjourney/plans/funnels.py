"""Registered funnel reports."""

from __future__ import annotations

from webjourney.config import DEFAULT_FUNNELS
from webjourney.operators import funnels as f
from webjourney.plans.registry import query

DEMO = DEFAULT_FUNNELS[0]


def _page(path: str, key: str = "uid", src: str = "visits") -> str:
    return f"SELECT {key} AS k, min(ts) AS t FROM {src} WHERE path ILIKE '{path}%' GROUP BY 1"


def _form(path: str, key: str = "uid", noise: bool = True) -> str:
    clean = ("AND data NOT LIKE '%timingsV2%' AND data NOT LIKE '%memory.totalJSHeapSize%' "
             "AND data NOT LIKE '%eventType%'") if noise else ""
    return (f"SELECT {key} AS k, min(ts) AS t FROM ve WHERE event_type = 'form_submit' "
            f"AND path ILIKE '{path}%' {clean} GROUP BY 1")


def _summary_sql() -> tuple[str, list[str]]:
    ctes, rows = [], []
    for i, fn in enumerate(DEFAULT_FUNNELS):
        for j, s in enumerate(fn.steps):
            ctes.append(f"s{i}_{j} AS ({_page(s.path) if s.type == 'page' else _form(s.path)})")
            src = f"r{i}_{j}"
            if j == 0:
                ctes.append(f"{src} AS (SELECT k, t FROM s{i}_0)")
            else:
                ctes.append(f"{src} AS (SELECT c.k, c.t FROM r{i}_{j - 1} p JOIN s{i}_{j} c ON c.k = p.k AND c.t >= p.t)")
            n, prev, first = f"(SELECT count(*) FROM {src})", f"(SELECT count(*) FROM r{i}_{j - 1})", f"(SELECT count(*) FROM r{i}_0)"
            rate = f"round(100.0 * {n} / {prev}, 2)::DOUBLE" if j else "NULL::DOUBLE"
            drop = f"greatest({prev} - {n}, 0)" if j else "NULL::BIGINT"
            rows.append(
                f"SELECT '{fn.key}' AS funnel_key, '{fn.label}' AS funnel_label, {j + 1}::BIGINT AS step, "
                f"'{s.label}' AS step_label, {n} AS users, {rate} AS rate, {drop} AS dropoff_count, "
                f"round(100.0 * {n} / {first}, 2)::DOUBLE AS share_of_first")
    return "\nUNION ALL ".join(rows), ctes


_SQL, _CTES = _summary_sql()


@query("funnel_summary", _SQL, *_CTES)
def funnel_summary(t):
    return f.funnel_summary(t.visits, t.events, DEFAULT_FUNNELS)


_K = "client_id"
_STEPS = (
    f"a AS ({_page('/demo', _K, '(SELECT * FROM visits WHERE client_id IS NOT NULL)')})",
    f"b AS (SELECT * FROM ({_form('/demo', _K, False)}) WHERE k IS NOT NULL)",
    f"c AS ({_page('/schedule', _K, '(SELECT * FROM visits WHERE client_id IS NOT NULL)')})",
)


def _timing(step: int, frm: str, to: str, x: str, y: str) -> str:
    return f"""
SELECT 'demo_to_schedule' AS funnel_key, {step}::BIGINT AS step, '{frm}' AS from_step, '{to}' AS to_step,
  count(*) AS sample_size, round(avg(d), 2) AS avg_seconds,
  round(list_sort(list(d))[greatest(floor(count(*) * 0.5)::INT, 1)], 2) AS median_seconds,
  round(list_sort(list(d))[greatest(floor(count(*) * 0.9)::INT, 1)], 2) AS p90_seconds
FROM (SELECT (epoch_us({y}.t) - epoch_us({x}.t)) / 1e6 AS d FROM {x} JOIN {y} ON {x}.k = {y}.k AND {y}.t >= {x}.t)"""


@query("funnel_timing",
       _timing(1, "Visited /demo", "Submitted form", "a", "b") + "\nUNION ALL"
       + _timing(2, "Submitted form", "Visited /schedule", "b", "c"), *_STEPS)
def funnel_timing(t):
    return f.funnel_timing(t.visits, t.events, DEMO)


_TOUCH = (
    "fv AS (SELECT * FROM visits WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts, id) = 1)",
    "lv AS (SELECT * FROM visits WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, id DESC) = 1)",
)


@query("funnel_dropoffs", """
SELECT fv.client_id, fv.ts AS first_seen, lv.ts AS last_seen, coalesce(fv.source, 'direct') AS source,
  coalesce(fv.medium, 'none') AS medium, coalesce(fv.campaign, 'none') AS campaign, fv.page_url AS entry_page
FROM b LEFT JOIN c ON b.k = c.k JOIN fv ON fv.client_id = b.k JOIN lv ON lv.client_id = b.k WHERE c.k IS NULL""",
       *_STEPS, *_TOUCH)
def funnel_dropoffs(t):
    return f.funnel_dropoffs(t.visits, t.events, DEMO, 1)


@query("funnel_user_totals", """
SELECT 0 AS step, (SELECT count(*) FROM a) AS stage_users, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS dropoffs
UNION ALL SELECT 1, (SELECT count(*) FROM a JOIN b USING (k)), (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM c))
UNION ALL SELECT 2, (SELECT count(*) FROM a JOIN b USING (k) JOIN c USING (k)), NULL""", *_STEPS)
def funnel_user_totals(t):
    return f.funnel_user_totals(t.visits, t.events, DEMO)


@query("funnel_stage_users", """
SELECT fv.client_id, c.t AS stage_reached_at, fv.ts AS first_seen, lv.ts AS last_seen, fv.page_url AS entry_page,
  lv.page_url AS exit_page, coalesce(fv.source, 'direct') AS source, coalesce(fv.medium, 'none') AS medium,
  coalesce(fv.campaign, 'none') AS campaign, fv.referrer AS entry_referrer,
  cap.fv IS NOT NULL AS has_captured_data,
  CASE WHEN cap.fv IS NOT NULL THEN cap.fv ELSE json_extract(cap.data, '$.values')::VARCHAR END AS captured_data,
  CASE WHEN cap.data IS NOT NULL THEN cap.page_url END AS captured_page,
  CASE WHEN cap.data IS NOT NULL THEN cap.ts END AS captured_at,
  list_extract(list_filter(list_zip(keys, vals), lambda p: contains(lower(p[1]), 'email')), 1)[2] AS email,
  list_extract(list_filter(list_zip(keys, vals), lambda p: contains(lower(p[1]), 'name')), 1)[2] AS name,
  p.seq AS path_sequence, floor((epoch_us(lv.ts) - epoch_us(fv.ts)) / 1e6)::BIGINT AS duration_seconds
FROM a JOIN b ON a.k = b.k JOIN c ON c.k = a.k JOIN fv ON fv.client_id = a.k JOIN lv ON lv.client_id = a.k
LEFT JOIN (SELECT client_id, string_agg(path, ' → ' ORDER BY ts, id) AS seq FROM visits GROUP BY 1) p ON p.client_id = a.k
LEFT JOIN (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, id DESC) = 1) cap
  ON cap.client_id = a.k""", *_STEPS, *_TOUCH, "FORMS")
def funnel_stage_users(t):
    return f.funnel_stage_users(t.visits, t.events, DEMO, 2)
