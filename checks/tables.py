"""Derived tables as SQL, for the queries' equivalents.

``with_tables`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

ENERGY = "energy_median energy_mean energy_max energy_count energy_std energy_sum energy_min".split()
WEATHER = (
    "temperature_max temperature_min wind_speed humidity cloud_cover pressure visibility dew_point"
).split()
CALENDAR = "day_of_week day_of_month month week_of_year quarter is_weekend season".split()
LAGS = [f"energy_sum_lag_{n}" for n in (1, 2, 3, 7, 14)]
ROLLING = [f"energy_sum_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std")]
FEATURES = WEATHER + CALENDAR + ["is_bank_holiday"] + LAGS + ROLLING
NUMERIC = ENERGY + FEATURES
DOUBLES = ENERGY + WEATHER + LAGS + ROLLING
ATTRIBUTES = "tariff acorn acorn_grouped file".split()
PROFILE = (
    "mean_energy std_energy max_energy min_energy median_energy weekend_ratio "
    "seasonal_variation peak_season_energy peak_month_energy"
).split()


def listed(columns, form="{0}", joint=", ") -> str:
    return joint.join(form.format(c) for c in columns)


CALENDAR_SQL = """CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(day(day) AS INTEGER) AS day_of_month,
  CAST(month(day) AS INTEGER) AS month, CAST(week(day) AS INTEGER) AS week_of_year,
  CAST(quarter(day) AS INTEGER) AS quarter, CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend,
  CAST(CASE WHEN month(day) IN (12, 1, 2) THEN 0 WHEN month(day) IN (3, 4, 5) THEN 1
            WHEN month(day) IN (6, 7, 8) THEN 2 ELSE 3 END AS INTEGER) AS season"""

ROLLING_SQL = ",\n  ".join(
    f"avg(energy_sum) OVER (PARTITION BY household_id ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) "
    f"AS energy_sum_rolling_mean_{n}, stddev_samp(energy_sum) OVER (PARTITION BY household_id ORDER BY day "
    f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS energy_sum_rolling_std_{n}"
    for n in (7, 14, 30)
)
LAG_SQL = ", ".join(
    f"lag(energy_sum, {n}) OVER (PARTITION BY household_id ORDER BY day) AS energy_sum_lag_{n}"
    for n in (1, 2, 3, 7, 14)
)
SEASON_NAME_SQL = "CASE season WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END"

TABLES = {
    "base": """SELECT concat('MAC', lpad(cast(l_suppkey AS string), 6, '0')) AS household_id, cast(l_shipdate AS date) AS day,
  cast(median(l_quantity) AS double) AS energy_median, avg(l_quantity) AS energy_mean, max(l_quantity) AS energy_max,
  cast(count(*) AS double) AS energy_count, stddev_samp(l_quantity) AS energy_std, sum(l_quantity) AS energy_sum,
  min(l_quantity) AS energy_min, l_suppkey AS k
FROM lineitem GROUP BY l_suppkey, cast(l_shipdate AS date)""",
    "readings": """SELECT household_id, day, energy_median, energy_mean, energy_max, energy_count, energy_std,
  CASE WHEN k % 7 = 0 AND day(day) = 13 THEN NULL ELSE energy_sum END AS energy_sum, energy_min, 1 AS ingest_ordinal
FROM base
UNION ALL
SELECT household_id, day, energy_median, energy_mean, energy_max, energy_count, energy_std, energy_sum + 1, energy_min, 2
FROM base WHERE k % 10 = 0 AND day(day) = 1""",
    "households": """SELECT concat('MAC', lpad(cast(s_suppkey AS string), 6, '0')) AS household_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'ToU' ELSE 'Std' END AS tariff, n_name AS acorn,
  CASE WHEN s_suppkey % 11 = 0 THEN 'ACORN-U' WHEN s_suppkey % 13 = 0 THEN NULL ELSE r_name END AS acorn_grouped,
  concat('block_', cast(s_suppkey % 5 AS string)) AS file
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "weather": """SELECT cast(o_orderdate AS date) AS day, max(o_totalprice) / 1e4 AS temperature_max, min(o_totalprice) / 1e4 AS temperature_min,
  cast(count(*) AS double) AS wind_speed, avg(o_totalprice) / 5e5 AS humidity,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END) AS cloud_cover, sum(o_totalprice) / 1e5 AS pressure,
  stddev_samp(o_totalprice) / 1e4 AS visibility, cast(median(o_totalprice) AS double) / 1e4 AS dew_point
FROM orders GROUP BY cast(o_orderdate AS date)""",
    "holidays": """SELECT DISTINCT day FROM base
WHERE (month(day) = 12 AND day(day) IN (25, 26)) OR (month(day) = 1 AND day(day) = 1)""",
    "merged": f"""SELECT r.*, {listed(ATTRIBUTES, 'h.{0}')}, {listed(WEATHER, 'w.{0}')}
FROM readings r LEFT JOIN households h ON r.household_id = h.household_id LEFT JOIN weather w ON r.day = w.day""",
    "deduped": """SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY household_id, day ORDER BY ingest_ordinal) AS place FROM merged)
WHERE place = 1""",
    "targeted": "SELECT * FROM deduped WHERE energy_sum IS NOT NULL",
    "filled": "SELECT household_id, day, "
    + listed(
        ENERGY + WEATHER,
        "coalesce(last_value({0} IGNORE NULLS) OVER so_far, first_value({0} IGNORE NULLS) OVER from_here) AS {0}",
    )
    + f", {listed(ATTRIBUTES)} FROM targeted\n"
    "WINDOW so_far AS (PARTITION BY household_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),\n"
    "  from_here AS (PARTITION BY household_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "medians": f"SELECT {listed(ENERGY + WEATHER, 'median({0}) AS m_{0}')} FROM filled",
    "cleaned": "SELECT household_id, day, "
    + listed(ENERGY + WEATHER, "coalesce({0}, m_{0}) AS {0}")
    + ", "
    + listed(ATTRIBUTES, "coalesce({0}, 'Unknown') AS {0}")
    + " FROM filled CROSS JOIN medians",
    "engineered": f"""SELECT *, {CALENDAR_SQL},
  CAST(day IN (SELECT day FROM holidays) AS INTEGER) AS is_bank_holiday,
  {LAG_SQL},
  {ROLLING_SQL}
FROM cleaned""",
    "features": "SELECT household_id, day, "
    + listed(NUMERIC, "coalesce({0}, 0) AS {0}")
    + f", {listed(ATTRIBUTES)} FROM engineered WHERE energy_sum_lag_14 IS NOT NULL",
    "marked": """SELECT *, CASE WHEN day > (SELECT max(day) - 60 FROM features) THEN 'test' ELSE 'train' END AS split
FROM features""",
    "naive": "SELECT *, energy_sum_lag_7 AS prediction FROM marked WHERE split = 'test'",
    "flagged": """SELECT *, (60 - energy_sum) / 60 AS anomaly_score, (60 - energy_sum) / 60 < 0 AS is_anomaly FROM features""",
    "seasons_seen": "SELECT DISTINCT season FROM features",
    "months_seen": "SELECT DISTINCT month FROM features",
    "season_means": """SELECT h.household_id, s.season, coalesce(avg(f.energy_sum), 0) AS mean
FROM (SELECT DISTINCT household_id FROM features) h CROSS JOIN seasons_seen s
LEFT JOIN features f ON f.household_id = h.household_id AND f.season = s.season GROUP BY ALL""",
    "month_means": """SELECT h.household_id, s.month, coalesce(avg(f.energy_sum), 0) AS mean
FROM (SELECT DISTINCT household_id FROM features) h CROSS JOIN months_seen s
LEFT JOIN features f ON f.household_id = h.household_id AND f.month = s.month GROUP BY ALL""",
    "profiles": """SELECT a.*, coalesce(s.variation, 0) AS seasonal_variation, s.peak AS peak_season_energy, m.peak AS peak_month_energy
FROM (
  SELECT household_id, avg(energy_sum) AS mean_energy, coalesce(stddev_samp(energy_sum), 0) AS std_energy,
    max(energy_sum) AS max_energy, min(energy_sum) AS min_energy, median(energy_sum) AS median_energy,
    count(energy_sum) AS reading_count,
    coalesce(avg(energy_sum) FILTER (is_weekend = 1) / nullif(avg(energy_sum) FILTER (is_weekend = 0), 0), 1) AS weekend_ratio
  FROM features GROUP BY household_id) a
JOIN (SELECT household_id, stddev_samp(mean) AS variation, max(mean) AS peak FROM season_means GROUP BY 1) s USING (household_id)
JOIN (SELECT household_id, max(mean) AS peak FROM month_means GROUP BY 1) m USING (household_id)""",
    "numbered": "SELECT *, CAST(substr(household_id, 4, 6) AS INTEGER) % 4 AS cluster FROM profiles",
    "cluster_means": f"""SELECT cluster, {listed(PROFILE, 'avg({0}) AS {0}')}, count(*) AS count
FROM numbered GROUP BY cluster""",
    "edges": """SELECT arg_max(cluster, mean_energy) AS high, arg_min(cluster, mean_energy) AS low FROM cluster_means""",
    "cluster_names": """SELECT cluster, CASE WHEN cluster = low THEN 'Low Consumers' WHEN cluster = high THEN 'High Consumers'
    WHEN cluster = (SELECT arg_max(cluster, weekend_ratio) FROM cluster_means, edges WHERE cluster NOT IN (high, low))
    THEN 'Weekend-Heavy' ELSE 'Balanced' END AS cluster_label
FROM cluster_means, edges""",
    "summary": "SELECT m.*, l.cluster_label FROM cluster_means m JOIN cluster_names l USING (cluster)",
    "chunks": r"""SELECT doc_id, source, CAST(0 AS INTEGER) AS chunk_ord,
  regexp_replace(regexp_replace(text, '^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
    '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS content
FROM documents""",
    "asked": r"""SELECT item_id AS question_id, text AS question,
  list_distinct(list_filter(regexp_split_to_array(lower(text), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda t: t <> '')) AS words
FROM benchmark""",
    "keyworded": """SELECT question_id, question, CASE WHEN len(useful) > 0 THEN useful ELSE words END AS keywords
FROM (SELECT *, list_filter(words, lambda w: NOT list_contains(['the','a','an','is','are','was','were','what','how','why','when','where',
  'which','who','do','does','did','can','could','will','would','should','in','on','at','to','for','of','with','and','or','not','this',
  'that','it','i','me','my','you','your','we','they','he','she','be','have','has','had'], w)) AS useful FROM asked)""",
    "hits": """SELECT question_id, doc_id, chunk_ord,
  (length(body) - length(replace(body, keyword, ''))) // length(keyword) AS n
FROM (SELECT question_id, unnest(keywords) AS keyword FROM keyworded) q,
  (SELECT doc_id, chunk_ord, lower(content) AS body FROM chunks) c
WHERE contains(body, keyword)""",
    "scores": """SELECT h.question_id, h.doc_id, h.chunk_ord,
  CAST(sum(n) + 2 * count(*) + max(CASE WHEN contains(lower(c.content), lower(a.question)) THEN 10 ELSE 0 END) AS BIGINT) AS score
FROM hits h JOIN asked a ON h.question_id = a.question_id
JOIN chunks c ON h.doc_id = c.doc_id AND h.chunk_ord = c.chunk_ord GROUP BY 1, 2, 3""",
    "ranked": """SELECT question_id, CAST(place AS INTEGER) AS rank, doc_id, chunk_ord, score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, chunk_ord) AS place FROM scores)
WHERE place <= 4
UNION ALL
SELECT a.question_id, CAST(f.place AS INTEGER), f.doc_id, f.chunk_ord, 0
FROM asked a, (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_ord) AS place FROM chunks QUALIFY place <= 3) f
WHERE a.question_id NOT IN (SELECT question_id FROM scores)""",
    "retrieved": """SELECT r.*, c.source, c.content FROM ranked r JOIN chunks c ON r.doc_id = c.doc_id AND r.chunk_ord = c.chunk_ord""",
    "contexts": """SELECT question_id, string_agg('[Source: ' || source || ']' || chr(10) || content,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY question_id""",
}


def _needed(text: str) -> set[str]:
    return {name for name in TABLES if re.search(rf"\b{name}\b", text)}


def with_tables(sql: str) -> str:
    names, queue = set(), _needed(sql)
    while queue:
        name = queue.pop()
        if name not in names:
            names.add(name)
            queue |= _needed(TABLES[name]) - names
    if not names:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{t}\n)" for n, t in TABLES.items() if n in names)
    return f"WITH {parts}\n{sql}"
