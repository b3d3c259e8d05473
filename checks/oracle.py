"""DuckDB side of the checks: name -> SQL.

The SQL joins, repeats and deduplicates rows in the plain way, where the Spark
side counts with flags, extremes and multiplicities.
"""

from __future__ import annotations

# Fixed values, written out here so that a slip in the library's does not agree
# with itself.
COUNTRIES = ["BR", "DE", "ID", "KR", "TH", "TW", "UA", "US", "VN"]
REVENUE_CHANNELS = [
    "non-tracking-organic",
    "QooApp",
    "Pre_registration_LMSnPush",
    "Organic",
    "Off-Facebook Installs",
    "Naver_CafePlug",
    "GG_Content_Influencers",
    "Google Organic Search",
    "Facebook Installs",
    "Official_Channels",
    "LINE_Internal",
    "Brandpage",
    "Naver_Brandsearch",
    "Adwords UAC Installs",
]

REG_FROM, REG_TO = "DATE '2024-01-02'", "DATE '2024-01-08'"
BEFORE = "TIMESTAMP '2024-01-09'"


def _strings(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


# Progress rows of the registration day, shared by most queries.
FIRST_DAY = """first_day AS (
  SELECT *, id_campaign > 0 AS played, last_tutorial = 'tutorial not enter' AS loose,
         last_tutorial = 'tutorial not enter' AND id_campaign = 0 AS strict
  FROM f_max_campaign WHERE datekey = reg_datekey
)"""

# The ten tables, from the raw event log.
TABLES = f"""
WITH signups AS (
  SELECT user_id, min(ts) AS reg_ts, 'DM' || (user_id % 7) AS dm, 'OS' || (user_id % 3) AS osv,
         ['Organic', 'Facebook Installs', 'Google Organic Search', 'Nontracking-Organic',
          'QooApp'][user_id % 6] AS network,
         [{_strings(COUNTRIES)}, 'JP'][user_id % 11 + 1] AS country
  FROM events WHERE event_type = 'signup' GROUP BY user_id
), kept AS (
  SELECT e.*, u.* EXCLUDE (user_id), u.reg_ts::DATE AS reg_day, e.ts::DATE AS day,
         regexp_extract(e.props, '[0-9]+')::BIGINT AS k,
         11001 + (regexp_extract(e.props, '[0-9]+')::BIGINT % 8) * 200 AS stage,
         floor(e.value * 10000)::BIGINT AS millis
  FROM events AS e JOIN signups AS u USING (user_id) WHERE e.ts >= u.reg_ts
), common_register AS (
  SELECT user_id AS nid, reg_ts AS _i_t, dm, osv FROM signups
  UNION ALL
  SELECT user_id, reg_ts, dm, osv FROM signups WHERE user_id % 50 = 0
), common_login AS (
  SELECT event_id AS _id, user_id AS nid, ts AS _i_t,
         if(event_id % 13 = 0, NULL, millis) AS loading_time_ms, dm, osv
  FROM kept WHERE event_type IN ('click', 'view')
), common_installed AS (
  SELECT event_id AS _id, ts AS _i_t, if(event_id % 17 = 0, NULL, 'DM' || (user_id % 7)) AS dm,
         'OS' || (user_id % 3) AS osv
  FROM events WHERE event_type = 'signup'
), common_gamemoney AS (
  SELECT user_id AS nid, ts AS _i_t,
         CASE event_type WHEN 'click' THEN 'session/login' WHEN 'view' THEN 'partner/login'
                         ELSE 'other' END AS rsn,
         if(event_id % 11 = 0, 'UNDEFINED', 'v,' || millis || ';' || k) AS add_rsn
  FROM kept
), pve_campaign_result AS (
  SELECT user_id AS nid, ts AS _i_t, {{'id_campaign': stage}} AS campaign_data,
         if(row_number() OVER (PARTITION BY user_id, stage ORDER BY ts, event_id) = 1, 1, 0)
           AS first_clear
  FROM kept WHERE event_type = 'purchase'
), user_days AS (
  SELECT user_id AS nid, reg_day AS reg_datekey, day AS datekey, network, country,
         max(stage) FILTER (event_type = 'purchase') AS top_stage,
         sum(value) FILTER (event_type = 'purchase') AS revenue
  FROM kept GROUP BY ALL
), f_max_campaign AS (
  SELECT nid, reg_datekey, datekey, id_campaign,
         if(id_campaign = 0, 'tutorial not enter', 'tutorial clear') AS last_tutorial
  FROM (SELECT *, coalesce(max(top_stage) OVER (PARTITION BY nid ORDER BY datekey), 0)
                    AS id_campaign FROM user_days)
), f_pve_campaign_result AS (
  SELECT user_id AS nid, reg_day AS reg_datekey, day AS datekey,
         if(event_id % 19 = 0, NULL, stage) AS id_campaign
  FROM kept WHERE event_type = 'purchase'
), f_user_map AS (
  SELECT nid, reg_datekey, datekey, (datekey - reg_datekey)::BIGINT AS date_diff_reg,
         network AS network_name, country AS reg_country,
         if(datekey = reg_datekey, 1, 0)::BIGINT AS nru, revenue AS daily_revenue
  FROM user_days
), adjust_conversion AS (
  SELECT user_id AS nid, network AS network_name, (epoch_us(reg_ts) // 1000000)::VARCHAR AS created_at
  FROM signups WHERE user_id % 5 <> 0
  UNION ALL
  SELECT user_id, 'Brandpage', (epoch_us(reg_ts) // 1000000)::VARCHAR
  FROM signups WHERE user_id % 5 <> 0 AND user_id % 9 = 0
), dim_osv_temp AS (
  SELECT DISTINCT 'MODEL' || (user_id % 7 % 4) AS model, 'DM' || (user_id % 7) AS dm,
         'OS' || (user_id % 3) AS osv
  FROM events
), {FIRST_DAY}"""

ON_TIME = "minute(_i_t) <= 54"

# Bodies that follow TABLES; they start with a comma (more CTEs) or SELECT.
ON_TABLES: dict[str, str] = {}

ON_TABLES["q01_daily_count_as_of"] = """
SELECT make_timestamp(created_at::BIGINT * 1000000)::DATE AS datekey, count(*) AS cnt_2
FROM adjust_conversion
WHERE make_timestamp(created_at::BIGINT * 1000000) <= TIMESTAMP '2024-01-08 12:00:00'
  AND make_timestamp(created_at::BIGINT * 1000000)::DATE
      BETWEEN DATE '2024-01-02' AND DATE '2024-01-10'
GROUP BY ALL"""



def _versions(state: str) -> str:
    """The daily count of what the history's commits made of the conversions."""
    return f"""
, timed AS (
  SELECT *, make_timestamp(created_at::BIGINT * 1000000) AS made FROM adjust_conversion
), second_commit AS (
  SELECT made + to_days(if(nid % 7 = 0, 1, 0)) AS made FROM timed
  WHERE made < TIMESTAMP '2024-01-08' AND nid % 13 <> 0
), third_commit AS (
  SELECT made FROM timed WHERE made < TIMESTAMP '2024-01-11' AND nid % 4 <> 1
)
SELECT made::DATE AS datekey, count(*) AS cnt_2 FROM {state}
WHERE made::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-10' GROUP BY ALL"""


ON_TABLES["q01_daily_count_versioned"] = _versions("second_commit")
ON_TABLES["q01_daily_count_versioned_late"] = _versions("third_commit")

ON_TABLES["q02_register_time_distribution"] = f"""
SELECT hour(_i_t) AS "Hour", minute(_i_t) AS min, count(DISTINCT nid) AS UU
FROM common_register
SEMI JOIN (FROM first_day WHERE strict AND reg_datekey <= {REG_TO}) USING (nid)
WHERE _i_t < {BEFORE}
GROUP BY ALL"""

ON_TABLES["s01_stored_tables"] = ON_TABLES["q02_register_time_distribution"]


def _minutes(pairs: str, cap: int, over: str) -> str:
    return f"""
, gaps AS ({pairs}),
users AS (SELECT m, count(DISTINCT nid) AS n FROM gaps GROUP BY m)
SELECT CASE WHEN m > {cap} THEN '{over}' WHEN m < 10 THEN '0' || m ELSE m::VARCHAR END AS min_time,
       sum(n)::BIGINT AS UU
FROM users GROUP BY 1"""


ON_TABLES["q03_minutes_to_stage_clear"] = _minutes(
    f"""SELECT r.nid, date_sub('minute', r._i_t, p._i_t) AS m
FROM common_register AS r JOIN pve_campaign_result AS p
  ON p.nid = r.nid AND date_trunc('day', p._i_t) = date_trunc('day', r._i_t)
WHERE p.first_clear = 1 AND p.campaign_data.id_campaign = 11001 AND r._i_t < {BEFORE}""",
    600,
    "600분 초과",
)
ON_TABLES["q03_minutes_to_stage_clear_100"] = _minutes(
    f"""SELECT r.nid, date_sub('minute', r._i_t, p._i_t) AS m
FROM common_register AS r JOIN pve_campaign_result AS p
  ON p.nid = r.nid AND date_trunc('day', p._i_t) = date_trunc('day', r._i_t)
WHERE p.first_clear = 1 AND p.campaign_data.id_campaign = 11001 AND r._i_t < {BEFORE}""",
    100,
    "100분 초과",
)
ON_TABLES["k15_minutes_hist"] = _minutes(
    """SELECT r.nid, date_sub('minute', r._i_t, p._i_t) AS m
FROM common_register AS r JOIN pve_campaign_result AS p
  ON p.nid = r.nid AND date_trunc('day', p._i_t) = date_trunc('day', r._i_t)
WHERE p.first_clear = 1""",
    720,
    "over half a day",
)


def _curve(cohort: str, horizon: int) -> str:
    return f"""
, cohort AS ({cohort}),
waits AS (
  SELECT c.reg_datekey, c.nid, min(f.datekey) - c.reg_datekey AS wait
  FROM cohort AS c JOIN f_max_campaign AS f USING (reg_datekey, nid)
  WHERE f.datekey > c.reg_datekey AND f.id_campaign > 0
  GROUP BY c.reg_datekey, c.nid
), cells AS (
  SELECT reg_datekey, count(DISTINCT nid) AS not_play_UU, unnest(range(1, {horizon + 1})) AS diff
  FROM cohort GROUP BY reg_datekey
), filled AS (
  SELECT cells.*, (SELECT nullif(count(*), 0) FROM waits AS w
                   WHERE w.reg_datekey = cells.reg_datekey AND w.wait = cells.diff) AS n
  FROM cells
)
SELECT reg_datekey, not_play_UU, diff::BIGINT AS diff, coalesce(n, 0) AS return_UU,
       (sum(n) OVER (PARTITION BY reg_datekey ORDER BY diff))::BIGINT AS return_UU_cum
FROM filled"""


ON_TABLES["q04_return_curve"] = _curve(
    f"SELECT DISTINCT reg_datekey, nid FROM first_day WHERE strict AND reg_datekey <= {REG_TO}",
    75,
)
ON_TABLES["k03_return_curve"] = _curve(
    "SELECT DISTINCT reg_datekey, nid FROM first_day WHERE loose", 29
)

ON_TABLES["q05_two_day_matrix_played"] = f"""
, stages AS (
  SELECT nid, datekey - reg_datekey AS offset_days, count(DISTINCT id_campaign) AS n
  FROM f_pve_campaign_result
  WHERE id_campaign IS NOT NULL AND greatest(reg_datekey, datekey) <= {REG_TO}
    AND nid IN (SELECT nid FROM first_day WHERE played AND reg_datekey <= {REG_TO})
  GROUP BY ALL
)
SELECT a.n AS cnt_1, coalesce(b.n, 0) AS cnt_2, count(*) AS UU
FROM stages AS a LEFT JOIN stages AS b ON b.nid = a.nid AND b.offset_days = 1
WHERE a.offset_days = 0
GROUP BY 1, 2"""


def _ranked_matrix(cohort: str, last: str) -> str:
    return f"""
, ranked AS (
  SELECT nid, datekey, id_campaign,
         row_number() OVER (PARTITION BY nid, datekey - reg_datekey
                            ORDER BY datekey, id_campaign NULLS FIRST) AS place
  FROM f_pve_campaign_result
  WHERE greatest(reg_datekey, datekey) <= {last} AND nid IN ({cohort})
), seconds AS (
  SELECT s.nid, count(DISTINCT s.id_campaign) AS n
  FROM ranked AS f JOIN ranked AS s ON s.nid = f.nid AND s.datekey = f.datekey + 1
  WHERE f.place = 1 AND s.place = 2 GROUP BY s.nid
), firsts AS (
  SELECT nid, count(DISTINCT id_campaign) FILTER (place = 1) AS n FROM ranked GROUP BY nid
)
SELECT firsts.n AS cnt_1, coalesce(seconds.n, 0) AS cnt_2, count(*) AS UU
FROM firsts LEFT JOIN seconds USING (nid) GROUP BY 1, 2"""


ON_TABLES["q06_two_day_matrix_not_entered"] = _ranked_matrix(
    f"SELECT nid FROM first_day WHERE strict AND reg_datekey <= {REG_TO}", REG_TO
)
ON_TABLES["k16_two_day_matrix"] = _ranked_matrix(
    "SELECT nid FROM first_day WHERE played", "DATE '2999-01-01'"
)

ON_TABLES["q07_loading_time_engagement"] = f"""
, logins AS (
  SELECT nid, _i_t::DATE AS reg_datekey,
         TRY_CAST(string_split(string_split(add_rsn, ',')[2], ';')[1] AS BIGINT) / 1000 AS loading
  FROM common_gamemoney
  WHERE rsn IN ('session/login', 'partner/login') AND add_rsn <> 'UNDEFINED' AND {ON_TIME}
    AND _i_t < {BEFORE}
), window_days AS (
  FROM f_max_campaign WHERE reg_datekey BETWEEN {REG_FROM} AND {REG_TO}
), idle AS (
  SELECT nid, reg_datekey FROM first_day WHERE strict AND reg_datekey BETWEEN {REG_FROM} AND {REG_TO}
), members AS (
  SELECT 'late' AS grp, i.* FROM idle AS i JOIN window_days AS w USING (nid, reg_datekey)
  WHERE w.id_campaign > 0 AND w.datekey - w.reg_datekey <= 15
  UNION ALL
  SELECT 'none', i.* FROM idle AS i JOIN window_days AS w USING (nid, reg_datekey)
  WHERE w.id_campaign = 0 AND w.datekey - w.reg_datekey <= 15
  UNION ALL
  SELECT if(a.id_campaign < b.id_campaign, 'up', 'same'), a.nid, a.reg_datekey
  FROM window_days AS a JOIN window_days AS b ON a.nid = b.nid
  WHERE a.datekey = a.reg_datekey AND b.datekey = b.reg_datekey + 1
    AND a.id_campaign > 0 AND b.id_campaign > 0
)
SELECT reg_datekey,
       CASE WHEN loading < 100 THEN 'a.under_100' WHEN loading < 200 THEN 'b.under_200'
            WHEN loading < 300 THEN 'c.under_300' WHEN loading < 400 THEN 'd.under_400'
            WHEN loading < 500 THEN 'e.under_500' WHEN loading < 600 THEN 'f.under_600'
            WHEN loading < 700 THEN 'g.under_700' WHEN loading < 800 THEN 'h.under_800'
            WHEN loading < 900 THEN 'i.under_900' WHEN loading < 1000 THEN 'j.under_1000'
            WHEN loading >= 1000 THEN 'k.over_1000' ELSE 'l.unreadable' END AS avg_loading_time,
       count(DISTINCT nid) FILTER (grp = 'late') AS late_enter_UU,
       count(DISTINCT nid) FILTER (grp = 'up') AS enter_2dayUU,
       nullif(count(DISTINCT nid) FILTER (grp = 'same'), 0) AS enter_not_2_dayUU,
       count(DISTINCT nid) FILTER (grp = 'none') AS not_enter_UU
FROM logins JOIN members USING (nid, reg_datekey)
GROUP BY 1, 2
HAVING count(*) FILTER (grp = 'up') > 0"""

RATIO = """
SELECT network_name, idle AS "not_play_UU", players AS "play_UU",
       round(idle / (players + idle), 6) AS ratio"""

ON_TABLES["q08_channel_ratio_window"] = f"""
, in_window AS (
  SELECT nid, nru, ifnull(network_name, 'Nontracking-Organic') AS network_name
  FROM f_user_map WHERE reg_datekey BETWEEN {REG_FROM} AND {REG_TO}
), starts AS (
  SELECT w.network_name, d.nid, d.strict, d.played
  FROM in_window AS w JOIN first_day AS d ON d.nid = w.nid
  WHERE w.nru = 1 AND d.reg_datekey BETWEEN {REG_FROM} AND {REG_TO}
)
{RATIO}
FROM (SELECT DISTINCT network_name FROM in_window)
LEFT JOIN (SELECT network_name, count(DISTINCT nid) AS idle FROM starts WHERE strict GROUP BY 1)
  USING (network_name)
LEFT JOIN (SELECT network_name, count(DISTINCT nid) AS players FROM starts WHERE played GROUP BY 1)
  USING (network_name)"""

ON_TABLES["s01_bucketed_tables"] = ON_TABLES["q08_channel_ratio_window"]

# Registrations joined to conversions, rows repeated: once per spelling of the
# channel, and once per channel and distinct registration clock.
ATTRIBUTION = """
, registered AS (
  SELECT nid, _i_t FROM common_register WHERE minute(_i_t) <= 54 {window}
), by_row AS (
  SELECT r.nid, ifnull(c.network_name, 'Nontracking-Organic') AS network_name
  FROM registered AS r
  LEFT JOIN (SELECT DISTINCT nid, {spelling} AS network_name FROM adjust_conversion) AS c USING (nid)
), by_clock AS (
  SELECT r.nid, ifnull(c.network_name, 'Nontracking-Organic') AS network_name
  FROM (SELECT DISTINCT nid, hour(_i_t), minute(_i_t) FROM registered) AS r
  LEFT JOIN (SELECT DISTINCT nid, ifnull(network_name, 'Nontracking-Organic') AS network_name
             FROM adjust_conversion) AS c USING (nid)
), channels AS (
  SELECT DISTINCT ifnull(network_name, 'Nontracking-Organic') AS network_name FROM f_user_map
)"""

ON_TABLES["q09_channel_ratio_all"] = f"""
{ATTRIBUTION.format(window="", spelling="network_name")}
{RATIO}
FROM channels
LEFT JOIN (SELECT b.network_name, count(DISTINCT b.nid) AS idle
           FROM by_row AS b JOIN first_day AS d USING (nid) WHERE d.strict GROUP BY 1)
  USING (network_name)
LEFT JOIN (SELECT b.network_name, count(DISTINCT b.nid) AS players
           FROM by_row AS b JOIN first_day AS d USING (nid) WHERE d.played GROUP BY 1)
  USING (network_name)"""


def _revenue(window: str, spelling: str, days: str, paid: str) -> str:
    return f"""
{ATTRIBUTION.format(window=window, spelling=spelling)}
, idle AS (
  SELECT b.network_name, sum(m.paid) / count(DISTINCT b.nid) AS per_user
  FROM (SELECT DISTINCT nid FROM first_day WHERE strict {days}) AS d
  JOIN by_row AS b USING (nid)
  JOIN (SELECT nid, network_name, sum(daily_revenue) AS paid FROM f_user_map {paid}
        GROUP BY ALL) AS m USING (nid)
  GROUP BY b.network_name
), players AS (
  SELECT b.network_name, sum(m.paid) / count(DISTINCT b.nid) AS per_user
  FROM (SELECT nid FROM first_day WHERE played {days}) AS d
  JOIN by_clock AS b USING (nid)
  JOIN (SELECT nid, network_name, sum(daily_revenue) AS paid FROM f_user_map
        GROUP BY ALL) AS m USING (nid)
  GROUP BY b.network_name
)
SELECT c.network_name, round(i.per_user, 6) AS not_play_revenue,
       round(p.per_user, 6) AS play_revenue
FROM channels AS c LEFT JOIN idle AS i USING (network_name) LEFT JOIN players AS p USING (network_name)"""


ON_TABLES["q10_channel_revenue_window"] = _revenue(
    f"AND _i_t >= {REG_FROM} AND _i_t < {BEFORE}",
    "ifnull(network_name, 'Nontracking-Organic')",
    f"AND reg_datekey BETWEEN {REG_FROM} AND {REG_TO}",
    f"WHERE reg_datekey BETWEEN {REG_FROM} AND {REG_TO} "
    f"AND datekey BETWEEN {REG_FROM} AND {REG_TO}",
)
ON_TABLES["q11_channel_revenue_all"] = _revenue("", "network_name", "", "")

def _not_entered(period: str) -> str:
    return f"""
SELECT {period} AS reg_datekey, m.network_name,
       count(DISTINCT m.nid) AS reg_UU,
       count(DISTINCT m.nid) FILTER (EXISTS (
         FROM first_day AS d
         WHERE d.loose AND d.nid = m.nid AND d.reg_datekey = m.reg_datekey)) AS not_play_UU
FROM f_user_map AS m WHERE m.nru = 1
GROUP BY 1, 2"""


ON_TABLES["q12_weekly_not_entered"] = _not_entered("strftime(m.reg_datekey, '%U')::BIGINT")
ON_TABLES["q12_weekly_from_fold"] = ON_TABLES["q12_weekly_not_entered"]
ON_TABLES["q12_monthly_from_fold"] = _not_entered("month(m.reg_datekey)")


def _cumulative(horizon: int, channels, default: str, where: str = "true") -> str:
    return f"""
, cells AS (
  SELECT unnest([{_strings(channels)}]) AS network_name, d AS date_diff_reg
  FROM range(1, {horizon + 1}) AS days(d)
), paid AS (
  SELECT date_diff_reg, network_name, sum(daily_revenue) AS amount
  FROM f_user_map WHERE {where} GROUP BY ALL HAVING count(daily_revenue) > 0
), named AS (SELECT date_diff_reg, ifnull(network_name, '{default}') AS network_name, amount FROM paid)
SELECT date_diff_reg::BIGINT AS date_diff_reg, network_name,
       round(sum(amount) OVER (PARTITION BY network_name
             ORDER BY date_diff_reg, amount NULLS FIRST
             ROWS UNBOUNDED PRECEDING), 6) AS daily_revenue
FROM cells LEFT JOIN named USING (date_diff_reg, network_name)"""


ON_TABLES["q13_cumulative_revenue"] = _cumulative(
    81, REVENUE_CHANNELS, "non-tracking-organic"
)
ON_TABLES["q14_cumulative_revenue_recent"] = _cumulative(
    36, REVENUE_CHANNELS, "non-tracking-organic", "reg_datekey >= DATE '2024-01-03'"
)
ON_TABLES["k13_cumulative_revenue"] = _cumulative(
    10, ["Nontracking-Organic", "Organic", "QooApp", "nobody"], "Nontracking-Organic"
)


def _transitions(cohort: str, n: int) -> str:
    return f"""
, ordered AS (
  SELECT f.nid, f.id_campaign,
         row_number() OVER (PARTITION BY f.nid ORDER BY f.id_campaign NULLS FIRST) AS place
  FROM f_max_campaign AS f JOIN ({cohort}) AS c USING (nid) WHERE f.reg_datekey <= {REG_TO}
), steps AS (
  SELECT nid, place, if(id_campaign > 12000, '2월드', id_campaign::VARCHAR) AS diff_0,
         lead(diff_0) OVER (PARTITION BY nid ORDER BY place) AS diff_1,
         lead(place) OVER (PARTITION BY nid ORDER BY place) AS follower
  FROM ordered
)
SELECT diff_0, diff_1, count(DISTINCT nid) AS UU
FROM steps WHERE place = {n} AND follower IS NOT NULL GROUP BY ALL"""


ON_TABLES["q15_transition_played"] = _transitions(
    f"SELECT DISTINCT nid FROM first_day WHERE played AND reg_datekey <= {REG_TO}", 1
)
ON_TABLES["q16_transition_not_entered"] = _transitions(
    "SELECT r.nid FROM common_register AS r "
    f"SEMI JOIN (FROM first_day WHERE loose AND reg_datekey <= {REG_TO}) AS d USING (nid) "
    f"WHERE {ON_TIME}",
    2,
)

ON_TABLES["q17_return_stats"] = f"""
, cohort AS (SELECT DISTINCT reg_datekey, nid FROM first_day WHERE strict AND reg_datekey <= {REG_TO}),
waits AS (
  SELECT reg_datekey, nid,
         (SELECT min(f.datekey) FROM f_max_campaign AS f
          WHERE f.nid = c.nid AND f.reg_datekey = c.reg_datekey AND f.id_campaign > 0
            AND f.datekey > c.reg_datekey) - reg_datekey AS wait
  FROM cohort AS c
)
SELECT reg_datekey, count(nid) AS not_play_UU, nullif(count(wait), 0) AS play_UU,
       round(avg(wait), 6) AS avg_diff, max(wait)::BIGINT AS avg_diff_max
FROM waits GROUP BY reg_datekey"""

ON_TABLES["q18_return_depth"] = f"""
, cohort AS (SELECT DISTINCT reg_datekey, nid FROM first_day WHERE strict AND reg_datekey <= {REG_TO}),
reached AS (
  SELECT c.reg_datekey, c.nid, min(f.id_campaign) AS low, max(f.id_campaign) AS high
  FROM cohort AS c JOIN f_max_campaign AS f USING (reg_datekey, nid)
  WHERE f.id_campaign > 0 AND f.datekey - c.reg_datekey BETWEEN 1 AND 7
  GROUP BY ALL
)
SELECT reg_datekey, if(low > 12000, '2월드 진입', low::VARCHAR) AS id_campaign,
       if(high > 12000, '2월드 진입', high::VARCHAR) AS id_campaign_max, size AS not_play_UU, UU
FROM (SELECT reg_datekey, count(nid) AS size FROM cohort GROUP BY ALL)
LEFT JOIN (SELECT reg_datekey, low, high, count(*) AS UU FROM reached GROUP BY ALL)
  USING (reg_datekey)"""

ON_TABLES["q19_country_month"] = """
, new_users AS (SELECT nid, reg_country, month(reg_datekey) AS mon FROM f_user_map WHERE nru = 1),
idle AS (
  SELECT n.reg_country, month(d.reg_datekey) AS mon, count(DISTINCT d.nid) AS not_enter
  FROM first_day AS d JOIN new_users AS n USING (nid) WHERE d.loose GROUP BY ALL
), everyone AS (
  SELECT reg_country, mon, count(DISTINCT nid) AS reg FROM new_users GROUP BY ALL
)
SELECT i.reg_country, i.mon AS reg_mon, i.not_enter AS "not_enter_UU", e.reg AS "reg_UU"
FROM idle AS i LEFT JOIN everyone AS e USING (reg_country, mon)"""


def _loading(kind: str, by_country: bool) -> str:
    country = "coalesce(p.reg_country, '기타') AS reg_country," if by_country else ""
    places = f"""LEFT JOIN (
  FROM f_user_map WHERE nru = 1 AND reg_datekey >= {REG_FROM}
    AND list_contains([{_strings(COUNTRIES)}], reg_country)) AS p USING (nid)"""
    return f"""
, first_login AS (
  SELECT nid, loading_time_ms / 1000 AS t FROM common_login
  QUALIFY row_number() OVER (PARTITION BY nid ORDER BY _i_t, _id) = 1
)
SELECT CASE WHEN t < 100 THEN 'under_100' WHEN t < 200 THEN 'under_200' WHEN t < 300 THEN 'under_300'
            WHEN t < 400 THEN 'under_400' WHEN t < 500 THEN 'under_500' WHEN t < 600 THEN 'under_600'
            WHEN t < 700 THEN 'under_700' WHEN t < 800 THEN 'under_800' ELSE 'over 800' END AS loading_time_ms,
       {country} count(DISTINCT nid) AS UU
FROM first_login
SEMI JOIN (FROM first_day WHERE {kind} AND reg_datekey >= {REG_FROM}) AS d USING (nid)
{places if by_country else ""}
GROUP BY ALL"""


ON_TABLES["q20_loading_country_not_entered"] = _loading("loose", True)
ON_TABLES["q21_loading_country_played"] = _loading("played", True)
ON_TABLES["q22_loading_played"] = _loading("played", False)


def _funnel(early: str) -> str:
    return f"""
SELECT model, sum(i.n)::BIGINT AS install_cnt, sum(r.n)::BIGINT AS register_cnt,
       sum(l.n)::BIGINT AS login_UU
FROM dim_osv_temp
LEFT JOIN (SELECT dm, osv, count(DISTINCT _id) AS n FROM common_installed WHERE {early}
           GROUP BY ALL) AS i USING (dm, osv)
LEFT JOIN (SELECT dm, osv, count(DISTINCT nid) AS n FROM common_register WHERE {early}
           GROUP BY ALL) AS r USING (dm, osv)
LEFT JOIN (SELECT dm, osv, count(DISTINCT nid) AS n FROM common_login WHERE {early}
           GROUP BY ALL HAVING count(DISTINCT _id) >= 2) AS l USING (dm, osv)
GROUP BY model"""


ON_TABLES["q23_device_funnel"] = _funnel(f"_i_t < {BEFORE}")
ON_TABLES["k14_device_funnel"] = _funnel("true")

ON_TABLES["q07_loading_time_prefiltered"] = ON_TABLES["q07_loading_time_engagement"]
ON_TABLES["q20_loading_country_prefiltered"] = ON_TABLES["q20_loading_country_not_entered"]
ON_TABLES["q21_loading_country_prefiltered"] = ON_TABLES["q21_loading_country_played"]
ON_TABLES["q22_loading_prefiltered"] = ON_TABLES["q22_loading_played"]
for _name in ("q04_return_curve", "q17_return_stats", "q18_return_depth"):
    ON_TABLES[f"{_name[:3]}_from_state"] = ON_TABLES[_name]

ON_TABLES["k01_day0_cohort"] = f"""
SELECT reg_datekey, nid FROM first_day WHERE strict AND reg_datekey BETWEEN {REG_FROM} AND {REG_TO}"""
ON_TABLES["k02_first_return"] = f"""
SELECT reg_datekey, nid, datekey FROM f_max_campaign
WHERE id_campaign > 0 AND datekey - reg_datekey BETWEEN 1 AND 10 AND reg_datekey <= {REG_TO}
QUALIFY datekey = min(datekey) OVER (PARTITION BY reg_datekey, nid)"""
ON_TABLES["k05_nested_split"] = """
SELECT nid, rsn, count(a) AS n_times, round(sum(a / 1000), 6) AS time_sum, sum(b)::BIGINT AS tail_sum
FROM (SELECT nid, rsn, TRY_CAST(split_part(split_part(add_rsn, ',', 2), ';', 1) AS BIGINT) AS a,
             TRY_CAST(split_part(add_rsn, ';', 2) AS BIGINT) AS b FROM common_gamemoney)
GROUP BY nid, rsn"""
ON_TABLES["k07_attribution"] = f"""
SELECT r.nid, c.network_name, r.registrations, r.clocks, c.spellings
FROM (SELECT nid, count(*) AS registrations, count(DISTINCT date_trunc('minute', _i_t)::TIME) AS clocks
      FROM common_register WHERE {ON_TIME} AND _i_t >= {REG_FROM} AND _i_t < {BEFORE} GROUP BY nid) AS r
JOIN (SELECT u.nid, ifnull(a.network_name, 'Nontracking-Organic') AS network_name,
             count(DISTINCT ifnull(a.network_name, '?')) AS spellings
      FROM (SELECT DISTINCT nid FROM common_register) AS u LEFT JOIN adjust_conversion AS a USING (nid)
      GROUP BY ALL) AS c USING (nid)"""
ON_TABLES["k12_stage_label"] = """
SELECT if(id_campaign > 12000, '2월드', id_campaign::VARCHAR) AS stage, count(*) AS plays,
       count(DISTINCT nid) AS UU
FROM f_pve_campaign_result GROUP BY stage"""
ON_TABLES["p_struct_access"] = """
SELECT campaign_data.id_campaign AS id_campaign, first_clear::BIGINT AS first_clear,
       count(*) AS plays, count(DISTINCT nid) AS UU
FROM pve_campaign_result GROUP BY 1, 2"""
ON_TABLES["j_inner_composite"] = """
SELECT f.id_campaign, count(*) AS days, round(sum(m.daily_revenue), 6) AS daily_revenue
FROM f_max_campaign AS f JOIN f_user_map AS m ON f.nid = m.nid AND f.datekey = m.datekey
WHERE f.id_campaign > 0 GROUP BY f.id_campaign"""
ON_TABLES["j_left_composite"] = """
, back AS (
  SELECT reg_datekey, nid, min(datekey) AS datekey FROM f_max_campaign
  WHERE datekey > reg_datekey AND id_campaign > 0 GROUP BY ALL
)
SELECT m.reg_country, count(*) AS users, count(b.datekey) AS returned,
       max(b.datekey) AS last_first_return
FROM f_user_map AS m LEFT JOIN back AS b USING (reg_datekey, nid) WHERE m.nru = 1
GROUP BY m.reg_country"""
ON_TABLES["a_group_alias"] = """
SELECT ifnull(network_name, 'Nontracking-Organic') AS network_name, count(DISTINCT nid) AS UU,
       count(*) AS days
FROM f_user_map GROUP BY 1"""

for _name, _columns in {
    "adjust_conversion": "nid, network_name, created_at",
    "common_register": "nid, epoch_us(_i_t) AS _i_t, dm, osv",
    "common_login": "_id, nid, epoch_us(_i_t) AS _i_t, loading_time_ms, dm, osv",
    "common_installed": "_id, epoch_us(_i_t) AS _i_t, dm, osv",
    "common_gamemoney": "nid, epoch_us(_i_t) AS _i_t, rsn, add_rsn",
    "pve_campaign_result": "nid, epoch_us(_i_t) AS _i_t, campaign_data.id_campaign AS campaign_data, "
    "first_clear::BIGINT AS first_clear",
    "f_max_campaign": "nid, reg_datekey, datekey, id_campaign, last_tutorial",
    "f_pve_campaign_result": "nid, reg_datekey, datekey, id_campaign",
    "f_user_map": "nid, reg_datekey, datekey, date_diff_reg, network_name, reg_country, nru, "
    "round(daily_revenue, 6) AS daily_revenue",
    "dim_osv_temp": "model, dm, osv",
}.items():
    ON_TABLES[f"src_{_name}"] = f"\nSELECT {_columns} FROM {_name}"


# SQL on the plain tables.
PLAIN: dict[str, str] = {
    "k04_densify": """
SELECT s.s_suppkey AS l_suppkey, m.month AS ship_month, round(sum(l.l_quantity), 6) AS quantity
FROM supplier AS s CROSS JOIN range(1, 13) AS m(month)
LEFT JOIN lineitem AS l
  ON l.l_suppkey = s.s_suppkey AND month(l.l_shipdate) = m.month
GROUP BY 1, 2""",
    "k04_sparse_axis": """
WITH facts AS (
  SELECT l_suppkey, l_shipdate::DATE - DATE '1992-01-01' AS day, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY ALL
), cells AS (
  SELECT s_suppkey AS l_suppkey, d AS day, quantity,
         sum(quantity) OVER (PARTITION BY s_suppkey ORDER BY d ROWS UNBOUNDED PRECEDING) AS total
  FROM supplier CROSS JOIN range(10000) AS days(d)
  LEFT JOIN facts ON facts.l_suppkey = s_suppkey AND facts.day = d
)
SELECT l_suppkey, count(*) AS days, count(quantity) AS days_shipped, round(sum(quantity), 6) AS quantity,
       count(total) AS days_since_first, round(sum(total), 6) AS total_days
FROM cells GROUP BY l_suppkey""",
    "k06_bucketize": """
SELECT CASE WHEN l_discount = 0 OR l_extendedprice >= 50000 THEN 'rest'
            WHEN l_extendedprice >= 20000 THEN 'high'
            WHEN l_extendedprice >= 5000 THEN 'mid' ELSE 'low' END AS bucket,
       count(*) AS n, round(sum(l_quantity), 6) AS quantity
FROM lineitem GROUP BY 1""",
    "k08_transition_matrix": """
WITH lines AS (
  SELECT l_orderkey, l_quantity::BIGINT AS q, row_number() OVER by_q AS place,
         lead(l_quantity::BIGINT) OVER by_q AS next_q,
         bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_return
  FROM lineitem WINDOW by_q AS (PARTITION BY l_orderkey ORDER BY l_quantity::BIGINT)
)
SELECT if(q > 40, 'many', q::VARCHAR) AS diff_0, if(next_q > 40, 'many', next_q::VARCHAR) AS diff_1,
       count(*) AS UU
FROM lines WHERE place = 2 AND next_q IS NOT NULL AND any_return GROUP BY 1, 2""",
    "k09_join_metrics": """
SELECT n_nationkey::BIGINT AS n_nationkey, n_name,
       nullif((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS customers,
       round((SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), 6) AS mean_balance,
       nullif((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS suppliers
FROM nation""",
    "k10_snapshot_as_of": """
SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
       round(max_by(o_totalprice, (o_orderdate, o_orderkey)), 6) AS o_totalprice,
       max(o_orderdate)::DATE AS day
FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY o_custkey""",
    "k10_history_as_of": """
WITH newest AS (
  SELECT m AS made, o_custkey, o_orderkey, o_totalprice
  FROM orders JOIN (SELECT unnest([TIMESTAMP '1994-01-01', TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01']) AS m)
    ON o_orderdate <= m AND NOT (m = TIMESTAMP '1998-01-01' AND o_custkey % 10 = 3)
  QUALIFY row_number() OVER (PARTITION BY m, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
)
SELECT 'ever' AS moment, o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice
FROM (SELECT DISTINCT o_custkey, o_orderkey, o_totalprice FROM newest)
UNION ALL
SELECT '1995-06-30', o_custkey, o_orderkey, round(o_totalprice, 6) FROM newest WHERE year(made) = 1994
UNION ALL
SELECT '1998-06-30', o_custkey, o_orderkey, round(o_totalprice, 6) FROM newest WHERE year(made) = 1998""",
    "k10_as_of_join": """
WITH last_of_time AS (
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1
)
SELECT l_suppkey, count(*) AS lines, count(o_orderkey) AS with_order,
       sum(o_orderkey)::BIGINT AS order_keys, round(sum(o_totalprice), 2) AS prices
FROM lineitem ASOF LEFT JOIN last_of_time ON o_custkey = l_suppkey AND o_orderdate <= l_shipdate
GROUP BY l_suppkey""",
    "w_running_orders": """
SELECT o_orderkey, o_orderpriority,
       round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
                                     ROWS UNBOUNDED PRECEDING), 2) AS running
FROM orders""",
    "k11_first_event": """
SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    "s_series": """
SELECT month::BIGINT AS month, nullif(count(o_orderkey), 0) AS orders
FROM generate_series(0, 14) AS s(month) LEFT JOIN orders ON month(o_orderdate) = month
GROUP BY month""",
    "p_predicates": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity,
       min(l_shipdate)::DATE AS first_day
FROM lineitem
WHERE year(l_shipdate) IN (1996, 1997) AND NOT l_shipdate::DATE = DATE '1997-05-05'
  AND (l_linestatus = 'O' OR l_returnflag = 'R') AND list_contains([1, 2, 4, 7], l_linenumber)
  AND l_linenumber < l_quantity AND l_partkey IS NOT NULL
GROUP BY ALL""",
    "j_semi_in": """
SELECT c_mktsegment, count(*) AS customers FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)
GROUP BY c_mktsegment""",
    "j_theta_self": """
WITH pairs AS (
  SELECT a.o_custkey, a.o_totalprice < b.o_totalprice AS rising
  FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey
  WHERE year(a.o_orderdate) = 1996 AND year(b.o_orderdate) = 1997
)
SELECT count(DISTINCT o_custkey) FILTER (rising) AS rising,
       count(DISTINCT o_custkey) FILTER (NOT rising) AS not_rising
FROM pairs""",
    "j_cross_grid": """
SELECT k::BIGINT AS c_nationkey, s AS c_mktsegment, nullif(count(c_custkey), 0) AS customers
FROM range(25) AS nations(k)
CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS s)
LEFT JOIN customer ON c_nationkey = k AND c_mktsegment = s
GROUP BY ALL""",
    "a_distinct_multi": """
SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers,
       count(DISTINCT l_partkey) AS parts, round(avg(l_quantity), 6) AS mean_quantity,
       round(max(l_extendedprice), 6) AS top_price
FROM lineitem GROUP BY ALL""",
    "a_conditional_distinct": """
SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS returned_parts
FROM lineitem GROUP BY l_suppkey""",
    "a_having_hidden": """
SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderpriority) = 5""",
    "w_running_sum": """
WITH monthly AS (
  SELECT o_orderpriority, strftime(o_orderdate, '%Y%m')::BIGINT AS month, sum(o_totalprice) AS total
  FROM orders GROUP BY ALL
)
SELECT a.o_orderpriority, a.month, round(sum(b.total), 2) AS running
FROM monthly AS a JOIN monthly AS b ON a.o_orderpriority = b.o_orderpriority AND b.month <= a.month
GROUP BY ALL""",
    "w_row_number_nth": """
SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[3] AS o_orderkey, 3::BIGINT AS rn
FROM orders GROUP BY o_custkey HAVING count(*) >= 3""",
    "o_label_sort": """
SELECT if(l_quantity::BIGINT > 45, 'over 45', l_quantity::BIGINT::VARCHAR) AS l_quantity, count(*) AS n
FROM lineitem GROUP BY 1 ORDER BY 1""",
    "f_time_functions": """
SELECT ts::DATE AS day, hour(ts) AS hour, count(*) AS n,
       count(*) FILTER (minute(ts) < 55) AS usable, sum(minute(ts))::BIGINT AS minutes,
       sum(date_sub('minute', ts::DATE::TIMESTAMP, ts))::BIGINT AS since_midnight,
       sum(date_sub('minute', ts, ts::DATE::TIMESTAMP))::BIGINT AS to_midnight,
       max(ts + INTERVAL 1 DAY)::DATE AS tomorrow, min(ts - INTERVAL 2 DAY)::DATE AS two_days_ago,
       sum(epoch_us(ts) // 1000000)::BIGINT AS seconds, max(month(ts)) AS month
FROM events GROUP BY ALL""",
    "f_week_sunday": """
SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%U')::BIGINT AS week, count(*) AS orders
FROM orders GROUP BY ALL""",
    "f_casts_concat": """
SELECT if(o_custkey < 10, printf('%02d', o_custkey), o_custkey::VARCHAR) AS customer,
       sum(o_orderkey)::BIGINT AS keys
FROM orders GROUP BY 1""",
    "f_split_offset": """
SELECT lang, string_split(string_split(text, chr(10))[1], ' ')[2] AS second_word, count(*) AS n
FROM documents GROUP BY ALL""",
    "f_case_coalesce": """
SELECT if(o_orderstatus = 'F', 'done', if(o_totalprice > 200000, 'large', NULL)) AS status,
       if(o_orderstatus = 'F', 'done', if(o_totalprice > 200000, 'large', 'other')) AS filled,
       count(*) AS n
FROM orders GROUP BY ALL""",
    "f_division": """
SELECT l_suppkey, round(r / nullif(n - r, 0), 6) AS odds, round(r / n, 6) AS share, r + n AS both
FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r
      FROM lineitem GROUP BY l_suppkey)""",
}


def oracle_sql() -> dict[str, str]:
    return {**{name: TABLES + body for name, body in ON_TABLES.items()}, **PLAIN}
