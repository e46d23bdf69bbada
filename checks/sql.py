"""The same queries in DuckDB SQL, written from the definitions and not from our plans."""

from __future__ import annotations

REF = "DATE '2001-08-02'"

VIEWS = f"""
accounts AS (
  SELECT s_suppkey AS account_id, s_name AS account_name, r_name AS industry, n_name AS country,
    (s_suppkey * 37 % 200) * 100 AS employee_count,
    greatest(s_acctbal, 0e0) * 2e5 AS annual_revenue,
    s_suppkey % 7 = 0 AS is_named_account,
    (s_suppkey % 7 = 0 OR s_suppkey % 4 = 0) AS is_icp_qualified,
    CASE WHEN s_suppkey % 10 < 3 AND s_suppkey % 7 <> 0 THEN NULL
      ELSE CAST(s_suppkey * 13 % 101 AS DOUBLE) END AS intent_score,
    s_suppkey % 33 = 0 AS do_not_contact
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
persons AS (
  SELECT c_custkey AS k, c_name, c_mktsegment,
    CASE WHEN c_custkey % 97 = 96 THEN NULL ELSE concat('u', CAST(
      CASE WHEN c_custkey % 13 = 0 THEN c_custkey - c_custkey % 26 ELSE c_custkey END AS VARCHAR),
      '@x.test') END AS email,
    concat('F', CAST(c_custkey % 50 AS VARCHAR)) AS first_name, c_name AS last_name,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS title,
    CASE c_custkey % 8 WHEN 1 THEN 'Technical Buyer' WHEN 2 THEN 'Financial Buyer'
      WHEN 3 THEN 'IT Operations' WHEN 4 THEN 'Security Engineer' WHEN 5 THEN NULL
      WHEN 6 THEN 'Non-Prospect' ELSE 'CISO' END AS job_persona,
    CASE c_custkey % 7 WHEN 0 THEN 'C-Level' WHEN 1 THEN 'VP' WHEN 2 THEN 'Director'
      WHEN 3 THEN 'Manager' WHEN 4 THEN 'Individual Contributor' WHEN 5 THEN NULL
      ELSE 'Non-Prospect' END AS job_level
  FROM customer
),
leads AS (
  SELECT k AS lead_id, email, first_name, last_name, title, job_persona, job_level,
    c_mktsegment AS lead_source,
    CASE WHEN k % 19 = 0 THEN 'Okta' ELSE c_name END AS company,
    CASE k % 6 WHEN 0 THEN 'New' WHEN 1 THEN 'MQL' WHEN 2 THEN 'Attempted' WHEN 3 THEN 'Qualified'
      WHEN 4 THEN 'Disqualified' ELSE 'Recycled' END AS lead_status,
    CASE WHEN k % 10 < 8 THEN DATE '2001-07-01' + CAST(k % 4 AS INT)
      ELSE DATE '2001-07-01' - CAST(k % 700 AS INT) END AS created_date,
    CASE WHEN k % 4 = 0 THEN {REF} - CAST(k % 60 AS INT) - 1 END AS mql_date,
    k % 3 = 0 AS is_converted,
    CASE k % 15 WHEN 6 THEN k + 2 WHEN 12 THEN k + 1000000 END AS converted_contact_id,
    k * 7 % 300 AS mkto_lead_score,
    k % 11 = 0 AS is_disqualified,
    CASE WHEN k % 11 = 0 THEN {REF} - CAST(30 + k % 335 AS INT) END AS dq_date,
    k % 20 = 0 AS has_opted_out, k % 25 = 1 AS email_bounced
  FROM persons WHERE k % 5 < 3
),
contacts AS (
  SELECT k AS contact_id, email, first_name, last_name, title, job_persona, job_level,
    CASE WHEN k % 50 = 49 THEN NULL WHEN k % 50 = 48 THEN -1
      ELSE CAST(floor(k / 5) AS BIGINT) % (SELECT count(*) FROM supplier) END AS account_id,
    CASE WHEN k % 4 = 0 THEN 'MQL' ELSE 'Active' END AS contact_status, k % 4 = 0 AS is_mql,
    CASE WHEN k % 10 = 3 THEN DATE '2001-07-01' + CAST(k % 4 AS INT)
      ELSE DATE '2001-07-01' - CAST(k % 1000 AS INT) END AS created_date,
    CASE WHEN k % 4 = 0 THEN {REF} - CAST(k % 90 AS INT) - 1 END AS mql_date,
    k * 3 % 120 AS mkto_contact_score,
    k % 5 = 3 AS has_lead_origin, k % 12 = 8 AS no_longer_with_company, k % 24 = 3 AS has_opted_out
  FROM persons WHERE k % 5 >= 3
),
typed_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
    CASE o_orderkey % 7 WHEN 0 THEN 'Webinar' WHEN 1 THEN 'Event' WHEN 2 THEN 'Content Syndication'
      WHEN 3 THEN 'Email' WHEN 4 THEN 'Advertisement' WHEN 5 THEN 'Telemarketing'
      ELSE 'Direct Mail' END AS campaign_type
  FROM orders
),
stated_orders AS (
  SELECT *, CASE
      WHEN campaign_type IN ('Webinar', 'Event') THEN
        CASE o_orderstatus WHEN 'F' THEN 'Attended' WHEN 'O' THEN 'Registered' ELSE 'No Show' END
      WHEN campaign_type = 'Email' THEN
        CASE WHEN o_orderstatus = 'F' THEN 'Clicked' ELSE 'Sent' END
      WHEN campaign_type = 'Telemarketing' THEN
        CASE WHEN o_orderstatus = 'F' THEN 'Contacted' ELSE 'Not Interested' END
      WHEN campaign_type = 'Direct Mail' THEN
        CASE WHEN o_orderstatus = 'F' THEN 'Responded' ELSE 'Sent' END
      ELSE 'Responded' END AS member_status
  FROM typed_orders
),
campaign_members AS (
  SELECT o_orderkey AS cm_id, o_custkey AS entity_id,
    CASE WHEN o_custkey % 5 < 3 THEN 'lead' ELSE 'contact' END AS entity_type,
    concat(campaign_type, '_', CAST(year(day) AS VARCHAR)) AS campaign_name,
    campaign_type, member_status,
    member_status NOT IN ('Sent', 'No Show', 'Not Interested') AS is_responded,
    {REF} - CAST(date_diff('day', day, {REF}) % 240 AS INT) AS response_date
  FROM stated_orders
)"""

CLEAN = """
sightings AS (
  SELECT 'lead' AS entity_type, lead_id AS entity_id, email FROM leads
  UNION ALL SELECT 'contact', contact_id, email FROM contacts
),
email_groups AS (
  SELECT email, count(*) AS n_records,
    min(entity_id) FILTER (entity_type = 'contact') AS first_contact_id
  FROM sightings GROUP BY email
),
lead_days AS (
  SELECT created_date, count(*) AS n FROM leads WHERE created_date IS NOT NULL GROUP BY 1
  HAVING count(*) > 20
),
contact_days AS (
  SELECT created_date, count(*) AS n FROM contacts WHERE created_date IS NOT NULL GROUP BY 1
  HAVING count(*) > 10
),
lead_flags AS (
  SELECT l.*,
    coalesce(company IN ('CrowdStrike', 'Palo Alto Networks', 'Fortinet', 'SentinelOne', 'Zscaler',
      'Okta', 'CyberArk', 'Varonis', 'Rapid7', 'Qualys'), false) AS exclude_competitor,
    coalesce(has_opted_out, false) AS exclude_opted_out,
    coalesce(email_bounced, false) AS exclude_bounced,
    coalesce(job_persona = 'Non-Prospect', false) AS exclude_non_prospect,
    coalesce(is_disqualified, false) AS exclude_disqualified,
    is_converted AND converted_contact_id IS NULL AS dq_broken_conversion,
    g.n_records > 1 AS dq_duplicate_email,
    mql_date IS NOT NULL AND lead_status IN ('Recycled', 'Disqualified') AS dq_mql_overwritten,
    created_date IN (SELECT created_date FROM lead_days) AS dq_etl_timestamp,
    title IS NULL OR job_persona IS NULL AS dq_incomplete,
    g.first_contact_id
  FROM leads l JOIN email_groups g ON l.email IS NOT DISTINCT FROM g.email
),
clean_leads AS (
  SELECT *, exclude_competitor OR exclude_opted_out OR exclude_bounced OR exclude_non_prospect
      OR exclude_disqualified AS is_excluded,
    dq_broken_conversion::INT + dq_duplicate_email::INT + dq_mql_overwritten::INT
      + dq_etl_timestamp::INT + dq_incomplete::INT AS dq_issue_count,
    CASE WHEN dq_broken_conversion AND email IS NOT NULL THEN first_contact_id END
      AS resolved_contact_id
  FROM lead_flags
),
contact_flags AS (
  SELECT c.*,
    coalesce(has_opted_out, false) AS exclude_opted_out,
    coalesce(no_longer_with_company, false) AS exclude_no_longer,
    coalesce(job_persona = 'Non-Prospect', false) AS exclude_non_prospect,
    coalesce(account_id IN (SELECT account_id FROM accounts WHERE do_not_contact), false)
      AS exclude_dnc_account,
    g.n_records > 1 AS dq_duplicate_email,
    false AS dq_mql_overwritten,
    created_date IN (SELECT created_date FROM contact_days) AS dq_etl_timestamp,
    title IS NULL OR job_persona IS NULL AS dq_incomplete
  FROM contacts c JOIN email_groups g ON c.email IS NOT DISTINCT FROM g.email
),
clean_contacts AS (
  SELECT *, exclude_opted_out OR exclude_no_longer OR exclude_non_prospect OR exclude_dnc_account
      AS is_excluded,
    dq_duplicate_email::INT + dq_etl_timestamp::INT + dq_incomplete::INT AS dq_issue_count
  FROM contact_flags
),
people AS (
  SELECT 'lead' AS entity_type, lead_id AS entity_id, * FROM clean_leads
  UNION ALL BY NAME
  SELECT 'contact' AS entity_type, contact_id AS entity_id, c.*, a.account_name, a.industry,
    a.is_named_account, a.is_icp_qualified, a.intent_score, a.employee_count, a.annual_revenue,
    CASE WHEN a.account_id IS NOT NULL THEN 1 END AS account_found
  FROM clean_contacts c LEFT JOIN accounts a USING (account_id)
)"""

FEATURES = f"""
aged AS (
  SELECT *, date_diff('day', response_date, {REF}) AS age FROM campaign_members
),
engagement AS (
  SELECT entity_type, entity_id,
    count(*) AS total_engagements,
    count(*) FILTER (is_responded) AS real_engagements,
    count(*) FILTER (is_responded AND age <= 30) AS engagement_last_30d,
    count(*) FILTER (is_responded AND age <= 90) AS engagement_last_90d,
    count(*) FILTER (is_responded AND age <= 180) AS engagement_last_180d,
    count(*) FILTER (is_responded AND age > 30 AND age <= 60) AS previous_30d,
    coalesce(min(age) FILTER (is_responded), 999) AS days_since_last_engagement,
    CAST(count(*) FILTER (campaign_type = 'Email' AND member_status = 'Sent') AS DOUBLE) / count(*)
      AS automation_ratio,
    count(DISTINCT campaign_type) AS campaign_type_diversity,
    count(*) FILTER (campaign_type = 'Webinar' AND member_status = 'Attended')
      AS webinar_attendances,
    count(*) FILTER (campaign_type = 'Event' AND member_status = 'Attended') AS event_attendances,
    count(*) FILTER (campaign_type = 'Content Syndication' AND is_responded) AS content_responses
  FROM aged GROUP BY ALL
),
features AS (
  SELECT p.*,
    coalesce(e.total_engagements, 0) AS total_engagements,
    coalesce(e.real_engagements, 0) AS real_engagements,
    coalesce(e.engagement_last_30d, 0) AS engagement_last_30d,
    coalesce(e.engagement_last_90d, 0) AS engagement_last_90d,
    coalesce(e.engagement_last_180d, 0) AS engagement_last_180d,
    coalesce(e.days_since_last_engagement, 999) AS days_since_last_engagement,
    coalesce(e.automation_ratio, 0e0) AS automation_ratio,
    coalesce(e.campaign_type_diversity, 0) AS campaign_type_diversity,
    coalesce(e.webinar_attendances, 0) AS webinar_attendances,
    coalesce(e.event_attendances, 0) AS event_attendances,
    coalesce(e.content_responses, 0) AS content_responses,
    CASE WHEN coalesce(e.real_engagements, 0) < 2 THEN 0e0
      WHEN e.previous_30d = 0 THEN CASE WHEN e.engagement_last_30d > 0 THEN 1e0 ELSE 0e0 END
      ELSE greatest(least(CAST(e.engagement_last_30d - e.previous_30d AS DOUBLE) / e.previous_30d,
        2e0), 0e0) END AS momentum_score,
    coalesce(e.real_engagements >= 2 AND e.engagement_last_30d > e.previous_30d, false)
      AS is_accelerating,
    CASE p.job_level WHEN 'C-Level' THEN 1e0 WHEN 'VP' THEN 0.85e0 WHEN 'Director' THEN 0.7e0
      WHEN 'Manager' THEN 0.5e0 WHEN 'Individual Contributor' THEN 0.3e0 ELSE 0.2e0 END
      AS level_score,
    CASE p.job_persona WHEN 'CISO' THEN 1e0 WHEN 'Technical Buyer' THEN 0.9e0
      WHEN 'Financial Buyer' THEN 0.7e0 WHEN 'IT Operations' THEN 0.6e0
      WHEN 'Security Engineer' THEN 0.5e0 WHEN 'Non-Prospect' THEN 0e0 ELSE 0.2e0 END
      AS persona_score,
    (p.title IS NOT NULL)::INT AS has_title,
    (p.job_persona IS NOT NULL AND p.job_persona <> 'Non-Prospect')::INT AS has_persona,
    (p.account_found = 1 AND coalesce(p.is_icp_qualified, false)) IS TRUE AS icp,
    (p.account_found = 1 AND coalesce(p.is_named_account, false)) IS TRUE AS named,
    CASE WHEN p.account_found = 1 THEN p.intent_score / 100e0 ELSE 0e0 END AS account_intent,
    CASE WHEN p.account_found = 1 AND p.employee_count IS NULL THEN NULL
      WHEN p.account_found = 1 THEN least(p.employee_count / 1e4, 1e0) ELSE 0e0 END
      AS account_employee_score,
    CASE WHEN p.account_found = 1 AND p.annual_revenue IS NULL THEN NULL
      WHEN p.account_found = 1 THEN least(p.annual_revenue / 1e9, 1e0) ELSE 0e0 END
      AS account_revenue_score,
    coalesce(p.account_found, 0) AS has_account
  FROM people p LEFT JOIN engagement e USING (entity_type, entity_id)
),
raw_scores AS (
  SELECT *,
    (CASE WHEN days_since_last_engagement >= 999 THEN 0e0
      ELSE 100e0 * exp(-0.693e0 * days_since_last_engagement / 45e0) END) * 0.4e0
    + least(engagement_last_30d * 20e0 + engagement_last_90d * 5e0, 100e0) * 0.3e0
    + least(campaign_type_diversity * 10e0, 30e0)
    + least(webinar_attendances * 15e0 + event_attendances * 20e0 + content_responses * 10e0, 40e0)
    - automation_ratio * 30e0 AS raw_engagement,
    level_score * 50e0 + persona_score * 50e0 + (has_title + has_persona) * 10e0 AS raw_profile,
    named::INT * 30e0 + icp::INT * 25e0 + account_intent * 30e0
      + (account_employee_score + account_revenue_score) * 7.5e0 AS raw_account,
    least(momentum_score * 40e0, 80e0) + CASE WHEN is_accelerating THEN 20e0 ELSE 0e0 END
      AS raw_momentum
  FROM features
),
components AS (
  SELECT *,
    greatest(least(raw_engagement, 100e0), 0e0) AS score_engagement,
    greatest(least(raw_profile, 100e0), 0e0) AS score_profile,
    CASE WHEN has_account = 0 THEN 15e0 WHEN raw_account IS NULL THEN NULL
      ELSE greatest(least(raw_account, 100e0), 0e0) END AS score_account,
    CASE WHEN engagement_last_30d = 0 THEN 0e0
      ELSE greatest(least(raw_momentum, 100e0), 0e0) END AS score_momentum
  FROM raw_scores
),
scored AS (
  SELECT *, round_even((score_engagement * 0.4e0 + score_profile * 0.25e0 + score_account * 0.2e0
    + score_momentum * 0.15e0) * 10e0, 0) / 10e0 AS readiness_score
  FROM components
),
tiered AS (
  SELECT *, CASE WHEN readiness_score >= 70 THEN 'Hot' WHEN readiness_score >= 45 THEN 'Warm'
    WHEN readiness_score >= 20 THEN 'Nurture' ELSE 'Cold' END AS tier
  FROM scored
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY readiness_score DESC NULLS LAST, entity_type, entity_id)
    AS rank
  FROM tiered
)"""

WHAT_IF = """
rescored AS (
  SELECT *, round_even((score_engagement * 0.6e0 + score_profile * 0.15e0 + score_account * 0.15e0
    + score_momentum * 0.1e0) * 100e0, 0) / 100e0 AS new_score
  FROM ranked WHERE NOT is_excluded
),
moved AS (
  SELECT *, CASE WHEN new_score >= 80 THEN 'Hot' WHEN new_score >= 55 THEN 'Warm'
      WHEN new_score >= 25 THEN 'Nurture' ELSE 'Cold' END AS new_tier,
    row_number() OVER (ORDER BY new_score DESC NULLS LAST, entity_type, entity_id) AS new_rank
  FROM rescored
)"""


def on_views(sql: str) -> str:
    return f"WITH {VIEWS} {sql}"


def on_clean(sql: str) -> str:
    return f"WITH {VIEWS}, {CLEAN} {sql}"


def on_scored(sql: str) -> str:
    return f"WITH {VIEWS}, {CLEAN}, {FEATURES} {sql}"


def on_moved(sql: str) -> str:
    return f"WITH {VIEWS}, {CLEAN}, {FEATURES}, {WHAT_IF} {sql}"


FLAGS = """
concat_ws(' | ',
  CASE WHEN is_excluded AND exclude_competitor THEN '🚫 Competitor' END,
  CASE WHEN is_excluded AND exclude_opted_out THEN '🚫 Opted Out' END,
  CASE WHEN is_excluded AND exclude_bounced THEN '🚫 Bounced' END,
  CASE WHEN is_excluded AND exclude_non_prospect THEN '🚫 Non Prospect' END,
  CASE WHEN is_excluded AND exclude_disqualified THEN '🚫 Disqualified' END,
  CASE WHEN is_excluded AND exclude_no_longer THEN '🚫 No Longer' END,
  CASE WHEN is_excluded AND exclude_dnc_account THEN '🚫 Dnc Account' END,
  CASE WHEN dq_issue_count > 0 THEN concat('⚠️ ', CAST(dq_issue_count AS VARCHAR), ' DQ') END)"""

COMPONENTS = """round(score_engagement, 6) AS score_engagement,
round(score_profile, 6) AS score_profile, round(score_account, 6) AS score_account,
round(score_momentum, 6) AS score_momentum"""

LISTED = f"""rank, entity_type, entity_id, tier, readiness_score, first_name, last_name, title,
{FLAGS} AS flags, {COMPONENTS}"""


def summary(metric: str, column: str) -> str:
    return f"""'{metric}' AS metric, count({column}) AS n, round(avg({column}), 6) AS mean,
round(stddev_samp({column}), 6) AS std, round(CAST(min({column}) AS DOUBLE), 6) AS min,
round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS q25,
round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS q50,
round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS q75,
round(CAST(max({column}) AS DOUBLE), 6) AS max"""


def one_score(name: str) -> str:
    return on_scored(f"SELECT entity_type, entity_id, round({name}, 6) AS {name} FROM scored")


def status_part(table: str, kind: str, status: str, flags: list[str]) -> str:
    parts = [
        f"""SELECT '{kind}' AS entity_type, '{status}' AS measure, {status} AS value,
        count(*) AS records FROM {table} GROUP BY {status}"""
    ] + [
        f"""SELECT '{kind}', '{f}', 'true', count(*) FILTER ({f}) FROM {table}""" for f in flags
    ]
    return f"""SELECT *, round(records * 100e0 / (SELECT count(*) FROM {table}), 6) AS pct
    FROM ({' UNION ALL '.join(parts)})"""


def null_part(table: str, kind: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{kind}' AS entity_type, '{c}' AS column_name,
        count(*) FILTER ({c} IS NULL) AS missing,
        round(count(*) FILTER ({c} IS NULL) * 100e0 / count(*), 6) AS null_pct FROM {table}"""
        for c in ("email", "title", "job_persona", "job_level", "mql_date")
    )


def prevalence_part(table: str, kind: str, flags: list[str]) -> str:
    parts = [(f, f) for f in [*flags, "is_excluded"]] + [
        ("issues_0", "dq_issue_count = 0"),
        ("issues_1_or_more", "dq_issue_count >= 1"),
        ("issues_3_or_more", "dq_issue_count >= 3"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS entity_type, '{name}' AS flag, count(*) FILTER ({test}) AS records "
        f"FROM {table}"
        for name, test in parts
    )


def finding(key, issue, severity, handling, scoring, operational, table, population, hit, confidence, rule) -> str:
    return f"""SELECT '{key}' AS finding, '{issue}' AS issue,
    count(*) FILTER ({population}) AS population, count(*) FILTER ({hit}) AS affected,
    round(CASE WHEN count(*) FILTER ({population}) = 0 THEN 0e0 ELSE
      count(*) FILTER ({hit}) * 100e0 / count(*) FILTER ({population}) END, 6) AS prevalence_pct,
    '{severity}' AS severity, '{handling}' AS handling, '{scoring}' AS scoring_impact,
    '{operational}' AS operational_impact, '{confidence}' AS confidence,
    '{rule}: ' || count(*) FILTER ({hit}) || ' of ' || count(*) FILTER ({population}) AS evidence FROM {table}"""


def scale_finding(key, issue, severity, handling, scoring, operational, confidence, rule) -> str:
    """Imported scores count if medians or upper quartiles of leads and contacts are more than half apart."""
    quantiles = ", ".join(
        f"quantile_cont(CAST(mkto_{kind}_score AS DOUBLE), 0.{p}) AS {kind}_{p}" for kind in ("lead", "contact") for p in (50, 75)
    )
    apart = " OR ".join(
        f"abs(lead_{p} - contact_{p}) > 0.5e0 * least(abs(lead_{p}), abs(contact_{p}))" for p in (50, 75)
    )
    lead, contact = (
        " || ', ' || ".join(f"coalesce(CAST(CAST({kind}_{p} AS DECIMAL(18,2)) AS VARCHAR), 'none')" for p in (50, 75))
        for kind in ("lead", "contact")
    )
    return f"""SELECT '{key}' AS finding, '{issue}' AS issue, population, affected,
    round(CASE WHEN population = 0 THEN 0e0 ELSE affected * 100e0 / population END, 6) AS prevalence_pct,
    '{severity}' AS severity, '{handling}' AS handling, '{scoring}' AS scoring_impact,
    '{operational}' AS operational_impact, '{confidence}' AS confidence,
    '{rule}: leads ' || {lead} || '; contacts ' || {contact} AS evidence
    FROM (SELECT *, CASE WHEN {apart} THEN given ELSE 0 END AS affected FROM (SELECT count(*) AS population,
      count(*) FILTER (mkto_lead_score IS NOT NULL OR mkto_contact_score IS NOT NULL) AS given, {quantiles} FROM people))"""


def etl_part(kind: str, table: str, days: str) -> str:
    return f"""SELECT '{kind}' AS entity_type, CAST(created_date AS VARCHAR) AS created_date,
    n AS n_records, round(n * 100e0 / (SELECT count(*) FROM {table}), 6) AS pct_of_records,
    round((SELECT CAST(sum(n) AS BIGINT) FROM {days}) * 100e0 / (SELECT count(*) FROM {table}), 6)
      AS pct_on_bulk_dates FROM {days}"""


def histogram_part(dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {dimension} AS value, bin, count(*) AS records,
    round(bin * 100e0 / 30, 6) AS bin_start FROM binned GROUP BY {dimension}, bin"""


def weights_part(name: str, w: tuple[str, str, str, str]) -> str:
    score = f"""round_even((score_engagement * {w[0]}e0 + score_profile * {w[1]}e0
    + score_account * {w[2]}e0 + score_momentum * {w[3]}e0) * 10e0, 0) / 10e0"""
    return f"""SELECT '{name}' AS weight_set, round(avg({score}), 6) AS mean_readiness,
    count(*) FILTER ({score} >= 70) AS hot_records FROM scored"""


def tiers_part(name: str, hot: int, warm: int, nurture: int) -> str:
    tests = {
        "Hot": f"readiness_score >= {hot}",
        "Warm": f"readiness_score < {hot} AND readiness_score >= {warm}",
        "Nurture": f"readiness_score < {warm} AND readiness_score >= {nurture}",
        "Cold": f"readiness_score IS NULL OR readiness_score < {nurture}",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS tier_set, '{t}' AS tier, count(*) FILTER ({test}) AS records FROM scored"
        for t, test in tests.items()
    )


def titles(flags: list[str]) -> str:
    def title(flag: str) -> str:
        return flag.split("_", 1)[1].replace("_", " ").title()

    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} THEN '{title(f)}' END" for f in flags) + ")"


ENGAGEMENT = """total_engagements, real_engagements, engagement_last_30d, engagement_last_90d,
engagement_last_180d, days_since_last_engagement, round(automation_ratio, 6) AS automation_ratio,
campaign_type_diversity, webinar_attendances, event_attendances, content_responses"""
MOMENTUM = "round(momentum_score, 6) AS momentum_score, is_accelerating"
PROFILE = "level_score, persona_score, has_title, has_persona"
ACCOUNT = """icp::INT AS account_is_icp, named::INT AS account_is_named,
round(account_intent, 6) AS account_intent,
round(account_employee_score, 6) AS account_employee_score,
round(account_revenue_score, 6) AS account_revenue_score, has_account"""

TAGGED = """, tagged AS (
  SELECT 'active_vp' AS cohort, * FROM ranked WHERE job_level = 'VP' AND score_engagement > 60
  UNION ALL SELECT 'ghost', * FROM ranked WHERE score_engagement < 10 AND score_profile > 60
  UNION ALL SELECT 'bot', * FROM ranked WHERE automation_ratio > 0.7e0
  UNION ALL SELECT 'excluded_competitor', * FROM ranked WHERE is_excluded AND exclude_competitor)"""

LEAD_EXCLUSIONS = ["exclude_competitor", "exclude_opted_out", "exclude_bounced",
                   "exclude_non_prospect", "exclude_disqualified"]
CONTACT_EXCLUSIONS = ["exclude_opted_out", "exclude_no_longer", "exclude_non_prospect",
                      "exclude_dnc_account"]
LEAD_DQ = ["dq_broken_conversion", "dq_duplicate_email", "dq_mql_overwritten", "dq_etl_timestamp",
           "dq_incomplete"]
CONTACT_DQ = LEAD_DQ[1:]

ALL: dict[str, str] = {
    "dnc_accounts": on_views("SELECT account_id FROM accounts WHERE do_not_contact"),
    "lead_exclusions": on_clean(
        f"SELECT lead_id, {', '.join(LEAD_EXCLUSIONS)}, is_excluded FROM clean_leads"
    ),
    "contact_exclusions": on_clean(
        f"SELECT contact_id, {', '.join(CONTACT_EXCLUSIONS)}, is_excluded FROM clean_contacts"
    ),
    "lead_dq_flags": on_clean(
        f"SELECT lead_id, {', '.join(LEAD_DQ)}, dq_issue_count FROM clean_leads"
    ),
    "contact_dq_flags": on_clean(
        f"SELECT contact_id, {', '.join(CONTACT_DQ)}, dq_issue_count FROM clean_contacts"
    ),
    "duplicate_emails": on_clean("SELECT email, n_records FROM email_groups WHERE n_records > 1"),
    "duplicate_email_audit": on_clean(
        """SELECT CAST(sum(n_records) AS BIGINT) AS email_records,
        CAST(sum(n_records) FILTER (n_records > 1) AS BIGINT) AS records_in_duplicates,
        count(*) FILTER (n_records > 1 AND email IS NOT NULL) AS duplicate_emails
        FROM email_groups"""
    ),
    "etl_dates": on_clean(
        etl_part("lead", "leads", "lead_days")
        + " UNION ALL "
        + etl_part("contact", "contacts", "contact_days")
    ),
    "resolve_conversions": on_clean(
        """SELECT lead_id, dq_broken_conversion,
        CAST(resolved_contact_id AS VARCHAR) AS resolved_contact_id FROM clean_leads"""
    ),
    "dangling_conversions": on_views(
        """SELECT lead_id, converted_contact_id FROM leads
        WHERE converted_contact_id IS NOT NULL
          AND converted_contact_id NOT IN (SELECT contact_id FROM contacts)"""
    ),
    "cleaning_stats": on_clean(
        """SELECT (SELECT count(*) FROM leads) AS total_leads,
        (SELECT count(*) FROM contacts) AS total_contacts,
        (SELECT count(*) FROM clean_leads WHERE is_excluded) AS excluded_leads,
        (SELECT count(*) FROM clean_contacts WHERE is_excluded) AS excluded_contacts,
        (SELECT count(*) FROM clean_leads WHERE dq_broken_conversion) AS broken_conversions,
        (SELECT count(resolved_contact_id) FROM clean_leads) AS resolved_conversions,
        (SELECT count(*) FROM email_groups WHERE n_records > 1) AS duplicate_emails"""
    ),
    "engagement_features": on_scored(f"SELECT entity_type, entity_id, {ENGAGEMENT} FROM features"),
    "momentum_features": on_scored(f"SELECT entity_type, entity_id, {MOMENTUM} FROM features"),
    "profile_features": on_scored(f"SELECT entity_type, entity_id, {PROFILE} FROM features"),
    "account_features": on_scored(f"SELECT entity_type, entity_id, {ACCOUNT} FROM features"),
    "entity_features": on_scored(
        f"SELECT entity_type, entity_id, {ENGAGEMENT}, {PROFILE}, {ACCOUNT}, {MOMENTUM} FROM features"
    ),
    "score_engagement": one_score("score_engagement"),
    "score_profile": one_score("score_profile"),
    "score_account": one_score("score_account"),
    "score_momentum": one_score("score_momentum"),
    "readiness": on_scored(
        f"SELECT entity_type, entity_id, {COMPONENTS}, readiness_score FROM scored"
    ),
    "custom_scorer": on_scored(
        """, deep AS (SELECT *, real_engagements * 100e0 / greatest(total_engagements, 1)
          AS depth FROM scored)
        SELECT entity_type, entity_id, round(depth, 6) AS score_depth,
          round_even((score_engagement * 0.35e0 + score_profile * 0.25e0 + score_account * 0.2e0
          + score_momentum * 0.1e0 + depth * 0.1e0) * 10e0, 0) / 10e0 AS readiness_score
        FROM deep"""
    ),
    "what_if_custom": on_scored(
        """, deep AS (SELECT *, real_engagements * 100e0 / greatest(total_engagements, 1)
          AS depth FROM scored WHERE NOT is_excluded),
        again AS (SELECT *, round_even((score_engagement * 0.25e0 + score_profile * 0.25e0
          + score_account * 0.125e0 + score_momentum * 0.125e0 + depth * 0.25e0) * 100e0, 0) / 100e0
          AS new_score FROM deep)
        SELECT entity_type, entity_id, new_score, CASE WHEN new_score >= 70 THEN 'Hot'
          WHEN new_score >= 45 THEN 'Warm' WHEN new_score >= 20 THEN 'Nurture' ELSE 'Cold' END AS new_tier
        FROM again"""
    ),
    "score_metrics": on_scored(
        """SELECT round(avg(readiness_score), 6) AS mean_score,
        round(median(readiness_score), 6) AS median_score,
        round(stddev_samp(readiness_score), 6) AS std_score FROM scored"""
    ),
    "tier_distribution": on_scored("SELECT tier, count(*) AS records FROM tiered GROUP BY tier"),
    "ranked_records": on_scored(
        f"""SELECT rank, entity_type, entity_id, tier, readiness_score, {COMPONENTS}, email,
        first_name, last_name, title, company, lead_status, contact_status, job_persona, job_level,
        CAST(created_date AS VARCHAR) AS created_date, CAST(mql_date AS VARCHAR) AS mql_date,
        account_name, industry, intent_score, is_excluded, dq_issue_count FROM ranked"""
    ),
    "top_callable": on_scored(
        f"SELECT {LISTED} FROM ranked WHERE NOT is_excluded ORDER BY rank LIMIT 500"
    ),
    "ranked_list": on_scored(
        f"SELECT {LISTED} FROM ranked WHERE tier IN ('Hot', 'Warm', 'Nurture')"
    ),
    "population": on_scored(
        """SELECT count(*) AS total, count(*) FILTER (is_excluded) AS excluded,
        count(*) FILTER (NOT is_excluded) AS scorable FROM ranked"""
    ),
    "ranked_page": on_scored(
        f"""SELECT {LISTED}, (SELECT count(*) FROM ranked WHERE tier IN ('Hot', 'Warm')
          AND NOT is_excluded) AS matching FROM ranked
        WHERE tier IN ('Hot', 'Warm') AND NOT is_excluded ORDER BY rank LIMIT 100"""
    ),
    "cohorts": on_scored(
        f"""{TAGGED} SELECT cohort, rank, entity_type, entity_id, readiness_score,
          round(score_engagement, 6) AS score_engagement, round(score_profile, 6) AS score_profile,
          tier FROM tagged"""
    ),
    "cohort_leaders": on_scored(
        f"""{TAGGED} SELECT cohort, members, rank, entity_type, entity_id, readiness_score, tier FROM (
          SELECT *, count(*) OVER (PARTITION BY cohort) AS members,
            row_number() OVER (PARTITION BY cohort ORDER BY rank) AS place FROM tagged)
        WHERE place = 1"""
    ),
    "record_lookup": on_scored(
        f"""SELECT entity_type, entity_id, rank,
        {titles([*LEAD_EXCLUSIONS, 'exclude_no_longer', 'exclude_dnc_account'])}
          AS active_exclusions,
        {titles(LEAD_DQ)} AS active_issues FROM ranked"""
    ),
    "record_labels": on_scored(
        """SELECT rank, entity_type, entity_id,
        concat('#', CAST(rank AS VARCHAR), ' | ', CAST(entity_id AS VARCHAR), ' | ', first_name, ' ',
          last_name, ' | Score: ', coalesce(printf('%.1f', readiness_score), '')) AS label
        FROM ranked WHERE NOT is_excluded ORDER BY rank LIMIT 200"""
    ),
    "engagement_history": on_views(
        """, placed AS (
          SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id
              ORDER BY response_date DESC NULLS LAST, cm_id) AS position,
            count(*) OVER w AS total_memberships,
            count(*) FILTER (is_responded) OVER w AS real_responses,
            count(*) FILTER (NOT is_responded) OVER w AS automated
          FROM campaign_members WINDOW w AS (PARTITION BY entity_type, entity_id))
        SELECT entity_type, entity_id, cm_id, campaign_type, campaign_name, member_status,
          is_responded, CAST(response_date AS VARCHAR) AS response_date, position,
          total_memberships, real_responses, automated FROM placed WHERE position <= 20"""
    ),
    "tier_stats": on_scored(
        """SELECT tier, count(readiness_score) AS records,
        round_even(avg(readiness_score) * 10e0, 0) / 10e0 AS avg_score,
        round_even(avg(score_engagement) * 10e0, 0) / 10e0 AS avg_engagement,
        round_even(avg(score_profile) * 10e0, 0) / 10e0 AS avg_profile
        FROM ranked WHERE NOT is_excluded GROUP BY tier"""
    ),
    "fairness": on_scored(
        """SELECT entity_type, count(readiness_score) AS records,
        round_even(avg(readiness_score) * 10e0, 0) / 10e0 AS mean_score,
        round_even(median(readiness_score) * 10e0, 0) / 10e0 AS median_score,
        round_even(avg(CASE WHEN tier = 'Hot' THEN 1e0 ELSE 0e0 END) * 100e0 * 10e0, 0) / 10e0
          AS pct_hot
        FROM ranked WHERE NOT is_excluded GROUP BY entity_type"""
    ),
    "score_histogram": on_scored(
        f""", binned AS (SELECT *, CAST(least(floor(readiness_score * 30 / 100e0), 29) AS BIGINT) AS bin
          FROM ranked WHERE NOT is_excluded AND readiness_score IS NOT NULL)
        {histogram_part('tier')} UNION ALL {histogram_part('entity_type')}"""
    ),
    "score_scatter": on_scored(
        """SELECT entity_type, entity_id, tier, round(score_engagement, 6) AS score_engagement,
        round(score_profile, 6) AS score_profile, readiness_score FROM ranked
        WHERE NOT is_excluded AND readiness_score IS NOT NULL AND score_engagement IS NOT NULL
          AND score_profile IS NOT NULL"""
    ),
    "what_if_ranks": on_moved(
        """SELECT entity_type, entity_id, rank, new_rank, rank - new_rank AS rank_change, new_score,
        new_tier FROM moved"""
    ),
    "what_if_impact": on_moved(
        """SELECT count(*) FILTER (tier = 'Hot') AS old_hot,
        count(*) FILTER (new_tier = 'Hot') AS new_hot,
        count(*) FILTER (tier = 'Warm') AS old_warm,
        count(*) FILTER (new_tier = 'Warm') AS new_warm,
        round(avg(readiness_score), 6) AS old_mean, round(avg(new_score), 6) AS new_mean,
        round(avg(abs(rank - new_rank)), 6) AS mean_rank_shift FROM moved"""
    ),
    "what_if_tiers": on_moved(
        """SELECT t.tier, (SELECT count(*) FROM moved m WHERE m.tier = t.tier) AS before,
        (SELECT count(*) FROM moved m WHERE m.new_tier = t.tier) AS after
        FROM (VALUES ('Hot'), ('Warm'), ('Nurture'), ('Cold')) t(tier)"""
    ),
    "what_if_top": on_moved(
        """SELECT new_rank, entity_type, entity_id, new_score, new_tier FROM moved
        ORDER BY new_rank LIMIT 10"""
    ),
    "rank_movers": on_moved(
        """SELECT entity_type, entity_id, rank, new_rank, rank - new_rank AS rank_change FROM moved
        ORDER BY rank_change DESC, entity_type, entity_id LIMIT 10"""
    ),
    "weight_sensitivity": on_scored(
        " UNION ALL ".join(
            [
                weights_part("default", ("0.4", "0.25", "0.2", "0.15")),
                weights_part("engagement_heavy", ("0.6", "0.15", "0.15", "0.1")),
                weights_part("profile_heavy", ("0.25", "0.45", "0.2", "0.1")),
            ]
        )
    ),
    "tier_sensitivity": on_scored(
        tiers_part("default", 70, 45, 20) + " UNION ALL " + tiers_part("strict", 80, 55, 25)
    ),
    "persona_audit": on_scored(
        """, expected AS (
          SELECT entity_type, entity_id, CASE
            WHEN job_persona = 'Non-Prospect' THEN 'outsider'
            WHEN coalesce(has_opted_out, false) OR coalesce(email_bounced, false)
              OR coalesce(is_disqualified, false) OR coalesce(no_longer_with_company, false)
              THEN 'blocked'
            WHEN job_persona = 'CISO' AND job_level IN ('C-Level', 'VP') THEN 'chief'
            WHEN job_persona IS NULL AND title IS NULL THEN 'unknown' END AS persona
          FROM people)
        SELECT entity_type, entity_id, persona, readiness_score,
          CASE WHEN is_excluded THEN 'EXCLUDED' ELSE tier END AS outcome,
          CASE WHEN is_excluded THEN persona IN ('outsider', 'blocked')
            WHEN persona = 'chief' THEN tier IN ('Hot', 'Warm', 'Nurture')
            WHEN persona = 'unknown' THEN tier IN ('Warm', 'Nurture', 'Cold')
            ELSE false END AS as_expected
        FROM expected JOIN ranked USING (entity_type, entity_id) WHERE persona IS NOT NULL"""
    ),
    "status_distribution": on_views(
        status_part(
            "leads",
            "lead",
            "lead_status",
            ["is_converted", "is_disqualified", "has_opted_out", "email_bounced"],
        )
        + " UNION ALL "
        + status_part(
            "contacts",
            "contact",
            "contact_status",
            ["has_lead_origin", "no_longer_with_company", "has_opted_out"],
        )
    ),
    "engagement_summary": on_views(
        f""", per AS (SELECT entity_type, entity_id, count(cm_id) AS total,
          count(*) FILTER (is_responded) AS real FROM campaign_members GROUP BY 1, 2)
        SELECT {summary('total', 'total')} FROM per UNION ALL
        SELECT {summary('real', '"real"')} FROM per"""
    ),
    "recency_summary": on_views(
        f""", real_ages AS (SELECT date_diff('day', response_date, {REF}) AS d
          FROM campaign_members WHERE is_responded)
        SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std,
          min(d) AS min, round(quantile_cont(CAST(d AS DOUBLE), 0.25), 6) AS q25,
          round(quantile_cont(CAST(d AS DOUBLE), 0.5), 6) AS q50,
          round(quantile_cont(CAST(d AS DOUBLE), 0.75), 6) AS q75, max(d) AS max,
          round(avg(CASE WHEN d <= 30 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_30d,
          round(avg(CASE WHEN d <= 90 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS pct_90d
        FROM real_ages"""
    ),
    "account_profile": on_views(
        "SELECT count(*) AS accounts, "
        + ", ".join(
            f"count(*) FILTER ({c}) AS n_{c}, "
            f"round(count(*) FILTER ({c}) * 100e0 / count(*), 6) AS pct_{c}"
            for c in ("is_named_account", "is_icp_qualified", "do_not_contact")
        )
        + " FROM accounts"
    ),
    "intent_summary": on_views(f"SELECT {summary('intent_score', 'intent_score')} FROM accounts"),
    "null_rates": on_views(null_part("leads", "lead") + " UNION ALL " + null_part("contacts", "contact")),
    "flag_prevalence": on_clean(
        prevalence_part("clean_leads", "lead", LEAD_EXCLUSIONS + LEAD_DQ)
        + " UNION ALL "
        + prevalence_part("clean_contacts", "contact", CONTACT_EXCLUSIONS + CONTACT_DQ)
    ),
    "score_summary": on_scored(
        " UNION ALL ".join(
            f"SELECT {summary(c, c)} FROM scored"
            for c in (
                "score_engagement",
                "score_profile",
                "score_account",
                "score_momentum",
                "readiness_score",
            )
        )
    ),
    "score_field_quartiles": on_views(
        f"""SELECT {summary('mkto_lead_score', 'mkto_lead_score')} FROM leads UNION ALL
        SELECT {summary('mkto_contact_score', 'mkto_contact_score')} FROM contacts"""
    ),
    "automation_audit": on_views(
        """SELECT count(*) AS memberships,
        count(*) FILTER (campaign_type = 'Email') AS email_memberships,
        round(count(*) FILTER (campaign_type = 'Email') * 100e0 / count(*), 6) AS email_pct,
        count(*) FILTER (campaign_type = 'Email' AND member_status = 'Sent') AS auto_sends,
        round(count(*) FILTER (campaign_type = 'Email' AND member_status = 'Sent') * 100e0
          / count(*), 6) AS auto_pct,
        count(*) FILTER (is_responded) AS responded FROM campaign_members"""
    ),
    "dq_findings": on_clean(
        " UNION ALL ".join(
            finding(*f)
            for f in [
                ("DQ-1", "Broken entity links", "High", "Resolve", "Distorts", "Misses prospects",
                 "clean_leads", "is_converted", "dq_broken_conversion",
                 "High", "converted leads without a contact"),
                ("DQ-2", "Email duplication", "Medium", "Flag", "Distorts", "Wastes calls",
                 "people", "true", "dq_duplicate_email",
                 "High", "records that share an e-mail"),
                ("DQ-3", "Temporal field overwrites", "Low", "Flag", "Neutral", "None",
                 "clean_leads", "true", "dq_mql_overwritten",
                 "Medium", "leads with an MQL date in an undone status"),
                ("DQ-4", "ETL-dominated timestamps", "Medium", "Flag", "Neutral", "None",
                 "people", "true", "dq_etl_timestamp",
                 "Medium", "records created on a bulk-load date"),
                ("DQ-6", "Non-prospect contamination", "High", "Exclude", "Inflates", "Wastes calls",
                 "people", "true", "exclude_non_prospect OR exclude_competitor",
                 "High", "non-prospects and competitors"),
                ("DQ-7", "Data completeness gaps", "Medium", "Flag", "Deflates", "Misses prospects",
                 "people", "true", "dq_incomplete",
                 "High", "records without title, persona or phone"),
                ("DQ-8", "Automation-inflated engagement", "High", "Filter", "Inflates",
                 "Wastes calls", "campaign_members", "true",
                 "campaign_type = 'Email' AND member_status = 'Sent'",
                 "High", "automatic e-mail sends"),
                ("DQ-9", "Structural contact blocks", "Critical", "Exclude", "Neutral", "Legal risk",
                 "people", "true", "exclude_opted_out OR exclude_bounced OR exclude_dnc_account",
                 "High", "records that opted out, bounced or belong to a blocked account"),
                ("DQ-10", "Qualification cycling", "Low", "Flag", "Inflates", "Wastes calls",
                 "clean_leads", "true", "mql_date > dq_date",
                 "Medium", "leads qualified again after disqualification"),
            ]
        )
        + " UNION ALL "
        + scale_finding("DQ-5", "Score field asymmetry", "Medium", "Filter", "Distorts", "None",
                        "Medium", "median and upper quartile of imported scores")
    ),
}

ALL |= {
    "stored_history": ALL["engagement_history"],
    "stored_engagement": on_scored(
        f"SELECT entity_type, entity_id, {ENGAGEMENT} FROM features WHERE total_engagements > 0"
    ),
    "find_record": on_scored(
        f"""SELECT entity_type, entity_id, rank, tier, readiness_score,
        {titles([*LEAD_EXCLUSIONS, 'exclude_no_longer', 'exclude_dnc_account'])} AS active_exclusions,
        {titles(LEAD_DQ)} AS active_issues FROM ranked WHERE entity_id = 42"""
    ),
    "merged_records": on_scored(
        """SELECT entity_type, entity_id, tier, readiness_score, email, title, company, lead_status, contact_status,
        job_level, account_name, industry, intent_score, is_excluded, dq_issue_count FROM ranked"""
    ),
    "score_sample": on_scored(
        """, placed AS (SELECT *, row_number() OVER (
            PARTITION BY tier, least(greatest(floor(score_engagement / 10e0), 0), 9),
              least(greatest(floor(score_profile / 10e0), 0), 9)
            ORDER BY md5(concat_ws(' ', entity_type, CAST(entity_id AS VARCHAR)))) AS place
          FROM ranked WHERE NOT is_excluded AND readiness_score IS NOT NULL AND score_engagement IS NOT NULL
            AND score_profile IS NOT NULL)
        SELECT entity_type, entity_id, tier, round(score_engagement, 6) AS score_engagement,
          round(score_profile, 6) AS score_profile, readiness_score FROM placed WHERE place <= 2"""
    ),
}
