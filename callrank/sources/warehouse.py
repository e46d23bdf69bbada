"""The star-schema test tables seen as CRM tables (the mapping of FIXTURES.md section 3)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.sources.crm import CrmTables

REFERENCE_DATE = date(2001, 8, 2)

# The columns read, with their types in the files: naming them saves a look at every file.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
}


def _scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _scan(spark, sf_dir, "nation").join(
        _scan(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    )
    return (
        _scan(spark, sf_dir, "supplier")
        .join(places, F.expr("s_nationkey = n_nationkey"))
        .selectExpr(
            "s_suppkey AS account_id",
            "s_name AS account_name",
            "r_name AS industry",
            "n_name AS country",
            "s_suppkey * 37 % 200 * 100 AS employee_count",
            "greatest(s_acctbal, 0D) * 2e5D AS annual_revenue",
            "s_suppkey % 7 = 0 AS is_named_account",
            "s_suppkey % 7 = 0 OR s_suppkey % 4 = 0 AS is_icp_qualified",
            "CASE WHEN s_suppkey % 10 >= 3 OR s_suppkey % 7 = 0 "
            "THEN CAST(s_suppkey * 13 % 101 AS double) END AS intent_score",
            "s_suppkey % 33 = 0 AS do_not_contact",
        )
    )


PERSON = [
    "CASE WHEN k % 97 <> 96 THEN concat('u', "
    "CASE WHEN k % 13 = 0 THEN k - k % 26 ELSE k END, '@x.test') END AS email",
    "concat('F', k % 50) AS first_name",
    "c_name AS last_name",
    "CASE WHEN k % 3 <> 0 THEN c_mktsegment END AS title",
    "element_at(array('CISO', 'Technical Buyer', 'Financial Buyer', 'IT Operations', "
    "'Security Engineer', NULL, 'Non-Prospect', 'CISO'), CAST(k % 8 AS int) + 1) AS job_persona",
    "element_at(array('C-Level', 'VP', 'Director', 'Manager', 'Individual Contributor', NULL, "
    "'Non-Prospect'), CAST(k % 7 AS int) + 1) AS job_level",
]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _customers(spark, sf_dir)
        .filter("k % 5 < 3")
        .selectExpr(
            "k AS lead_id",
            *PERSON,
            "CASE WHEN k % 19 = 0 THEN 'Okta' ELSE c_name END AS company",
            "element_at(array('New', 'MQL', 'Attempted', 'Qualified', 'Disqualified', 'Recycled'), "
            "CAST(k % 6 AS int) + 1) AS lead_status",
            "c_mktsegment AS lead_source",
            "date_add(DATE '2001-07-01', CAST(CASE WHEN k % 10 < 8 THEN k % 4 ELSE -(k % 700) END "
            "AS int)) AS created_date",
            "CASE WHEN k % 4 = 0 THEN date_sub(DATE '2001-08-02', CAST(k % 60 AS int) + 1) END "
            "AS mql_date",
            "k % 3 = 0 AS is_converted",
            "CASE k % 15 WHEN 6 THEN k + 2 WHEN 12 THEN k + 1000000 END AS converted_contact_id",
            "k * 7 % 300 AS mkto_lead_score",
            "k % 11 = 0 AS is_disqualified",
            "CASE WHEN k % 11 = 0 THEN 'Bad Data' END AS dq_reason",
            "CASE WHEN k % 11 = 0 THEN date_sub(DATE '2001-08-02', CAST(30 + k % 335 AS int)) END "
            "AS dq_date",
            "k % 20 = 0 AS has_opted_out",
            "k % 25 = 1 AS email_bounced",
        )
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _scan(spark, sf_dir, "supplier").agg(F.expr("count(*)")).scalar()
    return (
        _customers(spark, sf_dir)
        .filter("k % 5 >= 3")
        .withColumn("n_suppliers", suppliers)
        .selectExpr(
            "k AS contact_id",
            "CASE WHEN k % 50 = 48 THEN -1L WHEN k % 50 <> 49 "
            "THEN CAST(floor(k / 5) AS bigint) % n_suppliers END AS account_id",
            *PERSON,
            "CASE WHEN k % 4 = 0 THEN 'MQL' ELSE 'Active' END AS contact_status",
            "date_add(DATE '2001-07-01', CAST(CASE WHEN k % 10 = 3 THEN k % 4 ELSE -(k % 1000) END "
            "AS int)) AS created_date",
            "CASE WHEN k % 4 = 0 THEN date_sub(DATE '2001-08-02', CAST(k % 90 AS int) + 1) END "
            "AS mql_date",
            "k * 3 % 120 AS mkto_contact_score",
            "k % 4 = 0 AS is_mql",
            "k % 5 = 3 AS has_lead_origin",
            "CASE WHEN k % 5 = 3 THEN k - 2 END AS primary_lead_id",
            "k % 12 = 8 AS no_longer_with_company",
            "k % 24 = 3 AS has_opted_out",
        )
    )


def campaign_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _scan(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS cm_id",
            "o_custkey AS entity_id",
            "CASE WHEN o_custkey % 5 < 3 THEN 'lead' ELSE 'contact' END AS entity_type",
            "element_at(array('Webinar', 'Event', 'Content Syndication', 'Email', 'Advertisement', "
            "'Telemarketing', 'Direct Mail'), CAST(o_orderkey % 7 AS int) + 1) AS campaign_type",
            "o_orderstatus AS state",
            "CAST(o_orderdate AS date) AS ordered",
        )
        .selectExpr(
            "*",
            "CASE "
            "WHEN campaign_type IN ('Webinar', 'Event') THEN "
            "CASE state WHEN 'F' THEN 'Attended' WHEN 'O' THEN 'Registered' ELSE 'No Show' END "
            "WHEN campaign_type = 'Email' THEN IF(state = 'F', 'Clicked', 'Sent') "
            "WHEN campaign_type = 'Telemarketing' THEN "
            "IF(state = 'F', 'Contacted', 'Not Interested') "
            "WHEN campaign_type = 'Direct Mail' THEN IF(state = 'F', 'Responded', 'Sent') "
            "ELSE 'Responded' END AS member_status",
        )
        .selectExpr(
            "cm_id",
            "entity_id",
            "entity_type",
            "concat_ws('_', campaign_type, year(ordered)) AS campaign_name",
            "campaign_type",
            "member_status",
            "member_status NOT IN ('Sent', 'No Show', 'Not Interested') AS is_responded",
            "date_sub(DATE '2001-08-02', datediff(DATE '2001-08-02', ordered) % 240) "
            "AS response_date",
            "false AS is_active",
        )
    )


def crm_tables(spark: SparkSession, sf_dir: str) -> CrmTables:
    return CrmTables(
        accounts(spark, sf_dir),
        leads(spark, sf_dir),
        contacts(spark, sf_dir),
        campaign_members(spark, sf_dir),
    )
