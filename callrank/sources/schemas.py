"""Explicit table schemas and the fixed values of the CRM domain."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
BOOL, DATE = T.BooleanType(), T.DateType()

ACCOUNTS = _schema(
    account_id=STRING,
    account_name=STRING,
    industry=STRING,
    employee_count=LONG,
    annual_revenue=DOUBLE,
    is_icp_qualified=BOOL,
    is_named_account=BOOL,
    intent_score=DOUBLE,
    do_not_contact=BOOL,
    country=STRING,
)

LEADS = _schema(
    lead_id=STRING,
    email=STRING,
    first_name=STRING,
    last_name=STRING,
    title=STRING,
    company=STRING,
    lead_status=STRING,
    lead_source=STRING,
    job_persona=STRING,
    job_level=STRING,
    created_date=DATE,
    mql_date=DATE,
    is_converted=BOOL,
    converted_contact_id=STRING,
    mkto_lead_score=LONG,
    is_disqualified=BOOL,
    dq_reason=STRING,
    dq_date=DATE,
    has_opted_out=BOOL,
    email_bounced=BOOL,
    phone=STRING,
)

CONTACTS = _schema(
    contact_id=STRING,
    account_id=STRING,
    email=STRING,
    first_name=STRING,
    last_name=STRING,
    title=STRING,
    contact_status=STRING,
    job_persona=STRING,
    job_level=STRING,
    created_date=DATE,
    mql_date=DATE,
    mkto_contact_score=LONG,
    is_mql=BOOL,
    has_lead_origin=BOOL,
    primary_lead_id=STRING,
    no_longer_with_company=BOOL,
    has_opted_out=BOOL,
)

CAMPAIGN_MEMBERS = _schema(
    cm_id=STRING,
    entity_id=STRING,
    entity_type=STRING,
    campaign_name=STRING,
    campaign_type=STRING,
    member_status=STRING,
    is_responded=BOOL,
    response_date=DATE,
    is_active=BOOL,
)

# The columns without which no score can be given. The rest may be missing.
REQUIRED = {
    "accounts": ("account_id", "do_not_contact"),
    "leads": ("lead_id", "email"),
    "contacts": ("contact_id", "email"),
    "campaign_members": (
        "entity_id",
        "entity_type",
        "campaign_type",
        "member_status",
        "is_responded",
        "response_date",
    ),
}

# ---- Fixed values: they must equal those of the scoring model for right results ----

COMPETITORS = (
    "CrowdStrike",
    "Palo Alto Networks",
    "Fortinet",
    "SentinelOne",
    "Zscaler",
    "Okta",
    "CyberArk",
    "Varonis",
    "Rapid7",
    "Qualys",
)

CAMPAIGN_TYPES = (
    "Webinar",
    "Event",
    "Content Syndication",
    "Email",
    "Advertisement",
    "Telemarketing",
    "Direct Mail",
)

LEVEL_SCORES = {
    "C-Level": 1.0,
    "VP": 0.85,
    "Director": 0.7,
    "Manager": 0.5,
    "Individual Contributor": 0.3,
}

PERSONA_SCORES = {
    "CISO": 1.0,
    "Technical Buyer": 0.9,
    "Financial Buyer": 0.7,
    "IT Operations": 0.6,
    "Security Engineer": 0.5,
    "Non-Prospect": 0.0,
}

UNKNOWN_SCORE = 0.2
NON_PROSPECT = "Non-Prospect"
OVERWRITTEN_STATUSES = ("Recycled", "Disqualified")
TIERS = ("Hot", "Warm", "Nurture", "Cold")
NO_ENGAGEMENT_DAYS = 999
DECAY_RATE = 0.693
