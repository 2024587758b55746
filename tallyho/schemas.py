"""Declared schemas and fixed values.

Values under "FIXED VALUES" must equal the ones the original workload uses
(formats, vocabularies, limits, prices); they are stated here plainly and in
their natural order.  Everything else in this module is our own choice.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original workload)
# ---------------------------------------------------------------------------

NA = "N/A"
UNKNOWN_NAME = "Unknown"
UNKNOWN_ID = "Unknown ID"
NO_JSON_MESSAGE = "No JSON object found in response"
NO_URL_MESSAGE = "No URL provided"
INSUFFICIENT_INFO = "Insufficient information"

# Column order of one classification reply (a CSV line).
REPLY_COLUMNS = [
    "CompanyID", "CompanyName", "AI_native", "Confidence_1to5",
    "Reasons_3_points", "Sources_used", "Verification_critique",
]
REASON_SEPARATOR = " | "
SOURCE_SEPARATOR = ";"
# Allowed entries of Sources_used.
SOURCE_VOCABULARY = ["id", "name", "short_description", "long_description",
                     "keywords", "year"]
CRITIQUE_MAX_WORDS = 30

# Three-mode adoption reply.
ADOPTION_MODES = ["strict", "moderate", "lenient"]
ADOPTION_LABELS = ["Yes", "No"]
ADOPTION_CONFIDENCES = ["Low", "Medium", "High"]
# Standardised business-function keywords (in the order they are listed).
FUNCTION_KEYWORDS = [
    "customer_support", "sales", "marketing", "product_management",
    "software_development", "data_analytics", "operations",
    "supply_chain_logistics", "hr_recruiting", "training_onboarding",
    "compliance_legal", "finance_accounting", "founder_workflow", "other",
]

# Output columns of the per-finding research table, in order.
FINDING_ROW_COLUMNS = [
    "company_id", "company_name", "homepage_url", "industry", "founded_year",
    "research_stage_reached", "online_presence_score", "website_alive",
    "research_cost_usd", "researched_at",
    "finding_id", "genai_adoption_found", "adoption_confidence", "tool_name",
    "use_case", "business_function", "evidence_summary", "source_url",
    "source_type", "no_finding_reason",
]
NO_EVIDENCE_REASON = "no_evidence"

# Finding categories; the last two are the negative ones.
FINDING_TYPES = [
    "chatgpt_customer_support", "ai_chatbot_general",
    "copilot_engineering", "ai_code_generation", "ai_testing_qa",
    "ai_content_generation", "ai_marketing_automation", "ai_copywriting",
    "ai_document_processing", "ai_data_analysis", "ai_workflow_automation",
    "ai_recruiting_screening", "ai_hr_operations",
    "ai_sales_outreach", "ai_lead_scoring",
    "ai_internal_tools_general", "ai_adoption_unspecified",
    "no_adoption_found", "insufficient_information",
]
NEGATIVE_FINDING_TYPES = ["no_adoption_found", "insufficient_information"]
RESEARCH_STAGES = ["1", "2A", "2B", "3"]
PRESENCE_TIERS = ["low", "medium", "high"]

# Typographic characters replaced for spreadsheet-safe text, in order.
UNICODE_REPLACEMENTS = [
    ("\u202f", " "),    # narrow no-break space
    ("\u00a0", " "),    # no-break space
    ("\u2011", "-"),    # non-breaking hyphen
    ("\u2010", "-"),    # hyphen
    ("\u2013", "-"),    # en dash
    ("\u2014", "-"),    # em dash
    ("\u2018", "'"),    # left single quote
    ("\u2019", "'"),    # right single quote
    ("\u201c", '"'),    # left double quote
    ("\u201d", '"'),    # right double quote
    ("\u2026", "..."),  # ellipsis
    ("\u00b7", "."),    # middle dot
]

# Request-file limits.
MAX_REQUESTS_PER_BATCH = 50_000
EVEN_PLAN_MAX_FILE_MB = 100
EVEN_PLAN_TOKEN_CAP = 40_000_000
EVEN_PLAN_TOKENS_PER_REQUEST = 2_000
EVEN_PLAN_KB_PER_REQUEST = 14.2
GREEDY_MAX_REQUESTS = 49_000
GREEDY_MAX_FILE_MB = 190
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"
CUSTOM_ID_PREFIX = "startup-"

# HTTP statuses treated as transient.
RETRYABLE_STATUS_CODES = [429, 500, 502, 503, 504]
RETRY_MAX_ATTEMPTS = 3
RETRY_BASE_DELAY_SEC = 1.0
RATE_WINDOW_SEC = 60

# Batch job states.
BATCH_STATUSES = ["validating", "in_progress", "finalizing", "completed",
                  "failed", "expired", "cancelling", "cancelled"]
ACTIVE_BATCH_STATUSES = ["validating", "in_progress", "finalizing"]
LISTED_ACTIVE_BATCH_STATUSES = ["in_progress", "validating", "cancelling"]
STUCK_WARN_POLLS_SLOW = 5    # 2-minute polls
STUCK_WARN_POLLS_FAST = 10   # 30-second polls

# Priority routing.
DEEP_RESEARCH_MIN_SCORE = 3
HIGH_PRIORITY_MIN_SCORE = 4
PRIORITY_SCORE_LEVELS = [0, 1, 2, 3, 4, 5]
MIN_FINDING_CONFIDENCE = 0.5

# Unit costs in USD (stage, min, max) and budget limits.
UNIT_COSTS = [
    ("search", 0.02, 0.02),
    ("small_model_call", 0.0002, 0.0002),
    ("stage_1", 0.020, 0.020),
    ("stage_2a", 0.02, 0.02),
    ("stage_2b", 0.05, 0.10),
    ("stage_3", 0.41, 1.19),
]
TARGET_AVG_COST_PER_COMPANY = 0.10
HARD_BUDGET_LIMIT_USD = 5000.0

# Search-query wording.
SEARCH_QUERY_PREFIX = "Find information on the company "

# Agreement-verdict ladder (five tiers) and recommendation ladder (four).
VERDICT_TIERS = [(95.0, "excellent"), (90.0, "very_good"), (85.0, "good"),
                 (80.0, "moderate")]
VERDICT_FLOOR = "low"
RECOMMENDATION_TIERS = [(95.0, "short_sufficient"),
                        (90.0, "short_highly_sufficient"),
                        (85.0, "short_generally_sufficient")]
RECOMMENDATION_FLOOR = "long_adds_value"
RATE_SAME_TOLERANCE_POINTS = 1.0

# ---------------------------------------------------------------------------
# Our own choices (not fixed by the original workload)
# ---------------------------------------------------------------------------

# Confidence band per evidence source type (one reading of prose rules).
SOURCE_CONFIDENCE_BANDS = [
    ("company_blog", 0.9, 1.0),
    ("press_release", 0.9, 1.0),
    ("news_article", 0.7, 0.9),
    ("job_posting", 0.5, 0.7),
    ("linkedin_post", 0.5, 0.7),
]
# The same by stage: stage, source type, least, most.
STAGE_CONFIDENCE_BANDS = [
    ("2A", "company_blog", 0.9, 1.0),
    ("2A", "press_release", 0.9, 1.0),
    ("2A", "news_article", 0.7, 0.8),
    ("2A", "job_posting", 0.5, 0.6),
    ("2A", "linkedin_post", 0.5, 0.6),
    ("2B", "company_blog", 0.9, 1.0),
    ("2B", "press_release", 0.9, 1.0),
    ("2B", "news_article", 0.7, 0.8),
    ("2B", "job_posting", 0.5, 0.6),
    ("2B", "linkedin_post", 0.5, 0.6),
    ("3", "company_blog", 0.9, 1.0),
    ("3", "press_release", 0.9, 1.0),
    ("3", "news_article", 0.7, 0.9),
    ("3", "job_posting", 0.5, 0.7),
    ("3", "linkedin_post", 0.5, 0.7),
]
# Findings below this are left out at the stages above.
FINDING_CONFIDENCE_FLOOR = 0.5
# Escalation cut-offs that the prose leaves open.
ESCALATE_PRESENCE_HIGH = 70
ESCALATE_PRESENCE_LOW = 30
ESCALATE_CONFIDENCE_CLEAR = 0.9
ESCALATE_BAND_LOW = 0.5
ESCALATE_BAND_HIGH = 0.7

# Rule labeller vocabulary (stand-in for a hosted model).
AI_VOCABULARY = ["learning", "model", "data", "ai", "intelligence", "algorithm"]

# ---------------------------------------------------------------------------
# Declared schemas
# ---------------------------------------------------------------------------

COMPANY_SCHEMA = T.StructType([
    T.StructField("rcid", T.LongType()),
    T.StructField("org_uuid", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("cb_url", T.StringType()),
    T.StructField("homepage_url", T.StringType()),
    T.StructField("short_description", T.StringType()),
    T.StructField("long_description", T.StringType()),
    T.StructField("category_list", T.StringType()),
    T.StructField("category_groups_list", T.StringType()),
    T.StructField("created_date", T.StringType()),
    T.StructField("founded_date", T.StringType()),
])

COMPANY_CSV_SCHEMA = T.StructType([
    T.StructField("rcid", T.StringType()),
    *[f for f in COMPANY_SCHEMA.fields if f.name != "rcid"],
])

REPLY_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                             for c in REPLY_COLUMNS])

BATCH_RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([
                    T.StructField("content", T.StringType())]))]))),
            T.StructField("error", T.StructType([
                T.StructField("message", T.StringType())])),
        ])),
    ])),
])

SEARCH_RESULT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

SEARCH_PASS_SCHEMA = T.StructType([
    T.StructField("rcid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("short_description", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("homepage_url", T.StringType()),
    T.StructField("website_check", T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("is_alive", T.BooleanType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("error", T.StringType()),
    ])),
    T.StructField("tavily", T.StructType([
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("result_count", T.IntegerType()),
        T.StructField("raw_response", T.StructType([
            T.StructField("answer", T.StringType()),
            T.StructField("results", T.ArrayType(SEARCH_RESULT_SCHEMA)),
        ])),
        T.StructField("error", T.StringType()),
    ])),
    T.StructField("timestamp", T.StringType()),
])

FINDING_SCHEMA = T.StructType([
    T.StructField("tool_name", T.StringType()),
    T.StructField("use_case", T.StringType()),
    T.StructField("business_function", T.StringType()),
    T.StructField("evidence_summary", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

RESEARCH_RESULT_SCHEMA = T.StructType([
    T.StructField("genai_adoption_found", T.BooleanType()),
    T.StructField("findings", T.ArrayType(FINDING_SCHEMA)),
    T.StructField("no_finding_reason", T.StringType()),
    T.StructField("recommend_escalation", T.BooleanType()),
    T.StructField("escalation_reason", T.StringType()),
])

ADOPTION_REPLY_SCHEMA = T.StructType([
    *[T.StructField(f"genai_adoption_{m}", T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.StringType())]))
      for m in ADOPTION_MODES],
    T.StructField("primary_assessment", T.StringType()),
    T.StructField("genai_functions", T.ArrayType(T.StructType([
        T.StructField("function_keyword", T.StringType()),
        T.StructField("short_description", T.StringType()),
        T.StructField("confidence", T.StringType())]))),
    T.StructField("reasoning", T.ArrayType(T.StringType())),
])

BATCH_STATUS_SCHEMA = T.StructType([
    T.StructField("batch_num", T.IntegerType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total", T.LongType()),
    T.StructField("completed", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("has_jsonl", T.BooleanType()),
    T.StructField("has_results", T.BooleanType()),
    T.StructField("has_output", T.BooleanType()),
    T.StructField("checked_at", T.TimestampType()),
])

# System prompts sent with each request (our short stand-ins; the text is a
# parameter of every request builder).
CLASSIFY_SYSTEM_PROMPT = (
    "Classify the startup as AI-native (1) or not (0). Reply with exactly one "
    "CSV line: CompanyID,CompanyName,AI_native,Confidence_1to5,"
    "Reasons_3_points,Sources_used,Verification_critique")
ADOPTION_SYSTEM_PROMPT = (
    "Assess generative-AI adoption in strict, moderate and lenient modes and "
    "reply with JSON only.")
DEFAULT_MODEL = "classifier-small"
