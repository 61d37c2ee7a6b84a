"""Schemas of the persistent tables and of the records that flow between operators."""


# Persistent tables: (primary key, schema as DDL)
TABLES = {
    "research_sessions": ("session_id", ("session_id bigint, session_name string, description string, created_at timestamp")),
    "companies": ("company_id", ("company_id bigint, company_name string, industry string, fiscal_year string")),
    "documents": ("document_id", ("document_id bigint, session_id bigint, company_id bigint, file_name string, file_path string, upload_date timestamp")),
    "financial_metrics": ("metric_id", (
        "metric_id bigint, document_id bigint, revenue double, net_income double, total_assets double, "
        "total_liabilities double, eps double, debt_to_equity double")),
    "red_flags": ("red_flag_id", ("red_flag_id bigint, document_id bigint, risk_type string, severity string, description string")),
    "comparison_results": ("comparison_id", ("comparison_id bigint, company1_id bigint, company2_id bigint, comparison_summary string")),
    "research_queries": ("query_id", ("query_id bigint, session_id bigint, question string, answer string, created_at timestamp")),
    "reports": ("report_id", ("report_id bigint, session_id bigint, report_title string, report_path string, generated_at timestamp")),
}

# The one column an update may change, and the timestamp filled on insert.
UPDATABLE = {
    "research_sessions": "session_name",
    "companies": "company_name",
    "documents": "file_name",
    "financial_metrics": "revenue",
    "red_flags": "severity",
    "comparison_results": "comparison_summary",
    "research_queries": "answer",
    "reports": "report_title",
}
DEFAULT_TIMESTAMP = {
    "research_sessions": "created_at",
    "documents": "upload_date",
    "research_queries": "created_at",
    "reports": "generated_at",
}
# child table -> {foreign key: parent table}
FOREIGN_KEYS = {
    "documents": {"session_id": "research_sessions", "company_id": "companies"},
    "financial_metrics": {"document_id": "documents"},
    "red_flags": {"document_id": "documents"},
    "comparison_results": {"company1_id": "companies", "company2_id": "companies"},
    "research_queries": {"session_id": "research_sessions"},
    "reports": {"session_id": "research_sessions"},
}

COMPANY_METRICS = (
    "company_name string, fiscal_year string, source_document string, source_page string, revenue_cr double, "
    "revenue_growth_cc_pct double, ebit_margin_pct double, pat_margin_pct double, roe_pct double, roce_pct double, "
    "dso_days double, fcf_to_pat_pct double, revenue_per_employee_lakh double, attrition_rate_pct double, net_debt_cr double"
)
COMPANY_METRICS_REQUIRED = ("company_name", "fiscal_year", "source_document", "revenue_cr")
