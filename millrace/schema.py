"""Schemas of records, as DDL."""

EMAIL = "struct<email:string,type:string>"
PERSON = "struct<name:string,title:string,linkedin_url:string,affiliation:string>"
ENRICHED = "struct<name:string,title:string,linkedin_url:string,affiliation:string,title_source:string,linkedin_source:string,linkedin_confidence:double,linkedin_evidence:array<string>>"
BREAKDOWN = "struct<completeness:double,source_coverage:double,evidence_strength:double,validation_health:double,llm_self_reported:double,final:double,notes:array<string>>"
PAGE = "struct<url:string,status:string,tier:string,http_status:int,raw_chars:bigint,clean_chars:bigint,relevance_score:double,error:string,duration_seconds:double>"
USAGE = "struct<llm_calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,estimated_cost_usd:double,model:string>"
RECORD = f"domain string, url string, status string, company_overview string, target_audience string, contact_emails array<{EMAIL}>, personal_emails array<string>, team_members array<{ENRICHED}>, data_confidence_score double, confidence_breakdown {BREAKDOWN}, pages_crawled array<{PAGE}>, usage {USAGE}, errors array<string>, duration_seconds double, extracted_at string"
#: What a model returns; numbers may come as text.
EXTRACTION = f"company_overview string, target_audience string, contact_emails array<string>, team_members array<{PERSON}>, self_reported_confidence double"
PAGES = "domain string, url string, page_pos int, html string, http_status int, content_type string, tier string, error string, duration double"
ROBOTS = "domain string, body string"
SITEMAPS = "domain string, sitemap_url string, seq int, body string"
RESPONSES = "domain string, attempt int, content string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, model string, error string"
SEARCH = "domain string, name_key string, rank int, title string, url string, snippet string, error string"
