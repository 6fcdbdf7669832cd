"""Settings and the small fixed tables that the operators read."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

# Weights of words in paths that tell of a company, and of words that do not.
PAGE_KEYWORDS: dict[str, float] = {
    "about": 10.0, "about-us": 10.0, "our-story": 9.0, "who-we-are": 9.0, "team": 10.0, "our-team": 10.0,
    "leadership": 9.5, "founders": 9.5, "management": 8.0, "people": 7.0, "company": 8.0, "contact": 9.0,
    "contact-us": 9.0, "support": 6.0, "pricing": 6.5, "plans": 5.5, "customers": 5.0, "solutions": 4.5,
    "product": 4.5, "platform": 4.5, "use-cases": 4.0, "careers": 8.0, "press": 3.0, "investors": 3.0,
}
NEGATIVE_KEYWORDS: dict[str, float] = {
    "blog": -8.0, "docs": -8.0, "documentation": -8.0, "changelog": -7.0, "release": -6.0, "terms": -9.0,
    "privacy": -9.0, "legal": -8.0, "cookie": -9.0, "login": -9.0, "signup": -9.0, "sign-up": -9.0,
    "register": -9.0, "download": -6.0, "status": -6.0, "api": -5.0, "reference": -6.0, "tutorial": -6.0,
    "guide": -5.0, "webinar": -5.0, "event": -5.0, "search": -8.0, "tag": -7.0, "category": -6.0, "author": -7.0,
}
# Dollars for a million tokens, in and out.
MODEL_PRICES: dict[str, tuple[float, float]] = {
    "llama-3.3-70b-versatile": (0.59, 0.79), "llama-3.1-8b-instant": (0.05, 0.08), "openai/gpt-oss-120b": (0.15, 0.75),
    "openai/gpt-oss-20b": (0.10, 0.50), "moonshotai/kimi-k2-instruct": (1.00, 3.00),
}
DEFAULT_PRICE = (0.59, 0.79)
# Words of mailboxes by category, in order of precedence.
MAILBOX_WORDS: dict[str, tuple[str, ...]] = {
    "sales": ("sales", "sale", "buy", "purchase", "quote", "quotes", "deals", "upgrade"),
    "support": ("support", "help", "helpdesk", "service", "servicedesk", "care", "customercare", "customersuccess", "success", "assistance", "техподдержка"),
    "contact": ("contact", "contactus", "hello", "hallo", "hi", "hey", "reachus", "enquire"),
    "info": ("info", "information", "general", "office", "admin", "mail", "email", "inquiry", "inquiries", "enquiry", "enquiries", "ask", "questions"),
    "press": ("press", "media", "pr", "news", "newsroom", "communications", "comms", "journalists"),
    "partnerships": ("partner", "partners", "partnership", "partnerships", "alliances", "affiliate", "affiliates", "resellers", "bizdev", "businessdevelopment"),
    "careers": ("careers", "career", "jobs", "job", "recruiting", "recruitment", "recruiter", "hiring", "talent", "apply", "applications", "hr", "peopleops", "workwithus", "joinus"),
    "security": ("security", "infosec", "abuse", "vulnerability", "vulnerabilities", "vulns", "psirt", "soc", "cert", "bugbounty", "disclosure"),
    "privacy": ("privacy", "dpo", "gdpr", "dataprotection", "dsar", "ccpa"),
}
# Mailboxes of departments.
DEPARTMENT_WORDS = (
    "people", "team", "teams", "billing", "invoices", "invoice", "accounts", "accounting", "finance", "payments", "ap", "ar",
    "legal", "compliance", "trust", "safety", "moderation", "copyright", "dmca", "marketing", "events", "event", "webinars",
    "community", "social", "feedback", "suggestions", "ideas", "research", "academy", "training", "education", "learn", "docs",
    "developers", "developer", "dev", "devs", "api", "engineering", "eng", "it", "ops", "devops", "sre", "status", "newsletter",
    "subscribe", "unsubscribe", "noreply", "no-reply", "donotreply", "postmaster", "webmaster", "hostmaster", "admin", "root",
    "abuse-desk", "orders", "shipping", "returns", "refunds", "bookings", "reservations",
)
# The order of categories, and mailboxes that come first.
CATEGORY_ORDER = ("contact", "sales", "support", "info", "partnerships", "press", "careers", "security", "privacy", "other")
PREFERRED_PREFIXES = ("contact", "sales", "support", "hello", "info", "help", "press", "partnerships", "security", "privacy", "careers", "jobs", "team")
# Substrings that no address of a person or mailbox has.
EMAIL_BLOCKLIST = ("example.com", "domain.com", "yourcompany", "email.com", "sentry.io", "wixpress.com", "@2x", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".js", ".mjs", ".cjs", ".css", ".woff", ".map", ".vue")
# Markers of seniority as substrings of the padded title, by tier.
SENIORITY: tuple[tuple[str, ...], ...] = (
    ("founder", "co-founder", "cofounder", "co founder", "owner"), ("ceo", "chief executive"),
    ("cto", "cpo", "coo", "cfo", "cmo", "cro", "ciso", "cio", "chief "), ("president", "managing director", "general manager"),
    ("svp", "evp", "vp", "vice president"), ("head of", "director"), ("principal", "staff ", "lead ", "manager", "general counsel"),
)
UNTITLED = 99
# Words that tell nothing in names of people, names of companies, job titles, and results.
NAME_NOISE = ("jr", "sr", "ii", "iii", "iv", "phd", "mba", "md", "dr", "mr", "ms", "mrs", "prof", "the")
COMPANY_STOP = ("the", "inc", "llc", "ltd", "labs", "lab", "group", "technologies", "tech", "software", "systems", "solutions", "company", "corp", "io", "ai", "app", "com", "co", "get", "try", "hq", "cloud", "digital", "studio", "agency")
ROLE_STOP = ("the", "and", "for", "our", "team", "with", "from", "all", "new", "global", "senior", "lead", "head", "staff", "member", "manager", "director")
NO_ROLE = ("linkedin", "profile", "profiles", "experience", "education", "home", "sign in", "log in", "view profile", "posts", "activity")
# Endings of paths that are no pages, and statuses that a rendered fetch may get around.
NON_HTML = ("pdf", "zip", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "json", "xml", "mp4", "mp3", "woff", "woff2", "ttf", "dmg", "exe", "pkg", "deb", "rpm", "tar", "gz")
ESCALATE_STATUSES = (401, 403, 405, 406, 429, 500, 502, 503, 520, 521, 522, 530)
# Characters of thin, of substantial, and of enough text; weights of the score.
THIN_CHARS, SUBSTANTIAL_CHARS, LEAST_CHARS = 600, 800, 200
SCORE_WEIGHTS = {"overview": 0.18, "audience": 0.18, "emails": 0.16, "team": 0.28, "profiles": 0.12, "titles": 0.08}
BLEND = {"completeness": 0.50, "coverage": 0.20, "evidence": 0.15, "validation": 0.15}
USER_AGENT = "Mozilla/5.0 (compatible; millrace/1.0)"


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told; ``from_env`` reads upper-case names, and takes defaults for what isn't a number."""

    model: str = "openai/gpt-oss-120b"
    llm_api_key: str = ""
    llm_base_url: str = ""
    llm_timeout: float = 90.0
    llm_max_attempts: int = 3
    temperature: float = 0.1
    max_pages_per_domain: int = 6
    http_timeout: float = 20.0
    browser_timeout: float = 30.0
    domain_concurrency: int = 3
    page_concurrency: int = 3
    politeness_delay: float = 0.4
    max_fetch_attempts: int = 3
    respect_robots: bool = True
    max_chars_per_page: int = 6_000
    max_chars_per_domain: int = 24_000
    linkedin_search_enabled: bool = True
    linkedin_search_provider: str = "auto"
    serper_api_key: str = ""
    brave_api_key: str = ""
    linkedin_search_timeout: float = 15.0
    linkedin_search_results: int = 6
    linkedin_search_max_lookups: int = 5
    linkedin_search_delay: float = 1.2
    linkedin_min_confidence: float = 0.75
    output_path: str = "output/output.json"
    boilerplate_threshold: float = 0.6
    boilerplate_line_chars: int = 200
    candidate_depth: int = 3
    strict_emails: bool = False
    keywords: dict = field(default_factory=lambda: dict(PAGE_KEYWORDS))
    negative_keywords: dict = field(default_factory=lambda: dict(NEGATIVE_KEYWORDS))
    email_blocklist: tuple = EMAIL_BLOCKLIST

    @classmethod
    def from_env(cls, env=None) -> Settings:
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or not isinstance(f.default, (str, int, float)):
                continue
            if isinstance(f.default, bool):
                given[f.name] = raw.strip().lower() != "false"
            elif isinstance(f.default, str):
                given[f.name] = raw.strip()
            else:
                try:
                    given[f.name] = type(f.default)(raw)
                except ValueError:
                    pass
        return cls(**given)

    def price(self, model: str | None = None) -> tuple[float, float]:
        return MODEL_PRICES.get(model or self.model, DEFAULT_PRICE)
