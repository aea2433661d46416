"""Fixed values the results depend on: word lists, code tables, thresholds.

Everything here is plain data. The column builders in ``vacantia.functions`` turn it
into expressions, ``dictionary_rows`` turns it into DataFrame rows (the ``dict_phrases``
and ``dict_countries`` tables).
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------
# Countries (code, name), by regional membership.
# --------------------------------------------------------------------------------------
EU_MEMBERS = [
    ("AT", "Austria"), ("BE", "Belgium"), ("BG", "Bulgaria"), ("HR", "Croatia"),
    ("CY", "Cyprus"), ("CZ", "Czechia"), ("DK", "Denmark"), ("EE", "Estonia"),
    ("FI", "Finland"), ("FR", "France"), ("DE", "Germany"), ("GR", "Greece"),
    ("HU", "Hungary"), ("IE", "Ireland"), ("IT", "Italy"), ("LV", "Latvia"),
    ("LT", "Lithuania"), ("LU", "Luxembourg"), ("MT", "Malta"), ("NL", "Netherlands"),
    ("PL", "Poland"), ("PT", "Portugal"), ("RO", "Romania"), ("SK", "Slovakia"),
    ("SI", "Slovenia"), ("ES", "Spain"), ("SE", "Sweden"),
]
EEA_ONLY = [("IS", "Iceland"), ("LI", "Liechtenstein"), ("NO", "Norway")]
OTHER_EUROPE = [
    ("GB", "United Kingdom"), ("CH", "Switzerland"), ("AL", "Albania"), ("AD", "Andorra"),
    ("BY", "Belarus"), ("BA", "Bosnia and Herzegovina"), ("FO", "Faroe Islands"),
    ("GI", "Gibraltar"), ("GG", "Guernsey"), ("IM", "Isle of Man"), ("JE", "Jersey"),
    ("XK", "Kosovo"), ("MD", "Moldova"), ("MC", "Monaco"), ("ME", "Montenegro"),
    ("MK", "North Macedonia"), ("RU", "Russia"), ("SM", "San Marino"), ("RS", "Serbia"),
    ("UA", "Ukraine"), ("VA", "Vatican City"),
]
TRANSCONTINENTAL = [("TR", "Turkey"), ("GE", "Georgia"), ("AM", "Armenia"), ("AZ", "Azerbaijan")]
MIDDLE_EAST = [
    ("AE", "United Arab Emirates"), ("SA", "Saudi Arabia"), ("IL", "Israel"), ("QA", "Qatar"),
    ("KW", "Kuwait"), ("BH", "Bahrain"), ("OM", "Oman"), ("JO", "Jordan"), ("LB", "Lebanon"),
    ("IQ", "Iraq"), ("IR", "Iran"), ("YE", "Yemen"), ("SY", "Syria"), ("PS", "Palestine"),
]
AFRICA = [
    ("EG", "Egypt"), ("MA", "Morocco"), ("DZ", "Algeria"), ("TN", "Tunisia"), ("LY", "Libya"),
    ("NG", "Nigeria"), ("KE", "Kenya"), ("ZA", "South Africa"), ("GH", "Ghana"),
    ("ET", "Ethiopia"), ("TZ", "Tanzania"), ("UG", "Uganda"), ("RW", "Rwanda"),
    ("SN", "Senegal"), ("CI", "Ivory Coast"), ("CM", "Cameroon"), ("ZM", "Zambia"),
    ("ZW", "Zimbabwe"), ("MZ", "Mozambique"), ("AO", "Angola"), ("BW", "Botswana"),
    ("NA", "Namibia"), ("MU", "Mauritius"), ("SD", "Sudan"), ("ML", "Mali"), ("GA", "Gabon"),
    ("CD", "DR Congo"),
]
REST_OF_WORLD = [
    ("US", "United States"), ("CA", "Canada"), ("MX", "Mexico"), ("BR", "Brazil"),
    ("AR", "Argentina"), ("CL", "Chile"), ("CO", "Colombia"), ("PE", "Peru"),
    ("AU", "Australia"), ("NZ", "New Zealand"), ("IN", "India"), ("PK", "Pakistan"),
    ("BD", "Bangladesh"), ("LK", "Sri Lanka"), ("SG", "Singapore"), ("MY", "Malaysia"),
    ("TH", "Thailand"), ("VN", "Vietnam"), ("PH", "Philippines"), ("ID", "Indonesia"),
    ("JP", "Japan"), ("KR", "South Korea"), ("CN", "China"), ("HK", "Hong Kong"),
    ("TW", "Taiwan"),
]
COUNTRY_ALIASES = {
    "CZ": ["Czech Republic"],
    "NL": ["Holland"],
    "GB": ["UK", "U.K.", "Great Britain", "England", "Scotland", "Wales", "Northern Ireland"],
    "TR": ["Türkiye"],
    "AE": ["UAE"],
    "CI": ["Côte d'Ivoire"],
    "CD": ["Democratic Republic of the Congo"],
    "US": ["USA", "U.S.", "United States of America"],
}

# Region membership of each country group, most specific region first.
COUNTRY_GROUPS = [
    (EU_MEMBERS, ["EU", "EEA", "EUROPE", "EMEA"]),
    (EEA_ONLY, ["EEA", "EUROPE", "EMEA"]),
    (OTHER_EUROPE, ["EUROPE", "EMEA"]),
    (TRANSCONTINENTAL, ["EMEA"]),
    (MIDDLE_EAST, ["EMEA"]),
    (AFRICA, ["EMEA"]),
    (REST_OF_WORLD, []),
]
COUNTRIES = [(code, name, regions) for group, regions in COUNTRY_GROUPS for code, name in group]
COUNTRY_CODES = [code for code, _, _ in COUNTRIES]
COUNTRY_REGIONS = {code: regions for code, _, regions in COUNTRIES}
COUNTRY_PHRASES = [
    (label.lower(), code)
    for code, name, _ in COUNTRIES
    for label in [name, *COUNTRY_ALIASES.get(code, [])]
]
SUPPORTED_COUNTRIES = [c for c, _, regions in COUNTRIES if "EUROPE" in regions or c == "US"]

# --------------------------------------------------------------------------------------
# Location phrases.
# --------------------------------------------------------------------------------------
REGION_PHRASES = {
    "EUROPE": [
        "remote europe", "europe remote", "remote - europe", "remote-europe",
        "anywhere in europe", "work from anywhere in europe", "european candidates",
        "candidates based in europe", "remote within europe", "based in europe",
        "located in europe", "europe based", "european-based candidates",
    ],
    "EU": [
        "remote eu", "eu remote", "remote - eu", "remote within the eu", "european union",
        "european union only", "eu residents", "eu-based candidates", "eu based candidates",
        "must be located in the eu", "located in the eu", "eu candidates",
    ],
    "EEA": [
        "remote eea", "eea remote", "remote - eea", "european economic area",
        "candidates located within the eea", "eea residents", "eea-based candidates",
        "eea based candidates", "eea candidates",
    ],
    "EMEA": [
        "remote emea", "emea remote", "remote - emea", "candidates based in emea",
        "emea region", "emea candidates", "emea-based candidates",
    ],
}
WORLDWIDE_PHRASES = [
    "worldwide", "remote worldwide", "remote - worldwide", "global remote", "remote - global",
    "remote globally", "remote anywhere", "work from anywhere", "location independent",
    "anywhere in the world",
]
US_ELIGIBLE_PHRASES = [
    "remote north america", "north america remote", "north america only",
    "anywhere in north america",
]
EXCLUSIVE_PHRASES = [
    "latam only", "latin america only", "apac only", "asia pacific only", "asia-pacific only",
    "middle east only",
]
TIMEZONE_PHRASES = [
    "cet", "cest", "wet", "west", "eet", "eest", "gmt+0", "gmt+1", "gmt+2", "gmt+3", "utc+0",
    "utc+1", "utc+2", "utc+3", "european business hours", "european working hours",
    "european timezone", "european time zone",
]
WEAK_COMPANY_PHRASES = [
    "european team", "our european team", "offices throughout europe", "offices across europe",
    "offices in europe", "european offices", "pan-european", "hubs across europe",
    "hubs throughout europe",
]
SAFE_SHORT_CODES = {"US": "US", "USA": "US", "UK": "GB", "UAE": "AE", "CA": "CA", "NZ": "NZ"}
EXCLUSIVITY_MARKERS = [
    "only", "must be based in", "must reside in", "must be located in", "exclusively",
]
REGION_LABEL_ORDER = ["EU", "EEA", "EMEA", "EUROPE"]
DEFAULT_REGIONS = ["EU", "EEA", "EUROPE", "EMEA"]

# --------------------------------------------------------------------------------------
# Titles. Order is priority.
# --------------------------------------------------------------------------------------
SENIORITY = [
    ("DIRECTOR", "Director", ["director"]),
    ("MANAGER", "Manager", ["manager"]),
    ("PRINCIPAL", "Principal", ["principal"]),
    ("STAFF", "Staff", ["staff"]),
    ("LEAD", "Lead", ["lead", "tech lead", "technical lead"]),
    ("SENIOR", "Senior", ["senior", "sr.", "sr"]),
    ("JUNIOR", "Junior", ["junior", "jr.", "jr"]),
    ("INTERNSHIP", "Intern", ["internship", "intern"]),
    ("MID", "Mid-Level", ["mid-level", "mid level", "midlevel", "mid-senior"]),
]
ROLE_CATEGORIES = [
    ("FULL_STACK_ENGINEER", "Full Stack Software Engineer",
     ["full-stack", "software-engineering"], ["full stack", "full-stack", "fullstack"]),
    ("FRONTEND_ENGINEER", "Frontend Engineer",
     ["frontend", "software-engineering"], ["frontend", "front-end", "front end"]),
    ("BACKEND_ENGINEER", "Backend Engineer",
     ["backend", "software-engineering"], ["backend", "back-end", "back end"]),
    ("IOS_ENGINEER", "iOS Engineer", ["ios", "mobile"], ["ios engineer", "ios developer", "ios"]),
    ("ANDROID_ENGINEER", "Android Engineer",
     ["android", "mobile"], ["android engineer", "android developer", "android"]),
    ("MOBILE_ENGINEER", "Mobile Engineer", ["mobile"], ["mobile engineer", "mobile developer"]),
    ("QA_ENGINEER", "QA Engineer", ["qa", "testing"],
     ["qa engineer", "quality assurance", "test automation", "automation engineer", "sdet"]),
    ("SECURITY_ENGINEER", "Security Engineer", ["security"],
     ["security engineer", "application security engineer", "security engineering"]),
    ("SITE_RELIABILITY_ENGINEER", "Site Reliability Engineer", ["sre", "reliability"],
     ["site reliability", "sre engineer", "sre"]),
    ("DEVOPS_ENGINEER", "DevOps Engineer", ["devops"], ["devops"]),
    ("PLATFORM_ENGINEER", "Platform Engineer", ["platform"], ["platform engineer"]),
    ("CLOUD_ENGINEER", "Cloud Engineer", ["cloud"], ["cloud engineer"]),
    ("DATA_ENGINEER", "Data Engineer", ["data-engineering"], ["data engineer"]),
    ("ANALYTICS_ENGINEER", "Analytics Engineer", ["analytics"], ["analytics engineer"]),
    ("DATA_SCIENTIST", "Data Scientist", ["data-science"], ["data scientist"]),
    ("ML_ENGINEER", "Machine Learning Engineer", ["machine-learning", "ai"],
     ["machine learning engineer", "ml engineer"]),
    ("AI_ENGINEER", "AI Engineer", ["ai"],
     ["ai engineer", "generative ai engineer", "applied ai engineer", "ai/ml engineer"]),
    ("SOLUTIONS_ARCHITECT", "Solutions Architect", ["architecture"],
     ["solutions architect", "technical architect"]),
    ("SOFTWARE_ARCHITECT", "Software Architect", ["architecture"], ["software architect"]),
    ("ENGINEERING_MANAGEMENT", "Engineering Manager", ["management"],
     ["engineering manager", "head of engineering", "director of engineering"]),
    ("SOFTWARE_ENGINEER", "Software Engineer", ["software-engineering"],
     ["software engineer", "software developer", "developer", "engineer"]),
]
OTHER_CATEGORY = "OTHER"
DOMAIN_TAGS = [
    ("ai", ["ai", "artificial intelligence", "generative ai", "genai", "llm"]),
    ("cloud", ["cloud"]),
    ("data", ["data pipeline", "big data"]),
]

# --------------------------------------------------------------------------------------
# Employment, pay, technologies.
# --------------------------------------------------------------------------------------
EMPLOYMENT_KEYWORDS = [
    ("FREELANCE", ["freelance", "freelancer"]),
    ("CONTRACT", ["contract", "contractor", "contract-to-hire", "b2b"]),
    ("PART_TIME", ["part-time", "part time"]),
    ("INTERNSHIP", ["internship", "intern"]),
    ("PERMANENT", ["full-time", "full time", "permanent"]),
]
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
CURRENCY_CODES = ["EUR", "USD", "GBP", "PLN", "CHF", "SEK", "NOK", "DKK", "CZK", "RON", "HUF"]
PERIOD_KEYWORDS = [
    ("HOURLY", ["/hour", "/hr", "per hour", "hourly"]),
    ("DAILY", ["/day", "per day", "daily"]),
    ("MONTHLY", ["/month", "/mo", "per month", "monthly", "mies", "/mies"]),
    ("YEARLY", ["/year", "/yr", "per year", "per annum", "annum", "yearly", "annually"]),
]
PERIOD_SUFFIXES = {"YEARLY": "/yr", "MONTHLY": "/mo", "DAILY": "/day", "HOURLY": "/hr"}
TECHNOLOGIES = [
    ("REACT", "React", "FRAMEWORK", ["react", "react.js", "reactjs"]),
    ("VUE", "Vue", "FRAMEWORK", ["vue", "vue.js", "vuejs"]),
    ("ANGULAR", "Angular", "FRAMEWORK", ["angular", "angularjs"]),
    ("TYPESCRIPT", "TypeScript", "LANGUAGE", ["typescript"]),
    ("JAVASCRIPT", "JavaScript", "LANGUAGE", ["javascript"]),
    ("NODE_JS", "Node.js", "FRAMEWORK", ["node.js", "nodejs", "node js", "node"]),
    ("PYTHON", "Python", "LANGUAGE", ["python"]),
    ("JAVA", "Java", "LANGUAGE", ["java"]),
    ("CSHARP", "C#", "LANGUAGE", ["c#", "c-sharp", "csharp"]),
    ("CPLUSPLUS", "C++", "LANGUAGE", ["c++", "cplusplus"]),
    ("DOTNET", ".NET", "FRAMEWORK", [".net", "dotnet", "asp.net", "dot net"]),
    ("GOLANG", "Go", "LANGUAGE", ["golang"]),
    ("RUST", "Rust", "LANGUAGE", ["rust"]),
    ("PHP", "PHP", "LANGUAGE", ["php"]),
    ("RUBY", "Ruby", "LANGUAGE", ["ruby", "ruby on rails", "rails"]),
    ("AWS", "AWS", "CLOUD", ["aws", "amazon web services"]),
    ("AZURE", "Azure", "CLOUD", ["azure", "microsoft azure"]),
    ("GCP", "GCP", "CLOUD", ["gcp", "google cloud platform", "google cloud"]),
    ("DOCKER", "Docker", "TOOLING", ["docker"]),
    ("KUBERNETES", "Kubernetes", "TOOLING", ["kubernetes", "k8s"]),
    ("TERRAFORM", "Terraform", "TOOLING", ["terraform"]),
    ("POSTGRESQL", "PostgreSQL", "DATABASE", ["postgresql", "postgres"]),
    ("MONGODB", "MongoDB", "DATABASE", ["mongodb", "mongo"]),
    ("REDIS", "Redis", "DATABASE", ["redis"]),
    ("KAFKA", "Kafka", "TOOLING", ["kafka", "apache kafka"]),
    ("SPARK", "Spark", "TOOLING", ["apache spark", "spark"]),
    ("DATABRICKS", "Databricks", "TOOLING", ["databricks"]),
    ("PYTORCH", "PyTorch", "AI_ML", ["pytorch"]),
    ("TENSORFLOW", "TensorFlow", "AI_ML", ["tensorflow"]),
    ("LLM", "LLM", "AI_ML", ["llm", "llms", "large language model", "large language models"]),
    ("RAG", "RAG", "AI_ML",
     ["retrieval augmented generation", "retrieval-augmented generation", "rag"]),
    ("LANGCHAIN", "LangChain", "AI_ML", ["langchain"]),
    ("OPENAI", "OpenAI", "AI_ML", ["openai", "open ai", "chatgpt", "gpt-4", "gpt4"]),
    ("CLAUDE", "Claude", "AI_ML",
     ["claude ai", "claude (anthropic)", "anthropic claude", "claude code"]),
    ("AI_AGENTS", "AI Agents", "AI_ML", ["ai agents", "autonomous agents", "agentic ai"]),
]
EXACT_CASE_TECHNOLOGY = ("GOLANG", "Go")

# --------------------------------------------------------------------------------------
# Entity resolution.
# --------------------------------------------------------------------------------------
# Used as regular expressions on the end of the name, dots included ("s.a." also takes a
# final "scan" away): results follow the fixed list as it stands.
LEGAL_SUFFIXES = [
    "inc", "incorporated", "llc", "ltd", "limited", "gmbh", "s.a.", "sa", "b.v.", "bv", "ag",
    "plc", "corp", "corporation", "co", "s.r.o.", "oy", "ab", "as",
]
MATCH_WEIGHTS = {"url": 100, "company": 40, "title": 30, "description": 25, "location": 10}
MERGE_THRESHOLD = 70
TITLE_SIMILARITY = 0.85
DESCRIPTION_SIMILARITY = 0.6
NARROW_COUNTRIES = 2
CANDIDATE_WINDOW_DAYS = 45
CANDIDATE_LIMIT = 20
TITLE_SIMILARITY_FLOOR = 0.4

# --------------------------------------------------------------------------------------
# Capture, runs, search presets.
# --------------------------------------------------------------------------------------
TERMINAL_STATUSES = [
    "PUBLISHED", "REJECTED_GEOGRAPHY", "REJECTED_ROLE_CATEGORY", "MERGED_DUPLICATE",
]
ERROR_SAMPLE = 10
ATS_HOSTS = [
    ("greenhouse", ["boards.greenhouse.io", "job-boards.greenhouse.io"]),
    ("lever", ["jobs.lever.co"]),
    ("ashby", ["jobs.ashbyhq.com"]),
    ("workday", ["myworkdayjobs.com"]),
    ("smartrecruiters", ["jobs.smartrecruiters.com"]),
    ("workable", ["apply.workable.com"]),
    ("teamtailor", ["teamtailor.com"]),
    ("bamboohr", ["bamboohr.com"]),
    ("recruitee", ["recruitee.com"]),
    ("pinpoint", ["pinpointhq.com"]),
    ("personio", ["jobs.personio.com", "jobs.personio.de"]),
]
POSTED_WITHIN_HOURS = {"1h": 1, "6h": 6, "24h": 24, "3d": 72, "7d": 168, "30d": 720}
LANDING_PRESETS = {
    "remote-software-engineer-jobs": {"role_category": ["SOFTWARE_ENGINEER"]},
    "remote-full-stack-jobs": {"role_category": ["FULL_STACK_ENGINEER"]},
    "remote-backend-jobs": {"role_category": ["BACKEND_ENGINEER"]},
    "remote-frontend-jobs": {"role_category": ["FRONTEND_ENGINEER"]},
    "remote-ai-engineer-jobs": {"role_category": ["AI_ENGINEER", "ML_ENGINEER"]},
    "remote-data-engineer-jobs": {"role_category": ["DATA_ENGINEER"]},
    "remote-devops-jobs": {"role_category": ["DEVOPS_ENGINEER"]},
    "remote-jobs-europe": {"region": ["EUROPE"]},
    "remote-jobs-eu": {"region": ["EU"]},
    "remote-jobs-eea": {"region": ["EEA"]},
    "remote-jobs-emea": {"region": ["EMEA"]},
    "remote-jobs-uk": {"country": ["GB"]},
    "remote-jobs-germany": {"country": ["DE"]},
}
# (slug, display name, integration method, status)
SOURCES = [
    ("greenhouse", "Greenhouse", "PUBLIC_API", "ENABLED"),
    ("lever", "Lever", "PUBLIC_API", "ENABLED"),
    ("ashby", "Ashby", "PUBLIC_API", "ENABLED"),
    ("remoteok", "RemoteOK", "PUBLIC_API", "ENABLED"),
    ("workable", "Workable", "PUBLIC_API", "ENABLED"),
    ("smartrecruiters", "SmartRecruiters", "PUBLIC_API", "ENABLED"),
    ("remotive", "Remotive", "PUBLIC_API", "ENABLED"),
    ("himalayas", "Himalayas", "PUBLIC_API", "ENABLED"),
    ("workingnomads", "Working Nomads", "PUBLIC_API", "ENABLED"),
    ("jobicy", "Jobicy", "PUBLIC_API", "ENABLED"),
    ("nofluffjobs", "No Fluff Jobs", "PUBLIC_API", "ENABLED"),
    ("landingjobs", "Landing.jobs", "PUBLIC_API", "ENABLED"),
    ("weworkremotely", "We Work Remotely", "RSS_FEED", "ENABLED"),
    ("germantechjobs", "GermanTechJobs", "RSS_FEED", "ENABLED"),
    ("pythonjobs", "Python.org Jobs", "RSS_FEED", "ENABLED"),
    ("larajobs", "LaraJobs", "RSS_FEED", "ENABLED"),
    ("hackernews", "Hacker News (Who is Hiring?)", "OFFICIAL_API", "ENABLED"),
    ("jobgether", "Jobgether", "OFFICIAL_API", "ENABLED"),
    ("teamtailor", "Teamtailor", "RSS_FEED", "ENABLED"),
    ("personio", "Personio", "STRUCTURED_FEED", "ENABLED"),
    ("recruitee", "Recruitee", "STRUCTURED_FEED", "ENABLED"),
    ("pinpoint", "Pinpoint", "PUBLIC_API", "ENABLED"),
    ("careerpage", "Company career pages (JSON-LD)", "STRUCTURED_FEED", "DISABLED"),
    ("linkedin", "LinkedIn", "PERMITTED_CRAWL", "ENABLED"),
    ("remoteyeah", "RemoteYeah", "PERMITTED_CRAWL", "ENABLED"),
    ("wellfound", "Wellfound", "PERMITTED_CRAWL", "ENABLED"),
    ("jobright", "Jobright", "PERMITTED_CRAWL", "UNSUPPORTED"),
    ("indeed", "Indeed", "PERMITTED_CRAWL", "UNSUPPORTED"),
    ("glassdoor", "Glassdoor", "PERMITTED_CRAWL", "UNSUPPORTED"),
    ("welcometothejungle", "Welcome to the Jungle", "PERMITTED_CRAWL", "UNSUPPORTED"),
    ("workday", "Workday", "ATS_ENDPOINT", "UNSUPPORTED"),
    ("bamboohr", "BambooHR", "OFFICIAL_API", "UNSUPPORTED"),
]
# The order the status column sorts in.
SOURCE_STATUS_ORDER = ["ENABLED", "DISABLED", "UNSUPPORTED"]


def dictionary_rows() -> list[tuple[str, int, str, str]]:
    """All phrase dictionaries as ``(dict, priority, phrase, value)`` rows."""
    rows: list[tuple[str, int, str, str]] = []

    def add(name: str, pairs) -> None:
        rows.extend((name, i, phrase, value) for i, (phrase, value) in enumerate(pairs))

    add("region", [(p, r) for r, ps in REGION_PHRASES.items() for p in ps])
    add("worldwide", [(p, "WORLDWIDE") for p in WORLDWIDE_PHRASES])
    add("us-eligible", [(p, "US") for p in US_ELIGIBLE_PHRASES])
    add("exclusive-non-european", [(p, None) for p in EXCLUSIVE_PHRASES])
    add("country", COUNTRY_PHRASES)
    add("timezone", [(p, None) for p in TIMEZONE_PHRASES])
    add("weak-company", [(p, None) for p in WEAK_COMPANY_PHRASES])
    add("seniority", [(k, s) for s, _, ks in SENIORITY for k in ks])
    add("role_category", [(k, slug) for slug, _, _, ks in ROLE_CATEGORIES for k in ks])
    add("domain_tag", [(k, t) for t, ks in DOMAIN_TAGS for k in ks])
    add("employment_type", [(k, t) for t, ks in EMPLOYMENT_KEYWORDS for k in ks])
    add("technology", [(a, slug) for slug, _, _, als in TECHNOLOGIES for a in als])
    return rows
