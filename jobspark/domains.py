"""Dictionaries, enumerations, limits and weights."""

# Application stages, in board order.
STAGES = ("saved", "applied", "interviewing", "rejected", "offer")

# Stage moves offered to users.
STAGE_MOVES = (
    ("saved", "applied"),
    ("applied", "interviewing"),
    ("applied", "rejected"),
    ("interviewing", "offer"),
    ("interviewing", "rejected"),
    ("rejected", "saved"),
    ("offer", "saved"),
)

INTERVIEW_TYPES = ("phone_screen", "technical", "onsite", "behavioral", "other")
REMOTE_PREFERENCES = ("remote_only", "hybrid", "onsite", "any")
FEEDBACK = ("good", "bad", "skip")
PROFICIENCY = ("beginner", "intermediate", "advanced", "expert")
REQUIREMENT = ("required", "preferred")
RUN_STATUS = ("running", "completed", "failed")
SOURCES = ("adzuna", "usajobs", "remoteok")

# Similarity adjustment per feedback signal.
FEEDBACK_WEIGHT = {"good": 0.05, "bad": -0.10, "skip": -0.04}

SKILLS = (
    "python", "sql", "pyspark", "spark", "databricks", "delta lake", "airflow",
    "dbt", "aws", "azure", "gcp", "kafka", "docker", "kubernetes", "terraform",
    "java", "javascript", "react", "machine learning", "tableau", "power bi",
    "snowflake",
)

# Warning label -> text token that raises it. "upfront payment" is raised by the
# bare word, so "crypto payment" raises two labels.
RISK_TOKENS = {
    "upfront payment": "payment",
    "gift card": "gift card",
    "wire transfer": "wire transfer",
    "telegram": "telegram",
    "whatsapp": "whatsapp",
    "crypto payment": "crypto payment",
    "equipment check": "equipment check",
}
RISK_BAD_URL = "missing or invalid application URL"
RISK_PRIVATE_URL = "application URL resolves to a private address"
RISK_UNVERIFIED_URL = "application URL could not be verified"
RISK_HTTP_PREFIX = "application URL returned HTTP "
RISK_NOTICE = "Heuristic screening only; verify the employer independently."

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
EMBEDDING_DIMENSION = 1024
EMBEDDING_BATCH = 8
EMBEDDING_BATCH_MAX = 32

SYNC_LIMIT = 50
SYNC_LIMIT_MAX = 200
SYNC_QUERIES_MAX = 15
DEFAULT_QUERIES = ("software engineer", "data engineer", "machine learning engineer")
MIN_DESCRIPTION_WORDS = 12
MIN_DESCRIPTION_CHARS = 40
TAIL_MARKER = "please mention the word"

STALE_DAYS = 14
RESUME_MAX_BYTES = 250_000
ERROR_MAX_CHARS = 10_000


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))
