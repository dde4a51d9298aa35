"""Fixed values.

Word lists, lookup tables, constants and patterns below decide results and so
must keep exactly these values.  They are plain data; nothing here has logic.
"""

from __future__ import annotations

import sys

# ---------------------------------------------------------------- file discovery
EXCLUDED_PATH_PARTS = [
    "venv", ".venv", "__pycache__", ".git", ".tox",
    "node_modules", "dist", "build", ".eggs",
]

# ---------------------------------------------------------------- security rules
# (rule_id, regex, label, finding_type, severity)
SECRET_RULES = [
    ("api_key", r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*["']([^"']{10,})["']""",
     "API Key", "hardcoded_secret", "high"),
    ("password", r"""(?i)(secret|password|passwd|pwd)\s*[=:]\s*["']([^"']{5,})["']""",
     "Secret/Password", "hardcoded_secret", "high"),
    ("auth_token", r"""(?i)(token|auth[_-]?token)\s*[=:]\s*["']([^"']{10,})["']""",
     "Auth Token", "hardcoded_secret", "high"),
    ("openai_key", r"""sk-[a-zA-Z0-9]{32,}""",
     "OpenAI Key", "hardcoded_secret", "high"),
    ("aws_key", r"""(?i)aws[_-]?access[_-]?key[_-]?id\s*[=:]\s*["']([A-Z0-9]{20})["']""",
     "AWS Key", "hardcoded_secret", "high"),
    ("database_url", r"""(?i)(database_url|db_url)\s*[=:]\s*["']([^"']{10,})["']""",
     "Database URL", "hardcoded_secret", "high"),
]
INSECURE_RULES = [
    ("exec", r"""exec\s*\(""", "Use of exec()", "insecure_code", "medium"),
    ("eval", r"""eval\s*\(""", "Use of eval()", "insecure_code", "medium"),
    ("pickle", r"""pickle\.loads?\s*\(""",
     "Pickle deserialisation (code execution risk)", "insecure_code", "medium"),
    ("shell", r"""shell\s*=\s*True""",
     "shell=True in subprocess (injection risk)", "insecure_code", "medium"),
]
SECRET_MESSAGE_PREFIX = "Potential hardcoded "

# Comment-out rules of the rewriter: (regex, reason); first hit wins.
REMEDIATION_RULES = [
    (r"""\bexec\s*\(""",
     "exec() allows arbitrary code execution — validate or replace with safe alternative"),
    (r"""\beval\s*\(""",
     "eval() allows arbitrary code execution — validate or replace with safe alternative"),
    (r"""\bpickle\.loads?\s*\(""",
     "pickle.load/loads can execute arbitrary code — use json or safer format"),
    (r"""shell\s*=\s*True""",
     "shell=True in subprocess is vulnerable to injection — pass args as a list"),
]
REMEDIATION_DEFAULT = "Hardcoded secret detected — move to environment variable"

# ---------------------------------------------------------------- credentials
CREDENTIAL_LINE = (
    r"""^\s*([\w_]+)\s*(?::\s*[\w\[\], ]+)?\s*=\s*(['"])(.*?)\2\s*(?:#.*)?$"""
)
CREDENTIAL_KEYWORDS = [
    "key", "secret", "password", "passwd", "pwd", "token",
    "auth", "api", "jwt", "dsn", "url", "host", "endpoint",
    "credential", "private", "signing", "webhook", "stripe",
    "sendgrid", "twilio", "aws", "gcp", "azure", "github",
    "slack", "discord", "smtp", "ftp", "ssh", "ssl", "cert",
    "access", "refresh", "client", "server", "database", "db",
    "redis", "mongo", "postgres", "mysql", "sentry", "rollbar",
]
CREDENTIAL_MIN_LENGTH = 12
CREDENTIAL_SPECIALS = r"""[-_/@:!#$%^&*]"""
SIMPLE_WORD = r"""^[a-z_]+$"""
VERSION_TEXT = r"""^[\d]+\.[\d.]+$"""
ENVIRONMENT_NAME = r"""(?i)^(development|production|staging|test|debug|local)$"""
# (substrings, placeholder); first hit wins, else "your_<name>_here"
PLACEHOLDERS = [
    (["key"], "your_api_key_here"),
    (["secret"], "your_secret_here"),
    (["password", "pwd"], "your_password_here"),
    (["token"], "your_token_here"),
    (["url", "host"], "your_url_here"),
]

# ---------------------------------------------------------------- liveness
ALWAYS_ALIVE_FUNCTIONS = [
    "__init__", "__main__", "__all__", "__version__",
    "__repr__", "__str__", "__len__", "__iter__",
    "__enter__", "__exit__", "__call__", "__new__",
    "setup", "teardown", "main", "create_app", "make_app",
]
ALWAYS_ALIVE_SYMBOLS = [
    "__init__", "__main__", "__all__", "__version__", "__author__",
    "__repr__", "__str__", "__len__", "__iter__", "__next__",
    "__enter__", "__exit__", "__get__", "__set__", "__delete__",
    "__call__", "__class__", "__new__", "__del__",
    "setup", "teardown", "main",
    "create_app", "make_app",
    "celery", "app",
]
STDLIB_ROOTS = sorted(sys.stdlib_module_names)
THIRD_PARTY_ROOTS = [
    "django", "flask", "fastapi", "sqlalchemy", "pydantic",
    "requests", "aiohttp", "celery", "redis", "boto3",
    "numpy", "pandas", "scipy", "sklearn", "torch", "tensorflow",
    "langchain", "langgraph", "anthropic", "openai",
    "pytest", "click", "typer", "rich", "radon", "bandit",
]

# ---------------------------------------------------------------- thresholds
COMPLEXITY_GATE = 5
COMPLEXITY_HIGH = 15
SHORT_DOCSTRING = 10
LARGE_FILE_LINES = 450
CONFIDENCE_THRESHOLD = 0.7
HIGH_RISK_CONFIDENCE = 0.85
REJECTION_LIMIT = 0.50
HISTORY_ROWS = 10
REVIEWER_PAGE = 50
NOTIFICATION_PAGE = 100
DEBOUNCE = "30 seconds"
# Published letter bands for cyclomatic complexity: (upper bound, letter)
COMPLEXITY_GRADES = [(5, "A"), (10, "B"), (20, "C"), (30, "D"), (40, "E")]
COMPLEXITY_LAST_GRADE = "F"

# ---------------------------------------------------------------- actions
ACTION_TYPES = [
    "delete_file", "delete_function", "delete_import", "move_file",
    "restructure", "add_docstring", "fix_security", "update_dependency",
    "refactor_code",
]
RISK_OF_ACTION = {
    "delete_file": "critical",
    "delete_function": "high",
    "delete_import": "low",
    "move_file": "high",
    "restructure": "critical",
    "add_docstring": "low",
    "fix_security": "high",
    "refactor_code": "medium",
}
DEFAULT_RISK = "medium"
RISK_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
QUEUE_RISK_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
QUEUE_DEFAULT_RISK_RANK = 2
ACTION_PRIORITY = [
    "fix_security", "delete_file", "delete_import", "delete_function",
    "refactor_code", "add_docstring", "restructure", "move_file",
]
FILE_ACTION_ORDER = {
    "fix_security": 0,
    "delete_import": 1,
    "delete_function": 2,
    "refactor_code": 3,
    "add_docstring": 4,
    "restructure": 5,
    "move_file": 6,
}
LAST_ORDER = 99
DELETE_TYPES = ["delete_function", "delete_import", "delete_file"]
DESTRUCTIVE_TYPES = ["delete_function", "delete_import", "delete_file", "refactor_code"]
# primary -> secondary that runs after it on the same approval
COMPATIBLE = {"refactor_code": "add_docstring", "add_docstring": "refactor_code"}

AGENTS = ["dead_code", "security", "documentation", "structure"]
REVIEW_STATUSES = [
    "pending", "approved", "partially_approved", "rejected",
    "modified", "auto_approved", "invalidated", "blocked",
]

# ---------------------------------------------------------------- entity patterns
# Tried in order, on the description first and then on the title.
METHOD_NAME = [r"""[Mm]ethod '(\w+)'""", r"""[Mm]ethod:?\s+(\w+)"""]
CLASS_NAME = [r"""[Cc]lass '(\w+)'""", r"""[Cc]lass (\w+) is missing"""]
FUNCTION_NAME = [
    r"""[Ff]unction '(\w+)'""",
    r"""[Ff]unction:?\s+(\w+)""",
    r"""(?:Potentially unused function|Missing docstring for"""
    r"""|High complexity|High complexity method):\s*(\w+)""",
    r"""[Uu]nused:?\s+(\w+)""",
]
IMPORT_NAME = [
    r"""[Ii]mport ['"]?(\w+)['"]?""",
    r"""[Uu]nused import:?\s+['"]?(\w+)['"]?""",
    r"""'(\w+)' from '""",
]
STRUCTURE_NAME = [r"""[Cc]lass ['"]?(\w+)['"]?""", r"""[Mm]odule ['"]?(\w+)['"]?"""]
LOOSE_CLASS_NAME = [r"""[Cc]lass ['"]?(\w+)['"]?"""]
PENDING_DELETE_NAME = r"""[Ff]unction ['"]?(\w+)['"]?"""

# ---------------------------------------------------------------- text patterns
WORD = r"""[\p{L}\p{N}_]"""
CODE_FENCE = r"""(?s)```(?:python|py|Python)?[^\n]*\n(.*?)```"""
PLAIN_IMPORT = r"""^(\s*import\s+)(.+)$"""
FROM_IMPORT = r"""^(\s*from\s+[\w.]+\s+import\s+)(.+)$"""
ONE_LINE_LIST = r"""\[([^\]]+)\]"""
PREVIEW_CHARS = 60
LISTING_CHARS = 80
CHECKSUM_CHARS = 10
