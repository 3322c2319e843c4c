"""Fixed values of the git checks: patterns, names and words."""

# Secrets in raw objects (kind, pattern, score).
OBJECT_SECRETS = [
    ("Secret Found in Raw Git Object",
     r"""(?i)(password|passwd|secret|secret_key|api_key|apikey|token|auth_token|access_token|private_key)\s*[=:]\s*['"][^'"]{8,}['"]""", 95),
    ("JWT Token in Raw Git Object", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", 95),
    ("AWS Key in Raw Git Object", r"AKIA[0-9A-Z]{16}", 98),
]
SENSITIVE_PATHS = [".env", "config", "secret", "password"]
SENSITIVE_WORDS = "(?i)password|secret|token|key"
STASH_WORDS = "(?i)password|secret"
STANDARD_HOOKS = [
    "applypatch-msg", "commit-msg", "fsmonitor-watchman", "post-update", "pre-applypatch", "pre-commit",
    "pre-merge-commit", "pre-push", "pre-rebase", "pre-receive", "prepare-commit-msg", "push-to-checkout",
    "update", "pre-auto-gc",
]
HOOK_WORDS = r"curl|wget|nc |netcat|bash -i|/dev/tcp/|password|secret|token"
# Fixed value: objects above this size are reported.
LARGE_OBJECT_BYTES = 10 * 1024 * 1024

# Our own choice: the vendor signatures and entropy bounds are described in
# prose only, so these are not meant to equal another tool's.
HISTORY_SIGNATURES = [
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub Token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("Slack Token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("OpenAI Key", r"sk-[A-Za-z0-9]{32,}"),
    ("Secret Assignment", r"(?i)(?:password|secret_key|api_key|token)\s*=\s*\"[^\"\s]{8,}\""),
]
TOKEN = r"[A-Za-z0-9+/_=\-]{20,}"
TOKEN_MIN_BITS = 3.5
