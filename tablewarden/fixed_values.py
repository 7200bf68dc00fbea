"""Fixed values that results depend on. They are data, not logic: change them only with the format."""

# Limits.
SAFE_INTEGER_MAX = 9_007_199_254_740_991
LOCK_BUDGET_SECONDS = 10
PROGRESS_INTERVAL_MS = 250
MIN_THREADS = 2
PORT_RANGE = (1, 65_535)

# Run-log formats.
SUPPORTED_LOG_VERSION = "1"
COUNTER_PATTERN = r"\A(0|[1-9][0-9]*)\z"
TIMESTAMP_PATTERN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6}\z"
COUNTERS = (
    "rows",
    "rows_done",
    "rows_total",
    "bytes",
    "retries",
    "warnings",
    "errors",
    "completed",
    "total",
    "exit_code",
    "duration_ms",
    "files",
)
SOURCE_STATUSES = (
    "started",
    "progress",
    "finished",
    "failed",
    "cancelled",
    "warning",
    "detected",
    "paused",
)
PHASES = (
    "startup",
    "preflight",
    "locking",
    "backup",
    "restore",
    "verification",
    "finalization",
)
COMPLETION_EVENTS = ("dump_completed", "restore_completed")

# The consistency lifecycle of an export: (event, phase, status) in the order they must occur.
EXPORT_LIFECYCLE = (
    ("lock", "global_lock", "started"),
    ("backup_consistency", "startup", "finished"),
    ("table_unlock", "startup", "finished"),
    ("dump_phase", "wait_database_finish", "progress"),
)

# Names of an event's public fields, in output order.
PUBLIC_FIELDS = (
    "runId",
    "sequence",
    "parentSequence",
    "timestamp",
    "phase",
    "tool",
    "type",
    "status",
    "message",
    "code",
    "completed",
    "total",
    "rows",
    "bytes",
    "retries",
    "warnings",
    "errors",
    "files",
    "durationMs",
    "exitCode",
    "fatal",
    "retryable",
)

# Names and identifiers.
SAFE_IDENTIFIER_PATTERN = r"\A[A-Za-z0-9_-]+\z"
RESERVED_PREFIX = "tablewarden_"
SAFE_TOKEN_PATTERN = r"\A[A-Z0-9_]{1,64}\z"
SYSTEM_DATABASES = ("information_schema", "mysql", "performance_schema", "sys")
SAFE_ENGINE = "INNODB"

# The static privileges which together are as good as ALL PRIVILEGES when one grant holds them.
ALL_STATIC_PRIVILEGES = (
    "SELECT",
    "INSERT",
    "UPDATE",
    "DELETE",
    "CREATE",
    "DROP",
    "RELOAD",
    "SHUTDOWN",
    "PROCESS",
    "FILE",
    "REFERENCES",
    "INDEX",
    "ALTER",
    "SHOW DATABASES",
    "SUPER",
    "CREATE TEMPORARY TABLES",
    "LOCK TABLES",
    "EXECUTE",
    "REPLICATION SLAVE",
    "REPLICATION CLIENT",
    "CREATE VIEW",
    "SHOW VIEW",
    "CREATE ROUTINE",
    "ALTER ROUTINE",
    "CREATE USER",
    "EVENT",
    "TRIGGER",
    "CREATE TABLESPACE",
    "CREATE ROLE",
    "DROP ROLE",
)

# Settings.
PROFILES = ("production", "replica", "expert")
COMPRESSIONS = ("none", "gzip", "zstd")
CONSISTENCY_MODES = ("auto", "safe-no-lock", "no-lock")
DESTINATION_POLICIES = ("require-empty", "allow-existing")
OVERWRITE_POLICIES = ("reject", "drop", "truncate", "delete")
BINLOG_POLICIES = ("disable", "enable")
TLS_MODES = ("disabled", "preferred", "required", "verify-ca", "verify-identity")

# Redaction.
REDACTED = "[redacted]"
SECRET_ASSIGNMENT_KEYS = ("password", "passwd", "pwd")
# An assigned secret, whatever its case; group 1 is all but the value.
SECRET_ASSIGNMENT_PATTERN = r"""((?:password|passwd|pwd)\s*[=:]\s*)(?:"[^"]*"|'[^']*'|[^\s,;]+)"""
SENSITIVE_KEY_PATTERN = (
    "(?i)(password|passwd|pwd|secret|token|authorization|credential|api[-_]?key)"
)
