"""Line formats: timestamps, levels, masks, crash layouts.  Fixed values.

All patterns avoid look-around, so the same text runs in any linear-time regex
engine as well.
"""

# Fixed value: the characters Python's str methods and ``\s`` treat as white space.
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Fixed value: a run of word characters, counting letters and digits of any script.
WORD = r"[\p{L}\p{N}_]+"

# Timestamp layouts.
KERNEL_PRIORITY = r"<\d+>\[(\d+\.\d+)\]"
KERNEL_ANYWHERE = r"\[(\d+\.\d+)\]"
KERNEL_START = r"^\[\s*(\d+\.\d+)\]"
SERVICE = r"dtv_svc\[\d+\]: \[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{1,6})\]"
SCPL_LEVELLED = r"\[SCPL\] (?:INFO|WARNING|ERROR)\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,\.]\d{2,6})\s+"
SCPL_PLAIN = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
SLASHED = r"(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"
LOGCAT = r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"
LOGCAT_START = r"^\s*(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"
ISO = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
ISO_UTC = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)"
SYSLOG_START = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
SYSLOG_ANYWHERE = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
SYSLOG_FRACTION = r"^\s*(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)"

# Levels.
GATE_LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|WARNING|WARN|ERROR|ERR|FATAL|CRITICAL|CRIT)\b"
GATE_LEVEL_ALIASES = {"WARN": "WARNING", "ERR": "ERROR", "CRIT": "CRITICAL", "FATAL": "CRITICAL"}
UTILS_LEVEL = r"(?i)\b(VERBOSE|DEBUG|INFO|WARNING|WARN|ERROR|ERR|CRITICAL|FATAL|WTF)\b"
UTILS_LEVEL_ALIASES = {"WARN": "WARNING", "ERR": "ERROR", "WTF": "FATAL"}
CONTAINED_LEVELS = ["ERROR", "ERR", "WARN", "WARNING", "INFO", "DEBUG"]
LEVEL_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARNING": 3, "ERROR": 4, "FATAL": 5, "CRITICAL": 5}

# Fixed value: where a line states an HTTP status.
HTTP_STATUS = (
    r"(?i)\b(?:status|http_status|code|status_code)[\s=:]+([1-5]\d{2})\b"
    r"|\b([1-5]\d{2})\s+(?:HTTP|status)\b"
    r"|\s([1-5]\d{2})\s+(?:Internal|Not\s+Found|Error|Unauthorized|Forbidden|Bad\s+Request)"
)

ANSI = r"\x1b\[[0-9;]*[mABCDEFGHJKSTfhilmnpsu]"

# Masking rules in order; ``\1`` stands for the first group.
MASKS: list[tuple[str, str]] = [
    (r"(?:\x1b|\\x1b)\[[0-9;]*[A-Za-z]", ""),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"proctitle=[0-9a-fA-F]{12,}", "proctitle=<HEX>"),
    (r"=[0-9a-fA-F]{6,}\b", "=<HEX>"),
    (r"(?:\b[0-9a-fA-F]{2}\b *){8,}", "<HEXDUMP>"),
    (r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\.\d{3,}\s+\S+", "<JDT>"),
    (r"^\[\s*\d+\.\d{4,}\]", "[<UPTIME>]"),
    (r"\[\d+\]:", "[<PID>]:"),
    (r"\[\d+:\d+:(DEBUG|INFO|WARNING|ERROR|VERBOSE|CONSOLE):", r"[<PID>:<PID>:\1:"),
    (r"\[\d{3,}\]", "[<NUM>]"),
    (r"(?i)\b(?:pc|lr|sp)\s+[0-9a-fA-F]{6,}\b", "<ADDR>"),
    (r"/3rd/loki/lib\S+\.so(?:\.\d+)*", "<LIB>"),
    (r"\b(?:port|PORT)\s*[=:]\s*\d{4,5}\b", "<PORT>"),
    (r"\bv?\d+\.\d+\.\d+(?:[-+]\w+)?\b", "<VER>"),
    (r"\b1[4-9]\d{8}\b|\b[2-9]\d{9}\b", "<TS>"),
    (r"\b(?:pid|ppid|auid|uid|gid|euid|suid|fsuid|egid|sgid|fsgid|ses)\s*[=:]\s*\d+", "<PID>"),
    (r"\b\d{4,}\b", "<NUM>"),
]

_H = "[0-9a-fA-F]"

#: What every match of a costly mask holds: one of some fixed strings (a tuple), or a match of a regex that is cheap to look for.
MASK_SIGNS: dict[str, tuple[str, ...] | str] = dict(zip((regex for regex, _ in MASKS), [
    ("\x1b[", r"\x1b["), rf"-{_H}{{4}}-{_H}{{4}}-", r"\.\d{1,3}\.\d{1,3}\.\d", ("0x",), ("proctitle=",), ("=",), rf" {_H}{{2}} +{_H}", None, None,
    ("]:",), ("[",), ("[",), rf"[cCrRpP]\s+{_H}{{6}}", ("/3rd/loki/lib",), ("port", "PORT"), r"\.\d+\.\d", r"\d{10}", r"[ds]\s*[=:]\s*\d", None]))

# Tokens.
UPPER_TOKEN = r"[A-Z][A-Z0-9_]{3,}"
IDENT_TOKEN = r"[A-Z][A-Z0-9_]{3,}|[A-Za-z][a-zA-Z0-9_]{4,}"

# Fixed value: a whole token that varies between lines of one template.
VARIABLE_TOKEN = (
    r"^(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|0x[0-9a-fA-F]+"
    r"|/[\w./\-]+"
    r"|\d+)$"
)

# File names that look like logs.
LOG_EXTENSIONS = [".log", ".txt", ".dmesg", ".crash", ".tombstone", ".logcat"]
LOG_NAME = (
    r"(?i)(loki|smartcast|dmesg|tombstone|logcat|bugreport|android|kernel"
    r"|crash|diag|debug|error|syslog|messages)"
)

# Crash layouts.
LOAD_MAP = r"([0-9a-f]+)-([0-9a-f]+)\s+([rwxp-]+)\s+[0-9a-f]+\s+[\w:]+\s+\d+\s+(.+)"
LOAD_MAP_TOMBSTONE = r"([0-9a-fA-F]+)-[0-9a-fA-F]+\s+\S+\s+\S+\s+\S+\s+\S+\s+(/[^\s]+)"
FRAME = r"#(\d+)\s+pc\s+([0-9a-f]+)\s+(\S+)(?:\s+\(([^)]+)\))?"
FRAME_TOMBSTONE = r"#(\d{2})\s+pc\s+([0-9a-fA-F]+)\s+(/[^\s]+)"
OOPS_SIGNATURES = [
    ("NULL_DEREF", r"(?i)Unable to handle kernel NULL pointer dereference at virtual address ([0-9a-f]+)"),
    ("PAGE_FAULT", r"(?i)BUG: unable to handle kernel paging request at ([0-9a-f]+)"),
    ("KERNEL_PANIC", r"(?i)Kernel panic - not syncing:(.+)"),
    ("BUG", r"(?i)kernel BUG at (.+):(\d+)!"),
    ("OOPS", r"(?i)Internal error: Oops:(.+)"),
]
OOPS_PC = r"(?i)pc : \[<([0-9a-f]+)>\]"
OOPS_PC_SKIP = r"PC is at|RIP:"
OOPS_TAINTED = r"(?i)Tainted:\s*([A-Z\s]+)"
OOPS_TRACE_START = r"(?i)Call Trace:|Backtrace:"
OOPS_TRACE_LINE = r"(?i)(?:\[<[0-9a-f]+>\])?\s*([a-zA-Z0-9_\.]+)\+0x([0-9a-f]+)/0x([0-9a-f]+)"
VLQ_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

# Text lines that compression never removes, and lines it drops first.
PROTECTED = (
    r"(?i)## SYSTEM PROMPT|ErrorCategory\.|BugLayer\.|SIGSEGV|SIGABRT|stack trace:|backtrace:"
    r"|ConfidenceResult|FixCandidate|PipelineState|#00 pc|Fatal signal|Abort message"
)
LOW_SIGNAL = r"(?i)^\s*(?:\d{4}-\d{2}-\d{2}|\[\s*\d+\.\d+\])\s+\[DEBUG\]"

# Sanitizer and test output.
SANITIZER_LINE = (
    r"(?i)ERROR: AddressSanitizer|ERROR: ThreadSanitizer|heap-buffer-overflow"
    r"|use-after-free|DATA RACE"
)
SANITIZER_LABELS = [
    ("ERROR: AddressSanitizer", "AddressSanitizer error detected"),
    ("ERROR: LeakSanitizer", "Memory leak detected"),
    ("WARNING: ThreadSanitizer: data race", "Data race detected"),
    ("WARNING: ThreadSanitizer: lock-order-inversion", "Deadlock risk detected"),
]
TEST_PASS = r"\bPASS\b|\[  PASSED  \]\s+(\d+)"
TEST_FAIL = r"\bFAIL\b|\[  FAILED  \]\s+(\d+)"

# Symbols named in a root cause.
SYMBOL_CALL = r"(?i)\b([a-z_][a-z0-9_]*)\s*\("
SYMBOL_CLASS = r"\b([A-Z][a-zA-Z0-9]+)\b"
SYMBOL_FILE = r"(?i)\b([a-z_][a-z0-9_]*\.(?:py|js|cpp|c|h|java|go|rs))\b"
