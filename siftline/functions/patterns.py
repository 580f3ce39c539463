"""Regular expressions.

Written so that Java (Spark) and RE2 (the SQL oracle) read them alike:
``\\w`` and ``\\s`` differ between the two, hence the explicit classes.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE_SET = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_SET}]"
TRIM = f"^{SPACE}+|{SPACE}+$"
# The characters of SPACE one by one.
SPACES = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)
LONG_WORD = WORD + "{3,}"

# ---------------------------------------------------------------------------
# What counts as a target, a feature list, a data source or a use.
# ---------------------------------------------------------------------------
TARGET = tuple(
    p.replace(r"\w", WORD).replace(r"\s", SPACE)
    for p in (
        r"predict\s+(\w+)",
        r"forecast\s+(\w+)",
        r"classify\s+(\w+)",
        r"target\s+(?:variable|column|feature)?\s*:?\s*(\w+)",
        r"predicting\s+(\w+)",
        r"outcome\s+(?:variable|is)?\s*:?\s*(\w+)",
        r"dependent\s+variable\s*:?\s*(\w+)",
    )
)
FEATURE = tuple(
    p.replace(r"\s", SPACE)
    for p in (
        r"feature[s]?\s+(?:are|include|:)?\s*([^\.]+)",
        r"input[s]?\s+(?:are|include|:)?\s*([^\.]+)",
        r"variable[s]?\s+(?:are|include|:)?\s*([^\.]+)",
        r"based on\s+([^\.]+)",
        r"using\s+([^\.]+)\s+to",
    )
)
DATA_SOURCE = tuple(
    p.replace(r"\s", SPACE)
    for p in (
        r"dataset[s]?",
        r"data\s+(?:from|source|available)",
        r"csv",
        r"excel",
        r"database",
        r"kaggle",
        r"huggingface",
        r"uci",
    )
)
INTENDED_USE = tuple(
    p.replace(r"\s", SPACE)
    for p in (
        r"use\s+(?:for|to|in)",
        r"predictions?\s+(?:for|to|will)",
        r"deploy",
        r"production",
        r"application",
        r"help\s+(?:with|to)",
        r"goal\s+is",
        r"purpose",
    )
)
# A log line, a stage marker in its message, and the marker that ends a run.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - .*? - INFO - ?(.*)$"
STAGE_MARKER = r"^\s*\[Stage \d+\.?\d*(?: & \d+\.?\d*)?\] (.*)$"
END_MARKER = r"^\s*Pipeline results saved to "
# --- end of fixed values ---------------------------------------------------

BASED_ON = FEATURE[3]
TARGET_AFTER_PREDICT = TARGET[0]
