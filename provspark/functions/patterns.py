"""The patterns, names and word lists that results depend on."""

from __future__ import annotations

#: Query classes, in the order in which their terms are used.
QUERY_CLASSES = {
    "checkpoint_ids": r"(?i)\bCP-\d+\b",
    "section_marks": r"(?i)§\s*\d+(?:\.\d+)*|\b(?:section|chapter)\s+\d+(?:\.\d+)*",
    "camel_case": r"\b[A-Za-z][A-Za-z0-9_]*(?:[a-z][A-Z]|[A-Z][a-z]+[A-Z])[A-Za-z0-9_]*\b",
    "snake_case": r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]*\b",
    "kebab_case": r"(?<!-)\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b(?!-)",
    "namespace_symbols": r"\b[A-Za-z_]\w*(?:::[A-Za-z_]\w*)+\b",
    "dotted_or_versioned": r"\b[A-Za-z_][\w-]*(?:\.[\w-]+)+(?:@\d+)?\b|\b[\w.-]+@\d+\b",
    "file_symbols": r"\b[\w./-]+\.py:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?\b",
    "cli_flags": r"(?<!\w)--[a-z0-9][a-z0-9-]*\b",
    "error_codes": r"\b(?:[A-Z][A-Z0-9]*_[A-Z0-9_]*\d[A-Z0-9_]*|[A-Z]+\d{2,})\b",
    "anchors": r"(?i)#[a-z0-9][a-z0-9_-]*(?:-[a-z0-9_-]+)*",
    "paths": r"(?:^|\s)([\w.-]+(?:[/\\][\w.-]+)+)(?=$|\s|[,:;])",
    "quoted_phrases": r"""["']([^"']+?)["']""",
}

#: Symbols in a section's text.
SYMBOLS = {
    "checkpoint": r"(?i)\bCP-\d+\b",
    "file_symbol": r"\b[\w./-]+\.py:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?\b",
    "namespace": r"\b[A-Za-z_]\w*(?:::[A-Za-z_]\w*)+\b",
    "dotted": r"\b(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*(?::[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)?\b",
    "error": r"\b[A-Z][A-Za-z0-9]*(?:Error|Failure|Timeout|Exception)\b",
    "camel": r"\b(?:[A-Z][a-z0-9]+){2,}(?:Error|Failure|Timeout|Exception)?\b",
    "constant": r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+(?:\d+)?\b",
    "versioned": r"\b[A-Za-z_][\w.-]*@\d+\b",
    "cli_flag": r"(?<!\w)--[a-z0-9][a-z0-9-]*\b",
    "kebab": r"(?<!-)\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b(?!-)",
}
SECTION_MARK = r"(?i)(?:§\s*\d+(?:\.\d+)*|(?:section|chapter)\s+\d+(?:\.\d+)*)"
DEPENDENCY_LINE = r"(?i)^\s*(?:[-*]\s*)?(?:\*\*)?Dependencies?(?:\*\*)?\s*:\s*(.*)$"
LINK = r"\[[^\]]+\]\(([^)#]*)#([^)]+)\)"
DECLARATION = r"(?i)\b(?:interface|model|type|class|error|exception)\s+([\w.:-]+)"

CHECKPOINT_HEADING = r"(?i)^\s*(CP-\d+)\s*(?:[—–-]\s*)?(.*)$"
FIELD_LINE = r"^\s*(?:[-*]\s*)?(?:\*\*)?([A-Za-z][A-Za-z /_-]+?)(?:\*\*)?\s*:\s*(.*)$"
LIST_LINE = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)(.*)$"
#: Field names of checkpoints by their canonical heading.
FIELDS = {
    "goal": "goal",
    "why": "why",
    "dependencies": "dependencies",
    "dependency": "dependencies",
    "exact scope": "exact_scope",
    "scope": "exact_scope",
    "files modules": "files_modules",
    "files": "files_modules",
    "interfaces models": "interfaces_models",
    "interfaces": "interfaces_models",
    "models": "interfaces_models",
    "cli behavior": "cli_behavior",
    "tests acceptance criteria": "tests_acceptance_criteria",
    "tests": "tests_acceptance_criteria",
    "acceptance criteria": "tests_acceptance_criteria",
    "failure conditions": "failure_conditions",
    "out of scope": "out_of_scope",
    "artifacts": "artifacts",
    "verify": "verify",
    "security": "security",
    "security constraints": "security",
}

IDENTIFIER = r"\bCP-\d+\b|\b(?:[A-Z][a-z0-9]+){2,}\b|\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b|\b[A-Za-z_][\w-]*(?:\.[\w-]+)+(?:@\d+)?\b"
#: Markers of an assertion: family, polarity, pattern; the first to claim a span has it.
MARKERS = [
    ("modal", -1, r"(?i)\b(?:must|shall|should|may)\s+not\b|\bmust\s+never\b"),
    ("modal", 1, r"(?i)\b(?:must|shall|should)\b(?!\s+(?:not|never)\b)"),
    ("state", 1, r"(?i)\benabled\b"),
    ("state", -1, r"(?i)\bdisabled\b"),
    ("permission", 1, r"(?i)\ballowed\b"),
    ("permission", -1, r"(?i)\b(?:prohibited|disallowed)\b"),
    ("requirement", 1, r"(?i)\brequired\b"),
    ("requirement", -1, r"(?i)\bforbidden\b"),
]
LEADING_FIELD = r"^[-*+]\s*(?:\*\*)?[^:\n]{1,80}:(?:\*\*)?\s*"
TRAILING_QUALIFIER = r"(?i)\b(?:for|in|during|when|under|on|within|against|by|to)\b.*"
SUBJECT_STOP_WORDS = frozenset("a an and any are as be below by each every for from has have if in is it its no of or that the their them these this those to with".split())
PROPERTY_STOP_WORDS = frozenset("a an be is are the to".split())
SUBJECT_WINDOW = 96
HASH_TOKEN = r"[\w.@/:-]+"
