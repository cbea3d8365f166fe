"""The text patterns the labels and parsers are defined by.

They are written in RE2 syntax, where ``\\b``, ``\\w`` and ``\\s`` are ASCII
only and ``\\s`` leaves out the vertical tab. ``jvm`` spells the same meaning
for ``java.util.regex``, whose ``\\b`` follows Unicode letters instead.
"""

from __future__ import annotations

import re

# --- fixed values -----------------------------------------------------------
# keys
PERSERO = r"(?i)\(\s*persero\s*\)"
TBK = r"(?i)\btbk\b"
COMPANY_PUNCT = r"[.,]"
LEGAL_FORM = r"(?i)^\s*(pt|cv)\b\s*"
BLANKS = r"\s+"
MODE_TAG = r"(?i)\(\s*(hybrid|remote|onsite)\s*\)"
TITLE_SENIORITY = r"(?i)^(senior|junior|lead|intern|magang)\b[\s\-:.,]*"
NON_KEY = r"[^a-z0-9]+"

# work mode, in order of precedence
MODE_PATTERNS = (
    ("hybrid", r"(?i)\bhybrid\b"),
    ("remote", r"(?i)\bremote(?:ly)?\b|\bwfh\b|\bwfa\b|work from home|work from anywhere"
               r"|kerja dari rumah|kerja jarak jauh"),
    ("onsite", r"(?i)\bon[\s-]?site\b|\bwfo\b|work from office|kerja di kantor"),
)

# seniority words of a title, in order of precedence
LEVEL_PATTERNS = (
    ("lead", r"(?i)\blead\b"),
    ("senior", r"(?i)\bsenior\b"),
    ("junior", r"(?i)\bjunior\b"),
    ("intern", r"(?i)\bintern(?:ship)?\b|\bmagang\b"),
)

# years of experience, tried in order; a second group marks a rejected match
_YEAR = r"year(?:'?s)?'?"
YEARS_PATTERNS = (
    r"(?i)(\d+)\s*(?:-|to)\s*\d+\+?\s*" + _YEAR + r"\s+(?:of\s+)?experience",
    r"(?i)(\d+)\+?\s*" + _YEAR + r"\s+(?:of\s+)?experience",
    r"(?i)experience\s*:?\s*(?:of\s+)?(?:at\s+least\s+|minimum\s+)?(\d+)\+?\s*" + _YEAR,
    r"(?i)at\s+least\s+(\d+)\+?\s*" + _YEAR,
    r"(?i)minimum\s+(\d+)\+?\s*" + _YEAR,
    r"(?i)(\d+)\+\s*" + _YEAR + r"\b(\s*old\b)?",
    r"(?i)minimal\s*(\d+)\s*tahun",
    r"(?i)\bmin\.?\s*(\d+)\s*tahun",
    r"(?i)(\d+)\s*tahun\s*pengalaman",
    r"(?i)pengalaman\s*(?:kerja\s*)?(?:minimal\s*)?(\d+)\s*tahun",
)

# salary
_UNIT = r"(jt|juta|jutaan|rb|ribu|ribuan)"
_TO = r"-|–|—|~|s/d|s\.d\.?|sampai(?:\s+dengan)?|hingga"
SALARY_VAGUE = r"(?i)\b(negotiable|competitive|nego|kompetitif|undisclosed|confidential|tbd)\b"
SALARY_FOREIGN = r"(?i)[$€£]|\b(usd|sgd|myr|eur|gbp)\b"
SALARY_CURRENCY = r"(?i)\b(rp|idr)\.?\s*"
SALARY_PERIOD = r"(?i)/\s*(bulan|bln|month)\b|\bper\s*(bulan|month)\b"
SALARY_RANGE = (r"(?i)(\d[\d.,]*)\s*" + _UNIT + r"?\s*(?:" + _TO + r")\s*(\d[\d.,]*)\s*"
                + _UNIT + r"?")
SALARY_SINGLE = r"(?i)(\d[\d.,]*)\s*" + _UNIT + r"?"
SALARY_MAX_WORD = r"(?i)\b(up to|hingga|maksimal|maks|max|sampai(?:\s+dengan)?)\b"
SALARY_MIN_WORD = r"(?i)\b(mulai dari|minimal|min|dari|mulai|start from|from)\b"
UNIT_FACTORS = (
    (("jt", "juta", "jutaan"), 1_000_000),
    (("rb", "ribu", "ribuan"), 1_000),
)
# --- end of fixed values ----------------------------------------------------

YEARS_REJECTING = 5  # index of the pattern with the rejecting group

# words of which one must occur for the pattern to match, for a cheap first look
MODE_NEEDLES = {
    "hybrid": ("hybrid",),
    "remote": ("remote", "wfh", "wfa", "work from home", "work from anywhere",
               "kerja dari rumah", "kerja jarak jauh"),
    "onsite": ("site", "wfo", "work from office", "kerja di kantor"),
}
LEVEL_NEEDLES = {"lead": ("lead",), "senior": ("senior",), "junior": ("junior",), "intern": ("intern", "magang")}
VAGUE_NEEDLES = ("nego", "competitive", "kompetitif", "undisclosed", "confidential", "tbd")
FOREIGN_NEEDLES = ("$", "\u20ac", "\u00a3", "usd", "sgd", "myr", "eur", "gbp")
YEARS_NEEDLES = ("year",) * 6 + ("tahun",) * 4

_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_BEGIN, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_SPACE = r"\t\n\f\r "


def jvm(pattern: str) -> str:
    """The RE2 pattern in java.util.regex spelling, with ASCII boundaries.

    A boundary beside a letter, or beside a group whose words all begin or end
    with one there, looks at its other side alone.
    """
    pattern = re.sub(r"\\b(?=\(?[a-z])", lambda _: _BEGIN, pattern)
    pattern = re.sub(r"(?<=[a-z)])\\b", lambda _: _END, pattern)
    return (pattern.replace(r"[\s", "[" + _SPACE)
            .replace(r"\s", "[" + _SPACE + "]")
            .replace(r"\b", _BOUNDARY))
