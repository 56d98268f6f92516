"""Regular expressions, word lists and limits that results depend on.

Written for ``java.util.regex``. ``WS`` spells out the Unicode spaces that Java's ``\\s`` leaves out,
``\\z`` is the end of the input, and word edges are ASCII look-arounds.
"""

from __future__ import annotations

import string

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The characters of ``WS``, first those of one byte.
WS_ASCII = "\t\n\x0b\x0c\r "
WS_CHARACTERS = WS_ASCII + "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"

# --- fixed values: headings and sentences ---
KEYWORD_HEADING = (
    r"(?i)^(ARTICLE|CLAUSE|SECTION|SCHEDULE|ANNEXURE|ANNEX|PART|CHAPTER)"
    + WS
    + r"+(\d+|[IVXLC]+|[A-Z])(?![A-Za-z0-9_])[^\n]{0,70}\z"
)
CAPS_LINE = r"^[A-Z0-9][A-Z0-9 ,&/()'-]{3,79}\z"
CAPS_WORD = r"[A-Z]{3,}"
NUMBERED_HEADING = r"^(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?" + WS + r"+([A-Z][^\n]{2,79})\z"
ABBREVIATIONS = ("Rs", "No", "Mr", "Ms", "Mrs", "Dr", "Sr", "Jr", "vs", "Ltd", "Pvt", "Inc", "Co")
# the first two conditions say nothing new: they spare most places the search for abbreviations
SENTENCE_BOUNDARY = (
    rf"(?={WS})(?<=[.;:])" + r"(?<=(?<!(?<![A-Za-z0-9_])(?:" + "|".join(ABBREVIATIONS) + r"))[.;:])" + WS + r"+(?=[A-Z0-9(\[])"
)

# --- fixed values: personal identifiers, in detector order ---
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: What a name before ``@`` is made of; Java tests a class of single characters by one look-up.
_IN_NAME = "[" + string.ascii_letters + string.digits + "._%+-]"
#: The same matches without a search from inside a name: none begins there but where the last one ended.
EMAIL_SEARCH = EMAIL.replace("[A-Za-z0-9._%+-]+@", rf"(?:(?<!{_IN_NAME})|\G){_IN_NAME}++@")
# the others begin with a character that few texts hold, and look behind it only then
PAN = r"[A-Z](?<![A-Z0-9][A-Z])[A-Z]{2}[ABCFGHLJPT][A-Z]\d{4}[A-Z](?![A-Z0-9])"
IFSC = r"[A-Z](?<![A-Z0-9][A-Z])[A-Z]{3}0[A-Z0-9]{6}(?![A-Z0-9])"
AADHAAR = r"[2-9](?<![\d-][2-9])\d{3}(?:" + WS + r"|-)?\d{4}(?:" + WS + r"|-)?\d{4}(?![\d-])"
ACCOUNT = (
    r"(?i)a(?:ccount|/c|cct)\.?" + WS + r"*(?:number|num|no\.?|#)?" + WS + r"*[:\-]?" + WS
    + r"*(\d(?:\d|-|" + WS + r"){7,24}\d)(?!\d)"
)
PHONE = r"(?=[+06789])(?<![\d.])(?:\+91(?:" + WS + r"|-)?|0)?[6-9]\d{4}(?:" + WS + r"|-)?\d{5}(?![\d.])"
AMOUNT_BEFORE = r"(?i)(?:₹|rs\.?|inr|rupees)" + WS + r"*\z"
IDENTIFIER_TYPES = ("EMAIL", "PAN", "IFSC", "AADHAAR", "ACCOUNT", "PHONE")

# --- fixed values: document kind signals (matched on lower-cased text) ---
LOAN_SIGNALS = (
    r"\bloan\b",
    r"\bborrower\b",
    r"\blender\b",
    r"\bemi\b",
    r"\bequated monthly",
    r"\binterest rate\b|\brate of interest\b",
    r"\btenure\b",
    r"\bprepay(?:ment)?\b|\bforeclos",
    r"\bdisburs",
    r"\bsanction",
    r"\brepayment\b",
    r"\bprincipal\b",
    r"\bprocessing fee\b",
)
CONTRACT_SIGNALS = (
    r"\bagreement\b",
    r"\bpart(?:y|ies)\b",
    r"\bhereinafter\b",
    r"\bwhereas\b",
    r"\bterminat",
    r"\bindemnif",
    r"\bgoverning law\b|\bjurisdiction\b",
    r"\blessor\b|\blessee\b|\blandlord\b|\btenant\b|\blicensor\b|\blicensee\b",
    r"\bemployer\b|\bemployee\b|\bcontractor\b|\bservice provider\b",
    r"\bshall\b",
    r"\bnotice\b",
    r"\bdeposit\b|\brent\b|\bconsideration\b|\bfees?\b",
    r"\bconfidential",
)

# --- fixed values: search tokens ---
STOP_WORDS = (
    "the", "a", "an", "of", "to", "and", "or", "in", "on", "is", "are", "be", "for", "by", "with", "as", "at",
    "it", "this", "that", "shall",
)
PLACEHOLDER_TOKEN = r"\[[a-z]+_\d+\]"
TOKEN_BREAK = r"[^a-z0-9%]+"
SUFFIXES = ("ing", "ed", "es", "s")

# --- fixed values: answers and evaluation ---
NUMBER_IN_TEXT = r"(?<![A-Za-z0-9_.])(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![A-Za-z0-9_])"
ANSWER_MARKER = r"\[(\d+(?:" + WS + r"*,"+ WS + r"*\d+)*)\]"
NOT_IN_DOCUMENT = "NOT_IN_DOCUMENT"
NOT_STATED_ANSWER = "The document does not appear to state this."
NO_CONTEXT_ANSWER = "The document does not appear to contain anything related to this question."
NIL_WORDING = (
    r"(?i)" + EDGE_L
    + r"(nil|no (?:prepayment |foreclosure )?charge|without (?:any )?charge|free of charge|not charged|no penalty)"
    + EDGE_R + r"|(?i)" + EDGE_L + r"0%(?=[A-Za-z0-9_])"
)
REFUSAL_WORDING = r"(?i)(does not|doesn't|not (?:state|mention|specify|contain|provide|appear)|no (?:mention|information))"


def ascii_edges(pattern: str) -> str:
    """Spell ``\\b`` (ASCII word edge) as one look-around; Java would read it as Unicode-aware.

    In these patterns an edge is the start of a word when a word character or a group follows, else its end.
    """
    out, rest = "", pattern
    while r"\b" in rest:
        before, rest = rest.split(r"\b", 1)
        out += before
        starts = rest[:1].isalnum() or rest[:1] == "("
        out += EDGE_L if starts else EDGE_R
    return out + rest


def literal_openings(pattern: str) -> list[str] | None:
    """The literal text every alternative of a simple pattern starts with; null if one has none."""
    alternatives, depth, current = [], 0, ""
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            alternatives.append(current)
            current = ""
        else:
            current += ch
    openings = []
    for alternative in [*alternatives, current]:
        opening = ""
        for ch in alternative.replace(r"\b", ""):
            if not (ch.isalnum() or ch == " "):
                # a quantifier makes the last character optional
                opening = opening[:-1] if ch in "?*{" else opening
                break
            opening += ch
        if len(opening) < 2:
            return None
        openings.append(opening)
    return openings
