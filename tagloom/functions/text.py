"""Text normalisation of recognised labels. Null texts normalise to the empty string.

Order and exact effect of the replacements matter: some eat blanks ("MRP 399" becomes "MRP399") and later steps see that.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.dialect import BLANKS, SQUEEZE, STRIP, Step, gated, once, quoted, replaced, replaced_sql

#: What any text holds that steps of the normal form change: artifacts, white space, headings, currency and units.
ODD_MARKS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}¦—–]"
ODD_SPACE = r"[\r\t\n]|\s[,:;.!?]|  |^\s|\s$"
HEADING = r"(?i)\b(?:M\s*\.?\s*R\s*\.?\s*P|NET\s|MF[DG]|MANUFACTURED|PACKED|PKD|MKT|EXP(?:\.|\b|\s*DATE)|USE\s*BY|BEST\s*BEFORE|FSSAI)"
MONEY = r"(?i)\b(?:R[5S](?:\.|\b)|INR\b)"
UNIT = r"(?i)\d\s*(?:KGS?|GMS?|M[GL]|LTRS?|LIT(?:RE|ER)|L)\b"

# The replacements that define the normal form, in order.
_WHITESPACE = [
    Step(r"\r", "\n", False),
    Step(r"\t", " ", False),
    Step(r"\s+([,:;.!?])", "$1", False),
    BLANKS,
    Step(r"\n[ \t]*\n+", "\n", False),
    STRIP,
]
WHITESPACE = gated(ODD_SPACE, _WHITESPACE)
ARTIFACTS = gated(ODD_MARKS, [Step(r"[\x{200B}-\x{200F}\x{202A}-\x{202E}]", "", False), Step("¦", "|", False), Step("[—–]", "-", False)])
MRP_HEADING = gated(HEADING, [Step(r"\bM\s*\.?\s*R\s*\.?\s*P\s*\.?\b", "MRP")])
QUANTITY_HEADINGS = gated(
    HEADING,
    [
        Step(r"\bNET\s+WT\.?\b", "NET WEIGHT"),
        Step(r"\bNET\s+W[T7]\.?\b", "NET WEIGHT"),
        Step(r"\bNET\s+QTY\.?\b", "NET QUANTITY"),
        Step(r"\bNET\s+QUANT[I1]TY\b", "NET QUANTITY"),
        Step(r"\bNET\s+CONTENT[S5]?\b", "NET CONTENT"),
    ],
)
MAKER_HEADINGS = gated(
    HEADING,
    [
        Step(r"\bMFD\.?\s*BY\b", "MANUFACTURED BY"),
        Step(r"\bMFG\.?\s*BY\b", "MANUFACTURED BY"),
        Step(r"\bMANUFACTURED\s*&\s*MARKETED\s*BY\b", "MANUFACTURED AND MARKETED BY"),
        Step(r"\bMANUFACTURED\s+AND\s+MARKETED\s+BY\b", "MANUFACTURED AND MARKETED BY"),
        Step(r"\bPACKED\s*&\s*MARKETED\s*BY\b", "PACKED AND MARKETED BY"),
        Step(r"\bPACKED\s+AND\s+MARKETED\s+BY\b", "PACKED AND MARKETED BY"),
        Step(r"\bPKD\.?\s*BY\b", "PACKED BY"),
        Step(r"\bMKT\.?\s*BY\b", "MARKETED BY"),
    ],
)
DATE_HEADINGS = gated(
    HEADING,
    [
        Step(r"\bMFG\.?\s*DATE\b", "MANUFACTURING DATE"),
        Step(r"\bMFD\.?\s*DATE\b", "MANUFACTURING DATE"),
        Step(r"\bMFG\.?\b", "MANUFACTURING"),
        Step(r"\bEXP\.?\s*DATE\b", "EXPIRY DATE"),
        Step(r"\bEXP\.?\b", "EXPIRY"),
        Step(r"\bUSE\s*BY\b", "USE BY"),
        Step(r"\bBEST\s*BEFORE\b", "BEST BEFORE"),
    ],
)
LICENCE_HEADINGS = gated(
    HEADING,
    [
        Step(r"\bFSSAI\s+LIC\.?\s*NO\.?\b", "FSSAI LICENSE NUMBER"),
        Step(r"\bFSSAI\s+LICENSE\s+NO\.?\b", "FSSAI LICENSE NUMBER"),
        Step(r"\bFSSAI\s+LICENCE\s+NO\.?\b", "FSSAI LICENSE NUMBER"),
        Step(r"\bFSSAI\s+NO\.?\b", "FSSAI NUMBER"),
    ],
)
CURRENCY = gated(MONEY, [Step(r"\bR5\.?\b", "Rs"), Step(r"\bRS\.?\b", "Rs"), Step(r"\bINR\b", "Rs"), Step(r"\bRs\s+", "Rs ", False)])


def _unit(pattern: str, name: str) -> Step:
    return Step(rf"(?<=\d)\s*{pattern}\b", f" {name}", True, ((rf"([0-9])\s*{pattern}\b", rf"\1 {name}"),))


UNITS = [
    *gated(UNIT, [_unit(p, n) for p, n in (("KGS?", "KG"), ("KG", "KG"), ("GMS?", "G"), ("MG", "MG"), ("ML", "ML"), ("LTRS?", "L"), ("LIT(?:RE|ER)", "L"), ("L", "L"))]),
    SQUEEZE,
    STRIP,
]
DATE_SEPARATORS = [Step(r"(?<=\d)\s*[|]\s*(?=\d)", "/", False, ((r"([0-9])\s*\|\s*([0-9])", r"\1/\2"),) * 2)]
NORMAL_FORM = [
    *ARTIFACTS, *WHITESPACE, *MRP_HEADING, *QUANTITY_HEADINGS, *MAKER_HEADINGS, *DATE_HEADINGS, *LICENCE_HEADINGS, *CURRENCY, *UNITS, *DATE_SEPARATORS, *WHITESPACE,
]

# The conservative form that detections get.
_REPEATED = Step(r"([.,:;!?])\1+", "$1", False, tuple((rf"{p}{p}+", c) for p, c in ((r"\.", "."), (",", ","), (":", ":"), (";", ";"), ("!", "!"), (r"\?", "?"))))
DETECTION_FORM = [STRIP, Step(r"[\r\n]", " ", False), SQUEEZE, _REPEATED, STRIP]
REPAIRS = [
    *MRP_HEADING,
    Step(r"\bNET\s+WT\.?\b", "NET WEIGHT"),
    Step(r"\bNET\s+QTY\.?\b", "NET QUANTITY"),
    Step(r"\bBATCH\s+NO\.?\b", "BATCH NO"),
    Step(r"\bLOT\s+NO\.?\b", "LOT NO"),
    Step(r"\bMFD\.?\s+BY\b", "MANUFACTURED BY"),
    Step(r"\bMFG\.?\s+BY\b", "MANUFACTURED BY"),
    Step(r"\bFSSAI\s+LIC\.?\s+NO\.?\b", "FSSAI LIC NO"),
    *DETECTION_FORM,
]
# The form that several views of a package are merged in. Lines are kept.
VIEW_FORM = [
    Step("[–—]", "-", False),
    BLANKS,
    Step(r"\s*\.\s*", ".", False),
    Step(r"\bM\s*R\s*P\b", "MRP"),
    Step(r"\bM\s*F\s*G\b", "MFG"),
    Step(r"\bM\s*F\s*D\b", "MFD"),
    Step(r"[ \t]*(?:\r\n|[\r\n])\s*", "\n", False),
    STRIP,
]
RULE_FORM = [Step("₹", " rs ", False), Step("[—–]", "-", False), Step(r"[|\n]", " ", False), SQUEEZE, STRIP]
TOKEN = r"[A-Za-z0-9₹./:%@+\-]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(text: Column) -> Column:
    """NFKC and plain ligatures and blanks. Spark has no NFKC, so texts beyond ASCII go through an Arrow UDF; ASCII texts stay in the JVM."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def whitespace(text: Column) -> Column:
    return replaced(F.coalesce(text, F.lit("")), WHITESPACE)


def headings(text: Column) -> Column:
    return replaced(F.coalesce(text, F.lit("")), [*MRP_HEADING, *QUANTITY_HEADINGS, *MAKER_HEADINGS, *DATE_HEADINGS, *LICENCE_HEADINGS])


def units(text: Column) -> Column:
    """Measurement units after a number; lines become one."""
    return replaced(F.coalesce(text, F.lit("")), UNITS)


def currency(text: Column) -> Column:
    return replaced(F.coalesce(text, F.lit("")), CURRENCY)


def normal(text: Column) -> Column:
    """The normal form of a whole text, as one line."""
    return replaced(compatible(text), NORMAL_FORM)


def normal_ascii(text: Column) -> Column:
    """The normal form of a text that is known to hold no compatibility characters; entirely in the JVM."""
    return replaced(F.coalesce(text, F.lit("")), NORMAL_FORM)


def compacted(normal_text: Column) -> Column:
    """Lower-case letters and digits of a text in normal form."""
    return F.lower(F.regexp_replace(normal_text, "[^a-zA-Z0-9]+", ""))


def searchable(normal_text: Column) -> Column:
    """A text in normal form for searching."""
    return replaced(F.lower(normal_text), [SQUEEZE, STRIP])


def lines(text: Column) -> Column:
    """The non-empty lines of a text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: replaced(x, [STRIP])), lambda x: x != "")


def normal_lines(text: Column) -> Column:
    """The normal form of each line that isn't empty; compatibility characters are folded in the text as a whole."""
    each = F.transform(F.split(compatible(text), LINE_BREAK), lambda x: replaced(x, NORMAL_FORM))
    return F.filter(each, lambda x: x != "")


def tokens(normal_text: Column) -> Column:
    return F.regexp_extract_all(normal_text, F.lit(f"({TOKEN})"), 1)


def contains_any(searchable_text: Column, phrases: list[str]) -> Column:
    """Whether any phrase (given as searchable) occurs."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(searchable_text, F.lit(p))
    return found


def detection_form(text: Column) -> Column:
    return replaced(F.coalesce(text, F.lit("")), DETECTION_FORM)


def repaired(text: Column) -> Column:
    """A detection's text with frequent heading errors corrected."""
    return replaced(F.coalesce(text, F.lit("")), REPAIRS)


def is_valid(text: Column) -> Column:
    """At least two letters or digits, and punctuation is at most three quarters."""

    def readable(form: Column) -> Column:
        alphanumeric = F.length(F.regexp_replace(form, "[^A-Za-z0-9]", ""))
        punctuation = F.length(F.regexp_replace(form, r"[A-Za-z0-9\s]", ""))
        return (F.length(form) >= 2) & (alphanumeric >= 2) & (punctuation <= F.length(form) * F.lit(0.75))

    return once(detection_form(text), readable)


def is_valid_sql(text: str) -> str:
    t = replaced_sql(text, DETECTION_FORM)
    return (
        f"(length({t}) >= 2 AND length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) >= 2 "
        f"AND length(regexp_replace({t}, {quoted(r'[A-Za-z0-9\s]')}, '', 'g')) <= length({t}) * CAST(0.75 AS DOUBLE))"
    )


def view_form(text: Column) -> Column:
    """The form in which views are merged; lines stay."""
    return replaced(F.coalesce(text, F.lit("")), VIEW_FORM)


def words_only(text: Column) -> Column:
    """Lower-case runs of letters and digits with a blank between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def rule_form(text: Column) -> Column:
    return replaced(F.lower(F.coalesce(text, F.lit(""))), RULE_FORM)


def is_present(value: Column) -> Column:
    """Not null and, as a string, not blank."""
    return value.isNotNull() & (replaced(value.cast("string"), [STRIP]) != "")


def shown(value: Column) -> Column:
    """What a report shows for a value."""
    return F.when(is_present(value), replaced(value.cast("string"), [STRIP])).otherwise(F.lit("Not found"))


def status_icon(status: Column) -> Column:
    status = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(status.isin("PASS", "COMPLIANT"), "✅")
        .when(status.isin("FAIL", "NON-COMPLIANT"), "❌")
        .when(status.isin("REVIEW", "NEEDS REVIEW"), "⚠️")
        .when(status.isin("NOT_APPLICABLE", "N/A"), "⚪")
        .otherwise("ℹ️")
    )


# What tells that a field is mentioned somewhere in a text.
HINTS = {
    "mrp": r"\bmrp\b|maximum\s+retail\s+price",
    "net_quantity": r"net\s+(?:quantity|qty|weight|wt|content)",
    "manufacturer": r"manufactured\s+by|manufactured\s*&\s*marketed\s*by|packed\s+by|marketed\s+by",
    "batch": r"\bbatch\b|\blot\s+no",
    "fssai": r"\bfssai\b",
    "expiry": r"expiry|best\s+before|use\s+by",
    "manufacturing_date": r"date\s+of\s+manufacture|mfg\s+date|manufacturing\s+date",
    "ingredients": r"\bingredients?\b",
    "country_of_origin": r"country\s+of\s+origin|made\s+in",
    "customer_care": r"customer\s+care|helpline|customer\s+service",
}


def hints(text: Column) -> dict[str, Column]:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return {f"has_{name}": lowered.rlike(pattern) for name, pattern in HINTS.items()}
