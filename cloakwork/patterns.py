"""What counts as a price, a percentage or a vendor code; each pattern in Java's dialect and in RE2's."""

from __future__ import annotations

import re
from typing import NamedTuple

# White space as browsers see it, currencies, scales and units.
WHITE = "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same class for Python's expressions and for Java's, where a range is tested before its single characters.
PY_WS, JS_WS = f"[\\t-\\r \\u00a0{WHITE}]", f"[\\t-\\r \\u00a0[\\u1680-\\ufeff&&[{WHITE}]]]"
#: And all its signs.
WHITE_SIGNS = "".join(chr(p) for p in range(0x10000) if re.fullmatch(PY_WS, chr(p)))
_CUR = r"(?:SGD|USD|EUR|GBP|MYR|IDR|THB|PHP|VND|INR|JPY|CNY|AUD|NZD|HKD|KRW|S\$|US\$|A\$|\$|€|£|¥|₹)"
_SCALE = r"(?:trillion|billion|million|thousand|[TtBbMmKk])"
_UNIT = r"(?:/(?:MW|KW|GW|MWh|KWh|kW|m2|sqm|unit|hr))?"


_OPENS = "[~A-Z$€£¥₹]"


class Pattern(NamedTuple):
    category: str
    java: str
    re2: str


def _both(category: str, body: str, before: bool = False, after: bool = False, flags: str = "", first: str = "") -> Pattern:
    """body has WS for white space; before, after: whether a word boundary stands there; first: a class of what can begin
    a match, which Java's engine tests before it looks behind or tries alternatives."""
    java = flags + f"(?={first})" * bool(first) + r"(?<!\w)" * before + body.replace("WS", JS_WS) + r"(?!\w)" * after
    return Pattern(category, java, flags + r"\b" * before + body.replace("WS", r"\s") + r"\b" * after)


# The seven patterns.
PATTERNS = (
    _both("Price", rf"~?{_CUR}WS?\d[\d,]*(?:\.\d+)?(?:WS?{_SCALE})?{_UNIT}", first=_OPENS),
    _both("Price", rf"~?{_CUR}WS?\d[\d.]*{_SCALE}(?:[–\-](?:~?{_CUR}WS?)?\d[\d.]*{_SCALE})?{_UNIT}", first=_OPENS),
    _both("Price", r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", True, True, first=r"\d"),
    _both("Price", r"\d+(?:\.\d+)?WS?(?:MW|GW|KW|MWh|KWh|kW)", True, True, first=r"\d"),
    _both("Percentage", r"\d{1,3}(?:\.\d+)?WS?%", True, first=r"\d"),
    _both("Vendor Name", r"[A-Z]{2,3}-\d{1,4}", True, True, first="[A-Z]"),
    _both("Vendor Name", r"VendorWS+[A-Z]{2,3}-?\d{1,4}", True, True, "(?i)", "[Vv]"),
)

# Fixed values, also of all tuples and patterns below.
#: Cells that look like amounts or percentages (anchored, on cells with white space collapsed).
SWEEP = (
    r"[~$€£]?\s*-?\d{1,3}(?:,\d{3})+(?:\.\d+)?",
    r"(?i:USD|SGD|EUR|MYR|IDR|GBP|JPY|AUD|CHF|\$|€|£)\s*-?[\d,]+(?:\.\d+)?\s*(?i:[MKB])?(?:/\w+)?",
    r"-?\d+(?:\.\d+)?\s*%",
    r"\$\s*-",
)
#: Numbers in a value that aren't glued to a letter, and their scale.
TOKENS = rf"(?<![A-Za-z0-9])(?<![A-Za-z]-)(\d[\d,]*(?:\.\d+)?){JS_WS}?(trillion|billion|million|thousand|[TtBbMmKk](?![A-Za-z]))?"
#: What makes a value look like a price.
PRICE_LIKE = r"[$€£¥]|USD|SGD|IDR|MYR|EUR|GBP|CHF|JPY|AUD|(?<!\w)[MK](?!\w)|MW|GW|KW|[\d,]{5,}"
PERCENT_HEADERS = ("%", "weight", "percentage", "share", "ratio", "score", "rating")
VENDOR_HEADERS = ("vendor", "supplier", "name", "code", "company", "party")
#: Words in the header of a column that is masked whole.
SENSITIVE_HEADERS = (
    "vendor", "supplier", "company", "amount", "cost", "price", "total", "budget", "value", "usd", "sgd", "idr", "myr", "eur", "discount", "mark-up", "%", "percentage", "weight", "share",
    "ratio", "score", "rating", "capacity", "rate", "country",
)
