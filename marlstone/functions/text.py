"""Column expressions on text: identity keys, redaction, quantities, snippets. No Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width characters and the half-width ones they stand for.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Parameter names whose values are secrets, by a part of the name, the whole or its beginning.
SECRET_PARTS = ("token", "sign", "sig", "auth", "secret", "key", "session", "credential", "cookie", "passwd", "password")
SECRET_NAMES = ("sid", "policy", "expire", "expires", "expiration", "wstime", "uparams", "hdnts")
SECRET_PREFIXES = ("x-amz-", "x-goog-")


def fold(c: Column) -> Column:
    """Case folding by code point; both forms of the small sigma are one."""
    return F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))


def clean_query(c: Column) -> Column:
    """Without NULs, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "\0", ""), r"\s+", " "))


def occurrences(c: Column, folded: str) -> Column:
    """Overlapping occurrences of a folded literal in a folded column."""
    return F.regexp_count(c, F.lit("(?=" + re.escape(folded) + ")")).cast("long") if folded else F.lit(0).cast("long")


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def norm_key(c: Column) -> Column:
    """Identity key: half-width, lower case, single spaces, no brackets' remark."""
    plain = F.regexp_replace(half_width(c), r"\s*\([^()]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[\s_\-]+", " "))


def annotation(c: Column) -> Column:
    """The remark of `name (remark)`, or null."""
    found = F.regexp_extract(half_width(c), r"\(([^()]*)\)\s*$", 1)
    return F.when(found != "", F.trim(found))


def candidate_keys(*columns: Column) -> Column:
    """Distinct identity keys of names in order of preference, empty ones left out."""
    keys = [k for c in columns for k in (norm_key(c), F.lower(annotation(c)))]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def snippet(body: Column, query: str, around: int = 60) -> Column:
    """The text around the first hit of query, escaped, every hit in it marked; null without a hit."""
    at = F.instr(body, query)
    begin = F.greatest(at - around, F.lit(1))
    size = at + F.lit(len(query) + around) - begin
    window = escape_html(F.substring(body, begin, size))
    escaped = query
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = escaped.replace(a, b)
    marked = F.replace(window, F.lit(escaped), F.lit(f"<mark>{escaped}</mark>"))
    return F.when(at > 0, F.concat(F.when(begin > 1, F.lit("…")).otherwise(""), marked, F.when(begin + size - 1 < F.char_length(body), F.lit("…")).otherwise("")))


def secret_name(c: Column) -> Column:
    """Whether a parameter of that name (percent-encoded, any case) holds a secret."""
    name = F.lower(F.coalesce(F.try_url_decode(c), c))
    return name.isin(*SECRET_NAMES) | name.rlike("^(?:" + "|".join(SECRET_PREFIXES) + ")") | name.rlike("|".join(SECRET_PARTS))


def redacted_url(c: Column) -> Column:
    """A URL without user info, fragment and default port, host in lower case, without parameters whose
    name is a secret's or whose value looks like one. Parameters end at & and ; alike."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(host, F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    pairs = F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "[&;]")
    value = lambda p: F.coalesce(F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))), p)
    kept = F.filter(pairs, lambda p: (p != "") & ~secret_name(F.substring_index(p, "=", 1)) & ~((F.instr(p, "=") > 0) & has_secret(value(p))))
    query = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


#: Patterns of secrets: (name, pattern); all are read by Java and RE2 alike. A header's or parameter's name
#: begins a line or follows a separator. The patterns of signed_url, cookie and authorization.
_BEFORE = r"(?:^|[\s;,?&#\"'{(\[])"
SECRETS = (
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}"),
    ("cloud_key", r"AKIA[0-9A-Z]{16}"),
    ("assignment", r"(?i)(api[_-]?key|password|secret|token)\s*[=:]\s*[^\s]{6,}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("signed_url", r"(?i)[?&;#]\s*(?:[a-z0-9_.\-]*(?:" + "|".join(SECRET_PARTS) + r")[a-z0-9_.\-]*|" + "|".join(SECRET_NAMES) + r"|(?:" + "|".join(SECRET_PREFIXES) + r")[a-z0-9_.\-]*)=[^&;\s\"']{8,}"),
    ("cookie", r"(?i)" + _BEFORE + r"(?:set-)?cookie\s*[:=]\s*\S"),
    ("authorization", r"(?i)" + _BEFORE + r"authorization\s*[:=]\s*\S"),
    ("control", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
)


def has_secret(c: Column) -> Column:
    return c.rlike("|".join(f"(?:{p})" for _, p in SECRETS))


QUANTITY = r"([+-]?)([$€£]?)([0-9]+(?:\.[0-9]+)?)(%|kg|km|mb|gb|ms|usd|eur|s)?"


def quantities(c: Column) -> Column:
    """Sign, currency, number and unit of every quantity, joined by a bar."""
    parts = [F.regexp_extract_all(F.lower(c), F.lit(QUANTITY), F.lit(k)) for k in range(1, 5)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("a", "b", "n", "u"), strict=True))), lambda x: F.concat_ws("|", x["a"], x["b"], x["n"], x["u"]))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 20))


def canonical_body(c: Column) -> Column:
    """Line feeds only, no white space at the ends of lines and of the text."""
    x = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\s+$", ""), r"^\s+", "")
