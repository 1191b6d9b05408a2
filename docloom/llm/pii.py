"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

The kinds email, ip, card and phone follow fixed rules; a match of their pattern that fails its check is
dropped, and what it covered is not tried again.  Two more kinds are added beside them: iban (mod-97) and
national (a nine-digit number in groups of 3, 2 and 4, kept only where a word nearby says so).  Added
spans need a score of at least LEAST; the others stay whatever their score.

All searches take time in proportion to the text, also over long runs without white space.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national")
BASE = KINDS[:4]
#: Score of a span by itself, and what a context word within NEAR characters before or after it adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.3}
CONTEXT = {
    "email": ("mail", "email", "contact", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "appel"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "passport", "tax", "national"),
}
BOOST, LEAST, NEAR = 0.3, 0.5, 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every later digit, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
# Countries with account numbers of this kind, each with their length.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27"
        " GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27"
        " MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23"
        " TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")
_NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of <local>@<label>(.<label>)+ found from their @ signs.

    The local part is the longest run before the sign that starts after the last match and the last sign."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if local else None
        if m:
            found.append((at - local, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length, in groups or not, that pass mod-97; what follows them is not read."""
    found = []
    for start in _IBAN.finditer(text):
        rest = _IBAN_REST.get(IBAN_LENGTHS.get(text[start.start() : start.start() + 2], 0))
        m = rest.match(text, start.end()) if rest else None
        if m and mod97(text[start.start() : m.end()]):
            found.append((start.start(), m.end()))
    return found


def _digits(text: str) -> str:
    return _NO_DIGITS.sub("", text)


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        digits = _digits(text)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


_PATTERNS = {"ip": _IP, "card": _CARD, "phone": _PHONE, "national": _NATIONAL}


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in KINDS, then start; code points, end exclusive."""
    text = text or ""
    spans = [("email", *s) for s in emails(text)] + [("iban", *s) for s in ibans(text)]
    for kind, pattern in _PATTERNS.items():
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    scored = []
    for kind, a, b in spans:
        near = f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}".lower()
        hit = not CONTEXT[kind] or any(w in CONTEXT[kind] for w in _WORD.findall(near))
        score = min(1.0, PRIOR[kind] + BOOST * hit)
        if kind in BASE or score >= LEAST:
            scored.append((kind, a, b, score))
    return sorted(scored, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the union goes, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans_column(column):
    """array<struct<kind, start, end, score>>; empty for null and empty texts."""

    @F.pandas_udf("array<struct<kind:string, start:int, end:int, score:double>>")
    def found(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score")
        return pd.Series([[dict(zip(names, s)) for s in find(t)] for t in texts], dtype=object)

    return found(column)


def masked_column(column):
    """The text without its personal data; null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t, find(t)) for t in texts], dtype=object)

    return masked(column)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row.

    Null and empty texts have no spans; texts of any length are read as a whole, in time in proportion to it;
    repeated rows stay, an empty table gives no rows, other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), spans_column(F.col(text_col)).alias("spans"))


def joined(spans: str):
    """"kind:start:end" of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
