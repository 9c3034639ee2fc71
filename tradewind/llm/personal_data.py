"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.common import add_columns, texts

# The base kinds in their order, with their patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Kinds of the method beyond the base, after them in the order of spans.
MORE_KINDS = ("iban", "ssn", "local_phone")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_SIZES = range(15, 35)
_WORD_CHAR = re.compile(r"[A-Za-z0-9]")
# The length that a country gives its numbers; of other countries any length is tried.
_IBAN_SIZE = dict(re.findall(r"([A-Z]{2})([0-9]{2})", (
    "AD24AE23AL28AT20AZ28BA20BE16BG22BH22BR29BY28CH21CR22CY28CZ24DE22DK18DO28EE20EG29ES24FI18FO18FR27GB22GE22GI23GL18"
    "GR27GT28HR21HU28IE22IL23IQ23IS26IT27JO30KW30KZ20LB28LC32LI21LT20LU20LV21LY25MC27MD24ME22MK19MR27MT31MU30NL18NO15"
    "PK24PL28PS29PT25QA29RO24RS22SA24SC31SE24SI19SK24SM27ST25SV28TL23TN24TR26UA29VA22VG24XK20")))
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")

# Score of a pattern alone, and what a passed checksum and a context word nearby add.
_ALONE = {"email": 0.8, "ip": 0.5, "card": 0.2, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "local_phone": 0.3}
_CHECKED, _NEAR = 0.5, 0.3
_CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
_NEAR_WORD = {kind: re.compile(r"(?<!\w)(?:" + "|".join(words) + r")(?!\w)", re.IGNORECASE) for kind, words in _CONTEXT.items()}
WINDOW = 40  # characters on either side in which a context word counts
THRESHOLD = 0.5  # spans beyond the base need this score


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if i % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Numbers that pass mod 97, from left to right without overlap.

    A number ends at a word edge, 15 to 34 characters from its start without single spaces between them. Of the
    ends that pass, the one with the length of the country is taken, or else the last. If none passes, the
    search goes on after the first four characters.
    """
    out, done = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        at, number, passed = m.end(), m[0], {}
        while len(number) < _IBAN_SIZES[-1]:
            at += text[at:at + 1] == " "
            char = text[at:at + 1]
            if not ("0" <= char <= "9" or "A" <= char <= "Z"):
                break
            number, at = number + char, at + 1
            if len(number) in _IBAN_SIZES and not _WORD_CHAR.match(text, at) and mod97(number):
                passed[len(number)] = at
        if passed:
            done = passed.get(int(_IBAN_SIZE.get(m[0][:2], 0)), max(passed.values()))
            out.append((m.start(), done))
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses in linear time: left from each '@' over the local part, right over the domain.

    A match has one '@', and its local part starts where the run of local characters does (or where the
    address before it ended), so that scanning from the '@' finds the same as a search from the left.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                done = domain.end()
                out.append((start, done))
        at = text.find("@", at + 1)
    return out


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def _propose(text: str):
    """(kind, start, end, passed a checksum) of all candidates, kind after kind, each from left to right."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, False
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), True
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_octet, m.groups())):
                yield "ip", m.start(), m.end(), False
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end(), False
    for start, end in ibans(text):
        yield "iban", start, end, True
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end(), False
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


_RANK = {kind: i for i, kind in enumerate((*BASE_KINDS, *MORE_KINDS))}


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive."""
    base, more = [], []
    for kind, start, end, checked in _propose(text or ""):
        near = f"{text[max(0, start - WINDOW):start]} \0 {text[end:end + WINDOW]}"
        score = _ALONE[kind] + _CHECKED * checked + _NEAR * bool(_NEAR_WORD[kind].search(near))
        span = (kind, start, end, round(min(1.0, score), 2))
        if kind in BASE_KINDS:
            base.append(span)
        elif score >= THRESHOLD:
            more.append(span)
    base.sort(key=lambda s: s[1])
    more = [s for s in more if not any(b[1] < s[2] and s[1] < b[2] for b in base)] if more else more
    return sorted([*base, *more], key=lambda s: (s[1], _RANK[s[0]]))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with [KIND] in place of each span; of overlapping spans the leftmost names the gap."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_personal_data(df: DataFrame, text_col: str = "text", redacted: bool = True) -> DataFrame:
    """The input with `pii_spans` (kind, start, end, score) and, if wanted, `redacted_text`.

    Base kinds are leftmost matches without overlap within a kind whose check passes: e-mail, IP (parts up to
    255), card (14 to 19 digits, Luhn) and phone (10 to 15 digits); their score only informs. More kinds need a
    score of THRESHOLD and no base span in their place: IBAN (mod 97), social security and local phone numbers
    (a context word nearby). NULL counts as the empty text, has no spans, and stays NULL when redacted. A row
    depends on no other row, so repeated rows repeat their result. Whole texts are read; every pattern takes time
    in proportion to the text. Input columns named like a result are replaced.
    """
    fields = [T.StructField("pii_spans", _SPAN)]
    if redacted:
        fields.append(T.StructField("redacted_text", T.StringType()))

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        values = texts(batch, text_col)
        spans = [find_spans(t) for t in values]
        rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in spans]
        out = [pa.array(rows, _SPAN_ARROW)]
        return [*out, pa.array(map(redact, values, spans), pa.string())] if redacted else out

    return add_columns(df, fields, step)
