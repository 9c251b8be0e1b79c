"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, plus signs and words that announce an identifier,
in one pass over a text; the other anchors are runs of digits. At each anchor a local parser expands
to the left and right and validates what it has; no other pattern is searched over the whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cluster import add_columns, without
from .spans import Span, ascii_lower, digest, joined

BASE = ["email", "ip", "card", "phone"]
#: What the method adds: credentials in a URL, and an identifier after a word that announces one.
ADDED = ["login", "account"]
KINDS = BASE + ADDED

CUES = ["account", "acct", "iban", "passport", "customer id", "kontonummer", "konto", "cuenta", "compte", "ssn"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[^\s/?#@]+")
#: What may stand between a cue and its value: a sign, or only blanks or "is".
_BETWEEN = re.compile(r"(?:[ ]?(?:number|no|nr|num|id)\b\.?)?(?:[ ]{0,2}([:=#])[ ]{0,2}|[ ]{1,2}(?:is[ ]{1,2})?)")
_ACCOUNT = re.compile(r"[A-Za-z]{0,4}[0-9][A-Za-z0-9-]{4,33}")
_GROUPED = re.compile(r"[A-Za-z]{0,4}[0-9]{1,12}(?:[ -][0-9]{2,12}){1,8}(?![A-Za-z0-9]|[.,][0-9])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
#: Digits of a value that no sign announces.
LEAST_DIGITS = 6


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def iban(text: str) -> bool:
    """Whether the two digits after the country check what follows."""
    bare = text.replace(" ", "").replace("-", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def account_value(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """Start and end of the identifier that the cue ending at `at` announces, if it is valid."""
    between = _BETWEEN.match(text, at)
    if not between:
        return None
    at = between.end()
    if cue == "iban":
        if m := _IBAN.match(text, at):
            for end in range(m.end(), at + 14, -1):
                if not text[end : end + 1].isalnum() and text[end - 1].isalnum() and iban(text[at:end]):
                    return at, end
        return None
    if cue == "ssn":
        m = _SSN.match(text, at)
        return m and m.span()
    found = [m for p in (_ACCOUNT, _GROUPED) if (m := p.match(text, at)) and m.end() - at >= 5]
    m = max(found, key=lambda m: m.end(), default=None)
    if m and not between[1] and sum(c in "0123456789" for c in m[0]) < LEAST_DIGITS:
        return None
    return m and m.span()


def anchors():
    """The automaton: signs by their names, and `cue` for a word that announces something."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for c in CUES:
        found.add_word(c, ("cue", len(c)))
    found.make_automaton()
    return found


def find_pii(text: str, automaton) -> list[Span]:
    """All spans of one text. Matches of a kind do not overlap and are taken from the left."""
    out: list[Span] = []
    email_end = dotted_end = digits_end = login_end = account_end = 0
    for run in _RUN.finditer(text):
        at = run.start()
        if at >= dotted_end:
            m = _DOTTED.match(text, at)
            dotted_end = m.end()
            if m[0].count(".") >= 3:
                parts, place = m[0].split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    width = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                        out.append(("ip", place, place + width))
                    place += width + 1
        if at >= digits_end:
            m = _DIGITS.match(text, at)
            digits_end = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", at, digits_end))
    for last, (what, width) in automaton.iter(ascii_lower(text)):
        at = last - width + 1
        if what == "at":
            if at >= email_end and (m := _DOMAIN.match(text, at)):
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email_end = m.end()
                    out.append(("email", start, email_end))
        elif what == "plus":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", at, m.end()))
        elif what == "scheme":
            if at >= login_end and (m := _LOGIN.match(text, at)):
                start = at
                while start > login_end and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+-."):
                    start -= 1
                if start < at:
                    login_end = m.end()
                    out.append(("login", start, login_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()) and (span := account_value(text, ascii_lower(text[at : last + 1]), last + 1)):
            account_end = span[1]
            out.append(("account", *span))
    return out


FIELDS = [
    T.StructField("_n_email", T.LongType()),
    T.StructField("_n_ip", T.LongType()),
    T.StructField("_n_card", T.LongType()),
    T.StructField("_n_phone", T.LongType()),
    T.StructField("_base_sha256", T.StringType()),
    T.StructField("_spans", T.StringType()),
]


def scan_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns _n_email, _n_ip, _n_card, _n_phone (long), _base_sha256 (of the base kinds'
    spans) and _spans (all, as kind:start:end joined by commas, in code points, end exclusive).

    Whole texts are read and rows stay where they are: nothing is shuffled.

    Defined cases: a null or empty text has no spans; spans of different kinds may overlap, and
    those that begin at one place come in the order of KINDS; only ASCII letters and digits take part in
    a span; an input column with the name of a result is replaced; repeated rows each give a row;
    an empty table gives an empty table.
    """

    def make(batches):
        automaton = anchors()
        for (texts,) in batches:
            counts, digests, spans = [[] for _ in BASE], [], []
            for text in texts.to_pylist():
                found = find_pii(text, automaton) if text else []
                base = [s for s in found if s[0] in BASE]
                for kind, c in zip(BASE, counts, strict=True):
                    c.append(sum(s[0] == kind for s in base))
                digests.append(digest(base, BASE))
                spans.append(joined(found, KINDS))
            yield [*counts, digests, spans]

    return add_columns(without(docs, [f.name for f in FIELDS]), make, FIELDS, [text_col])


def mask_pii(text: str, spans: str, sign: str = "[{kind}]") -> str:
    """The text with each span of a scan_pii() row put under its kind; inside an overlap the
    earlier span wins."""
    out, end = [], 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= end:
            out += [text[end:a], sign.format(kind=kind.upper())]
            end = b
    return "".join([*out, text[end:]])
