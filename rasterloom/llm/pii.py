"""Personal data by anchor expansion.

An Aho-Corasick automaton scans a text once for anchors: at-signs, plus signs before a
digit, digits, URL schemes and identifier cues. A deterministic parser for the kind then
expands from the anchor to the left and right, and validates what it found. Text without
anchors costs no more than the scan.

Kinds, in the order of results: email, ip, card, phone (the base kinds), url, account, secret.
Offsets are code points, ends exclusive. Spans of one kind don't overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm.shared import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# What a parser may run over, from an anchor on.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[a-z]+://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`{}|\\^\[\]]*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAMED = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?\x20?[:=#]?\x20?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I)

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
_SECRET = re.compile(r"[\"']?\x20{0,2}(?::=|=>|[:=])\x20{0,2}[\"']?([A-Za-z0-9_.+/=-]{16,512})(?![A-Za-z0-9_.+/=-])")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
        found.add_word("+" + digit, ("+", 2))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_valid(text: str) -> bool:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Expand an at-sign: the local part to the left, not before ``least``."""
    begin = at
    while begin > least and text[begin - 1] in _LOCAL:
        begin -= 1
    if begin == at or not (m := _DOMAIN.match(text, at + 1)):
        return None
    return begin, m.end()


def _addresses(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Four parts at a time of a dotted run of numbers, each part at most 255."""
    parts, at = text[begin:end].split("."), begin
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        stop = at + sum(map(len, four)) + 3
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
            yield at, stop
        at = stop + 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """What follows an identifier cue: an IBAN that validates, or a bare number."""
    begin = at
    while begin < len(text) and begin < at + 3 and text[begin] in " :=#":
        begin += 1
    if m := _IBAN.match(text, begin):
        stop = m.end()
        while stop - begin >= 15:
            if iban_valid(text[begin:stop]):
                return begin, stop
            stop = max(text.rfind(" ", begin, stop), begin)
        return None
    if m := _NAMED.match(text, at):
        return m.span(1)
    return None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    """What is assigned to a secret's name: 16 characters or more with letters and digits."""
    m = _SECRET.match(text, at)
    if m and any(map(str.isdigit, m.group(1))) and any(map(str.isalpha, m.group(1))):
        return m.span(1)
    return None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in ``text``, ascending; kinds without spans are absent."""
    found: dict[str, list[tuple[int, int]]] = {}
    mail_end = card_end = ip_end = phone_end = url_end = account_end = 0

    def add(kind: str, begin: int, end: int) -> None:
        found.setdefault(kind, []).append((begin, end))

    for last, (what, width) in automaton().iter(text):
        at = last - width + 1
        if what == "0":
            if at >= card_end:
                m = _NUMBER.match(text, at)
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, card_end)
            if at >= ip_end:
                ip_end = _DOTTED.match(text, at).end()
                for span in _addresses(text, at, ip_end):
                    add("ip", *span)
        elif what == "@":
            if at >= mail_end and (span := _email(text, at, mail_end)):
                add("email", *span)
                mail_end = span[1]
        elif what == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    add("phone", at, phone_end)
        elif what == "url":
            if at >= url_end and (m := _URL.match(text, at)):
                url_end = at + len(m.group().rstrip(".,;:!?)"))
                if url_end > last + 1:
                    add("url", at, url_end)
        elif what == "secret":
            if span := _secret(text, last + 1):
                add("secret", *span)
        elif at >= account_end and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and (span := _account(text, last + 1)):
            add("account", *span)
            account_end = span[1]
    return found


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each text, ordered by kind (as in KINDS), then start.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no spans;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = []
                for text in part.column(1):
                    spans = find(text.as_py()) if text.is_valid else {}
                    rows.append([{"kind": k, "start": b, "end": e} for k in KINDS for b, e in spans.get(k, ())])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
