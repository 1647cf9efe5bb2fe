"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass; from
each hit a deterministic local parser widens to the boundaries of an email address, IP address, card,
phone number, credentialed URL or account identifier and validates it. No other part of a text is looked at.

Kinds ``email ip card phone`` are the base spans: those of the leftmost non-overlapping matches of their
patterns that pass the validation. Kinds ``url`` (a URL with user information) and ``account`` (an
identifier after a cue such as "account no") are added; they never remove a base span.

Defined cases: null and empty texts give no spans; a span at the very start or end of a text counts; spans of
different kinds may overlap and are listed by kind, then start; repeated rows give equal results; texts of any length
are scanned whole; offsets are code points, ends exclusive; an empty table gives an empty result; columns besides
the id and the text, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
# The characters and shapes of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SCHEMES = ("://",)
CUES = ("account", "Account", "ACCOUNT", "acct", "IBAN", "iban", "passport", "Passport", "SSN", "ssn", "user id", "User ID", "customer id", "Customer ID")
# In capitals the middle word must end before the identifier: NO begins a Norwegian IBAN.
MIDDLE = r"(?:\s?(?:number|no\.?|id|#|(?i:number|id)(?![A-Za-z0-9])|(?i:no)(?:\.|(?![A-Za-z0-9]))))?\s?[:=#]?\s?"
IDENTIFIER = re.compile(MIDDLE + r"([A-Za-z0-9][A-Za-z0-9-]{5,33})(?![A-Za-z0-9-])")
GROUPED = re.compile(MIDDLE + r"([A-Za-z]{2}[0-9]{2}(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
USER_INFO = re.compile(r"[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def grouped_end(value: str) -> int:
    """Where an IBAN in groups ends: after its last group with which its check digits are right, or else after the last one with a digit."""
    groups, ends = value.split(" "), []
    for k in range(3, len(groups) + 1):
        iban = "".join(groups[:k])
        if int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
            ends.append(k)
    with_digits = max(k for k, g in enumerate(groups, 1) if any(c in "0123456789" for c in g))
    return len(" ".join(groups[: ends[-1] if ends else with_digits]))


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789", *SCHEMES, *CUES):
        a.add_word(word, word)
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind in the order BASE + ADDED, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    email_end = number_end = ip_end = card_end = 0
    for end, word in anchors.iter(text):
        at = end + 1 - len(word)
        if len(word) == 1 and "0" <= word <= "9":
            if at < number_end:
                continue
            number_end = DIGITS.match(text, at).end()
            if at >= ip_end and (m := QUAD.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found["ip"].append((at, ip_end))
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                if card_end - at < 64:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, card_end))
        elif word == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif word == "+":
            if (m := PHONE.match(text, at)) and 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                found["phone"].append((at, m.end()))
        elif word in SCHEMES:
            start = at
            while start > max(0, at - 12) and text[start - 1].lower() in LETTERS:
                start -= 1
            if start < at and (m := USER_INFO.match(text, end + 1)):
                found["url"].append((start, m.end()))
        elif word in ("IBAN", "iban") and (at == 0 or not text[at - 1].isalnum()) and (m := GROUPED.match(text, end + 1)) and sum(c in "0123456789" for c in m[1]) >= 4:
            found["account"].append((m.start(1), m.start(1) + grouped_end(m[1])))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := IDENTIFIER.match(text, end + 1)) and sum(c in "0123456789" for c in m[1]) >= 4:
            found["account"].append(m.span(1))
    return [(k, s, e) for k in (*BASE, *ADDED) for s, e in found[k]]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the number of spans of each base kind, base_sha256, spans."""

    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            spans = [find_spans(t, anchors) if t else [] for t in batch.column(1).to_pylist()]
            base = [[x for x in own if x[0] in BASE] for own in spans]
            counts = [pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in BASE]
            hashes = pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base], pa.string())
            yield pa.record_batch([batch.column(0), *counts, hashes, pa.array([_joined(own) for own in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
