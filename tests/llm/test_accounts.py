"""Identifiers after a cue."""

import pytest

from quillon.llm import pii


@pytest.mark.parametrize(
    "text, want",
    [
        ("Account Number: 12345678", ["12345678"]),
        ("ACCOUNT NUMBER 12345678 x", ["12345678"]),
        ("Account No: 12345678", ["12345678"]),
        ("Passport No.12345678", ["12345678"]),
        ("account number: 12345678", ["12345678"]),
        ("IBAN DE89 3704 0044 0532 0130 00 ok", ["DE89 3704 0044 0532 0130 00"]),
        ("IBAN: GB29 NWBK 6016 1331 9268 19, then", ["GB29 NWBK 6016 1331 9268 19"]),
        ("IBAN AT61 1904 3002 3457 3201 for rent", ["AT61 1904 3002 3457 3201"]),
        ("iban DE89 3704 0044 0532 0130 01 then", ["DE89 3704 0044 0532 0130 01"]),
        ("IBAN NO93 8601 1117 947", ["NO93 8601 1117 947"]),
        ("IBAN NO9386011117947", ["NO9386011117947"]),
        ("IBAN DE89370400440532013000", ["DE89370400440532013000"]),
        ("account numbers were lost", []),
    ],
)
def test_accounts(text, want):
    assert [text[s:e] for k, s, e in pii.find_spans(text, pii.automaton()) if k == "account"] == want
