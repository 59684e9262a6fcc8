import re

import pytest

from parapet.operators import pii, spans

GOLDEN = {
    "Card: 4111 1111 1111 1111": "Card: [REDACTED_CARD]",
    "Card: 4111111111111111 and 4111-1111-1111-1111": "Card: [REDACTED_CARD] and [REDACTED_CARD]",
    "Mi DNI es 12345678A": "Mi DNI es [REDACTED_DNI]",
    "NIE: X1234567A": "NIE: [REDACTED_DNI]",
    "IBAN: ES79 2100 0813 6101 2345 6789": "IBAN: [REDACTED_IBAN] 6789",
    "My SSN is 123-45-6789": "My SSN is [REDACTED_SSN]",
    "Call +34 912 345 678 now": "Call [REDACTED_PHONE] now",
    "Mail 5551234567@example.com": "Mail [REDACTED_EMAIL]",
    "an emoji \U0001F600 then a@b.org and ñ 123-45-6789 end": "an emoji \U0001F600 then [REDACTED_EMAIL] and ñ [REDACTED_SSN] end",
    "nothing here": "nothing here", "": "", None: "",
    "a@b.org": "[REDACTED_EMAIL]",
}


def test_specific_detectors_win(spark):
    rows = list(enumerate(GOLDEN))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, text string, `__at` int, `a.b` string")
    out = spans.redact_specific(df)
    assert out.columns == df.columns
    assert {r["id"]: r["text"] for r in out.collect()} == {i: GOLDEN[t] for i, t in rows}


def test_more_detectors_and_own_patterns(spark):
    df = spark.createDataFrame([(1, "Server 192.168.100.100, MRN-2024-12345, ticket ID-123456789012345 and born 31/12/1999")],
                               "id long, text string")
    own = [pii.CustomPattern("TICKET", r"\bID-(\d{3})\d{12}\b", "[ticket $1 $$]")]
    assert spans.redact_specific(df, "text", pii.ALL_OPTIONS, own).first()["text"] == (
        "Server [REDACTED_IP], [REDACTED_MRN], ticket [ticket 123 $] and born [REDACTED_DOB]")


def test_places_are_those_of_the_original(spark):
    text = "é\U0001F600 a@b.org, then 123-45-6789; card 4111 1111 1111 1111, call (555) 123-4567 or 4111111111111111x " * 20
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    found = spans.find_spans(df, "text", ["id"]).collect()
    assert all(r["id"] == 1 for r in found)
    places = sorted((r["start"], r["stop"], r["type"]) for r in found)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
    first = {kind: text[a:b] for a, b, kind in reversed(places)}
    assert first["EMAIL"] == "a@b.org" and first["SSN"] == "123-45-6789" and first["PHONE"] == "(555) 123-4567"
    assert first["CREDIT_CARD"].startswith("4111 1111 1111 1111")
    assert sum(kind == "EMAIL" for _, _, kind in places) == len(re.findall("a@b", text))


def test_all_kinds_have_a_rank():
    assert sorted(spans.SPECIFIC_FIRST) == sorted(pii.DETECTORS)
    with pytest.raises(ValueError):
        spans.ordered({"detectNothing": True}, ())
