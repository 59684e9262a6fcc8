import pytest
from pyspark.sql import functions as F

from parapet.operators import pii
from parapet.operators.chain import run_chain


def redacted(texts, text, options=None, custom=()):
    return pii.redact(texts(text), "text", options, custom).first()["text"]


def verdict(texts, text, **options):
    return run_chain(texts(text), [pii.Pii("block", options)]).first()


ORDER_EFFECTS = [
    ("Card: 4111 1111 1111 1111", "Card: [REDACTED_PHONE] 1111"),
    ("Card: 4111111111111111", "Card: [REDACTED_CARD]"),
    ("Mi DNI es 12345678A", "Mi DNI es [REDACTED_PHONE]A"),
    ("NIE: X1234567A", "NIE: [REDACTED_DNI]"),
    ("IBAN: ES79 2100 0813 6101 2345 6789", "IBAN: ES[REDACTED_PHONE] 2345 6789"),
    ("My SSN is 123-45-6789", "My SSN is [REDACTED_SSN]"),
    ("Server at 192.168.100.100", "Server at [REDACTED_PHONE]"),
    ("Contact me at user.name+tag@domain.co.uk please", "Contact me at [REDACTED_EMAIL] please"),
    ("Hello world", "Hello world"),
    ("", ""),
]


def test_steps_see_what_earlier_steps_left(texts):
    out = pii.redact(texts(*[given for given, _ in ORDER_EFFECTS]), "text").orderBy("id").collect()
    assert [r["text"] for r in out] == [wanted for _, wanted in ORDER_EFFECTS]


def test_health_data_with_phones_off(texts):
    options = {"detectPatientNames": True, "detectMedicalRecordNumbers": True, "detectPhones": False}
    text = "Patient Pepito García, MRN-2024-12345, HbA1c 9.2%, email pepito@hospital.com"
    assert redacted(texts, text, options) == "[REDACTED_PATIENT], [REDACTED_MRN], HbA1c 9.2%, email [REDACTED_EMAIL]"


def test_several_types_with_phones_off(texts):
    out = redacted(texts, "Email: test@example.com and SSN: 123-45-6789 and DNI: 87654321B", {"detectPhones": False})
    assert out == "Email: [REDACTED_EMAIL] and SSN: [REDACTED_SSN] and DNI: [REDACTED_DNI]"


@pytest.mark.parametrize("text, options, blocked", [
    ("My email is test@example.com", {}, True),
    ("My SSN is 123-45-6789", {}, True),
    ("SSN: 123 45 6789", {}, True),
    ("Card: 4111 1111 1111 1111", {}, True),
    ("Card: 4111-1111-1111-1111", {}, True),
    ("Mi DNI es 12345678A", {}, True),
    ("NIE: X1234567A", {}, True),
    ("IBAN: ES79 2100 0813 6101 2345 6789", {}, True),
    ("Server at 192.168.1.1", {}, False),
    ("Server at 192.168.1.1", {"detectIpAddresses": True}, True),
    ("Analyze data for MRN-2024-78432", {"detectMedicalRecordNumbers": True}, True),
    ("Analyze data for NHC: 78432", {"detectMedicalRecordNumbers": True}, True),
    ("Analyze data for HC-2024/12345", {"detectMedicalRecordNumbers": True}, True),
    ("Analyze data for Medical Record 2024-78432", {"detectMedicalRecordNumbers": True}, True),
    ("Patient Pepito García, HbA1c 9.2%", {"detectPatientNames": True}, True),
    ("Paciente: María López Fernández, edad 67", {"detectPatientNames": True}, True),
    ("Patient Juan Pérez diagnosed with T2DM", {"detectPatientNames": True}, True),
    ("Patient Data Sheet", {"detectPatientNames": True}, False),
    ("Born 31/12/1999", {"detectDatesOfBirth": True, "detectPhones": False}, True),
    ("Passport AB123456", {"detectPassports": True}, True),
    ("Hello world", {}, False),
])
def test_block_mode(texts, text, options, blocked):
    out = verdict(texts, text, **options)
    assert out["blocked"] == blocked and out["text"] == text
    if blocked:
        assert out["reason"].startswith("PII detected in prompt: ")


def test_block_reason_lists_types_in_step_order(texts):
    out = verdict(texts, "123-45-6789, a@b.org, c@d.org")
    assert out["reason"] == "PII detected in prompt: EMAIL, SSN. Remove personal information before sending."


def test_custom_pattern_runs_last_and_ignores_case(texts):
    custom = [pii.CustomPattern("CUSTOM_ID", r"ID-\d{6}", "[REDACTED_ID]")]
    assert redacted(texts, "My id-123456 is private", custom=custom) == "My [REDACTED_ID] is private"


def test_custom_replacement_references(texts):
    custom = [pii.CustomPattern("X", r"(a)(b)", r"<$2$1|$&|$$|\>")]
    assert redacted(texts, "xaby", custom=custom) == r"x<ba|ab|$|\>y"


def test_custom_pattern_that_changes_nothing_is_still_found(texts):
    found = pii.findings(texts("foo foo"), "text", ["id"], None, [pii.CustomPattern("FOO", "foo", "foo")]).collect()
    assert [(r["type"], r["n"]) for r in found] == [("FOO", 2)]


def test_digits_of_other_scripts_count(texts):
    assert redacted(texts, "SSN ١٢٣-٤٥-٦٧٨٩") == "SSN [REDACTED_SSN]"


def test_border_before_accented_letter(texts):
    # "é" is a letter, so there is no border between it and the digits
    assert redacted(texts, "é12345678A", {"detectPhones": False}) == "é12345678A"


def test_findings_count_at_each_step(texts):
    found = pii.findings(texts("a@b.org 4111 1111 1111 1111 c@d.org", "nothing"), "text", ["id"], pii.ALL_OPTIONS)
    assert sorted(map(tuple, found.collect())) == [(0, "EMAIL", 2), (0, "PHONE", 1)]
    report = pii.findings_report(found).collect()
    assert sorted(map(tuple, report)) == [("EMAIL", 2, 1), ("PHONE", 1, 1)]


def test_columns_keep_their_place(spark):
    df = spark.sql("SELECT 'a@b.org' AS text, 1 AS id, true AS blocked")
    assert pii.redact(df, "text").columns == ["text", "id", "blocked"]
    assert run_chain(df, [pii.Pii("block")]).columns == ["text", "id", "blocked", "screen", "reason"]


def test_unknown_option_is_refused(texts):
    with pytest.raises(ValueError):
        pii.redact(texts("x"), "text", {"detectNothing": True})


def test_redaction_is_stable(spark, texts):
    once = pii.redact(texts(*[t for t, _ in ORDER_EFFECTS]), "text", pii.ALL_OPTIONS)
    twice = pii.redact(once, "text", pii.ALL_OPTIONS)
    assert once.join(twice, "id").filter(once.text != twice.text).count() == 0


def test_response_redaction(texts):
    screen = [pii.ResponsePii()]
    out = run_chain(texts("Call (555) 123-4567, a@b.org", "SSN 123-45-6789", "plain"), screen).orderBy("id").collect()
    # no phone detector on this side
    assert [r["text"] for r in out] == ["Call (555) 123-4567, [REDACTED_EMAIL]", "SSN [REDACTED_SSN]", "plain"]


def test_response_redaction_that_keeps_the_length_is_dropped(texts):
    mail = "abc@" + "d" * 8 + ".org"
    assert len(mail) == len("[REDACTED_EMAIL]")
    assert run_chain(texts(f"to {mail}"), [pii.ResponsePii()]).first()["text"] == f"to {mail}"


def test_every_step_is_planned_once(texts):
    """Nested steps must not be copied into one another: one replace per detector, one count per detector."""
    df = pii.findings(texts("x"), "text", ["id"], pii.ALL_OPTIONS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 11 and plan.count("regexp_extract_all(") == 11  # what a count becomes
    redaction = pii.redact(texts("x"), "text", pii.ALL_OPTIONS).filter(F.col("text") != "x")
    assert redaction._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 11
