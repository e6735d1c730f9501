"""Golden spans and texts."""

import pytest
from pyspark.sql import functions as F

from veilspan import DEFAULT_RECOGNIZERS, scan

F1B = (
    "My email is test@example.com and my phone is +91-9876543210. My SSN is 123-45-6789. John Doe lives at 123 Main St,"
    " Anytown, CA 90210. My password is StrongP@ss1. My AADHAAR is 1234 5678 9012. My PAN is ABCDE1234F. My API key is"
    " sk-" + "x" * 40 + "."
)
F1 = F1B.replace(
    "StrongP@ss1. ", "StrongP@ss1. Here's an SSH key: ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQCw0+... user@host. "
)
F2 = "[settings]\npassword=mysecret\nfreq=20.0\ncolorId=4\napi_key=some_internal_key_value"
F6 = "call 555 123-4567-Aa1x now"
F7 = "John Doe Smith called"

TOKEN_TEXT = (
    "My email is **********le.com and my phone is +91-*******210. My SSN is *******6789. John Doe lives at [REDACTED]."
    " My password is [REDACTED]. My AADHAAR is XXXXXXXX8 9012. My PAN is XXXXXX234F. My API key is"
    " [API_KEY_REDACTED][API_KEY_REDACTED]."
)
LINE_TEXT = (
    "My email is **********le.com and my phone is +[REDACTED]. My SSN is [REDACTED]. John Doe lives at [REDACTED]."
    " My [REDACTED] is [REDACTED]. My AADHAAR is XXXXXXXX8 9012. My PAN is [REDACTED]. My API key is"
    " [API_KEY_REDACTED][API_KEY_REDACTED]."
)
F1_TOKEN_TEXT = (
    "My email is **********le.com and my phone is +91-*******210. My SSN is *******6789. John Doe lives at [REDACTED]."
    " My password is [REDACTED]. Here's an SSH key: [SSH_KEY_REDACTED]"
)
F1_LINE_TEXT = (
    "My email is **********le.com and my phone is +[REDACTED]. My SSN is [REDACTED]. John Doe lives at [REDACTED]."
    " My [REDACTED] is [REDACTED]. Here's an SSH key: [SSH_KEY_REDACTED]"
)
F2_TEXT = "[settings]\npassword=mysecret\nfreq=20.0\n[REDACTED]\napi_key=[API_KEY_REDACTED]"
HEAD = [("EMAIL_ADDRESS", 12, 28)]
TAIL = [("API_KEY", 228, 231), ("API_KEY", 231, 271)]
TOKEN_SPANS = (
    HEAD
    + [("PHONE_NUMBER", 49, 59), ("US_SSN", 71, 82), ("ADDRESS", 102, 132), ("PASSWORD", 149, 160)]
    + [("AADHAAR_NUMBER", 176, 190), ("PAN_NUMBER", 202, 212)]
    + TAIL
)
LINE_SPANS = (
    HEAD
    + [("PASSWORD", 46, 59), ("PASSWORD", 71, 82), ("ADDRESS", 102, 132), ("PASSWORD", 137, 145)]
    + [("PASSWORD", 149, 160), ("AADHAAR_NUMBER", 176, 190), ("PASSWORD", 202, 212)]
    + TAIL
)


def run(spark, text, scope, names=None):
    df = spark.createDataFrame([("k", text)], "path string, text string")
    result = scan(df, recognizers=DEFAULT_RECOGNIZERS.with_scope(scope), names=names)
    kept = F.transform("kept", lambda x: F.struct(x["entity"], x["start"], -x["neg_end"]))
    row = result.redacted.select("redacted", kept.alias("kept")).first()
    return row["redacted"], [tuple(k) for k in row["kept"]], result.findings.count()


@pytest.mark.parametrize(
    "text, scope, raw, spans, redacted",
    [
        (F1B, "token", 9, TOKEN_SPANS, TOKEN_TEXT),
        (F1B, "line", 14, LINE_SPANS, LINE_TEXT),
        (F1, "token", 12, TOKEN_SPANS[:5] + [("SSH_KEY", 181, 348)], F1_TOKEN_TEXT),
        (F1, "line", 18, LINE_SPANS[:6] + [("SSH_KEY", 181, 348)], F1_LINE_TEXT),
        (F2, "token", 2, [("PASSWORD", 39, 48), ("API_KEY", 57, 80)], F2_TEXT),
        (F2, "line", 2, [("PASSWORD", 39, 48), ("API_KEY", 57, 80)], F2_TEXT),
        (F6, "line", 2, [("PHONE_NUMBER", 5, 9), ("PASSWORD", 9, 22)], "call ****[REDACTED] now"),
    ],
)
def test_golden(spark, text, scope, raw, spans, redacted):
    assert run(spark, text, scope) == (redacted, spans, raw)


def test_names(spark):
    redacted, spans, raw = run(spark, F1B, "token", ["John Doe"])
    assert ("PERSON", 84, 92) in spans and raw == 10
    assert redacted == TOKEN_TEXT.replace("John Doe", "[REDACTED]")


def test_overlapping_names_merge(spark):
    assert run(spark, F7, "line", ["John Doe", "Doe Smith"]) == ("[REDACTED] called", [("PERSON", 0, 14)], 2)


def test_phone_keeps_what_is_outside_the_boundary(spark):
    assert run(spark, "call (555) 123-4567 now", "token")[1] == [("PHONE_NUMBER", 6, 19)]


def test_ecdsa_name_with_suffix_is_no_key(spark):
    assert run(spark, "ecdsa-sha2-nistp256 AAAA", "token")[1] == []
