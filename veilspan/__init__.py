"""Find and redact sensitive values in text, as Spark DataFrame operations."""

from veilspan.plans.scan import ScanResult, check, scan
from veilspan.policy import DEFAULT_POLICY, Rule
from veilspan.recognizers import DEFAULT_RECOGNIZERS, Recognizer, RecognizerSet

__all__ = [
    "DEFAULT_POLICY",
    "DEFAULT_RECOGNIZERS",
    "Recognizer",
    "RecognizerSet",
    "Rule",
    "ScanResult",
    "check",
    "scan",
]
