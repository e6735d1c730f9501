"""The recognizer table: which pattern finds which entity, with what score."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from veilspan import schemas

# ---------------------------------------------------------------------------
# The entities, patterns and scores that decide the results.
# ---------------------------------------------------------------------------
ENTITIES = (
    "EMAIL_ADDRESS",
    "CREDIT_CARD",
    "PHONE_NUMBER",
    "US_SSN",
    "PERSON",
    "ADDRESS",
    "PASSWORD",
    "SSH_KEY",
    "AADHAAR_NUMBER",
    "PAN_NUMBER",
    "API_KEY",
)

CREDIT_CARD = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
)
# The source's look-ahead for a digit is left out: behind \b there is none, and the checking engine has no look-ahead.
PHONE_NUMBER = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
EMAIL_ADDRESS = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PASSWORD_RUN = r"\b[a-zA-Z0-9!@#$%^&*()_+=\-\[\]{}|;:'\",.<>/?`~]{8,}\b"
PASSWORD_NEEDS = (r"[a-z]", r"[A-Z]", r"\d")
US_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
ADDRESS = (
    r"\b\d{1,5}\s(?:[A-Za-z0-9\s\.,'#-]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct"
    r"|Place|Pl|Square|Sq|Terrace|Ter|Parkway|Pkwy|Circle|Cir)\.?)[\s,]+[A-Za-z\s\.,'-]+,\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?\b"
)
SSH_KEY = r"ssh-(rsa|dss|ecdsa|ed25519)\s[A-Za-z0-9+/=]+\s*.*"
AADHAAR_NUMBER = r"\b\d{4}\s\d{4}\s\d{4}\b|\b\d{12}\b"
PAN_NUMBER = r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"
API_KEY = (
    r"\b(?:sk-|AKIA|SG\.|pk_|Bearer\s|xoxb-|EAACEdEose|ya29\.[a-zA-Z0-9_-]+"
    r"|AIza[0-9A-Za-z-_]{35}|[A-Za-z0-9-_]{20,40}(?:\.[A-Za-z0-9-_]{20,40})?)\b"
)

SCORES = {
    "CREDIT_CARD": 0.95,
    "PHONE_NUMBER": 0.9,
    "EMAIL_ADDRESS": 0.96,
    "PASSWORD": 0.95,
    "US_SSN": 0.9,
    "ADDRESS": 0.85,
    "SSH_KEY": 0.95,
    "AADHAAR_NUMBER": 0.9,
    "PAN_NUMBER": 0.9,
    "API_KEY": 0.85,
}
PERSON_SCORE = 0.85
# ---------------------------------------------------------------------------

# Where a pattern has failed at a word boundary, it also fails everywhere in the run
# that follows: an e-mail's local part must reach its '@'. Passing over the run keeps
# long texts linear.
EMAIL_SKIP = r"\b[a-zA-Z0-9._%+-]{32,}+"

# An address read from its end: the ZIP code comes first, and the digit-free stretch before it
# holds the street word. Stretches of different ZIP codes do not overlap, so long texts without an
# address, or with street words only, take linear time; the forward pattern tries every
# street word against the rest of its run. A match goes from the first number of its run to the
# last ZIP code that has a street word, in either direction.
_STREET = re.search(r"\(\?:(Street[^)]*)\)", ADDRESS)[1]
_DRAWER = "|".join(word[::-1] for word in _STREET.split("|"))
_ADDRESS_TAIL = rf"\b(?:\d{{4}}-)?\d{{5}}\s*[A-Z]{{2}}\s*,[A-Za-z\s\.,'-]+[\s,]\.?(?:{_DRAWER})[A-Za-z0-9\s\.,'#-]"
ADDRESS_BACKWARDS = _ADDRESS_TAIL + r"+\s\d{1,5}\b"
# A tail with its street word but without a number: no number is left of it in the whole run.
ADDRESS_SKIP = _ADDRESS_TAIL + "*+"

PASSWORD_SCOPES = ("line", "text", "token")


@dataclass(frozen=True)
class Recognizer:
    """One pattern for one entity.

    ``needs_text`` (a substring) or ``needs_regex`` (a cheap pattern) name something
    every match must contain; texts without it skip the full pattern. ``needs_also``
    is a second such pattern, tried only after the first.
    ``skip`` is what to pass over where the pattern failed, because no match can start
    in it; it has no effect on the result. Neither pattern may have capturing groups.
    ``needs_ahead`` lists classes that must each occur at or after a match's start,
    within ``scope`` ('line', 'text', or 'token' for the match itself).
    ``backwards`` is the same pattern for the reversed text (``skip`` then is too).
    ``language`` is the language of the texts it is meant for; ``for_language`` chooses by it.
    """

    entity: str
    pattern_name: str
    regex: str
    score: float
    needs_text: str | None = None
    needs_regex: str | None = None
    needs_also: str | None = None
    skip: str | None = None
    needs_ahead: tuple[str, ...] = ()
    scope: str = "line"
    language: str = "en"
    backwards: str | None = None


def _default_list() -> tuple[Recognizer, ...]:
    s = SCORES
    return (
        Recognizer("CREDIT_CARD", "credit_card_pattern", CREDIT_CARD, s["CREDIT_CARD"], needs_regex=r"\d"),
        Recognizer("PHONE_NUMBER", "phone_pattern", PHONE_NUMBER, s["PHONE_NUMBER"], needs_regex=r"\d"),
        Recognizer(
            "EMAIL_ADDRESS", "email_pattern", EMAIL_ADDRESS, s["EMAIL_ADDRESS"], needs_text="@", skip=EMAIL_SKIP
        ),
        Recognizer(
            "PASSWORD",
            "password_pattern",
            PASSWORD_RUN,
            s["PASSWORD"],
            needs_regex=r"\d",
            needs_ahead=PASSWORD_NEEDS,
        ),
        Recognizer("US_SSN", "ssn_pattern", US_SSN, s["US_SSN"], needs_regex=r"\d"),
        # Every address ends in state and ZIP; testing for that first keeps the
        # backtracking street pattern away from all other texts.
        Recognizer(
            "ADDRESS",
            "address_pattern",
            ADDRESS,
            s["ADDRESS"],
            needs_regex=r"\d",
            needs_also=r",\s*[A-Z]{2}\s*\d{5}",
            skip=ADDRESS_SKIP,
            backwards=ADDRESS_BACKWARDS,
        ),
        Recognizer("SSH_KEY", "ssh_key_pattern", SSH_KEY, s["SSH_KEY"], needs_text="ssh-"),
        Recognizer("AADHAAR_NUMBER", "aadhaar_pattern", AADHAAR_NUMBER, s["AADHAAR_NUMBER"], needs_regex=r"\d"),
        Recognizer("PAN_NUMBER", "pan_pattern", PAN_NUMBER, s["PAN_NUMBER"], needs_regex=r"\d"),
        Recognizer("API_KEY", "api_key_pattern", API_KEY, s["API_KEY"]),
    )


def _matches_nothing(regex: str) -> bool:
    """Whether a pattern matches the empty text, by the engine that will run it; raises ValueError if it is not one.

    Without a running session there is no engine to ask: the pattern is looked at as far as ``re`` can read it.
    """
    context = SparkContext._active_spark_context
    if context is None:
        try:
            return re.search(regex, "") is not None
        except re.error:
            return False
    try:
        return context._jvm.java.util.regex.Pattern.compile(regex).matcher("").find()
    except (Py4JJavaError, IllegalArgumentException) as error:
        raise ValueError(f"not a pattern: {regex!r}") from error


class RecognizerSet:
    """An ordered set of recognizers plus the matching flags they share.

    ``flags`` takes any of 'i', 'm', 's'; the default matches as written: case
    matters and ``.`` stops at a newline.
    """

    def __init__(self, items: Iterable[Recognizer], flags: str = "", entities: Iterable[str] = ENTITIES):
        if set(flags) - set("ims"):
            raise ValueError(f"unknown flags: {flags!r}")
        self.items = tuple(items)
        self.flags = flags
        self.entities = tuple(entities)
        for item in self.items:
            if item.scope not in PASSWORD_SCOPES:
                raise ValueError(f"unknown scope: {item.scope!r}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RecognizerSet) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def _key(self) -> tuple:
        return (self.items, self.flags, self.entities)

    def __iter__(self) -> Iterator[Recognizer]:
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    @property
    def prefix(self) -> str:
        # U: Unicode \b \d \s. d: only \n ends a line.
        return f"(?Ud{self.flags})"

    def priority(self, entity: str) -> int:
        return self.entities.index(entity)

    def only(self, entities: Iterable[str]) -> RecognizerSet:
        """Keep the listed entities; the others are never matched at all."""
        wanted = set(entities)
        unknown = wanted - set(self.entities)
        if unknown:
            raise ValueError(f"unknown entities: {sorted(unknown)}")
        return RecognizerSet((r for r in self.items if r.entity in wanted), self.flags, self.entities)

    def for_language(self, language: str) -> RecognizerSet:
        """Keep the recognizers meant for texts of ``language``."""
        return RecognizerSet((r for r in self.items if r.language == language), self.flags, self.entities)

    def with_recognizer(self, entity: str, regex: str, score: float, name: str | None = None) -> RecognizerSet:
        """Add a pattern of the user's own, for a known or a new entity."""
        if _matches_nothing(regex):
            raise ValueError(f"pattern matches the empty string: {regex!r}")
        if not 0.0 <= score <= 1.0:
            raise ValueError(f"score out of range: {score}")
        entities = self.entities if entity in self.entities else (*self.entities, entity)
        added = Recognizer(entity, name or f"{entity.lower()}_custom", regex, float(score))
        return RecognizerSet((*self.items, added), self.flags, entities)

    def with_flags(self, flags: str) -> RecognizerSet:
        # With dot-all, "ahead on the line" becomes "ahead in the text"; a chosen scope stays.
        wide = "s" in flags
        items = tuple(replace(r, scope="text") if wide and r.needs_ahead and r.scope == "line" else r for r in self.items)
        return RecognizerSet(items, flags, self.entities)

    def with_scope(self, scope: str) -> RecognizerSet:
        items = tuple(replace(r, scope=scope) if r.needs_ahead else r for r in self.items)
        return RecognizerSet(items, self.flags, self.entities)

    def with_recognizers_from(self, df: DataFrame) -> RecognizerSet:
        """Add the patterns of a recognizer table; they become literals of the plan."""
        rows = df.select("entity", "pattern_name", "regex", "score").collect()
        items, entities = list(self.items), list(self.entities)
        for r in sorted(rows, key=lambda r: (r["entity"], r["pattern_name"])):
            one = RecognizerSet((), self.flags, entities).with_recognizer(r["entity"], r["regex"], r["score"], r["pattern_name"])
            items += one.items
            entities = list(one.entities)
        return RecognizerSet(items, self.flags, entities)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.entity, r.pattern_name, r.regex, r.score, self.priority(r.entity)) for r in self.items]
        return spark.createDataFrame(rows, schemas.RECOGNIZER)


DEFAULT_RECOGNIZERS = RecognizerSet(_default_list())
