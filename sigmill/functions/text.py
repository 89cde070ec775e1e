"""Report text: normalisation, masking and the deterministic issue rules, as columns.

Plain rules stay in the JVM. Span resolution across overlapping kinds, Unicode
normalisation and the balanced-brace scan have no built-in and run as Arrow
batched functions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T

MIN_LENGTH, MAX_LENGTH = 20, 500
SCAN_TYPE = "struct<decision:string,masked:string,kinds:array<string>,spans:array<struct<start:int,end:int,kind:string>>,residual:boolean>"

_REJECT = {k: re.compile(p) for k, p in T.REJECT_PATTERNS.items()}
_MASK = {k: re.compile(p) for k, p in T.MASK_PATTERNS.items()}
_DATE = re.compile(T.DASH_DATE)


def any_of(text: Column, words: Iterable[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def normalize(text: Column) -> Column:
    """Stripped, composed (NFC) text with canonical placeholders; null unless 20 to 500 code points remain."""

    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()))

    out = F.pandas_udf(composed, "string")(text)
    for local, canonical in T.PLACEHOLDERS.items():
        out = F.replace(out, F.lit(local), F.lit(canonical))
    return F.when(F.length(out).between(MIN_LENGTH, MAX_LENGTH), out)


def reject_kinds(text: Column) -> Column:
    """Kinds for which a report is refused, in their fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(k)) for k, p in T.REJECT_PATTERNS.items()]))


def _dated(found: str) -> bool:
    match = _DATE.fullmatch(found)
    if not match:
        return False
    year, month, day = match.groups()
    full = int(year) + (2000 if len(year) == 2 else 0)
    return 2000 <= full <= 2099 and 1 <= int(month) <= 12 and 1 <= int(day) <= 31


#: What every match of the digit patterns holds: eight characters of digits and their separators, the first a digit.
_DIGITS = re.compile(r"\d[\d\s.)/‐‑‒–—―−-]{7}")
_NEEDED = {
    "EMAIL": lambda text, digits: "@" in text,
    "OTP": lambda text, digits: "otp" in text.lower() or "일회용" in text,
    "PASSWORD": lambda text, digits: "비밀번호" in text or "패스워드" in text,
}


def _searched(patterns: dict, text: str) -> list:
    """The (kind, pattern) that may match: a text without what a pattern needs is not searched for it."""
    digits = _DIGITS.search(text) is not None
    return [(k, p) for k, p in patterns.items() if (_NEEDED[k](text, digits) if k in _NEEDED else digits)]


def _candidates(text: str) -> list[tuple[int, int, str]]:
    return [
        (m.start(), m.end(), kind)
        for kind, pattern in _searched(_MASK, text)
        for m in pattern.finditer(text)
        if kind != "ACCOUNT" or not _dated(m.group())
    ]


def has_residual(text: str) -> bool:
    return any(p.search(text) for _, p in _searched(_REJECT, text)) or bool(_candidates(text))


def scan_text(text: str | None):
    """Decision, masked text, kinds and spans: longer spans win, then earlier ones."""
    if text is None:
        return None
    refused = [k for k, p in _searched(_REJECT, text) if p.search(text)]
    if refused:
        return ("REJECT", "", refused, [], False)
    chosen: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(_candidates(text), key=lambda s: (s[0] - s[1], s[0])):
        at = bisect(chosen, (start, end, kind))
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or end <= chosen[at][0]):
            chosen.insert(at, (start, end, kind))
    if not chosen:
        return ("ALLOW", text, [], [], False)
    pieces, at = [], 0
    for start, end, kind in chosen:
        pieces += [text[at:start], f"[{kind}]"]
        at = end
    masked = "".join([*pieces, text[at:]])
    kinds = list(dict.fromkeys(kind for _, _, kind in chosen))
    return ("MASKED", masked, kinds, chosen, has_residual(masked))


def scan(text: Column) -> Column:
    """Struct of the masking result; residual marks texts in which sensitive data remained."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [scan_text(x) or (None, None, None, None, None) for x in s]
        return pd.DataFrame(rows, columns=["decision", "masked", "kinds", "spans", "residual"])

    return F.pandas_udf(run, SCAN_TYPE)(text)


def residual(text: Column) -> Column:
    """Whether a text that should be masked still holds refused or maskable data."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else has_residual(x)), "boolean")(text)


def masked_items(masked: Column) -> Column:
    shown = [F.when(F.contains(masked, F.lit(f"[{k}]")), F.lit(k)) for k in T.SHOWN_KINDS]
    return F.array_compact(F.array(*shown))


def grounded(quote: Column, text: Column) -> Column:
    """A missing quote needs no ground; any other must be part of the text."""
    return quote.isNull() | F.contains(text, quote)


def names_date_and_time(quote: Column) -> Column:
    return F.coalesce(quote.rlike(T.FULL_DATE) & quote.rlike(T.CLOCK_TIME), F.lit(False))


def iso_with_offset(value: Column) -> Column:
    return value.rlike(T.ISO_OFFSET)


def network_negated(text: Column) -> Column:
    return any_of(text, T.NETWORK_NORMAL) | text.rlike(T.NETWORK_NEGATION)


def issue_candidate(text: Column) -> Column:
    """The issue type that keywords suggest, by the first rule that holds; null if none does."""
    failed = any_of(text, T.FAILURE)
    information = any_of(text, T.INFORMATION_TOPICS) & any_of(text, T.INFORMATION_REQUESTS)
    local = any_of(text, T.NETWORK) | any_of(text, T.DEVICE)
    return (
        F.when(~failed & information, "UNRELATED_OR_AMBIGUOUS")
        .when(failed & ~network_negated(text) & local, "DEVICE_NETWORK_SUSPECTED")
        .when(failed & any_of(text, T.LOGIN), "LOGIN_ACCESS_FAILURE")
        .when(any_of(text, T.RESULT) & (failed | any_of(text, T.UNSURE)), "ORDER_RESULT_UNCONFIRMED")
        .when(failed & any_of(text, T.BALANCE), "BALANCE_INQUIRY_ERROR")
        .when(failed & any_of(text, T.ORDER) & any_of(text, T.SUBMISSION), "ORDER_SUBMISSION_FAILURE")
        .when(~failed & any_of(text, T.INFORMATION), "UNRELATED_OR_AMBIGUOUS")
    )


def has_minimum_evidence(issue_type: Column, text: Column) -> Column:
    out = F.when(issue_type == "UNKNOWN", True)
    for kind, words in T.MINIMUM_EVIDENCE.items():
        found = any_of(text, words)
        out = out.when(issue_type == kind, found & ~network_negated(text) if kind == "DEVICE_NETWORK_SUSPECTED" else found)
    return out.otherwise(False)


def issue_conflict(issue_type: Column, status: Column, text: Column) -> Column:
    """Whether a type confirmed from the text disagrees with the text's own cues."""
    candidate = issue_candidate(text)
    stalled = any_of(text, T.STALL) & ~any_of(text, T.RESULT_QUESTION)
    conflict = (
        F.coalesce(candidate != issue_type, F.lit(False))
        | ((issue_type == "DEVICE_NETWORK_SUSPECTED") & network_negated(text))
        | ((issue_type == "ORDER_RESULT_UNCONFIRMED") & stalled)
    )
    return (status == "CONFIRMED_FROM_TEXT") & conflict


def compact_evidence(issue_type: Column, quote: Column, text: Column) -> Column:
    """A quote that is the whole text shrinks to its part from the first cue on, or to what follows the first comma."""
    options = []
    for kind, words in T.CUES.items():
        for word in words:
            at = F.locate(word, text)
            options.append(F.when((issue_type == kind) & (at > 1), F.substr(text, at)))
    comma = F.locate(",", text)
    after = F.regexp_replace(F.substr(text, comma + 1), r"^\s+", "")
    options.append(F.when((comma > 0) & (after != ""), after))
    return F.when(issue_type.isNotNull() & (quote == text), F.coalesce(*options, quote)).otherwise(quote)


def order_type_grounded(order_type: Column, quote: Column) -> Column:
    words = F.when(order_type == "LIMIT", T.LIMIT_WORD).when(order_type == "MARKET", T.MARKET_WORD)
    return words.isNull() | F.contains(F.coalesce(quote, F.lit("")), words)


def order_type_fallback(order_type: Column, status: Column, text: Column) -> Column:
    """Drops a confirmed order type when the text names neither kind."""
    named = any_of(text, (T.LIMIT_WORD, T.MARKET_WORD))
    return F.when((status == "CONFIRMED_FROM_TEXT") & ~named, F.lit(None)).otherwise(order_type)


def json_object(content: Column) -> Column:
    """The JSON object inside chatter: a fenced block, the whole text, or the first balanced braces."""
    whole = F.trim(content)
    fenced = F.regexp_extract(whole, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.when(F.startswith(whole, F.lit("{")) & F.endswith(whole, F.lit("}")), whole)
    balanced = F.pandas_udf(lambda s: s.map(balanced_object), "string")(whole)
    return F.coalesce(F.when(fenced != "", fenced), bare, balanced)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}"]', re.S)


def balanced_object(text: str | None) -> str | None:
    """From the first brace to the one that closes it, braces inside strings aside."""
    begin = -1 if text is None else text.find("{")
    if begin < 0:
        return None
    depth = 0
    for token in _TOKEN.finditer(text, begin):
        if token.group() == '"':
            return None  # a string that never ends
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0 and token.group() == "}":
            return text[begin : token.end()]
    return None


def to_integer(value: Column) -> Column:
    return F.expr("null").cast("bigint") if value is None else F.regexp_replace(value, r"[^\d-]", "").try_cast("bigint")


def unknown_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit("UNKNOWN"))


def symbol_code(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when((F.length(code) == 7) & F.startswith(code, F.lit("A")), F.substr(code, F.lit(2))).otherwise(code)


def market(value: Column) -> Column:
    return F.when(value == "KOSDAQ GLOBAL", "KOSDAQ").otherwise(value)


def client_masked(text: Column) -> Column:
    """The looser masking that a client applies before sending, kind after kind."""
    out = F.regexp_replace(text, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[이메일]")
    out = F.regexp_replace(out, r"(?<!\d)\d{4}(?:[\s./-]*\d{4}){3}(?!\d)", "[카드번호]")
    out = F.regexp_replace(out, r"(?<!\d)0\d{1,2}[\s.)-]*\d{3,4}[\s.-]*\d{4}(?!\d)", "[전화번호]")
    return F.regexp_replace(out, r"(?<!\d)(?:\d{10,14}|\d{2,6}[ -]+\d{2,6}[ -]+\d{2,8})(?!\d)", "[계좌번호]")


DATE = r"(\d{2}|\d{4})\s*(?:년|[-./])\s*(\d{1,2})\s*(?:월|[-./])\s*(\d{1,2})"
CLOCK = r"(오전|오후)?\s*(\d{1,2})\s*(?:시(?:\s*(\d{1,2})\s*분)?|:\s*([0-5]\d))"


def occurred_at(text: Column) -> Column:
    """ISO date-time at +09:00 from the first date and the first time that the text names; null without both.

    An offline stand-in for a language model. The text is searched once for each; the parts come from the short matches.
    """
    part = lambda match, pattern, i: F.nullif(F.regexp_extract(match, pattern, i), F.lit("")).cast("int")

    def shown(day: Column, clock: Column) -> Column:
        year, month, date = (part(day, DATE, i) for i in (1, 2, 3))
        year = F.when(year < 100, year + 2000).otherwise(year)
        half, hour = F.regexp_extract(clock, CLOCK, 1), part(clock, CLOCK, 2)
        hour = F.when((half == "오후") & (hour < 12), hour + 12).when((half == "오전") & (hour == 12), 0).otherwise(hour)
        minute = F.coalesce(part(clock, CLOCK, 3), part(clock, CLOCK, 4), F.lit(0))
        sound = month.between(1, 12) & date.between(1, 31) & hour.between(0, 23) & minute.between(0, 59)
        return F.when(sound, F.format_string("%04d-%02d-%02dT%02d:%02d:00+09:00", year, month, date, hour, minute))

    day = F.regexp_extract(text, DATE, 0)
    clock = F.regexp_extract(F.regexp_replace(text, DATE + r"\s*일?", "|"), CLOCK, 0)
    found = F.transform(F.array(day), lambda d: F.when(d != "", F.struct(d.alias("day"), clock.alias("clock"))))
    return F.transform(found, lambda f: shown(f["day"], f["clock"]))[0]


def order_action(text: Column) -> Column:
    """BUY or SELL when the text names just one of them; an offline stand-in for the model."""
    buy, sell = F.contains(text, F.lit(T.BUY_WORD)), F.contains(text, F.lit(T.SELL_WORD))
    return F.when(buy & ~sell, "BUY").when(sell & ~buy, "SELL").otherwise("UNKNOWN")


def submission_status(text: Column) -> Column:
    """What the text says outright about the order: that it was not placed, that it was, or nothing; an offline stand-in for the model."""
    return (
        F.when(text.rlike(T.NOT_SUBMITTED), "CUSTOMER_REPORTED_NOT_SUBMITTED").when(text.rlike(T.SUBMITTED), "CUSTOMER_REPORTED_SUBMITTED").otherwise("UNKNOWN")
    )


def taxonomy(spark: SparkSession) -> DataFrame:
    """(issue_type, place, label, phrase, criterion): the 19 symptom labels."""
    rows = [(kind, i, *entry) for kind, entries in T.TAXONOMY.items() for i, entry in enumerate(entries, 1)]
    return spark.createDataFrame(rows, "issue_type string, place int, label string, phrase string, criterion string")
