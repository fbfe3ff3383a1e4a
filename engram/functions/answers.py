"""Text functions of answers, privacy and plans: token F1, answer check, detector with confidence, anonymiser, JSON repair,
phrases made absolute, retrieval plan. Null texts give null or nothing."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from engram.functions.rules import STOP_WORDS, jvm, strip

# Patterns of personal data by kind, with the base of their confidence.
DETECTED = [
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), ("phone", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"), ("ssn", r"\b\d{3}[-]?\d{2}[-]?\d{4}\b"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"), ("api_key", r"\b(?:sk[-_])?[A-Za-z0-9]{20,}\b"),
    ("password", r"(?i)(?:password|passwd|pwd)[\s:=]+[\"']?[^\"'\s]+[\"']?"), ("url_with_auth", r"(?i)https?://[^:\s]+:[^@\s]+@[^\s]+"),
]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "ssn": "[SSN]", "credit_card": "[CARD]", "ip_address": "[IP]", "api_key": "[API_KEY]", "password": "[REDACTED]", "url_with_auth": "[URL]"}
# Given names, cities and dates that the anonymiser replaces.
NAMES = r"(?i)\b(John|Jane|Mike|Sarah|David|Lisa|James|Mary|Robert|Jennifer)\b"
CITIES = r"(?i)\b(New York|Los Angeles|Chicago|San Francisco|Seattle|Boston|Miami|Austin|Denver|Portland)\b"
MONTHS = "January February March April May June July August September October November December".split()
DATES = rf"(?i)\b(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}})\b"


def normal_answer(text: Column) -> Column:
    """Lower case without articles, marks and extra blanks."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.lower(text)), jvm(r"\b(a|an|the|and)\b"), " "), "[.,!?'\"]", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def token_f1(answer: Column, truth: Column) -> Column:
    """Harmonic mean of shared words over the answer's and the truth's words; of an empty one 1 if both are equal."""
    a, t = normal_answer(answer), normal_answer(truth)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    x, y = words(a), words(t)
    both = F.size(F.array_intersect(x, y))
    p, r = both / F.size(x), both / F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (a == t).cast("double")).when(both == 0, 0.0).otherwise(2 * p * r / (p + r))


def correct(expected: Column, answer: Column, category: Column) -> Column:
    """Whether an answer is right: equal, one in the other, by F1 (0.7 for times, category 2, else 0.5); category 5 asks for no answer."""
    e, a = normal_answer(expected), normal_answer(answer)
    held = (e == a) | (a.contains(e) & (F.length(e) > 2)) | (e.contains(a) & (F.length(a) > 3))
    none = answer.rlike("(?i)no information|not mentioned|unknown")
    return F.when(held, True).when(category == 5, none).otherwise(token_f1(answer, expected) >= F.when(category == 2, 0.7).otherwise(0.5))


def detect(text: Column) -> Column:
    """array<struct<kind, value, confidence>> of personal data, kind by kind."""
    found = []
    for kind, pattern in DETECTED:
        digits = lambda v: F.regexp_replace(v, r"\D", "")
        sure = {"email": lambda v: F.lit(0.95), "phone": lambda v: F.when(F.length(digits(v)) >= 10, 0.9).otherwise(0.6), "ssn": lambda v: F.lit(0.85),
                "credit_card": lambda v: F.when((F.length(digits(v)) >= 13) & F.call_function("luhn_check", digits(v)), 0.95).otherwise(0.5), "api_key": lambda v: F.when(F.length(v) > 30, 0.8).otherwise(0.5)}.get(kind, lambda v: F.lit(0.7))
        make = lambda k, s: lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"), s(v).alias("confidence"))
        found.append(F.transform(F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(0)), make(kind, sure)))
    return F.flatten(F.array(*found))


def anonymised(text: Column) -> Column:
    """The text with a placeholder for each item, name, city and date; kinds in order, so overlapping items can't shift each other."""
    out = reduce(lambda c, kp: F.regexp_replace(c, jvm(kp[1]), PLACEHOLDERS[kp[0]].replace("[", r"\[").replace("]", r"\]")), reversed(DETECTED), text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, jvm(NAMES), "[PERSON]"), jvm(CITIES), "[LOCATION]"), jvm(DATES), "[DATE]")


def unsafe(text: Column) -> Column:
    """What an anonymised text still shows: array of reasons, empty where it is safe."""
    left = F.filter(detect(text), lambda d: d["kind"] != "password")
    return F.array_compact(F.array(F.when(F.size(left) > 0, "personal"), F.when(F.lower(text).contains("password"), "password"), F.when(F.lower(text).contains("secret"), "secret")))


def repair(raw: str | None) -> dict | list | None:
    """The JSON object in a model's answer: without fences and what stands around it, trailing commas dropped; else its facts, else null."""
    if not raw or not raw.strip():
        return None
    text = re.sub(r"\n?```\s*$", "", re.sub(r"^```(?:json|JSON)?\s*\n?", "", raw, flags=re.M), flags=re.M).strip()
    bare = lambda x: re.sub(r",\s*([}\]])", r"\1", x)
    start, depth = text.find("{"), 0
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            text = text[start:i + 1]
            break
    facts = re.search(r'"facts"\s*:\s*\[(.*?)\]', raw, re.S)
    for candidate in (text, raw[raw.find("{"):raw.rfind("}") + 1], f'{{"facts": [{facts[1]}]}}' if facts else ""):
        try:
            return json.loads(bare(candidate))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """``repair`` on a column, as JSON text."""
    return pd.Series([None if (x := repair(t)) is None else json.dumps(x) for t in texts], dtype=object)


def absolute_phrases(text: Column, anchor: Column) -> Column:
    """A text whose first relative phrase is made absolute: years, months and days by date, vague ones as `the week before` the anchor."""
    day = lambda d: F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM yyyy"))
    year, date = F.year(anchor), F.to_date(anchor)
    month = lambda n: F.date_format(F.add_months(F.trunc(date, "month"), n), "MMMM yyyy")
    ago = F.regexp_extract(text, jvm(r"(?i)\b(\d{1,4})\s+years?\s+ago\b"), 1)
    rules_ = [(r"last year", (year - 1).cast("string")), (r"next year", (year + 1).cast("string")), (r"next month", month(1)), (r"last month", month(-1)), (r"yesterday", day(F.date_sub(date, 1))), (r"tomorrow", day(F.date_add(date, 1))),
              (r"\d{1,4}\s+years?\s+ago", (year - F.when(ago != "", ago).cast("int")).cast("string")), (r"last weekend", F.concat(F.lit("the weekend before "), day(date))), (r"last week", F.concat(F.lit("the week before "), day(date))),
              (r"last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)", F.concat(F.lit("the "), F.regexp_extract(text, r"(?i)\blast (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 1), F.lit(" before "), day(date))),
              (r"this past week", F.concat(F.lit("the week before "), day(date))), (r"a few weeks ago", F.concat(F.lit("a few weeks before "), day(date))), (r"recently", F.concat(F.lit("before "), day(date)))]
    out = None
    for pattern, to in rules_:
        p = jvm(rf"(?i)\b{pattern}\b")
        hit = F.regexp_extract(text, rf"(?is)\A(.*?)\b(?:{pattern})\b(.*)\z", 1), F.regexp_extract(text, rf"(?is)\A.*?\b(?:{pattern})\b(.*)\z", 1)
        new = F.concat(hit[0], to, hit[1])
        out = F.when(text.rlike(p), new) if out is None else out.when(text.rlike(p), new)
    return out.otherwise(text)


def plan(query: str) -> dict:
    """How to retrieve for a query: its keywords, kind, capitalised entities (which narrow the subjects) and depth."""
    low = query.lower()
    kinds = (("temporal", r"\b(when|before|after|last|since|until|yesterday|ago)\b"), ("causal", r"\b(why|because|cause|led to|reason)\b"), ("preference", r"\b(prefer|like|favou?rite|love|hate)\b"), ("procedural", r"\b(how to|how do|steps|process)\b"))
    words = [w for w in re.sub(r"[^a-z0-9_\s]", " ", low).split() if len(w) > 2 and w not in STOP_WORDS]
    named = [w for w in re.findall(r"\b[A-Z][a-zA-Z]+\b", query) if w.lower() not in STOP_WORDS]
    kind = next((k for k, p in kinds if re.search(p, low)), "factual")
    return {"keywords": list(dict.fromkeys(words)), "kind": kind, "entities": named, "subjects": named, "depth": 3 if kind in ("causal", "temporal") else 1 if len(words) < 3 else 2}


def overlap_terms(one: Column, other: Column) -> Column:
    """Number of words of one text that are held by, or hold, a word of the other."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    y = words(other)
    return F.size(F.filter(words(one), lambda w: F.exists(y, lambda v: v.contains(w) | w.contains(v))))
