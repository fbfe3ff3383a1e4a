"""Rule tables over text and what turns them into columns: facts, causal links, procedures, intents, entities, times.

A table is a list of patterns in order; each is one expression over the text in the JVM. Patterns are written for both
engines that read them: without look-around, ``.`` stops at ``\\n`` only. Null texts match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must can to of in for
on with at by from as into through during before after above below between under again further then once here there when where why how
all each every both few more most other some such no nor not only own same so than too very just and but if or because until while this
that these those what which who whom i me my myself we our ours you your yours he him his she her hers it its they them their theirs""".split()
# What the speaker says of themself: pattern, group of the subject (0: user), predicate, group of the object.
FACTS = [
    (r"(?:my|the)\s+(\w+(?:\s+\w+)?)\s+is\s+([^,.!?]+)", 1, "is", 2),
    (r"\bi\s+am\s+(?:a\s+)?(\w+(?:\s+\w+)?)", 0, "is_a", 1),
    (r"\bi\s+work\s+(?:at|for)\s+([^,.!?]+)", 0, "works_at", 1),
    (r"\bi\s+live\s+in\s+([^,.!?]+)", 0, "lives_in", 1),
    (r"\bi\s+(?:really\s+|actually\s+)?(?:prefer|like|love)\s+([^,.!?]+)", 0, "prefers", 1),
    (r"\bi\s+(?:use|am using)\s+([^,.!?]+)", 0, "uses", 1),
    (r"my\s+name\s+is\s+(\w+(?:\s+\w+)?)", 0, "has_name", 1),
    (r"(?:i'm|i\s+am)\s+called\s+(\w+(?:\s+\w+)?)", 0, "has_name", 1),
    (r"(\w+(?:\s+\w+)?)\s+is\s+my\s+favorite", 0, "favorite", 1),
    (r"\bi\s+need\s+([^,.!?]+)", 0, "needs", 1),
    (r"\bi\s+want\s+([^,.!?]+)", 0, "wants", 1),
    (r"(?:the\s+)?project\s+(?:uses|is using)\s+([^,.!?]+)", 0, "uses", 1),
    (r"(?:we're|we\s+are)\s+building\s+([^,.!?]+)", 0, "is_building", 1),
    (r"\bi(?:'m|’m|\s+am)\s+(?:currently\s+)?working\s+on\s+(?:a\s+)?(?:project\s+)?(?:called\s+)?([^,.!?]+)", 0, "working_on", 1),
    (r"it(?:'s|’s|\s+is)\s+about\s+([^,.!?]+)", 0, "is_about", 1),
    (r"(?:started|been\s+working)\s+(?:on\s+(?:this|it)\s+)?(?:about\s+)?(\d+\s+(?:months?|weeks?|days?|years?))", 0, "project_duration", 1),
    (r"(?:my|i'm in|i am in)\s+(?:the\s+)?(\w+)\s+timezone", 0, "timezone", 1),
    (r"\bi\s+speak\s+(\w+)", 0, "speaks", 1),
]
# Tools that a text mentions: pattern (of the text as written or, the third, in lower case), further pattern, subject, predicate, object.
MENTIONS = [
    (r"```typescript|\.ts\b", None, "user", "uses", "typescript"), (r"```python|\.py\b", None, "user", "uses", "python"), (r"```javascript|\.js\b", None, "user", "uses", "javascript"),
    (r"(?i)\breact\b", None, "project", "uses", "react"), (r"(?i)\bnext\.?js\b", None, "project", "uses", "nextjs"), (r"(?i)\bvue\b", None, "project", "uses", "vue"),
    (r"(?i)\bpostgres(?:ql)?\b", None, "project", "uses", "postgresql"), (r"(?i)\bmongodb?\b", None, "project", "uses", "mongodb"), (r"(?i)\bsqlite\b", None, "project", "uses", "sqlite"),
    (r"(?i)\b(claude|opus|sonnet)\b", r"(?i)prefer|like|love|use|using", "user", "prefers", None), (r"(?i)\b(?:gpt-?4|chatgpt|openai)\b", r"(?i)prefer|like|love|use|using", "user", "uses", "openai"),
]
STRONG = ("has_name", "works_at", "lives_in", "timezone", "speaks")
# Cause and effect: pattern, group of the cause (0: what was said before), group of the effect, mechanism, bump of the confidence.
CAUSES = [
    (r"(.+?)\s+because\s+(.+?)(?:\.|\z)", 2, 1, "direct causation", 0.15),
    (r"due\s+to\s+(.+?),?\s+(.+?)(?:\.|\z)", 1, 2, "attributed cause", 0.0),
    (r"(.+?)\s+led\s+to\s+(.+?)(?:\.|\z)", 1, 2, "progressive causation", 0.15),
    (r"(.+?)\s+caused\s+(.+?)(?:\.|\z)", 1, 2, "direct causation", 0.2),
    (r"(.+?)\s+resulted\s+in\s+(.+?)(?:\.|\z)", 1, 2, "outcome relationship", 0.0),
    (r"as\s+a\s+result\s+of\s+(.+?),?\s+(.+?)(?:\.|\z)", 1, 2, "consequence", 0.0),
    (r"(.+?),?\s+so\s+(.+?)(?:\.|\z)", 1, 2, "logical consequence", 0.0),
    (r"(.+?),?\s+therefore\s+(.+?)(?:\.|\z)", 1, 2, "logical deduction", 0.0),
    (r"since\s+(.+?),?\s+(.+?)(?:\.|\z)", 1, 2, "temporal/causal connection", 0.0),
    (r"(.+?)\s+made\s+(?:me\s+)?(.+?)(?:\.|\z)", 1, 2, "forced outcome", 0.0),
    (r"after\s+(.+?),?\s+(.+?)(?:\.|\z)", 1, 2, "temporal sequence", 0.05),
    (r"(.+?)\s+triggered\s+(.+?)(?:\.|\z)", 1, 2, "trigger mechanism", 0.2),
    (r"(?:if|when)\s+(.+?),?\s+(?:then\s+)?(.+?)(?:\.|\z)", 1, 2, "conditional relationship", 0.05),
    (r"(.+?)\s+(?:enabled|allowed)\s+(.+?)(?:\.|\z)", 1, 2, "enabling condition", 0.15),
    (r"(.+?)\s+prevented\s+(.+?)(?:\.|\z)", 1, 2, "prevention mechanism", 0.0),
    (r"that'?s\s+why\s+(.+?)(?:\.|\z)", 0, 1, "explanation", 0.0),
    (r"(.+?)\s+is\s+why\s+(.+?)(?:\.|\z)", 1, 2, "explicit explanation", 0.0),
]
# How things are done: pattern, group of the trigger, group of the action, confidence.
PROCEDURES = [
    (r"when\s+(.+?),?\s+(?:i|you|we)\s+(?:usually\s+)?(.+?)(?:\.|\z)", 1, 2, 0.75),
    (r"if\s+(.+?),?\s+(?:then\s+)?(?:i|you|we)\s+(.+?)(?:\.|\z)", 1, 2, 0.7),
    (r"to\s+(.+?),?\s+(?:i|you|we)\s+(?:usually\s+)?(.+?)(?:\.|\z)", 1, 2, 0.7),
    (r"(?:i|you|we)\s+always\s+(.+?)\s+when\s+(.+?)(?:\.|\z)", 2, 1, 0.8),
    (r"the\s+(?:best\s+)?way\s+to\s+(.+?)\s+is\s+(?:to\s+)?(.+?)(?:\.|\z)", 1, 2, 0.75),
    (r"for\s+(.+?),?\s+(?:use|try|do)\s+(.+?)(?:\.|\z)", 1, 2, 0.7),
    (r"(?:i|we)\s+prefer\s+to\s+(.+?)\s+when\s+(.+?)(?:\.|\z)", 2, 1, 0.75),
    (r"whenever\s+(.+?),?\s+(?:i|you|we)\s+(.+?)(?:\.|\z)", 1, 2, 0.75),
    (r"(.+?)\s+works\s+(?:best|well)\s+when\s+(.+?)(?:\.|\z)", 2, 1, 0.7),
    (r"first\s+(.+?),?\s+then\s+(.+?)(?:\.|\z)", 1, 2, 0.65),
    (r"start\s+(?:by|with)\s+(.+?),?\s+then\s+(.+?)(?:\.|\z)", 1, 2, 0.7),
    (r"before\s+(.+?),?\s+(?:always|usually)\s+(.+?)(?:\.|\z)", 1, 2, 0.7),
]
# Procedures that a text implies: pattern, further pattern, trigger, action, confidence. Bounds belong to the first and last word alone.
IMPLIED = [
    (r"\bdebug|error|fix|issue\b", "verbose|log|console|print", "when debugging", "use verbose logging", 0.6),
    (r"\btest|spec|check\b", "before|first|initially", "before deploying changes", "run tests", 0.65),
    (r"\breview|pr|pull request|merge\b", "", "when submitting code", "create a pull request for review", 0.6),
    (r"\bgit|commit|push|branch\b", "message|describe|explain", "when committing changes", "write descriptive commit messages", 0.6),
]
# Tag and its pattern.
TAGS = [("debugging", "debug|error|fix|issue"), ("testing", "test|spec|assert"), ("deployment", "deploy|release|ship"), ("git", "commit|push|merge|pr|branch"),
        ("coding", "code|function|class|method"), ("review", "review|feedback|check"), ("documentation", "document|readme|comment"), ("build", "build|compile|package")]
# Pattern, intent, confidence; the most confident wins, of equals the first, and without any `question` at 0.3.
INTENTS = [
    (r"^(what|who|where|when|why|how|which|can you tell|do you know|did|does|is|are|was|were)\b", "question", 0.9), (r"\?\z", "question", 0.8), (r"^(explain|describe|tell me about)\b", "question", 0.85),
    (r"^(do|make|create|build|write|generate|run|execute|send|update|delete|remove|add|set|configure)\b", "command", 0.9), (r"^(please|could you|would you|can you)\s+(do|make|create|build|write|generate|run)", "command", 0.85),
    (r"^(i need you to|i want you to)\b", "command", 0.85), (r"\b(remember when|recall|that time|previously|earlier|before|last time|we discussed)\b", "reference", 0.85),
    (r"\b(you said|you told me|you mentioned|we talked about)\b", "reference", 0.9), (r"^(hi|hello|hey|good morning|good afternoon|good evening|thanks|thank you|bye|goodbye)\b", "social", 0.95),
    (r"^(how are you|what's up|sup)\b", "social", 0.9), (r"\b(imagine|pretend|write a story|create a poem|brainstorm|ideas for)\b", "creative", 0.85), (r"^(once upon a time|let's roleplay|act as)\b", "creative", 0.9),
]
# What an intent needs.
NEEDS = {"question": ("facts", "episodes"), "command": ("procedures", "facts"), "reference": ("episodes", "facts", "causal"), "creative": (), "social": ("facts",)}
SURE = {"question": 0.8, "command": 0.7, "reference": 0.85, "creative": 0.3, "social": 0.5}
# Entities: pattern and type, in order; words that are none.
ENTITIES = [(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", "person"), (r"\b([A-Z][a-zA-Z]+(?:\s+\d+)?(?:\.\d+)*)\b", "project"), (r"\b([A-Z][a-zA-Z]+(?:\s+(?:Inc|Corp|LLC|Ltd|Co|Group))?)\b", "organization"),
            (r"(?i)\b(API|CLI|SDK|UI|UX|ML|AI|LLM|GPU|CPU|RAM|SSD|HDD)\b", "thing"), (r'"([^"]+)"', "unknown"), (r"'([^']+)'", "unknown")]
NO_ENTITIES = """I You We They He She It The A An This That What Where When Why How Which Who Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December Today Yesterday Tomorrow Please Thanks Hello Hi Yes No Maybe Sure Okay Good
Great Nice Cool""".split()
# Patterns of personal data in the order in which they are masked.
PERSONAL = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"), ("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"), ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("api_key", r"\b(?:sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|ghp_[A-Za-z0-9]{36})\b"), ("password", r"(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+"),
]
# Kinds of profile facts by predicate.
KINDS = {"preference": "prefers likes dislikes hates loves favors avoids values enjoys".split(), "trait": "is_a has_name works_at lives_in from speaks nationality role occupation age".split(),
         "plan": "will plans_to intends_to wants_to going_to scheduled deadline".split(), "state": "working_on planning considering trying testing buying waiting_for debugging building".split()}



def jvm(pattern: str) -> str:
    """A pattern whose word bounds are those of ASCII words, as its ``\\w`` is; the JVM's own count letters of all alphabets."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def keywords(text: Column, kept: str = r"[^a-zA-Z0-9_\s]", longer: int = 2) -> Column:
    """Distinct words in order of appearance, longer than ``longer`` and no stop words."""
    words = F.split(F.regexp_replace(F.lower(text), kept, " "), r"\s+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer) & ~F.array_contains(stop, w)))


def keywords_plain(text: Column) -> Column:
    """``keywords`` of letters and digits alone, as episodes have them: an underscore separates."""
    return keywords(text, r"[^a-z0-9\s]")


def topic(text: Column) -> Column:
    """The first three keywords."""
    top = F.slice(keywords_plain(text), 1, 3)
    return F.when(F.size(top) > 0, F.array_join(top, ", ")).otherwise("General discussion")


def groups(text: Column, rules: list[tuple[str, int, int]], flags: str = "(?id)") -> Column:
    """array<struct<rule, at, a, b>>: what two groups of each pattern caught; group 0 gives the empty text."""
    found = []
    for i, (pattern, a, b) in enumerate(rules):
        caught = lambda g: F.regexp_extract_all(text, F.lit(jvm(flags + pattern)), F.lit(g))
        one = caught(b)
        both = F.arrays_zip((caught(a) if a else F.transform(one, lambda x: F.lit(""))).alias("a"), one.alias("b"))
        found.append(F.transform(both, lambda x, k: F.struct(F.lit(i).alias("rule"), k.alias("at"), x["a"].alias("a"), x["b"].alias("b"))))
    return F.coalesce(F.flatten(F.array(*found)), F.array().cast("array<struct<rule:int,at:int,a:string,b:string>>"))


def pick(values: list, index: Column) -> Column:
    """The value of a rule's number."""
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def clean_fact(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)\A(a|an|the)\s+", ""), "['\"]", ""), r"\s+", " "))


def clean_clause(c: Column, pronouns: str = "i|we|they|he|she|it") -> Column:
    """A clause without the pronoun before it and quotes; whole, however long."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), rf"(?i)\A({pronouns})\s+", ""), "['\"]", ""), r"\s+", " ")


def mentions(text: Column) -> Column:
    """array<struct<s, p, o>> of the tools that a text mentions."""
    out = []
    for first, second, s, p, o in MENTIONS:
        hit = text.rlike(jvm(first)) if second is None else text.rlike(jvm(first)) & text.rlike(jvm(second))
        out.append(F.when(hit, F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), (F.lit(o) if o else F.lower(F.regexp_extract(text, jvm(first), 1))).alias("o"))))
    return F.array_compact(F.array(*out))


def implied_procedures(text: Column) -> Column:
    """array<struct<a, b, c>>: trigger, action and confidence of what a text implies."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(jvm(a)) & low.rlike(jvm(b)), F.struct(F.lit(t).alias("a"), F.lit(d).alias("b"), F.lit(c).alias("c"))) for a, b, t, d, c in IMPLIED]))


def tags(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(jvm(p)), F.lit(n)) for n, p in TAGS]))


def intent(text: Column) -> Column:
    """struct<confidence, intent> of a message."""
    hits = [F.when(text.rlike(jvm("(?i)" + p)), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("_i"), F.lit(k).alias("intent"))) for i, (p, k, c) in enumerate(INTENTS)]
    none = F.struct(F.lit(0.3).alias("confidence"), F.lit(-99).alias("_i"), F.lit("question").alias("intent"))
    best = F.greatest(*hits, none)
    return F.struct(best["confidence"].alias("confidence"), best["intent"].alias("intent"))


def entities(text: Column) -> Column:
    """array<struct<value, type, confidence>>: distinct by letter case, the first of the patterns' order."""
    none = F.array(*map(F.lit, NO_ENTITIES))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(jvm(p)), F.lit(1)), lambda v: F.struct(strip(v).alias("value"), F.lit(t).alias("type"))) for p, t in ENTITIES]))
    kept = F.filter(found, lambda e: F.length(e["value"]).between(2, 50) & ~F.array_contains(none, e["value"]))
    firsts = F.filter(kept, lambda e, i: F.array_position(F.transform(kept, lambda x: F.lower(x["value"])), F.lower(e["value"])) == i + 1)
    low = F.lower(text)

    def sure(e: Column) -> Column:
        v = e["value"]
        quoted = text.contains(F.concat(F.lit('"'), v, F.lit('"'))) | text.contains(F.concat(F.lit("'"), v, F.lit("'")))
        said = (F.length(low) - F.length(F.replace(low, F.lower(v), F.lit("")))) / F.length(v)
        parts = [F.lit(0.5), F.when(quoted, 0.3).otherwise(0.0), F.when(v.contains(" "), 0.1).otherwise(0.0), F.when((e["type"] == "thing") & v.rlike(jvm(r"\A[A-Z]{2,}\z")), 0.2).otherwise(0.0),
                 F.when(said > 1, F.least(said - 1, F.lit(3.0)) * 0.1).otherwise(0.0)]
        return F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)), 6)

    return F.transform(firsts, lambda e: F.struct(e["value"].alias("value"), e["type"].alias("type"), sure(e).alias("confidence")))


def time_range(text: Column, now: Column) -> Column:
    """struct<reference, start, end> of the first kind of time that a text names, relative to ``now``; null for none."""
    day, end_of = F.date_trunc("day", now), F.expr("interval 86399999 milliseconds")
    ago = F.regexp_extract(text, jvm(r"(?i)\b(\d{1,4})\s+days?\s+ago\b"), 1)
    date = F.try_to_timestamp(F.when(text.rlike(jvm(r"\b\d{4}-\d{2}-\d{2}\b")), F.regexp_extract(text, jvm(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)), F.lit("yyyy-MM-dd"))
    span = lambda pattern, start, end: F.when(text.rlike(jvm("(?i)" + pattern)), F.struct(F.lower(F.regexp_extract(text, jvm(f"(?i)({pattern})"), 1)).alias("reference"), start.alias("start"), end.alias("end")))
    week = now - F.expr("interval 7 days")
    yesterday = day - F.expr("interval 1 day")
    return F.coalesce(
        span(r"\byesterday\b", yesterday, yesterday + end_of), span(r"\blast\s+week\b", week, now), span(r"\blast\s+month\b", now - F.expr("interval 1 month"), now),
        span(r"\b\d{1,4}\s+days?\s+ago\b", F.timestamp_micros(F.unix_micros(now) - F.when(ago != "", ago).cast("bigint") * 86_400_000_000), now),
        span(r"\bthis\s+morning\b", day, day + F.expr("interval 12 hours")), span(r"\bearlier\s+today\b", day, now), span(r"\brecently\b", week, now),
        F.when(date.isNotNull(), span(r"\b\d{4}-\d{2}-\d{2}\b", date, date + end_of)))


def expiry(text: Column, now: Column) -> Column:
    """When what a text plans is over: the end of a day, or a week, month or year from now; null where it names none."""
    low, end = F.lower(text), F.date_trunc("day", now) + F.expr("interval 86399 seconds")
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return (F.when(has("today"), end).when(has("tomorrow"), end + F.expr("interval 1 day")).when(has("this week", "next week"), now + F.expr("interval 7 days"))
            .when(has("this month", "next month"), now + F.expr("interval 1 month")).when(has("this year", "next year"), now + F.expr("interval 1 year")))


def profile_kind(predicate: Column, value: Column) -> Column:
    """preference, trait, plan or state of a fact."""
    known = F.coalesce(*[F.when(F.lower(predicate).isin(*KINDS[kind]), kind) for kind in ("preference", "trait", "plan", "state")])
    return F.when(known.isNotNull(), known).when(value.rlike(jvm(r"(?i)\b(week|month|day|tomorrow|soon|later|next)\b")), "plan").otherwise("trait")


def question_flags(text: Column) -> dict[str, Column]:
    """Whether a question asks for an inference, a duration, a count, a yes or no."""
    low = F.lower(text)
    duration = low.rlike(jvm(r"\bhow (long|many years|many months)\b"))
    return {"is_inference": low.rlike(jvm(r"\b(likely|would|might|could|suspected|possible|probably|suggest)\b")), "is_duration": duration, "is_count": low.rlike(jvm(r"\bhow many\b")) & ~duration,
            "is_yes_no": low.rlike(jvm(r"^(is |are |does |do |did |has |have |was |were |will |would |can |could |should )"))}


def density(text: Column) -> Column:
    """How much a text says: keywords and capitalised words among its words, numbers, dates, specific terms."""
    n = F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 2)), F.lit(1))
    hit = lambda p: F.when(text.rlike(jvm(p)), 0.1).otherwise(0.0)
    parts = [F.size(keywords_plain(text)) / n * 0.4, F.regexp_count(text, F.lit(jvm(r"\b[A-Z][a-z]+\b"))) / n * 0.3, hit(r"\d+"), hit(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2}"), hit("(?i)(?:project|company|location|technology|tool|method|approach)")]
    return F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)), 6)


def salience(text: Column) -> Column:
    low = F.lower(text)
    hit = lambda c, w: F.when(c, w).otherwise(0.0)
    parts = [F.lit(0.3), hit(low.contains("!"), 0.1), hit(F.regexp_count(low, F.lit("!+")) > 2, 0.1), hit(low.rlike(jvm(r"\b(amazing|awesome|fantastic|incredible|love|great|excellent)\b")), 0.1),
             hit(low.rlike(jvm(r"\b(important|critical|urgent|must|need|essential|crucial)\b")), 0.15), hit(low.rlike(jvm(r"\b(remember|don't forget|note|save|keep)\b")), 0.1), F.least(F.regexp_count(low, F.lit(r"\?")) * 0.05, F.lit(0.15))]
    return F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)), 6)


def utility(text: Column) -> Column:
    low = F.lower(text)
    hit = lambda p, w: F.when(low.rlike(jvm(p)), w).otherwise(0.0)
    parts = [F.lit(0.4), hit(r"\b(solved|fixed|working|works|done|completed|success)\b", 0.2), hit(r"\b(thank|thanks|perfect|exactly)\b", 0.15), hit(r"\b(learned|understand|got it|makes sense|i see)\b", 0.1),
             hit("```|function|class|import|export|const|let|var", 0.1)]
    return F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)), 6)


def mask(kind: str, m: Column) -> Column:
    """What stands for a found item of personal data."""
    last = lambda n: F.right(m, F.lit(n))
    return {"email": F.concat(F.left(m, F.lit(1)), F.lit("***@"), F.element_at(F.split(m, "@"), 2)), "phone": F.concat(F.left(m, F.lit(3)), F.lit("***"), last(2)), "ssn": F.lit("***-**-****"),
            "credit_card": F.concat(F.lit("****-****-****-"), last(4)), "ip_address": F.lit("***.***.***.***"), "api_key": F.concat(F.left(m, F.lit(6)), F.lit("***REDACTED***")), "password": F.lit("password: ***REDACTED***")}[kind]


def personal_counts(text: Column) -> Column:
    """map of kind -> number of items in the text as it is."""
    return F.create_map(*[x for k, p in PERSONAL for x in (F.lit(k), F.regexp_count(text, F.lit(jvm(p))))])


def personal_masked(text: Column) -> Column:
    """The text with every item masked, kind by kind; items are found in the text as it is."""
    out = text
    for kind, pattern in PERSONAL:
        out = F.aggregate(F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(0)), out, lambda acc, m: F.replace(acc, m, mask(kind, m)))
    return out
