"""Personal data inside free text: typed placeholders with format-preserving Feistel pseudonyms.

Kinds: email, phone, id_number, street_address, person_name. An item becomes ``[KIND:pseudonym]``. Digits and letters of
phones and id numbers are keyed-permuted within their format by a Feistel network: a phone keeps its country code and
its number is permuted without trunk zeros and signs, so that all spellings of it stay linked over documents; an id
number that its check digits validate (CPF, DNI and NIE, T.C., NIR, IBAN, Luhn) stays valid. Other kinds get a keyed
tag of 16 bytes. ``dates=True`` permutes dates as well, within their format and century. All other text is kept. Null
stays null; empty texts and texts without items are unchanged; of overlapping items the earlier kind in the list of
finders wins. Names are known by a given name or by what stands before them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given names of the six languages, without accents.
GIVEN = frozenset("""
adam alan albert alejandro alice ana andre andrea andreas anna anne annika antoine antonio anton arthur ayse baptiste
beatriz benjamin bernd birgit bruno burak camille carlos carmen carolina caroline catarina catherine caglar charles
charlotte chloe christina claire cem daniel david diego diogo dirk duarte edward elena elif elisabeth
elizabeth elodie emily emma emre eric etienne eva fatma felix fernando florian francisco francois franziska gabriel
george gerhard goncalo grace greta guillaume gulsen hakan hannah hans hatice heike helena helene henry hugo huseyin ignacio
ines inigo irene isabel jack jacques james jan jana javier jean jens joao joana john jonas jorge jose joseph juan jules
julia julie julien jurgen karin katharina katrin kemal kevin klaus laura lena leon lucas lucia lucie ludwig luis luisa lukas
manuel margaux maria mariana marie markus marta martin mary mathieu matthew matthias mehmet merve michael miguel
monika murat mustafa nicolas nina nuno olivier oscar pablo patricia paul paula paulo pedro peter petra pierre pilar rachel
rafael raul ricardo richard robert rui sabine sarah selin sergio simon sofia sophie stefan stephen susan sven teresa
thomas tiago tom ursula uwe victor werner william wolfgang yusuf zeynep alvaro
""".split())
# Words that follow or end like a name but are none.
NOT_FAMILY = frozenset("""called asked said says told has had is was will would can could and or und oder et ou e y ve ile the a me m te
hat ist war wird will am ligou disse es era fue est a dun beni now about in im an to from with who wants likes sagte rief ist also
bitte please not he she it we they bu o da de del la le der die das""".split())
PLACES = frozenset("bakery museum street st road rd lane ave avenue blvd team club gmbh ltd inc school hospital hotel festival park square str strasse platz foundation university airport".split())
STOP_STREET = frozenset("first late too many open before after more longer than the to of when a an on in at and or hours minutes days questions for from is was were we i it".split())

SAME_LENGTH = {c: " " for c in map(ord, "\u00a0\u2009\u202f\u200b\t")} | {ord(c): "-" for c in "–—‑−"} | {ord(c): "'" for c in "’ʼ"}
W = r"[^\W\d_][\w'.\-]*"
#: The sign between the parts of an address; what stands on its sides is read from there, so a text is scanned once.
AT = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?|(?<=[\w+\-]) at (?=[\w\-]+(?: (?:dot|\(dot\)|\[dot\]) [\w\-]+)+)", re.I)
LOCAL = re.compile(r"[\w.+\-]")
DOMAIN = re.compile(r"[\w\-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w\-]+)*?(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z]{2,})+(?![\w@])|[\w\-]+(?: (?:dot|\(dot\)|\[dot\]) [\w\-]+)+", re.I)
KEYS = (
    r"social security(?: number| no\.?)?|ssn|ni number|national insurance(?: number| no\.?)?|passport|driv(?:er|ing)(?:'?s)? licen[cs]e|residence permit|tax id|"
    r"num[ée]ro fiscal|n[°ºo]\.? ?de s[ée]cu(?:rit[ée] sociale)?|s[ée]curit[ée] sociale|passeport|permis de conduire|titre de s[ée]jour|carte d'identit[ée]|"
    r"ausweis(?:nummer|nr\.?)?|personalausweis(?:nummer)?|steuer-?id(?:nr\.?)?|steuernummer|reisepass(?:nummer)?|(?:sozial|renten)versicherungsnummer|f[üu]hrerschein(?:nummer)?|aufenthaltstitel|"
    r"dni|nie|nif|pasaporte|seguridad social|permiso de (?:conducir|residencia)|cpf|rg|cnh|cart[ãa]o de cidad[ãa]o|passaporte|niss|carta de condu[çc][ãa]o|"
    r"t\.? ?c\.?(?: kimlik)?|kimlik|vergi(?: kimlik)?|pasaport|ehliyet|ikamet izni")
VALUE = r"(?P<v>[A-Za-z]{0,3}[\- ]?\d(?:[ .\-/]{0,2}\d|[\-.]?[A-Za-z](?![a-z]{2})){4,20})"
ID_KEYED = re.compile(rf"(?<![\w])(?i:{KEYS})(?i:\s*(?:n[o°º]\.?|nr\.?|numaras[ıi]|number|nummer|:|#|=)){{0,2}}\s*[:=]?\s{{0,3}}{VALUE}")
ID_BARE = re.compile(
    r"(?<![\w.\-/+])(?P<v>\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dXx]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]|"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2})(?![\w\-])")
STREETS = [re.compile(p, re.I) for p in (
    rf"(?:(?:apt|flat|unit|suite)\.?\s*\w+,\s*)?(?<![\w\-.])\d{{1,5}}\s?[a-z]?\s+(?P<mid>(?:{W}\s+){{1,3}})(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|drive|court|square|sq|terrace|close|gardens|gdns|grove|crescent|cres|place|mews|row|parade|hill|quay|parkway|pkwy|highway|hwy)\b\.?(?:,?\s+(?:apt|flat|unit|suite)\.?\s*\w+)?",
    r"(?:\b(?:am|an der|auf der|im)\s+)?\b[^\W\d_][\w\-]{1,}[ \-]?(?:stra(?:ß|ss)e|str\.|str|gasse|platz|weg|allee|ring|ufer|damm|steig|chaussee)\s+\d{1,4}\s?[a-z]?\b(?:,\s*\d{5}\s+\w+)?",
    rf"(?<![\w\-.])\d{{1,4}}\s*(?:bis|ter|quater)?,?\s*(?:rue|avenue|av\.|boulevard|bd\.?|bld\.?|place|pl\.|chemin|ch\.|quai|impasse|imp\.|all[ée]e|cours|route|rte\.?|square|passage|faubourg|sentier)\s+(?:de la |de l'|des |du |de |d')?{W}",
    rf"\b(?:calle|c/|c\.|plaza|pza\.|plza\.|avda\.?|avenida|av\.|paseo|camino|ronda|carretera|ctra\.|glorieta|travesía)\s*(?:de (?:la |los |las )?|del )?{W}(?:\s+{W})?,?\s+(?:n\.?[ºo°]\s*)?\d{{1,4}}\b(?:,\s*\d+[ºª°]\s*\w?)?",
    rf"\b(?:rua|r\.|av\.|avenida|travessa|tv\.|trav\.|pra[çc]a|largo|estrada|estr\.|alameda|al\.|beco|rodovia)\s+(?:d[aeo]s?\s+)?{W}(?:\s+{W})?,?\s+(?:n\.?[ºo°]\s*)?\d{{1,4}}\b",
    rf"{W}\s+(?:(?:mah(?:\.|allesi)|mh\.)\s+{W}\s+)?(?:sokak|soka[ğg][ıi]|sok\.|sk\.|cad\.|cd\.|caddesi|bulvar[ıi]|blv\.)\s*(?:no\s*:?\s*)?\d{{1,4}}(?:/\d+)?",
)]
#: What a text must contain for the street patterns that start with any word.
GERMAN = re.compile(r"(?:stra(?:ß|ss)e|str\.?|gasse|platz|weg|allee|ring|ufer|damm|steig|chaussee)\s+\d", re.I)
TURKISH = re.compile(r"(?:sokak|soka[ğg][ıi]|sok\.|sk\.|cad\.|cd\.|caddesi|bulvar[ıi]|blv\.)\s*(?:no\s*:?\s*)?\d", re.I)
GATES = (None, GERMAN, None, None, None, TURKISH)
#: Five digits close together, as every phone and id number has.
DIGITS = re.compile(r"\d(?:[^\d\n]{0,4}\d){4}")
PHONE = re.compile(
    r"(?<![\w.\-/+])(?:\+\d{1,3}[ \-.]{0,2}(?:\(\d{1,4}\)[ \-.]{0,2})?\d(?:[ \-./]{0,2}\d){5,12}"
    r"|00\d{2}[ \-.]{0,2}(?:\(\d{1,4}\)[ \-.]{0,2})?\d(?:[ \-./]{0,2}\d){5,12}"
    r"|(?:\d[ \-]{0,2})?\(\d{2,5}\)[ \-.]{0,2}\d(?:[ \-./]{0,2}\d){5,9}"
    r"|(?:1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}"
    r"|0\d{1,4}[ /.\-]{0,2}\d(?:[ \-./]{0,2}\d){5,9}"
    r"|[679]\d{2}[ \-]{0,2}\d{3}[ \-]{0,2}\d{3})(?:\s*(?:ext\.?|x)\s*\d{1,5})?(?![\w\-/]|[.,]\d)")
#: Words after which a name stands, and its shape: capitalised words, of which hyphens and apostrophes are part.
CUE = re.compile(r"\b(?:[Mm]y (?:full )?name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Mm]e chamo|[Oo] meu nome é|[Bb]enim adım|[Aa]dım|Mrs?\.?|Ms\.?|Dr\.|Prof\.|Herrn?|Frau|Mme|Monsieur|Madame|Señora?|Sra?\.|Senhora?|Dona|[Ss]igned(?: by)?|[Ss]incerely,|[Bb]est regards,|[Cc]ontact(?: person)?:|[Pp]atient:|[Nn]ame:)\s{1,3}")
SHAPE = re.compile(r"[A-ZÀ-ÖØ-ÞĞİŞ][a-zà-öø-ÿğışœ]+(?:[\-'][A-ZÀ-ÖØ-ÞĞİŞ]?[a-zà-öø-ÿğışœ]+)*(?: [A-ZÀ-ÖØ-ÞĞİŞ][a-zà-öø-ÿğışœ]+(?:[\-'][A-ZÀ-ÖØ-ÞĞİŞ]?[a-zà-öø-ÿğışœ]+)*){1,2}(?![\w@])")
DIGIT = re.compile(r"\d")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}")
WORD = re.compile(r"[^\W\d_][\w\u0300-\u036f]*")
FAMILY = re.compile(r"\s{1,3}((?:[^\W\d_]\.\s{1,3})?)([^\W\d_][\w\u0300-\u036f'\-]+)")
LAST_FIRST = re.compile(r"([^\W\d_][\w'\-]{2,}),\s{1,3}\Z")
_FOLDED: dict[str, str] = {}
_IS_GIVEN: dict[str, bool] = {}


def fold(word: str) -> str:
    """Lower case without accents."""
    if word not in _FOLDED:
        if len(_FOLDED) > 200_000:
            _FOLDED.clear()
        plain = unicodedata.normalize("NFD", word.lower().replace("ı", "i"))
        _FOLDED[word] = "".join(c for c in plain if not unicodedata.combining(c))
    return _FOLDED[word]


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: outwards from each sign between their parts."""
    out, done = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        rest = DOMAIN.match(text, m.end()) if start < m.start() else None
        if rest:
            out.append((start, rest.end()))
            done = rest.end()
    return out


def has_given(text: str) -> bool:
    """Whether any word is a given name."""
    for w in WORD.findall(text):
        known = _IS_GIVEN.get(w)
        if known is None:
            if len(_IS_GIVEN) > 200_000:
                _IS_GIVEN.clear()
            known = _IS_GIVEN[w] = fold(w) in GIVEN
        if known:
            return True
    return False


def names(text: str) -> list[tuple[int, int]]:
    """Spans of given and family name together."""
    out, done = [], 0
    for m in WORD.finditer(text):
        if m.start() < done or fold(m[0]) not in GIVEN or text[max(0, m.start() - 1):m.start()] in {".", "-", "+", "@", "'", "_"} and m.start():
            continue
        before = LAST_FIRST.search(text, max(0, m.start() - 40), m.start()) if m.start() else None
        if before and before[1].isupper() and fold(before[1]) not in GIVEN:
            out.append((before.start(), m.end()))
            done = m.end()
            continue
        end, family = m.end(), None
        while step := FAMILY.match(text, end):
            if step[1] == "" and fold(step[2]) in GIVEN:
                end, family = step.end(), family or None
                continue
            family = step
            break
        if family is None:  # given names up to here, so none after this one has a family name either
            done = end
            continue
        word, after = family[2].strip("'"), WORD.search(text, family.end(), family.end() + 30)
        if len(word) < 3 or fold(word) in NOT_FAMILY or fold(word) in PLACES or (after and after.start() - family.end() <= 2 and fold(after[0]) in PLACES and text[family.end()] == " "):
            continue
        out.append((m.start(), family.end()))
        done = family.end()
    return out


def introduced(text: str) -> list[tuple[int, int]]:
    """Spans of names of any origin that a cue introduces: two or three capitalised words, none of a place or firm."""
    out = []
    for m in CUE.finditer(text):
        name = SHAPE.match(text, m.end())
        if name and not any(fold(w) in PLACES or fold(w) in NOT_FAMILY for w in WORD.findall(name[0])):
            after = WORD.search(text, name.end(), name.end() + 30)
            if not (after and after.start() - name.end() == 1 and fold(after[0]) in PLACES):
                out.append((name.start(), name.end()))
    return out


def find(raw: str) -> list[tuple[int, int, str]]:
    """Items of a text as (start, end, kind), in order and without overlap."""
    text = raw.translate(SAME_LENGTH)
    found: list[tuple[int, int, str]] = []  # in order, so a neighbour on each side decides

    def add(start: int, end: int, kind: str) -> None:
        i = bisect(found, (start, end, kind))
        if (not i or found[i - 1][1] <= start) and (i == len(found) or found[i][0] >= end):
            found.insert(i, (start, end, kind))

    low = text.lower()
    if "@" in text or "(at)" in low or "[at]" in low or " dot " in low:
        for start, end in emails(text):
            add(start, end, "email")
    numbers = DIGITS.search(text)
    if numbers:
        for pattern in (ID_KEYED, ID_BARE):
            for m in pattern.finditer(text):
                if sum(c.isdigit() for c in m["v"]) >= 5:
                    add(m.start("v"), m.end("v"), "id_number")
    if numbers or DIGIT.search(text):
        for gate, pattern in zip(GATES, STREETS):
            if gate is None or gate.search(text):
                for m in pattern.finditer(text):
                    if not (m.groupdict().get("mid") and STOP_STREET & set(m["mid"].lower().split())):
                        add(m.start(), m.end(), "street_address")
    if numbers:
        for m in PHONE.finditer(text):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 20 and not DATE.match(m[0]):
                add(m.start(), m.end(), "phone")
    for start, end in names(text) if has_given(text) else ():
        add(start, end, "person_name")
    for start, end in introduced(text):
        add(start, end, "person_name")
    return found


def feistel(symbols: list[int], radix: int, key: bytes, rounds: int = 8) -> list[int]:
    """A keyed permutation of sequences of one length over ``radix`` symbols (alternating Feistel halves)."""
    half = len(symbols) // 2
    a, b = symbols[:half], symbols[half:]
    for i in range(rounds):
        seed = hashlib.blake2b(bytes([i, radix, len(symbols)]) + bytes(b), key=key, digest_size=32).digest()
        shift = int.from_bytes(seed, "big")
        value = (int("".join(map(chr, (48 + x for x in a))) or "0") if radix == 10 else sum(x * radix ** j for j, x in enumerate(reversed(a)))) + shift
        value %= radix ** len(a)
        c = []
        for _ in a:
            c.append(value % radix)
            value //= radix
        a, b = b, c[::-1]
    return a + b


# Country codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: check letters of DNI and NIE by remainder


def _mod11(digits: list[int], weights: range) -> int:
    rest = sum(d * w for d, w in zip(digits, weights)) * 10 % 11
    return rest % 10


def _luhn(digits: list[int]) -> int:
    return -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def checked(text: str) -> tuple[int, str] | None:
    """(number of payload signs, scheme) of an id number, in upper case without signs, that its check digits validate."""
    d = [int(c) for c in text if c.isdigit()]
    if text.isdigit() and len(set(text)) > 1:
        for scheme, size in (("cpf", 9), ("tc", 9), ("nir", 13), ("luhn", len(text) - 1)):
            if (scheme != "luhn" or len(text) in (14, 15, 16)) and len(text) > size and text[size:] == completed(scheme, text[:size]):
                return size, scheme
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", text) and len(text) == 9 and len(d) in (7, 8) and text[8] == completed("dni", text[:8]):
        return 8, "dni"
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", text) and text[2:4] == completed("iban", text[:2] + text[4:]):
        return len(text) - 2, "iban"
    return None


def completed(scheme: str, payload: str) -> str | None:
    """The check signs of a payload; null where the payload is none of the scheme."""
    if scheme == "iban":
        turned = "".join(str(int(c, 36)) for c in payload[2:] + payload[:2] + "00")
        return f"{98 - int(turned) % 97:02d}"
    if scheme == "dni":
        return LETTERS[int(payload.translate(str.maketrans("XYZ", "012"))) % 23]
    d = [int(c) for c in payload]
    if scheme == "cpf":
        first = _mod11(d, range(10, 1, -1))
        return f"{first}{_mod11([*d, first], range(11, 1, -1))}"
    if scheme == "tc":
        if not d[0]:
            return None
        tenth = (7 * sum(d[0::2]) - sum(d[1::2])) % 10
        return f"{tenth}{(sum(d) + tenth) % 10}"
    if scheme == "nir":
        return f"{97 - int(payload) % 97:02d}"
    return str(_luhn(d))


def refill(item: str, signs: str) -> str:
    """The signs in the format of an item: its digits and letters in turn, the case as there."""
    left = iter(signs)
    return "".join((x.upper() if c.isupper() else x.lower()) if c.isalnum() and (x := next(left, None)) else c for c in item)


def permuted(item: str, key: bytes) -> str:
    """Digits and letters of an id number permuted, each within their kind; check signs follow."""
    bare = "".join(c for c in item if c.isascii() and c.isalnum())
    got = checked(bare.upper())
    body = bare if got is None else bare.upper()[:got[0]] if got[1] != "iban" else bare.upper()[:2] + bare.upper()[4:]
    fixed = {"iban": 2, "dni": 1 if not body[:1].isdigit() else 0}.get(got[1], 0) if got else 0
    for _ in range(100):  # walks on where a permuted payload is none of its scheme
        digits, letters = ([int(c) for c in body[fixed:] if c.isdigit()], [ord(c.lower()) - 97 for c in body[fixed:] if c.isalpha()])
        d, x = iter(feistel(digits, 10, key)), iter(feistel(letters, 26, key))
        body = body[:fixed] + "".join(str(next(d)) if c.isdigit() else chr(97 + next(x)) for c in body[fixed:])
        end = completed(got[1], body.upper()) if got else ""
        if end is not None:
            break
    signs = body if not got else body[:2] + end + body[2:] if got[1] == "iban" else body + (end or "")
    return refill(item, signs)


def permuted_phone(item: str, key: bytes) -> str:
    """A phone number with its country code kept and the rest permuted as digits without trunk zeros: `+49 30`, `0049 30`
    and `030` before the same number stay linked."""
    digits = "".join(c for c in item if c.isdigit())
    head = 0
    if item.lstrip().startswith("+") or digits.startswith("00"):
        head = 2 if digits.startswith("00") and not item.lstrip().startswith("+") else 0
        head += next((n for n in (1, 2) if digits[head:head + n] in SHORT_CODES), 3)
    while head < len(digits) - 4 and digits[head] == "0":
        head += 1
    rest = "".join(map(str, feistel([int(c) for c in digits[head:]], 10, key)))
    return refill(item, digits[:head] + rest)


def permuted_date(item: str, key: bytes) -> str | None:
    """A date in its format, permuted among the days of its century; null where it is none that exists."""
    parts = [int(x) for x in re.findall(r"\d+", item)]
    year_first = len(item) > 4 and item[:4].isdigit()
    y, m, d = parts if year_first else parts[::-1]
    try:
        at = date(y, m, d)
    except ValueError:
        return None
    low, high = date(y // 100 * 100 or 1, 1, 1), date(y // 100 * 100 + 99, 12, 31)
    n, size = at.toordinal() - low.toordinal(), high.toordinal() - low.toordinal() + 1
    while True:  # cycle walking: the permutation of five digits until it falls among the days
        n = int("".join(map(str, feistel([int(c) for c in f"{n:05d}"], 10, key))))
        if n < size:
            break
    to = date.fromordinal(low.toordinal() + n)
    signs = f"{to.year:04d}{to.month:02d}{to.day:02d}" if year_first else f"{to.day:02d}{to.month:02d}{to.year:04d}"
    return refill(item, signs)


def pseudonym(item: str, kind: str, key: bytes) -> str:
    """Stands for an item: of the same format for numbers, a keyed tag for others."""
    if kind == "phone":
        return permuted_phone(item, key)
    if kind == "id_number":
        return permuted(item, key)
    return hashlib.blake2b(fold(" ".join(item.split())).encode(), key=key, digest_size=16).hexdigest()


def redact(raw: str, key: bytes, dates: bool = False) -> tuple[str, list[str]]:
    """The text with placeholders, and its kinds."""
    out, at, kinds = [], 0, set()
    found = find(raw)
    if dates:
        taken = [m.span() for m in DATE.finditer(raw) if all(m.end() <= a or m.start() >= b for a, b, _ in found)]
        found = sorted(found + [(a, b, "date") for a, b in taken])
    for start, end, kind in found:
        if kind == "date":
            out += [raw[at:start], permuted_date(raw[start:end], key) or raw[start:end]]
        else:
            out += [raw[at:start], f"[{kind.upper()}:{pseudonym(raw[start:end], kind, key)}]"]
            kinds.add(kind)
        at = end
    return "".join(out) + raw[at:], sorted(kinds)


def redacted(df: DataFrame, key: str, text: str = "text", dates: bool = False) -> DataFrame:
    """Adds ``r``: struct of the redacted text and the kinds found. Whoever has the key can link and invert numbers."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf("redacted string, kinds array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        pairs = [(None, []) if t is None else redact(t, secret, dates) for t in texts]
        return pd.DataFrame({"redacted": [a for a, _ in pairs], "kinds": [b for _, b in pairs]})

    # Not deterministic, so that no filter on it is copied below another operator and scans again.
    return df.withColumn("r", run.asNondeterministic()(F.col(text)))
