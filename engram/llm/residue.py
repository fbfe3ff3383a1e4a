"""Template residue and error-page text: labelled exemplars, an inverted index, TF-IDF containment by window.

A document is cut into windows (lines and sentences) outside code and quotations. Tokens are words and marks: a mark
is a stretch between signs, known by its signs and the kind of what they enclose (``{{name}}`` and ``{{city}}`` are
one), or the name of a missing value. Exemplars, slots among them, are tokenised alike. Each window retrieves by its
tokens the exemplars it may contain and takes the labels of those whose weight it holds to the label's threshold
(filler passages: of which it is made to that share). A window with a contained slot that no ``talk`` exemplar
explains excludes its document; error, notice and filler windows exclude it once they make up ``share`` of its words.
In a window much longer than its exemplar only the shared words count as residue. Weights are inverse document
frequencies over all documents, for marks their greatest. Null, empty and blank texts are never excluded.

The index is kept by anchors: an exemplar's heaviest tokens, so many that a window without any can't reach the
threshold. A document without anchors and marks is settled by its set of words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from http import HTTPStatus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled residue, one exemplar a line.
ERRORS = """404 not found
page not found
502 bad gateway
503 service temporarily unavailable
service unavailable
500 internal server error
upstream request timed out
gateway timeout
403 forbidden
access denied
too many requests
slow down
session has expired
the session you asked for does not exist or was removed
content is not available in your region
checking your browser before you can enter
request to model failed after attempts overloaded
traceback most recent call last
file line
keyerror
typeerror cannot read properties of undefined reading
at load js
at async main js
error unauthorized status
error query parameter is required status
error rate limited status
error internal error status
error status
try again in a few minutes
please try again later
something went wrong
etwas ist schiefgelaufen
ein fehler ist aufgetreten
zu viele anfragen
wir führen wartungsarbeiten durch
une erreur est survenue veuillez réessayer plus tard
trop de requêtes
service indisponible
algo salió mal inténtalo más tarde
demasiadas solicitudes
servicio no disponible
algo deu errado tente novamente mais tarde
muitas solicitações
serviço indisponível
bir şeyler ters gitti
çok fazla istek
sorry we can't find that page
we are down for maintenance back in minutes
oops
nginx
bad request
502 gateway
503 gateway
504 gateway
sign in again to continue
log in again to continue
connection refused
connection timed out
internal server error
an error occurred while processing your request
an unexpected error occurred
this site can't be reached
under construction
verify you are human
ungültige anfrage
mauvaise requête
solicitud incorrecta
requisição inválida
geçersiz istek
seite nicht gefunden
zugriff verweigert
diese seite gibt es nicht mehr
interner serverfehler
bitte später erneut versuchen
sitzung ist abgelaufen
page introuvable
accès refusé
le serveur a rencontré un problème
session a expiré reconnectez-vous
página no encontrada
acceso denegado
error interno del servidor
sesión ha caducado
página não encontrada
acesso negado
erro interno do servidor
sessão expirou
sayfa bulunamadı
erişim engellendi
sunucu hatası oluştu lütfen sonra deneyin
oturumunuzun süresi doldu"""
NOTICES = """please enable javascript to continue
you have disabled javascript in your browser
javascript is required to view this memory
enable cookies and scripts then press reload
app needs scripts to run
bitte aktivieren sie javascript um fortzufahren
diese anwendung benötigt skripte
bitte einschalten und neu laden
veuillez activer javascript pour continuer
cette application a besoin de scripts pour fonctionner
active javascript para continuar
activa javascript para continuar
esta aplicación necesita scripts para funcionar
ative o javascript para continuar
este aplicativo precisa de scripts para funcionar
devam etmek için javascript'i etkinleştirin
bu uygulamanın çalışması için betikler açık olmalı"""
FILLER = """bla bla bla
asdf asdf qwer asdf
test test
text goes here
summary here
insert body here
insert text here
your text here
content goes here
sample text replace before release
text to follow
description to follow
blindtext steht hier
text folgt
texte à remplacer
texto de ejemplo cambiar luego
texto provisório aqui
buraya metin gelecek"""
PASSAGES = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua arcu quis velit ornare massa nulla felis porta vitae semper tempus"""
# Slots by example, then names of missing values.
SLOTS = """{{name}}
{{NAME}}
{{first name}}
{{of more than five words each}}
{{0}}
{{}}
{{> part}}
{{{name}}}
{{{first name}}}
{{{NAME}}}
${name}
${first name}
#{name}
#{first name}
{name}
{0}
<%= name %>
<%name%>
<%= first name %>
[[name]]
[[NAME]]
[[first name]]
<<name>>
<<NAME>>
<<first name>>
<NAME>
[name]
[NAME]
[first name]
%(name)s
%s
@@name@@
@@NAME@@
%%name%%
%%NAME%%
$NAME$
%NAME%
__NAME__
XXX
____
null
undefined
NaN
None"""
# Marks that stand for themselves: roles, notes and links in brackets, English uses of none.
PLAIN = """[user]
[assistant]
[system]
[at]
[dot]
[sic]
[x]
[link]
[image]
None of
None were
None was
None are
None is
None have
None has
None had
None can
None could
None will
None would
None should
None may
None might
None must
None do
None does
None did
None so
None too
None but
None other
None the
None at"""
TALK = """template slot placeholder filled
template placeholder explained guide
tool fills slot template
documentation example placeholder syntax
vorlage platzhalter steht erklärte
modèle écrit remplace guide
plantilla escribe herramienta guía
modelo escreve-se ferramenta guia
şablonda yazılır doldurur kılavuz
path folder name guide
helper prints test checks
joked name badge"""
CHROME = """memory hub
menu search sign in
home login help
request id
reference
back to start page
zurück zur startseite
retour à l'accueil
volver al inicio
voltar ao início
ana sayfaya dön"""
THRESHOLD = {"error": 0.8, "notice": 0.8, "filler": 0.8, "passage": 0.8, "slot": 0.8, "talk": 0.45, "chrome": 0.6}
# Every branch starts with a character of its own and looks back from there: the scan skips to these characters.
MARK = re.compile(
    r"\{+[^{}\n]*\}+|[$#]\{+[^{}\n]*\}+|<%[^%\n]*%>|<<[^<>\n]*>>|\[+[^\[\]\n]*\]+|%\([^()\n]*\)[a-z](?!\w)|@@[^@\n]*@@|%%[^%\n]*%%"
    r"|<[A-Z][A-Z_]{2,}>|\$(?<!\w\$)[A-Z_]{2,}\$|%(?<!\w%)[A-Z_]{3,}%|_(?<!\w_)_[A-Z]+__(?!\w)|X(?<!\wX)XX+(?!\w)|____+|%(?<![\w%]%)s(?!\w)"
    r"|null(?<![\w\"'./(]null)(?![\w\"'(])|undefined(?<![\w\"'./(]undefined)(?![\w\"'(])|N(?<![\w\"'./(]N)(?:aN|one)(?![\w\"'(])")
NEXT = re.compile(r"\s+(\w+)")
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|“[^”\n]*[”“]|„[^“”\n]*[“”]|«[^»\n]*»|\"(?<![\w{:\s]\")[^\"\n]*\"|\"(?<=[\s(\w]\")[^\"\n:{}]*\"(?!\s*:)", re.S)
ROLE = re.compile(r"^\W*\[(?:user|assistant|system)\]:\s*", re.M)
SIGNS = re.compile(r"([$#]?\{+|<%=?|<<|\[+|%\(|@@|%%)(.*?)(\}+|%>|>>|\]+|\)[a-z]|@@|%%)\Z")
BARE = re.compile(r"<[A-Z][A-Z_]+>|\$[A-Z_]+\$|%[A-Z_]+%|__[A-Z]+__|%s")
NAMES = ("null", "undefined", "NaN", "None")
#: Marks are written as one letter of the private use area each, so that they pass as tokens.
TOKEN = re.compile(r"[\ue000-\uf8ff]|[^\W_]+(?:['’\-][^\W_]+)*")
WINDOW = re.compile(r"\n+|\s(?<=[.!?…]\s)\s*")
TAGS = re.compile(r"</?[a-z][^<>\n]*>")
PRIVATE = re.compile(r"[\ue000-\uf8ff]")


def mark_shape(m: re.Match) -> str:
    """What a mark is known by: its signs around the kind of its inside, or itself."""
    text = m[0]
    if text in NAMES:
        after = NEXT.match(m.string, m.end()) if text == "None" else None
        return f"None {after[1].lower()}" if after and f"None {after[1].lower()}" in ITSELF else text
    if text[0] == "X" or text.startswith("____"):
        return "XXX" if text[0] == "X" else "____"
    if BARE.fullmatch(text):
        return re.sub(r"[A-Z](?:[A-Z_]*[A-Z])?", "NAME", text) if text != "%s" else text
    opening, inside, closing = SIGNS.match(text).groups()
    inside, whole = inside.strip(), m[0].lower()
    link = m.string[m.end():m.end() + 1] if closing == "]" else ""
    link = link if link in ("(", "[") else ""
    if whole in ITSELF and not link:
        return whole
    words = len(inside.split())
    if not inside or inside.isdigit():
        kind = inside and "0"
    elif re.fullmatch(r"[A-Z][A-Z0-9_]*", inside):
        kind = "NAME"
    elif re.fullmatch(r"[^\W\d]\w*(?:\.\w+)*", inside):
        kind = "name"
    else:
        kind = "words" if inside[0].isalpha() and words <= 5 else "long" if inside[0].isalpha() else "other"
    # Signs after a word, as in patterns, and brackets of links are other marks.
    before = m.string[m.start() - 1:m.start()]
    glued = "·" if opening in ("{", "[") and (before.isalnum() or before in ("_", "$", "'") and opening == "{") else ""
    return f"{glued}{opening.rstrip('=')}{kind}{closing}{link}"


MARKS: dict[str, str] = {}
ITSELF = frozenset(PLAIN.splitlines())
for _line in PLAIN.splitlines():
    MARKS.setdefault(_line, chr(0xE000 + len(MARKS)))
for _line in SLOTS.splitlines():
    MARKS.setdefault(mark_shape(MARK.search(_line)), chr(0xE000 + len(MARKS)))


def marked(text: str) -> str:
    """The text with a letter for each mark that an exemplar has; other marks stay as they are."""
    return MARK.sub(lambda m: f" {MARKS[shape]} " if (shape := mark_shape(m)) in MARKS else m[0], PRIVATE.sub(" ", text))


def tokenise(text: str) -> list[str]:
    return TOKEN.findall(marked(text).lower())


def exemplars() -> list[tuple[str, list[str]]]:
    """(label, tokens) of every labelled exemplar."""
    groups = (("error", ERRORS), ("notice", NOTICES), ("filler", FILLER), ("passage", PASSAGES), ("slot", SLOTS), ("talk", TALK), ("chrome", CHROME))
    status = [("error", tokenise(f"{s.value} {s.phrase}")) for s in HTTPStatus if s.value >= 400]
    return status + [(label, tokenise(line)) for label, text in groups for line in text.splitlines()]


def windows(text: str) -> list[list[str]]:
    """Tokens of each window outside code and quotations."""
    body = marked(ROLE.sub("", text if text.lstrip().startswith("{\"") else CODE.sub(" ", text)))
    found = (TOKEN.findall(w) for w in WINDOW.split(TAGS.sub(" \n", body).lower()))
    return [w for w in found if w]


class Index:
    """Inverted index from anchor to exemplars, with inverse document frequencies."""

    def __init__(self, idf: dict[str, float], common: float = 0.01) -> None:
        self.top = max(idf.values(), default=1.0)
        self.idf, self.all = idf, [(label, set(tokens)) for label, tokens in exemplars()]
        self.posts: dict[str, list[int]] = defaultdict(list)
        self.weight = []
        usual = 1 - math.log(common)  # the weight of a word that this share of the documents has
        for i, (label, tokens) in enumerate(self.all):
            heavy = sorted(tokens, key=self.of, reverse=True)
            whole = sum(map(self.of, heavy))
            self.weight.append(whole)
            if label == "passage":
                anchors = [t for t in heavy if not idf or self.of(t) >= min(usual, self.top)]
            else:
                anchors, held = [], 0.0
                for t in heavy:
                    anchors.append(t)
                    held += self.of(t)
                    if held > (1 - THRESHOLD[label]) * whole + 1e-9:
                        break
            for t in anchors:
                self.posts[t].append(i)
        self.slots = frozenset(MARKS) - ITSELF
        wanted = {i for i, (label, _) in enumerate(self.all) if label not in ("talk", "chrome")}
        self.gate = frozenset(t for t, at in self.posts.items() if wanted & set(at))

    def of(self, token: str) -> float:
        return self.idf.get(token, self.top)

    def labels(self, window: set[str]) -> dict[str, tuple[float, set[str]]]:
        """Best containment by label that reaches its threshold, with the shared tokens."""
        best: dict[str, tuple[float, set[str]]] = {}
        for i in {i for t in window for i in self.posts.get(t, ())}:
            label, tokens = self.all[i]
            shared = window & tokens
            whole = sum(map(self.of, window)) if label == "passage" else self.weight[i]
            held = sum(map(self.of, shared)) / whole
            if held >= THRESHOLD[label] - 1e-9 and held >= best.get(label, (0.0,))[0]:
                best[label] = (held, tokens)
        return best

    def judge(self, text: str | None, share: float = 0.5) -> str | None:
        """Why a text is excluded, or null."""
        if not text or not text.strip():
            return None
        if self.gate.isdisjoint(TOKEN.findall(text.lower())) and not any(mark_shape(m) in self.slots for m in MARK.finditer(text)):
            return None
        residue: dict[str, int] = defaultdict(int)
        words = 0
        for w in windows(text):
            have = set(w)
            best = self.labels(have) if not have.isdisjoint(self.posts) else {}
            if "slot" in best and "talk" not in best and "error" not in best:
                return "slot"
            size = len(w)
            if "passage" in best:
                residue["filler"] += size
            else:
                label = max((k for k in ("error", "notice", "filler") if k in best), key=lambda k: best[k][0], default=None)
                if label:
                    tokens = best[label][1]
                    residue[label] += size if size <= 3 * len(tokens) + 3 else sum(t in tokens for t in w)
                elif "chrome" in best:
                    continue
            words += size
        total = sum(residue.values())
        return max(residue, key=residue.__getitem__) if total and total >= share * words else None


def idf_of(documents: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequencies of the exemplars' tokens over all documents; at most one row a token."""
    vocabulary = sorted({t for _, tokens in exemplars() for t in tokens if not PRIVATE.match(t)})
    seen = documents.select(F.explode(F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}'’\-]+"), F.array(*map(F.lit, vocabulary)))).alias("t"))
    counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    n = documents.count()
    return {t: 1 + math.log((1 + n) / (1 + counts.get(t, 0))) for t in vocabulary}


def excluded(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``reason``: slot, error, notice or filler for documents to exclude, else null."""
    idf = idf_of(documents, text)
    held: dict = {}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        if "i" not in held:
            held["i"] = Index(idf)
        return pd.Series([held["i"].judge(t) for t in texts], dtype=object)

    # Not deterministic, so that no filter on it is copied below another operator and judges again.
    return documents.withColumn("reason", run.asNondeterministic()(F.col(text)))
