"""Language of texts and passages: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic net, then calibrated by a temperature.

N-grams (1 to 4, words bounded) are hashed into ``SPACE`` features; a sentence is the mean of its n-grams'
inverse document frequencies, so its logits are a sum over words, and each worker keeps the words it met.
The model is fitted on about ``SAMPLE`` labelled documents, chosen by hash, of each at most ``PER_DOCUMENT`` sentences,
chosen by hash as well; a fifth of them fits the temperature. A sentence whose words come from several languages is cut
at any number of places, in time that grows with its words. Null and empty texts and texts without words have no
passages. Quoted phrases, code, links and addresses are no sentences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "tr")
SPACE, SCALE = 1 << 17, 12.0
SAMPLE, PER_DOCUMENT = 3_000, 24
# Usual spellings of each language's name and code.
SPELLINGS = {
    "en": "en eng english englisch anglais inglés inglês ingilizce", "de": "de deu ger german deutsch allemand alemán alemão almanca",
    "fr": "fr fra fre french français francais französisch francés francês fransızca", "es": "es spa spanish español espanol espagnol spanisch espanhol castellano ispanyolca",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portekizce", "tr": "tr tur turkish türkçe turkce türkisch turc turco",
}
BY_NAME = {name: lang for lang, names in SPELLINGS.items() for name in names.split()}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NOISE = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|www\.\S+|\S+@\S+|“[^”\n]*[”“]|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|‘[^’\n]*’(?!\w)|^\s*>?\s*\[?(?:user|assistant|system|quote|user said|assistant said)\]?\s*:", re.S | re.M | re.I)
SPLIT = re.compile(r"(?<=[.!?…;])[\s)]+|\n+|[¿¡]|\s[—–/|]+\s")


def label_of(lang: str | None) -> str | None:
    """The language a label names, null for none of the six."""
    if not lang:
        return None
    name = lang.strip().lower().replace("i̇", "i")
    return BY_NAME.get(name) or BY_NAME.get(re.split(r"[-_ (]", name)[0])


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence outside quotations, code and links."""
    words = (WORD.findall(s.lower()) for s in SPLIT.split(NOISE.sub(" ", text)))
    return [w for w in words if w]


def grams(word: str) -> list[int]:
    """Hashed n-grams of a word with its bounds."""
    w = f"_{word}_"
    return [crc32(w[i:i + n].encode()) % SPACE for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [crc32(f"={word}".encode()) % SPACE]


@dataclass
class Model:
    """Weights (n-gram, language), inverse document frequencies, temperature."""

    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    memo: dict = field(default_factory=dict, repr=False)

    def word(self, w: str) -> tuple:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            g = grams(w)
            got = self.memo[w] = (*(self.weights[g] * self.idf[g, None]).sum(axis=0).tolist(), len(g))
        return got

    def judge(self, words: list[str]) -> tuple[str, float]:
        """Best language of words and its calibrated confidence."""
        return self.best([sum(c) for c in zip(*map(self.word, words))])

    def best(self, sums: list[float]) -> tuple[str, float]:
        k = SCALE / sums[-1]
        logits = [(s * k + b) / self.temperature for s, b in zip(sums, self.bias)]
        top = max(logits)
        return LANGS[logits.index(top)], 1 / sum(math.exp(v - top) for v in logits)

    def many(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``best`` of many rows of sums: indices of the languages and their confidences."""
        logits = (sums[:, :-1] * (SCALE / sums[:, -1:]) + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        return logits.argmax(axis=1), 1 / np.exp(logits).sum(axis=1)

    def chain(self, rows: np.ndarray, change: float = 6.0) -> list[tuple[int, int]]:
        """Bounds of the stretches of the likeliest sequence of languages, one a word, where each change costs."""
        logits = (rows[:, :-1] * (SCALE / rows[:, -1:]) + self.bias) / self.temperature
        logits -= np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + logits.max(axis=1, keepdims=True)
        score, came = logits[0], []
        for e in logits[1:]:
            top = int(score.argmax())
            stay = score >= score[top] - change
            came.append(np.where(stay, np.arange(len(LANGS)), top))
            score = np.where(stay, score, score[top] - change) + e
        at = int(score.argmax())
        path = [at]
        for back in reversed(came):
            at = int(back[at])
            path.append(at)
        path.reverse()
        edges = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
        return list(zip(edges, edges[1:]))

    def parts(self, words: list[str], sure: float = 0.97, side: int = 4, least: float = 0.9) -> list[tuple[str, float, int]]:
        """(lang, confidence, words) of a sentence, cut where stretches of ``side`` words or more surely differ in language."""
        got = [self.word(w) for w in words]
        lang, p = self.best([sum(c) for c in zip(*got)])
        if p >= sure or len(words) < 2 * side:
            return [(lang, p, len(words))]
        rows = np.array(got)
        upto = np.vstack([np.zeros(rows.shape[1]), rows.cumsum(axis=0)])
        pieces: list[list] = []
        for a, b in self.chain(rows):
            name, q = self.best((upto[b] - upto[a]).tolist())
            if pieces and (b - a < side or q < least or pieces[-1][3] == name):
                a = pieces.pop()[0]
                name, q = self.best((upto[b] - upto[a]).tolist())
            pieces.append([a, b, q, name])
        sound = all(q >= least and b - a >= side for a, b, q, _ in pieces)
        if sound and len(pieces) > 2:
            return [(name, q, b - a) for a, b, q, name in pieces]
        cuts = np.arange(side, len(words) - side + 1)
        (x, px), (y, py) = self.many(upto[cuts]), self.many(upto[-1] - upto[cuts])
        both = np.where((x != y) & (np.minimum(px, py) >= least), px * py, 0.0)
        i = int(both.argmax())
        if both[i] > 0:
            return [(LANGS[x[i]], float(px[i]), int(cuts[i])), (LANGS[y[i]], float(py[i]), len(words) - int(cuts[i]))]
        return [(name, q, b - a) for a, b, q, name in pieces] if sound and len(pieces) == 2 else [(lang, p, len(words))]


def train(samples: list[tuple[list[str], int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, rounds: int = 1) -> Model:
    """FTRL-proximal over (words, class) sentences; every fifth is held out for the temperature."""
    memo: dict[str, list[int]] = {}
    feats = []
    df = np.zeros(SPACE)
    for words, _ in samples:
        g = np.array([x for w in words for x in (memo.get(w) or memo.setdefault(w, grams(w)))])
        u, c = np.unique(g, return_counts=True)
        df[u] += 1
        feats.append((u, c / len(g)))
    idf = np.log((1 + len(samples)) / (1 + df))
    k = len(LANGS)
    z, n, bias = np.zeros((SPACE, k)), np.zeros((SPACE, k)), np.zeros(k)

    def weights(u: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[u]) <= l1, 0.0, -(z[u] - np.sign(z[u]) * l1) / ((beta + np.sqrt(n[u])) / alpha + l2))

    for _ in range(rounds):
        for i, (u, c) in enumerate(feats):
            if i % 5 == 4:
                continue
            x, w = c * idf[u] * SCALE, weights(u)
            e = np.exp((s := x @ w + bias) - s.max())
            p = e / e.sum()
            p[samples[i][1]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / alpha
            z[u] += g - sigma * w
            n[u] += g * g
            bias -= 0.01 * p
    model = Model(weights(np.arange(SPACE)).astype(np.float32), idf.astype(np.float32), bias)
    held = [((c * idf[u] * SCALE) @ model.weights[u] + bias, samples[i][1]) for i, (u, c) in enumerate(feats) if i % 5 == 4]
    if held:
        scores, truth = np.array([s for s, _ in held]), np.array([t for _, t in held])

        def loss(t: float) -> float:
            v = scores / t
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(truth)), truth]).mean())

        model.temperature = min((0.3 * 1.15 ** j for j in range(25)), key=loss)
    return model


def fit(documents: DataFrame, sample: int = SAMPLE, per_document: int = PER_DOCUMENT) -> Model:
    """Model from about ``sample`` labelled documents (at most a tenth more), of each at most ``per_document`` sentences."""
    known = documents.where("lang is not null").withColumn("_k", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    share = min(1.0, sample / max(1, known.count()))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, lang in zip(pdf["_k"], pdf["text"], pdf["lang"]):
                name = label_of(lang)
                whole = [" ".join(w) for w in sentences(text) if len(w) > 2] if name and text else []
                out += [(key, x, LANGS.index(name)) for x in sorted(whole, key=lambda x: crc32(x.encode()))[:per_document]]
            yield pd.DataFrame(out, columns=["k", "words", "lang"])

    rows = known.where(F.col("_k") < int(share * (1 << 20)) + 1).select("_k", "text", "lang").mapInPandas(chosen, "k bigint, words string, lang int").limit(sample * per_document).collect()
    return train([(r["words"].split(" "), r["lang"]) for r in sorted(rows, key=lambda r: (crc32(r["words"].encode()), r["k"]))])


def languages(passages: Column, words: int = 3, least: float = 0.75) -> Column:
    """Languages with a full sentence; of a text with shorter stretches alone, those that are sure."""
    full = F.filter(passages, lambda p: (p["n_words"] >= words) & (p["confidence"] >= least))
    short = F.filter(passages, lambda p: (p["n_words"] == 2) & (p["confidence"] >= 0.95))
    return F.array_distinct(F.transform(F.when(F.size(full) > 0, full).otherwise(short), lambda p: p["lang"]))


def passages(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``passages``: array of (lang, confidence, n_words) per sentence of a text.

    The model travels as a broadcast of fixed size (SPACE x 6 floats)."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.idf, model.bias, model.temperature))
    held: dict = {}

    @F.pandas_udf("array<struct<lang:string,confidence:double,n_words:int>>")
    def run(texts: pd.Series) -> pd.Series:
        if "m" not in held:
            held["m"] = Model(*shared.value)
        m, seen = held["m"], {}
        out = []
        for t in texts:
            got = []
            for words in sentences(t) if t else ():
                key = tuple(words)
                if key not in seen:
                    seen[key] = m.parts(words)
                got.extend(seen[key])
            out.append(got)
        return pd.Series(out)

    # Not deterministic, so that no filter on it is copied below another operator and judges again.
    return df.withColumn("passages", run.asNondeterministic()(F.col(text)))
