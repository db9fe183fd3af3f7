"""Languages of documents and of their stretches by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.sampling import bounded_sample

#: Labelled documents and sentences of them at most from which the model is trained (a sample by hash of doc_id), the
#: buckets of subwords, their dimensions, and the calibrated confidence below which a sentence has no language.
TRAIN_DOCS, TRAIN_SENTENCES, BUCKETS, WIDTH, CONFIDENT = 6_000, 16_000, 1 << 15, 16, 0.7
LENGTHS = (2, 3, 4)
#: Letters, marks on letters included, that a closed sentence of fewer than four words has at least.
LETTERS = 10
#: Pieces of held-out sentences at most from which the confidence of such short ones is calibrated.
SHORT_PIECES = 20_000

# Codes and names of the languages that labels may give.
NAMES = {
    "en": "eng english", "hi": "hin hindi", "mr": "mar marathi", "bn": "ben bengali bangla", "ta": "tam tamil", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish", "pt": "por portuguese",
    "gu": "guj gujarati", "te": "tel telugu", "kn": "kan kannada", "ml": "mal malayalam", "pa": "pan punjabi", "ur": "urd urdu", "or": "ori odia", "as": "asm assamese", "it": "ita italian", "nl": "nld dut dutch", "ru": "rus russian", "ar": "ara arabic", "zh": "zho chi chinese", "ja": "jpn japanese",
}
_CODES = {n: k for k, v in NAMES.items() for n in [k, *v.split()]}

_PARAGRAPH = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*•–]|\d+[.)])\s)")
# Short forms whose dot ends no sentence.
SHORT = "Rs rs No Nos Dr Smt Pt Ms Mr Mrs Shri Sri Prof Govt Dept approx ca vs e.g i.e Nr Hr Fr bzw z.B d.h Sr Sra núm Mme Mlle Fig Tel".split()
_END = re.compile(r"(?=[.!?।॥…])" + "".join(rf"(?<!\b{re.escape(x)})" for x in SHORT) + r"(?<![\s(][A-Z])([.!?।॥…]+[\"'”’»)*_]*)(?=\s|$)")
_NOISE = regex.compile(r"[^\p{L}\p{M}]+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x2060, 0xFEFF])


def label_code(label: Column) -> Column:
    """The two-letter code that a label names in any spelling or with a region; null if it names no language."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return F.try_element_at(codes, base)


def _letters(text: str) -> int:
    return sum(unicodedata.category(c)[0] in "LM" for c in text)


def sentences(text: str) -> list[tuple[str, bool]]:
    """The stretches of a text in order, and whether each is a full sentence: closed by its mark and of ten letters or four words.

    Abbreviations are listed, so the minimum only keeps out crumbs; what is too doubtful the model's confidence rejects.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_INVISIBLE))
    out = []
    for part in _PARAGRAPH.split(text):
        part = " ".join(part.split())
        begin = 0
        for m in _END.finditer(part):
            s = part[begin : m.end()].strip()
            begin = m.end()
            out.append((s, len(s.split()) >= 4 or _letters(s) >= LETTERS))
        if rest := part[begin:].strip():
            out.append((rest, False))
    return [(s, full) for s, full in out if any(c.isalpha() for c in s)]


def subwords_by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subwords (runs of 2 to 4 letters, word ends included) their bucket numbers and the text of each, in order of texts."""
    # letters keep their combining marks: only digits, punctuation and space are folded to one blank
    clean = [" " + _NOISE.sub(" ", t.lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in LENGTHS:
            same = owner[: len(owner) - n + 1] == owner[n - 1 :]
            yield ((h[same] ^ (h[same] >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64), owner[: len(owner) - n + 1][same]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords and the text of each, in order of texts."""
    parts = list(subwords_by_length(texts))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, at = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    return ids[order], at[order]


class LanguageModel:
    """Embeddings of hashed subwords, averaged over a text, under a linear softmax with calibrated temperature.

    Trained by stochastic gradient descent; then once more on labels put right where the first model is sure of
    another language, since some labels are wrong. A fifth of the texts is held out for the temperature.
    """

    def __init__(self, texts: list[str], labels: list[str], epochs: int = 4, seed: int = 5):
        self.names = sorted(set(labels))
        y = np.array([self.names.index(v) for v in labels])
        rng = np.random.default_rng(seed)
        ids, at = subwords(texts)
        bounds = np.searchsorted(at, np.arange(len(texts) + 1))
        held = rng.random(len(texts)) < 0.2
        for _ in range(2):
            self._train(ids, bounds, y, np.flatnonzero(~held), epochs, rng)
            self.heat = 1.0
            p = self._softmax(self._logits(texts))
            sure = p.max(1) > 0.6
            y = np.where(sure, p.argmax(1), y)
        test = np.flatnonzero(held) if held.any() else np.arange(len(texts))
        z = self._logits(texts)[test]
        self.held_out = float((z.argmax(1) == y[test]).mean())
        loss = {t: -np.log(self._softmax(z * t)[np.arange(len(test)), y[test]] + 1e-9).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)}
        self.heat = min(loss, key=loss.get)
        # short texts tell less: they have a temperature of their own, from pieces of the texts held out
        words = [(texts[i].split(), y[i]) for i in test]
        parts = [(" ".join(w[k : k + n]), v) for w, v in words for n in (1, 2, 3) for k in range(0, len(w) - n + 1, 4)][:SHORT_PIECES]
        parts = [(t, v) for t, v in parts if _letters(t) >= LETTERS]
        self.short_heat = self.heat
        if parts:
            z, v = self._logits([t for t, _ in parts]), np.array([v for _, v in parts])
            loss = {t: -np.log(self._softmax(z * t)[np.arange(len(v)), v] + 1e-9).mean() for t in (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0) if t <= self.heat}
            self.short_heat = min(loss, key=loss.get)

    def _train(self, ids, bounds, y, rows, epochs, rng):
        k = len(self.names)
        e, w = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, k))
        rate, batch = 0.5, 32
        total = epochs * (len(rows) // batch + 1)
        done = 0
        for _ in range(epochs):
            mixed = rng.permutation(rows)
            for b in range(0, len(mixed), batch):
                r = mixed[b : b + batch]
                n = (bounds[r + 1] - bounds[r]).astype(np.int64)
                r, n = r[n > 0], n[n > 0]
                if not len(r):
                    continue
                own = np.repeat(np.arange(len(r)), n)
                i = ids[np.repeat(bounds[r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                mean = np.add.reduceat(e[i], np.cumsum(n) - n) / n[:, None]
                g = self._softmax(mean @ w)
                g[np.arange(len(r)), y[r]] -= 1
                step = rate * (1 - done / total)
                back = step * (g @ w.T) / np.sqrt(n)[:, None]
                w -= step * mean.T @ g / len(r) * 4
                np.subtract.at(e, i, back[own] / 4)
                done += 1
        self.table = (e @ w).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def _logits(self, texts: list[str]) -> np.ndarray:
        """Mean weights of each text's subwords, a thousand texts at a time, so that memory stays bounded."""
        z = np.zeros((len(texts), len(self.names)), np.float32)
        for a in range(0, len(texts), 1_000):
            part, size = z[a : a + 1_000], np.zeros((min(1_000, len(texts) - a), 1), np.float32)
            for ids, at in subwords_by_length(texts[a : a + 1_000]):
                if len(ids):
                    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    part[at[starts]] += np.add.reduceat(self.table[ids], starts)
                    size[at[starts], 0] += np.diff(np.append(starts, len(at)))
            part /= np.maximum(size, 1)
        return z

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated confidence."""
        names: list[str] = []
        sure: list[np.ndarray] = []
        for a in range(0, len(texts), 1_000):
            part = texts[a : a + 1_000]
            heat = np.array([self.heat if len(t.split()) >= 4 else self.short_heat for t in part])[:, None]
            p = self._softmax(self._logits(part).astype(np.float64) * heat)
            names += [self.names[i] for i in p.argmax(1)]
            sure.append(p.max(1))
        return names, np.concatenate(sure) if sure else np.zeros(0)


_MASK = re.compile(r"\d+|(?<!^)\b[A-Z][\w'-]*")


def voted(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Sentences with the label that most documents give to sentences of the same frame (names and figures masked).

    Labels of whole documents are partly wrong, and a sentence of a mixed one need not be in its language; sentences
    that many documents share outvote that.
    """
    frames = [_MASK.sub("_", s) for s, _ in pairs]
    votes: dict[str, Counter] = {}
    for f, (_, c) in zip(frames, pairs):
        votes.setdefault(f, Counter())[c] += 1
    return [(s, votes[f].most_common(1)[0][0]) for f, (s, _) in zip(frames, pairs)]


def fit(documents: DataFrame, docs: int = TRAIN_DOCS, limit: int = TRAIN_SENTENCES) -> LanguageModel | None:
    """A model trained on a bounded sample of labelled documents; None if there is no labelled sentence."""
    labelled = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code"))
    sample = bounded_sample(labelled, "doc_id", docs, F.expr("code is not null and length(text) > 40"), 11)
    rows = voted([(s, c) for t, c in zip(sample["text"], sample["code"]) for s, full in sentences(t) if full])
    rows = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))[:limit]]
    return LanguageModel([s for s, _ in rows], [c for _, c in rows]) if rows else None


_SEGMENT = "doc_id bigint, label string, segment int, words int, full boolean, lang string, confidence double"


def segments(documents: DataFrame, model: LanguageModel | None = None, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, label (the code that lang names), segment (from 1), words, full, lang, confidence of every stretch.

    A stretch is a run of neighbouring sentences of one language; full says whether it has a full sentence. Sentences
    below the confidence belong to the stretch around them and, alone, have no language. Null, empty and letterless
    texts have no stretch. One pass without a shuffle; whole texts are read.
    """
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", label_code(F.col("lang")).alias("label"), "text").where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in (b.iloc[i : i + 500] for b in batches for i in range(0, len(b), 500)):
            cut = [sentences(t) for t in pdf["text"]]
            names, sure = model.predict([s for c in cut for s, _ in c]) if model else ([None] * sum(map(len, cut)), np.zeros(sum(map(len, cut))))
            out, k = [], 0
            for doc, label, c in zip(pdf["doc_id"], pdf["label"], cut):
                runs: list[list] = []
                for s, full in c:
                    lang, p = (names[k], float(sure[k])) if sure[k] >= confident else (None, float(sure[k]))
                    k += 1
                    n = len(s.split())
                    if runs and (lang is None or runs[-1][2] in (None, lang)):
                        r = runs[-1]
                        if lang is not None:
                            r[3] = p * n + (r[3] if r[2] is not None else 0)
                            r[4] = n + (r[4] if r[2] is not None else 0)
                            r[1] = (r[1] if r[2] is not None else False) or full
                            r[2] = lang
                        r[0] += n
                    else:
                        runs.append([n, full and lang is not None, lang, p * n, n])
                out += [(doc, label, i, r[0], r[1], r[2], r[3] / r[4]) for i, r in enumerate(runs, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "label", "segment", "words", "full", "lang", "confidence"])

    return rows.mapInPandas(run, _SEGMENT)


def mislabelled(documents: DataFrame) -> DataFrame:
    """doc_id, lang of documents whose label is missing, names no language or another one, or that mix languages.

    One row for each language that has a full sentence in the document.
    """
    langs = segments(documents).where("full and lang is not null").groupBy("doc_id", "lang").agg(F.max("label").alias("label"))
    docs = langs.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return docs.where(wrong).select("doc_id", F.explode("langs").alias("lang"))


def document_languages(documents: DataFrame) -> DataFrame:
    """doc_id, label, lang, share of its words, confidence: the language that most words of a document are in; ties go to the first by name."""
    by = segments(documents).where("lang is not null").groupBy("doc_id", "lang").agg(F.max("label").alias("label"), F.sum("words").alias("w"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("c"))
    best = F.max_by(F.struct("lang", "w", "c"), F.struct("w", F.array_join(F.transform(F.split("lang", ""), lambda x: F.chr(F.lit(255) - F.ascii(x))), ""))).alias("b")
    return by.groupBy("doc_id").agg(F.max("label").alias("label"), best, F.sum("w").alias("all")).select("doc_id", "label", F.col("b.lang").alias("lang"), F.round(F.col("b.w") / F.col("all"), 4).alias("share"), F.round("b.c", 4).alias("confidence"))
