"""Documents that contain held-out test items, wholly or partly, by word-level FM-indexes of corpus shards."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak, of how many words one may be replaced where the whole item is there, words that a
#: shard's index holds before it is searched, and the distance of sampled suffix positions.
RUN, REPLACED, SHARD, SAMPLE = 12, 8, 1_000_000, 8

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_DROP = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text regardless of case, punctuation, markup, white space, entities and Unicode form."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_DROP))
    return _WORD.findall(text.casefold())


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The suffix array of codes (0: a word of no item) by prefix doubling; every 0 counts as different from all others.

    So the doubling ends as soon as the longest stretch of items' words is sorted, whatever the length of the texts.
    """
    n = len(codes)
    zero = codes == 0
    rank = np.where(zero, np.cumsum(zero) - 1, codes.astype(np.int64) + int(zero.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FmIndex:
    """Burrows-Wheeler transform of a shard's words in a wavelet matrix, with sampled suffix positions."""

    def __init__(self, codes: np.ndarray, sigma: int):
        codes = np.append(codes, 0)  # the sentinel that ends the shard
        order = suffix_order(codes)
        self.n, self.levels = len(codes), max(1, int(sigma).bit_length())
        bwt = codes[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=sigma + 1))))
        self.ones, self.zeros = [], []
        seq = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # A walk back must not pass a word of no item, whose order is not that of what follows it: the suffixes right
        # behind such words are sampled too.
        self.marked = (codes[order] != 0) & ((order % SAMPLE == 0) | (bwt == 0))
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.sampled = order[self.marked]

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word c stands before row `at` of the transform."""
        i, begin = at, np.zeros_like(at)
        for k in range(self.levels):
            bit = (c >> (self.levels - 1 - k)) & 1
            a, b = self.ones[k][i], self.ones[k][begin]
            i = np.where(bit, self.zeros[k] + a, i - a)
            begin = np.where(bit, self.zeros[k] + b, begin - b)
        return i - begin

    def word_at(self, row: np.ndarray) -> np.ndarray:
        c, i = np.zeros_like(row), row
        for k in range(self.levels):
            a = self.ones[k][i]
            bit = self.ones[k][i + 1] - a
            i = np.where(bit, self.zeros[k] + a, i - a)
            c = c * 2 + bit
        return c

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of a matrix, filled up on the left)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        live = np.arange(len(patterns))
        for k in range(width):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - k]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes that begin with an item's word, by walking back to the nearest sampled one."""
        out, row, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            r = row[todo]
            hit = self.marked[r]
            out[todo[hit]] = self.sampled[self.mark_rank[r[hit]]] + steps
            todo = todo[~hit]
            r = r[~hit]
            c = self.word_at(r)
            row[todo] = self.first[c] + self.rank(c, r)
            steps += 1
        return out


class Probe:
    """The items' patterns: every run of RUN words, and for each item the pieces of which one survives the replacements."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, replaced: int = REPLACED):
        self.vocabulary: dict[str, int] = {}
        rows: list[tuple[int, int, list[int], bool]] = []
        self.whole: dict[int, np.ndarray] = {}
        self.allowed: dict[int, int] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not codes:
                continue
            self.whole[item], self.allowed[item] = np.array(codes), len(codes) // replaced
            rows += [(item, i, codes[i : i + run], True) for i in range(len(codes) - run + 1)]
            cuts = np.linspace(0, len(codes), self.allowed[item] + 2).astype(int)
            rows += [(item, int(a), codes[a:b], False) for a, b in zip(cuts, cuts[1:]) if b > a]
        width = max((len(r[2]) for r in rows), default=1)
        self.item = np.array([r[0] for r in rows], np.int64)
        self.offset = np.array([r[1] for r in rows], np.int64)
        self.length = np.array([len(r[2]) for r in rows], np.int64)
        self.exact = np.array([r[3] for r in rows], bool)
        self.patterns = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            self.patterns[i, width - len(r[2]) :] = r[2]

    def find(self, ids: list[int], codes: list[np.ndarray]) -> pd.DataFrame:
        """doc_id, item_id, first_word, last_word of the leaks in a shard; overlapping runs of an item are one span."""
        starts = np.cumsum([0] + [len(c) + 1 for c in codes])[:-1]
        text = np.zeros(int(starts[-1] + len(codes[-1]) + 1) if len(codes) else 0, np.int64)
        for s, c in zip(starts, codes):
            text[s : s + len(c)] = c
        if not len(self.patterns) or not text.any():
            return pd.DataFrame({k: pd.Series(dtype="int64") for k in ("doc_id", "item_id", "first_word", "last_word")})
        index = FmIndex(text, len(self.vocabulary))
        lo, hi = index.search(self.patterns, self.length)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = index.locate(rows)
        doc = np.searchsorted(starts, at, "right") - 1
        exact = self.exact[which]
        spans = [(int(d), int(i), int(a), int(a + n - 1)) for d, i, a, n in zip(doc[exact], self.item[which[exact]], at[exact], self.length[which[exact]])]
        begin = at[~exact] - self.offset[which[~exact]]
        for d, i, b in set(zip(doc[~exact].tolist(), self.item[which[~exact]].tolist(), begin.tolist())):
            item = self.whole[i]
            if b >= starts[d] and b + len(item) <= starts[d] + len(codes[d]) and (text[b : b + len(item)] != item).sum() <= self.allowed[i]:
                spans.append((d, i, b, b + len(item) - 1))
        merged: list[list[int]] = []
        for d, i, a, b in sorted(set(spans)):
            if merged and merged[-1][:2] == [d, i] and a <= merged[-1][3] + 1:
                merged[-1][3] = max(merged[-1][3], b)
            else:
                merged.append([d, i, a, b])
        return pd.DataFrame([(ids[d], i, a - starts[d] + 1, b - starts[d] + 1) for d, i, a, b in merged], columns=["doc_id", "item_id", "first_word", "last_word"]).astype("int64")


def leaked_spans(documents: DataFrame, benchmark: DataFrame, run: int = RUN, replaced: int = REPLACED, shard: int = SHARD) -> DataFrame:
    """doc_id, item_id, first_word, last_word (from 1): where documents hold `run` or more consecutive words of an item, or the whole item with at most one word in `replaced` replaced.

    benchmark: item_id, text; held-out test sets are small and fixed, so the driver reads them and their patterns go with the
    function. Each worker packs the words of its documents into shards and searches an FM-index of each; nothing is
    shuffled. Null, empty and wordless texts and items have no leaks; a document of any length lies in one shard.
    """
    probe = Probe([(r[0], r[1]) for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").collect()], run, replaced)
    sent = documents.sparkSession.sparkContext.broadcast(probe)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = sent.value
        get = probe.vocabulary.get
        ids, codes, n = [], [], 0
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                c = np.fromiter((get(w, 0) for w in words(text)), np.int64)
                if c.any():
                    ids.append(i)
                    codes.append(c)
                    n += len(c)
                if n >= shard:
                    yield probe.find(ids, codes)
                    ids, codes, n = [], [], 0
        if ids:
            yield probe.find(ids, codes)

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(shards, "doc_id bigint, item_id bigint, first_word bigint, last_word bigint")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak, each pair once."""
    return leaked_spans(documents, benchmark).select("doc_id", "item_id").distinct()
