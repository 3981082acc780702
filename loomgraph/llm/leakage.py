"""Evaluation passages inside a corpus, by a positional index of the passages.

Terms are runs of 3, 4 and 6 characters of the folded text without white
space, marks and markup, so line breaks, tables, full-width digits and script
make no difference. All terms of all test items are indexed with their
positions, none is left out for being common, and every document is read once
against the index: the positions of an item that lie in terms of the document
bound what an alignment could find (see ``Screen``). Only pairs whose bounds
reach a limit are then aligned sentence by sentence for exact and lightly
edited occurrences, so the result is that of aligning every pair.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .cn import simplified

_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_SKIP = re.compile(r"[\W_]+")
_SENT = re.compile(r"(?<=[。？！])|(?<=[.?!])\s+(?=[A-Z])|\n+")


def plain(t: str | None) -> str:
    """The characters of a text that count for comparison."""
    if not t:
        return ""
    if "<" in t:
        t = _MARKUP.sub("", t)
    if "&" in t:
        t = html.unescape(t)
    t = _SKIP.sub("", t)
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):  # full-width digits and letters; marks are gone by now
            t = _SKIP.sub("", unicodedata.normalize("NFKC", t))
        t = simplified(t)
    return t.lower()


def _hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n characters of many texts, with the number of their text and their position in it."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(code) < n:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    h = np.zeros(len(code) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[i:len(code) - n + 1 + i]
        h ^= h >> np.uint64(29)
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    row = np.repeat(np.arange(len(texts)), lens)[:len(h)]
    pos = np.arange(len(h)) - start[row]
    ok = pos <= lens[row] - n
    return h.view(np.int64)[ok], row[ok], pos[ok]


class _Terms:
    """Membership of hashes in a fixed set: a bit table first, then binary search."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms)
        self.mask = np.uint64((1 << max(16, int(len(self.terms) * 32).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        self.bits[(self.terms.view(np.uint64) & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` whose value is in the set."""
        k = np.flatnonzero(self.bits[(h.view(np.uint64) & self.mask).astype(np.int64)])
        if not len(k) or not len(self.terms):
            return k[:0]
        at = np.minimum(np.searchsorted(self.terms, h[k]), len(self.terms) - 1)
        return k[self.terms[at] == h[k]]


class Passage:
    """One test item, ready to be looked for in documents."""

    def __init__(self, text: str):
        self.sents: list[tuple[int, str]] = []
        raw_at: list[int] = []
        at = 0
        for part in _SENT.split(text):
            k = text.find(part, at)
            at = k + len(part)
            p = plain(part)
            if not p:
                continue
            self.sents.append((len(raw_at), p))
            cs = [i for i, c in enumerate(part) if plain(c)]
            cs = (cs + [len(part) - 1] * len(p))[:len(p)]
            raw_at += [k + i for i in cs]
        self.q = "".join(p for _, p in self.sents)
        self.raw_at = raw_at
        self.english = sum(c.isascii() for c in self.q) > 0.8 * max(1, len(self.q))
        self.seeds: dict[str, list[int]] = {}
        for i in range(len(self.q) - 4):
            self.seeds.setdefault(self.q[i:i + 5], []).append(i)

    def match(self, doc: str, cover: float = 0.8, facts: float = 0.7) -> tuple[int, int]:
        """Sentences that ``doc`` (plain) holds, and the longest stretch of the item in it, in characters of the item.

        A sentence is held if ``cover`` of its characters and ``facts`` of its
        digits stand there in order: the same wording about other facts is not
        the same sentence.
        """
        votes: list[Counter] = [Counter() for _ in self.sents]
        sent_of = np.searchsorted([a for a, _ in self.sents], np.arange(len(self.q)), side="right") - 1
        for j in range(len(doc) - 4):
            for i in self.seeds.get(doc[j:j + 5], ()):
                votes[sent_of[i]][(j - i) // 8] += 1
        hit = 0
        where = np.full(len(self.q), -1, dtype=np.int64)
        least = 6 if self.english else 4
        for k, (at, s) in enumerate(self.sents):
            best, found = 0.0, None
            for d, v in votes[k].most_common(3):
                if v < 0.12 * len(s):
                    break
                lo = max(0, d * 8 + at - 10)
                blocks = difflib.SequenceMatcher(None, s, doc[lo:lo + len(s) + 34], autojunk=False).get_matching_blocks()
                c = sum(b.size for b in blocks if b.size >= 3) / len(s)
                if c > best:
                    best, found = c, (lo, [b for b in blocks if b.size >= least])
            if not found:
                continue
            seen = np.zeros(len(s), dtype=bool)
            for b in found[1]:
                seen[b.a:b.a + b.size] = True
                where[at + b.a:at + b.a + b.size] = found[0] + b.b + np.arange(b.size)
            digits = np.array([c.isdigit() for c in s])
            if best >= cover and (not digits.any() or seen[digits].mean() >= facts):
                hit += 1
        return hit, self._stretch(where)

    def _stretch(self, where: np.ndarray) -> int:
        best, start, prev, miss = 0, -1, -1, 0
        for i in np.flatnonzero(where >= 0):
            if prev >= 0 and i - prev <= 5 and 0 < where[i] - where[prev] <= 10:
                miss += i - prev - 1
                if miss > 0.08 * (i - start + 1) + 2:
                    start, miss = i, 0
            else:
                start, miss = i, 0
            prev = i
            best = max(best, self.raw_at[i] - self.raw_at[start] + 1)
        return int(best)


class Screen:
    """Which test items a document may hold, by bounds that no held item can miss.

    The terms of all items are indexed with their positions. What ``match``
    finds lies in equal runs within one sentence: 3 characters at least for
    the cover of a sentence, ``least`` for its facts and for stretches. So the
    positions that lie in a run of that length standing anywhere in the
    document are an upper bound for all three, and no pair is left out that
    ``match`` would accept.
    """

    def __init__(self, passages: list[Passage], stretch: int, stretch_english: int, cover: float = 0.8, facts: float = 0.7):
        self.ps, self.cover, self.facts = passages, cover, facts
        self.need = [stretch_english if p.english else stretch for p in passages]
        sents = [(i, s) for e in (False, True) for i, p in enumerate(passages) if p.english == e for _, s in p.sents]
        self.item = np.array([i for i, _ in sents], dtype=np.int64)
        self.len = np.array([len(s) for _, s in sents], dtype=np.int64)
        # sentences begin at whole bytes, so that packed bits can be counted by sentence
        room = -(-self.len // 8) * 8
        self.at = np.cumsum(room) - room
        self.where = [np.concatenate([np.arange(a, a + k) for a, k in zip(self.at[self.item == i], self.len[self.item == i])] or [np.zeros(0, dtype=np.int64)]) for i in range(len(passages))]
        q = "".join(s.ljust(r) for (_, s), r in zip(sents, room))
        english = np.repeat(np.array([passages[i].english for i, _ in sents], dtype=bool), room)
        self.size = len(q)
        self.grams = []
        for n, where in ((3, None), (4, ~english), (6, english)):
            h, row, pos = _hashes([s for _, s in sents], n)
            p = self.at[row] + pos
            if where is not None:
                h, p = h[where[p]], p[where[p]]
            known = _Terms(h)
            lo, hi = (int(p.min()), int(p.max()) + n) if len(p) else (0, 0)
            of = np.full(hi - lo, len(known.terms), dtype=np.int64)  # the last one is never present
            of[p - lo] = np.searchsorted(known.terms, h)
            self.grams.append((n, known, of, lo))
        self.digit = np.packbits(np.array([c.isdigit() for c in q], dtype=bool))
        self.n_digits = self._count(self.digit)
        self.n_sents = np.bincount(self.item, minlength=len(passages))
        self.wanted = np.minimum(2, self.n_sents)
        self.raw = [np.array(p.raw_at, dtype=np.int64) for p in passages]
        self.pad = np.packbits(np.array([c == " " for c in q], dtype=bool))
        self.byte_item = np.repeat(self.item, room // 8)
        # a stretch fills so many whole bytes in a row, but for its misses
        self.filled: list[tuple[np.ndarray, int, int]] = []
        for e in (False, True):
            few, many, mine = 1 << 30, 0, np.zeros(len(passages), dtype=bool)
            for i, raw in enumerate(self.raw):
                j = np.searchsorted(raw, raw + self.need[i] - 1)
                k = (j - np.arange(len(raw)))[j < len(raw)] + 1
                if passages[i].english == e and len(k):
                    few, many, mine[i] = min(few, k.min()), max(many, k.max()), True
            if mine.any():
                w = max(0, (int(few) - 7) // 8)
                self.filled.append((mine, w, 8 * w - int(0.08 * (many + 5) + 2)))

    def _count(self, packed: np.ndarray) -> np.ndarray:
        """Bits set in each sentence."""
        return np.add.reduceat(np.bitwise_count(packed), self.at // 8, dtype=np.int64) if len(self.at) else np.zeros(0, dtype=np.int64)

    def find(self, docs: list[str]) -> Iterator[list[int]]:
        """For each document (plain), the numbers of the items it may hold."""
        hits = []
        for n, known, _, _ in self.grams[1:]:
            h, row, _ = _hashes(docs, n)
            k = known.find(h)
            hits.append((np.searchsorted(known.terms, h[k]), np.searchsorted(row[k], np.arange(len(docs) + 1))))
        for d, doc in enumerate(docs):
            t4, t6 = (t[b[d]:b[d + 1]] for t, b in hits)
            runs = np.zeros(self.size, dtype=bool)
            self._cover(runs, 1, t4)
            self._cover(runs, 2, t6)
            yield self._items(runs, doc) if len(t4) or len(t6) else []

    def _cover(self, out: np.ndarray, g: int, terms: np.ndarray) -> None:
        """Mark the positions of the items that lie in one of the terms."""
        n, known, of, lo = self.grams[g]
        if len(terms):
            there = np.zeros(len(known.terms) + 1, dtype=bool)
            there[terms] = True
            a = there[of]
            for i in range(n):
                out[lo + i:lo + len(a)] |= a[:len(a) - i]

    def _items(self, runs: np.ndarray, doc: str) -> list[int]:
        bits = np.packbits(runs)
        maybe = self._count(bits & self.digit) >= self.facts * self.n_digits - 1e-6
        enough = lambda: np.bincount(self.item[maybe], minlength=len(self.ps)) >= self.wanted
        out = set()
        if np.any(enough()):
            _, known, _, _ = self.grams[0]
            h, _, _ = _hashes([doc], 3)
            wide = np.zeros(self.size, dtype=bool)
            self._cover(wide, 0, np.searchsorted(known.terms, h[known.find(h)]))
            maybe &= self._count(np.packbits(wide)) >= self.cover * self.len - 1e-6
            out.update(np.flatnonzero(enough() & (self.n_sents > 0)).tolist())
        total = np.concatenate([[0], np.cumsum(np.bitwise_count(bits | self.pad), dtype=np.int64)])
        for mine, w, least in self.filled:
            here = self.byte_item[:len(total) - w][total[w:] - total[:-w] >= least] if w else self.byte_item
            for i in sorted(set(here[mine[here]].tolist()) - out):
                if self._may_stretch(runs[self.where[i]], i):
                    out.add(i)
        return sorted(out)

    def _may_stretch(self, runs: np.ndarray, i: int) -> bool:
        """Whether the positions of ``runs`` hold a stretch, by the gaps and misses that ``Passage._stretch`` allows."""
        at = np.flatnonzero(runs)
        raw = self.raw[i][at]
        ends = np.flatnonzero(np.diff(at) > 5) + 1
        for a, b in zip(np.concatenate([[0], ends]), np.concatenate([ends, [len(at)]])):
            if b == a or raw[b - 1] - raw[a] + 1 < self.need[i]:
                continue
            p = at[a:b]
            slack = p - np.arange(b - a) - 0.08 * p  # misses so far less those allowed
            top = np.maximum.accumulate(slack)
            last = np.searchsorted(raw[a:b], raw[a:b] - self.need[i] + 1, side="right") - 1
            ok = last >= 0
            if np.any(slack[ok] - top[last[ok]] <= 2.08 + 1e-6):
                return True
        return False


def leaked_passages(docs: DataFrame, items: DataFrame, stretch: int = 60, stretch_english: int = 140, max_terms: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, doc_id, sentences, stretch`` of documents that hold a test item.

    A document holds an item if it holds two of its sentences or more, a
    stretch of ``stretch`` characters (``stretch_english`` in English items),
    or a one-sentence item whole; also reordered, reformatted, lightly edited
    or amid other text. The items are a stated query set: they are read to the
    driver and may have ``max_terms`` characters at most (split larger sets);
    the work for a document grows with them. All documents are read. Null and
    empty texts hold nothing, items that are empty are in no document, repeated
    rows give one row.
    """
    rows = sorted({(int(r[0]), r[1]) for r in items.where("item_id is not null and text is not null").select("item_id", "text").collect()})
    size = sum(len(plain(t)) for _, t in rows)
    if size > max_terms:
        raise ValueError(f"{size} test terms; split the test items into sets of at most {max_terms}")
    rows = [(i, t) for i, t in rows if plain(t)]

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passages = [Passage(t) for _, t in rows]
        screen = Screen(passages, stretch, stretch_english)
        for pdf in it:
            out = []
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k:k + 500]
                texts = [plain(t) for t in part["t"]]
                for d, s, held in zip(part["doc_id"], texts, screen.find(texts)):
                    for i in held:
                        p = passages[i]
                        hit, run = p.match(s)
                        if hit >= min(2, len(p.sents)) or run >= screen.need[i]:
                            out.append((rows[i][0], d, hit, run))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "sentences", "stretch"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return texts.mapInPandas(verify, "item_id long, doc_id long, sentences int, stretch int").dropDuplicates(["item_id", "doc_id"])
