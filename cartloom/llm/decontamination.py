"""Benchmark decontamination: a BM25 index of test items, asked with every passage of every text.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; each
character of U+3000 to U+9FFF, which are written without spaces, is a word of its own. A text
is read in passages of twice the length of the longest item, each beginning halfway through
the one before, so every span as long as an item lies inside a passage. The terms of the
index are pairs of neighbouring words: single words are so common across texts that the bounds
of nearly every passage would reach any useful threshold. The score of an item is its BM25
score for the passage's distinct terms, as a share of what the item itself would get, so one
threshold serves short and long items.

Retrieval is block-max WAND. A passage whose terms cannot reach the threshold together, each
at its best, is skipped for a whole block of texts at once; for the others the pivot moves
over the postings, and blocks of items whose best impacts cannot reach the threshold are
skipped. What is retrieved is verified: at least ``OVERLAP`` of the word triples of the
item's question (all but its last quarter) and of its answer (the last quarter) must be in
the passage.

Items of fewer than ``LEAST_WORDS`` words have too few pairs to be ranked; a text that holds
all their words in a row has them, with a score of one.

An index is broadcast and holds about ``INDEX_WORDS`` words of items. A larger benchmark is dealt to
several indexes that are built and asked one after another, the hits so far being written in
between, so the driver holds one. Document frequencies, mean length and length of a passage are
those of the whole benchmark, so hits and scores do not depend on the number of indexes. Defined
results: null and empty texts have no hit; items that are null or have no word are not looked
for; equal rows of the benchmark count once in the statistics and are each reported, repeated rows
of documents each have their hits; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.session import materialize

THRESHOLD = 0.5
OVERLAP = 0.5
LEAST_WORDS = 5
INDEX_WORDS = 2_000_000
ITEM_BLOCK = 16
K1, B = 1.2, 0.75
TRIPLE = 3

_PLAIN = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_c] = _c
for _c in range(65, 91):
    _PLAIN[_c] = _c + 32

HITS = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    data, starts = words.flat(texts)
    data = _PLAIN[data]
    alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))  # first of three bytes
    begins, ends, doc = words.word_bounds(data, starts, np.concatenate([alone, alone + 3]))
    return words.PrefixHashes(data).of(begins, ends), doc


def _pairs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every pair of neighbouring words of a text, and the number of its first word."""
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    return words.joined_hashes(hashes, 2)[inside], inside


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of all items that are ranked: numbers, longest item, and items by term."""

    n_items: int
    n_words: int
    span: int
    frequencies: dict[int, int]


def _terms(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word pairs of items, with the number of items that hold each."""
    own = [np.unique(words.joined_hashes(x, 2)) for x in items if len(x) >= LEAST_WORDS]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)


def _counted(items: list[np.ndarray]) -> tuple[int, int, int]:
    sizes = [len(x) for x in items if len(x) >= LEAST_WORDS]
    return len(sizes), sum(sizes), max(sizes, default=1)


def _split(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    hashes, doc = _hashed(texts)
    return np.split(hashes, np.searchsorted(doc, np.arange(1, len(texts)))) if len(texts) else []


class Index:
    """Postings of test items by term, with the best impact of every term and block of items."""

    def __init__(
        self, ids: list[int], texts: list[str], times: list[int] | None = None, statistics: Statistics | None = None
    ) -> None:
        split = _split(pa.array(texts, pa.string()))
        ranked = [k for k, own in enumerate(split) if len(own) >= LEAST_WORDS]
        short = [k for k, own in enumerate(split) if 0 < len(own) < LEAST_WORDS]
        self.ids = [ids[k] for k in ranked + short]
        self.times = [times[k] if times else 1 for k in ranked + short]
        self.items = [split[k] for k in ranked]
        self.statistics = statistics or Statistics(
            *_counted(split), dict(zip(*[x.tolist() for x in _terms(split)], strict=True))
        )
        self.span = self.statistics.span
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(split[k]) for k in short}):
            numbers = np.array([len(ranked) + j for j, k in enumerate(short) if len(split[k]) == n])
            keys = np.array([words.joined_hashes(split[k], n)[0] for k in short if len(split[k]) == n], np.uint64)
            self.short[n] = np.sort(keys), numbers[np.argsort(keys, kind="stable")]
        self.parts = []
        for own in self.items:
            cut = len(own) - max(TRIPLE, len(own) // 4)
            self.parts.append((self._triples(own[: max(cut, TRIPLE)]), self._triples(own[cut:])))
        self._post()

    @staticmethod
    def _triples(own: np.ndarray) -> np.ndarray:
        return np.unique(words.joined_hashes(own, TRIPLE))

    def _post(self) -> None:
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, own in enumerate(self.items):
            for term, tf in zip(*np.unique(words.joined_hashes(own, 2), return_counts=True), strict=True):
                postings[int(term)].append((i, int(tf)))
        n, mean = self.statistics.n_items, self.statistics.n_words / max(1, self.statistics.n_items)
        impacts: dict[int, list[tuple[int, float]]] = {}
        gains: list[list[float]] = [[] for _ in self.items]
        for term, rows in postings.items():
            seen = self.statistics.frequencies[term]
            idf = math.log(1 + (n - seen + 0.5) / (seen + 0.5))
            impacts[term] = []
            for i, tf in rows:
                gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.items[i]) / mean))
                gains[i].append(gain)
                impacts[term].append((i, gain))
        selves = [math.fsum(own) for own in gains]  # exact, so the order of terms does not matter
        self.vocabulary = np.array(sorted(impacts), np.uint64)
        self.rows: list[list[tuple[int, float]]] = []
        self.blocks: list[dict[int, float]] = []
        for term in self.vocabulary.tolist():
            own = [(i, gain / selves[i]) for i, gain in impacts[term]]
            best: dict[int, float] = {}
            for i, share in own:
                best[i // ITEM_BLOCK] = max(share, best.get(i // ITEM_BLOCK, 0.0))
            self.rows.append(own)
            self.blocks.append(best)
        self.best = np.array([max(b.values()) for b in self.blocks])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that reach the threshold for distinct ``terms``, by block-max WAND."""
        least = threshold - 1e-9
        lists = [[self.rows[t], 0, float(self.best[t]), self.blocks[t]] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[2]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            upto = pivot + 1
            while upto < len(lists) and lists[upto][0][lists[upto][1]][0] == item:
                upto += 1
            if sum(x[3].get(item // ITEM_BLOCK, 0.0) for x in lists[:upto]) < least:
                # nothing before the end of this block, or before the next list begins, can reach it
                goal = (item // ITEM_BLOCK + 1) * ITEM_BLOCK
                if upto < len(lists):
                    goal = min(goal, lists[upto][0][lists[upto][1]][0])
                goal = max(goal, item + 1)
                moved = lists[:upto]
            elif lists[0][0][lists[0][1]][0] == item:
                score = math.fsum(x[0][x[1]][1] for x in lists[:upto])
                if score >= least:
                    found.append((item, score))
                goal, moved = item + 1, lists[:upto]
            else:
                goal, moved = item, lists[:pivot]
            for x in moved:
                rows, at = x[0], x[1]
                while at < len(rows) and rows[at][0] < goal:
                    at += 1
                x[1] = at
            lists = [x for x in lists if x[1] < len(x[0])]
        return found

    def hits(self, texts: pa.Array, threshold: float, overlap: float) -> list[list[dict]]:
        """The verified items of each text of a block, best passage first per item."""
        n = len(texts)
        out: list[dict[int, tuple]] = [{} for _ in range(n)]
        hashes, doc = _hashed(texts)
        self._find_short(hashes, doc, out)
        if self.items:
            self._find_ranked(hashes, doc, n, threshold, overlap, out)
        return [
            [
                {"item_id": self.ids[i], "score": s, "question": q, "answer": a}
                for i, (_, s, q, a) in sorted(x.items()) for _ in range(self.times[i])
            ]
            for x in out
        ]

    def _find_short(self, hashes: np.ndarray, doc: np.ndarray, out: list[dict[int, tuple]]) -> None:
        """Items of few words, wherever all of them follow each other."""
        for size, (keys, numbers) in self.short.items():
            runs = words.joined_hashes(hashes, size)
            inside = np.flatnonzero(doc[: len(runs)] == doc[size - 1 :]) if len(runs) else np.zeros(0, np.int64)
            first = np.searchsorted(keys, runs[inside])
            found = keys[np.minimum(first, len(keys) - 1)] == runs[inside]
            for pair in np.unique(doc[inside[found]] * len(keys) + first[found]).tolist():
                d, at = divmod(pair, len(keys))
                for i in numbers[at : np.searchsorted(keys, keys[at], "right")].tolist():
                    out[d][i] = (2.0, 1.0, 1.0, 1.0)

    def _find_ranked(
        self, hashes: np.ndarray, doc: np.ndarray, n: int, threshold: float, overlap: float, out: list[dict[int, tuple]]
    ) -> None:
        counts = words.count_per_text(doc, n)
        begins = np.cumsum(counts) - counts
        pairs, at = _pairs(hashes, doc)
        term = np.minimum(np.searchsorted(self.vocabulary, pairs), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[term] == pairs)
        term, known, own = term[hit], at[hit], doc[at[hit]]
        piece = (known - begins[own]) // self.span
        last = np.maximum(0, (counts + self.span - 1) // self.span - 2)  # number of the last passage
        base = np.cumsum(last + 1) - (last + 1)
        here, before = piece <= last[own], piece >= 1
        passage = np.concatenate([(base[own] + piece)[here], (base[own] + piece - 1)[before]])
        asked = np.unique(passage * len(self.vocabulary) + np.concatenate([term[here], term[before]]))
        passage, term = asked // len(self.vocabulary), asked % len(self.vocabulary)
        bound = np.bincount(passage, weights=self.best[term], minlength=int(base[-1] + last[-1] + 1) if n else 0)
        firsts = np.searchsorted(passage, np.arange(len(bound) + 1))
        for p in np.flatnonzero(bound >= threshold - 1e-9).tolist():
            found = self.search(term[firsts[p] : firsts[p + 1]].tolist(), threshold)
            if not found:
                continue
            d = int(np.searchsorted(base, p, "right")) - 1
            first = int(begins[d] + (p - base[d]) * self.span)
            triples = words.joined_hashes(hashes[first : min(first + 2 * self.span, begins[d] + counts[d])], TRIPLE)
            for item, score in found:
                question, answer = (float(np.isin(part, triples).mean()) for part in self.parts[item])
                if question >= overlap and answer >= overlap:
                    new = (question + answer, score, question, answer)
                    out[d][item] = max(new, out[d].get(item, new))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items by term, and one row without term for the numbers of a batch."""
    for batch in batches:
        items = _split(batch.column(0))
        terms, seen = _terms(items)
        numbers = _counted(items)
        columns = [terms.view(np.int64).tolist() + [None], seen.tolist() + [0]] + [[0] * len(terms) + [x] for x in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "seen", "items", "words", "span"])


_TERMS = "term long, seen long, items long, words long, span long"


def _indexes(benchmark: DataFrame, index_words: int) -> Iterator[tuple[Index, bool]]:
    """One index per ``index_words`` words of items, and whether it is the last; built when it is asked for.

    The driver gets the items of one index and the frequencies of their terms.
    """
    items = benchmark.where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.coalesce(F.sum(words.n_words(F.col("text"))), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / index_words))
    numbers = counted = None
    if parts > 1:
        counted = materialize(
            items.select("text").mapInArrow(_count_terms, _TERMS).groupBy("term").agg(
                F.sum("seen").alias("seen"), F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("span").alias("span")
            ), "decontamination-terms",
        )
        numbers = counted.where("term IS NULL").select("items", "words", "span").first()
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        statistics = None
        if counted is not None:
            asked = own.select("text").mapInArrow(_count_terms, _TERMS).select("term").distinct()
            seen = counted.join(asked, "term", "left_semi").select("term", "seen").toArrow()
            terms = seen["term"].to_numpy().view(np.uint64).tolist()
            statistics = Statistics(*numbers, dict(zip(terms, seen["seen"].to_pylist(), strict=True)))
        rows = own.orderBy("item_id", "text").collect()
        yield Index(*[[r[c] for r in rows] for c in ("item_id", "text", "times")], statistics), k == parts - 1


def hits_of(text: Column, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Column:
    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64())] + [(c, pa.float64()) for c in ("score", "question", "answer")]))
        found: list[list[dict]] = []
        for first, last in words.blocks(texts):
            found += index.hits(texts.slice(first, last - first), threshold, overlap)
        return pa.array(found, kind)

    return find(text)


def with_hits(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", index_words: int = INDEX_WORDS, **limits
) -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``hits``, the verified items found in its text, by id."""
    out = documents.select(F.struct(*documents.columns).alias("row"), F.array().cast(HITS).alias("hits"))
    for index, last in _indexes(benchmark, index_words):
        if index.ids:
            found = F.coalesce(hits_of(F.col("row")[text], index, **limits), F.array().cast(HITS))
            out = out.select("row", F.concat("hits", found).alias("hits"))
            if not last:
                out = materialize(out, "decontamination-hits")
    return out.select("row", F.array_sort("hits").alias("hits"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents in which no test item was found."""
    clean = with_hits(documents, benchmark, **limits).where(F.size("hits") == 0)
    return clean.select(*[F.col("row")[c].alias(c) for c in documents.columns])
