"""Quality rules: hashed n-gram likelihood ratio between trusted and raw text.

Words and word pairs are hashed to a fixed number of buckets each. The trusted multinomials are
counted over documents that are labelled good and not toxic, the raw ones over all documents.
A document's score is the mean, over its words and pairs, of the logarithm of the ratio of
the two. A few bad words hardly move the mean of a long text, so the lowest mean of two
neighbouring words of the whole text is a second score; a document is kept if both reach
their thresholds. Ratios are whole millionths, so sums are exact and every document has the
same verdict however the rows are divided.

The thresholds are fitted on labelled documents that were held out of the trusted counts, so
they follow the amount of trusted text: the one of the mean on good and bad documents, the one
of the lowest window on good and toxic ones. Documents that fail the base rules (fewer than 10
words, or more than a fifth of the words in 5-word windows that occur twice) are rejected
before.

Defined results: a null text is an empty one (no words, ``base_failed``); labels that are
null, or of null documents, are ignored; a document with several labels is trusted only if
all are good; repeated rows are judged row by row; without any label, or without held-out
rows of both kinds, the thresholds are ``DEFAULT_THRESHOLD`` and ``NO_THRESHOLD``. Lines and windows are compared
by 64-bit hashes inside one text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words

#: Buckets of the hashed words and of the hashed pairs; they bound the model (one weight each) that
#: goes to every task. Words that share a bucket hide each other, so words have the most.
WORD_BUCKETS, PAIR_BUCKETS = 1 << 20, 1 << 16
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
#: Neighbouring words of the lowest mean.
WINDOW = 2
#: Bits of the table of labelled ids that goes to the texts (8 MB), and of one of its rows (Spark's bitmaps).
FILTER_BITS, BITMAP_BITS = 1 << 26, 1 << 15
#: Every so many-th labelled id is held out to fit the threshold.
FOLDS = 5
MILLION = 1_000_000
DEFAULT_THRESHOLD = -100_000
#: Without held-out toxic rows no window is too low.
NO_THRESHOLD = -(1 << 40)
#: Rejecting one percent of good rows outweighs keeping so many percent of bad ones.
GOOD_WEIGHT = 20

_PAIR = np.uint64(1_000_003)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score_sum long, n_grams long, low_sum long"
)


@dataclass(frozen=True)
class Model:
    """Weights per bucket in millionths, and the least mean and window of a kept document."""

    weights: np.ndarray
    threshold: int
    low_threshold: int


def _word_codes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of every word, computed once per distinct word."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    codes = [
        int.from_bytes(hashlib.md5(raw[b:e], usedforsecurity=False).digest()[:4], "big")
        for b, e in zip(begins[first].tolist(), ends[first].tolist(), strict=True)
    ]
    return np.array(codes, np.uint64)[which]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every word, then of every word pair, in the order of the texts."""
    data, starts = words.flat(texts)
    begins, ends, doc = words.word_bounds(data, starts)
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    codes = _word_codes(data, begins, ends, words.PrefixHashes(data).of(begins, ends))
    same = doc[1:] == doc[:-1]
    pairs = (codes[:-1] * _PAIR + codes[1:])[same] % np.uint64(PAIR_BUCKETS) + np.uint64(WORD_BUCKETS)
    return (codes % np.uint64(WORD_BUCKETS)).astype(np.int64), doc, pairs.astype(np.int64), doc[1:][same]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of their rows come after the first."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    several, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = equal
    several[order[1:]] = equal
    several[order[:-1]] |= equal
    return several, later


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of the base rules for every text of a block."""
    data, starts = words.flat(texts)
    n = len(starts) - 1
    begins, ends, doc = words.word_bounds(data, starts)
    prefix = words.PrefixHashes(data)

    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    n_words = words.count_per_text(doc, n)
    word_chars = np.bincount(doc, weights=heads[ends] - heads[begins], minlength=n).astype(np.int64)

    is_break = np.flatnonzero(data == 10)
    line_begins = np.sort(np.concatenate([starts[:-1], is_break + 1]), kind="stable")
    # a break at the end of a text begins a line there, before the next text begins its own
    line_doc = np.repeat(np.arange(n), np.bincount(np.searchsorted(starts, is_break, "right") - 1, minlength=n) + 1)
    line_ends = np.concatenate([line_begins[1:], [len(data)]]) if n else line_begins
    inner = np.concatenate([line_doc[1:] == line_doc[:-1], [False]]) if n else np.zeros(0, bool)
    line_ends = line_ends - inner
    with_word = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends, line_doc = line_begins[with_word], line_ends[with_word], line_doc[with_word]
    own = words.mixed(line_doc.astype(np.uint64) + np.uint64(1))
    _, later = _repeated(words.mixed(prefix.of(line_begins, line_ends) ^ own))

    windows = words.joined_hashes(prefix.of(begins, ends), 5)
    inside = np.flatnonzero(doc[: len(windows)] == doc[4:]) if len(windows) else np.zeros(0, np.int64)
    several, _ = _repeated(words.mixed(windows[inside] ^ words.mixed(doc[inside].astype(np.uint64) + np.uint64(1))))
    cover = np.zeros(len(begins) + 1, np.int64)
    np.add.at(cover, inside[several], 1)
    np.add.at(cover, inside[several] + 5, -1)
    repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]],
        "n_dup_lines": words.count_per_text(line_doc[later], n),
        "n_repeat_words": repeat.astype(np.int64),
        "base_failed": (n_words < 10) | (100 * repeat > 20 * n_words),
    }


def _blocks(texts: pa.Array):
    for first, last in words.blocks(texts):
        yield texts.slice(first, last - first)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    totals = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return totals[ends] - totals[ends - counts]


def _scores(texts: pa.Array, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Summed weights, number of n-grams, and the lowest sum of ``WINDOW`` neighbouring words."""
    word, doc, pair, pair_doc = _grams(texts)
    n_words, n_pairs = words.count_per_text(doc, len(texts)), words.count_per_text(pair_doc, len(texts))
    own = weights[word].astype(np.int64)
    windows = (own[:-1] + own[1:])[doc[1:] == doc[:-1]]  # one per pair
    low = np.zeros(len(texts), np.int64)
    with_pair = np.flatnonzero(n_pairs)
    if len(with_pair):
        low[with_pair] = np.minimum.reduceat(windows, (np.cumsum(n_pairs) - n_pairs)[with_pair])
    return {"score_sum": _sums(own, n_words) + _sums(weights[pair], n_pairs), "n_grams": n_words + n_pairs, "low_sum": low}


def judged(text: Column, weights: np.ndarray) -> Column:
    """A struct of ``SCHEMA`` for each text: base counts, summed weights, number of n-grams and the
    lowest sum of ``WINDOW`` words (zero for a text with fewer)."""

    @F.arrow_udf(SCHEMA)
    def judge(texts: pa.Array) -> pa.Array:
        parts: list[dict[str, np.ndarray]] = []
        for block in _blocks(texts):
            parts.append({**base_counts(block), **_scores(block, weights)})
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if not parts:
            return pa.array([], pa.struct([(n, pa.bool_() if n == "base_failed" else pa.int64()) for n in names]))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[n] for p in parts])) for n in names], names
        )

    return judge(text)


def _known(labels: DataFrame) -> DataFrame:
    """(label_id, role) of the ids with a role: 1 (counted as trusted), or held out: 2 (good), 3 (bad), 4 (toxic only)."""
    rows = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    )
    held = F.pmod("label_id", F.lit(FOLDS)) == 0
    role = (
        F.when((F.col("q") == 1) & (F.col("t") == 0), F.when(held, 2).otherwise(1))
        .when(held & (F.col("q") == 0), 3)
        .when(held, 4)
        .otherwise(0)
    )
    return rows.select("label_id", role.alias("role")).where("role > 0")


def _slot(key: Column) -> Column:
    """The bit of a key; ids of two tables may be numbers of different sizes."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(FILTER_BITS))


def _marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows with ``maybe``: true for every row whose key is among ``ids``, and for few others.

    The slots of all ids are bits of one table of at most ``FILTER_BITS / 8`` bytes, which goes to the rows.
    """
    slots = ids.toDF("id").select(_slot(F.col("id")).alias("slot"))
    bits = slots.groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("slot", F.lit(BITMAP_BITS))).alias("bits")
    )
    slot = _slot(F.col(key))
    at = F.pmod(slot, F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.col("bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    # FILTER_BITS bounds this side
    joined = rows.join(F.broadcast(bits), F.floor(slot / BITMAP_BITS) == F.col("bucket"), "left")
    return joined.select(*rows.columns, maybe.alias("maybe"))


def _roles(documents: DataFrame, labels: DataFrame, roles: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Every text with its role, 0 if that is none of ``roles``. Only texts that may have one are shuffled."""
    known = _known(labels).where(F.col("role").isin(*roles))
    rows = _marked(documents.select(F.col("doc_id").alias("id"), "text"), "id", known.select("label_id"))
    # always by shuffles: the labels have no bound
    found = rows.where("maybe").join(known.hint("merge"), F.col("id") == F.col("label_id"), "left")
    return rows.where("NOT maybe").select("text", F.lit(0).alias("role")).unionAll(
        found.select("text", F.coalesce("role", F.lit(0)).alias("role"))
    )


def _count(batches):
    trusted, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        roles = batch.column(1).to_numpy(zero_copy_only=False)
        first = 0
        for block in _blocks(batch.column(0)):
            good = roles[first : first + len(block)] == 1
            word, doc, pair, pair_doc = _grams(block)
            for buckets, own in ((word, doc), (pair, pair_doc)):
                np.add.at(raw, buckets, 1)
                np.add.at(trusted, buckets[good[own]], 1)
            first += len(block)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(trusted[used]), pa.array(raw[used])], ["bucket", "trusted", "raw"]
    )


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Counts over all documents, weights per bucket, and the thresholds.

    The driver gets one row per bucket and one per held-out score in hundredths.
    """
    counted = (
        _roles(documents, labels, (1,)).mapInArrow(_count, "bucket long, trusted long, raw long")
        .groupBy("bucket")
        .agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))
        .toArrow()  # at most one row per bucket, as whole columns
    )
    trusted, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    used = counted["bucket"].to_numpy()
    trusted[used], raw[used] = counted["trusted"].to_numpy(), counted["raw"].to_numpy()
    weights = np.concatenate([
        _weights(trusted[:WORD_BUCKETS], raw[:WORD_BUCKETS]), _weights(trusted[WORD_BUCKETS:], raw[WORD_BUCKETS:])
    ])

    # the scores of texts that may be held out are joined, not their texts
    held_out = _known(labels).where("role >= 2").withColumnRenamed("label_id", "held_id")
    rows = documents.select(F.col("doc_id").alias("id"), "text")
    maybe = _marked(rows, "id", held_out.select("held_id")).where("maybe")
    scored = maybe.select("id", judged(F.col("text"), weights).alias("j")).join(held_out, F.col("id") == F.col("held_id"))
    mean = F.expr("j.score_sum DIV (greatest(j.n_grams, 1L) * 10000)")
    low = F.expr(f"j.low_sum DIV ({WINDOW} * 10000)")
    held = (
        scored.select("role", F.col("j.base_failed").alias("failed"), F.posexplode(F.array(mean, low)).alias("kind", "score"))
        .groupBy("kind", "score")
        .agg(*[F.count_if((F.col("role") == k) & ~F.col("failed")).alias(f"n{k}") for k in (2, 3, 4)])
        .toPandas()
    )
    means, lows = held[held["kind"] == 0], held[held["kind"] == 1]
    least = _best_cut(*[lows[c].to_numpy() for c in ("score", "n2", "n4")])
    return Model(
        weights, _threshold(*[means[c].to_numpy() for c in ("score", "n2", "n3")]),
        NO_THRESHOLD if least is None else least * 10_000,
    )


def _weights(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Logarithms of the ratio of two smoothed multinomials, in whole millionths."""
    p = np.log((trusted + 1) / (trusted.sum() + len(trusted)))
    q = np.log((raw + 1) / (raw.sum() + len(raw)))
    return np.floor((p - q) * MILLION + 0.5).astype(np.int32)


def _best_cut(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> int | None:
    """The score with the best balance of held-out rows below it, the lowest among equal ones."""
    if not good.sum() or not bad.sum():
        return None
    seen = np.flatnonzero(good + bad)  # not the scores of other rows
    order = seen[np.argsort(score[seen])]
    score, good, bad = score[order].astype(np.int64), good[order].astype(np.int64), bad[order].astype(np.int64)
    below_good, below_bad = np.cumsum(good) - good, np.cumsum(bad) - bad
    gain = below_bad * good.sum() - GOOD_WEIGHT * below_good * bad.sum()
    return int(score[np.argmax(gain)])


def _threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> int:
    """The best cut of means, less a quarter of its size, as text that was never labelled scores
    lower than labelled text."""
    best = _best_cut(score, good, bad)
    return DEFAULT_THRESHOLD if best is None else best * 10_000 - abs(best) * 2_500


def verdict(model: Model) -> Column:
    """Whether a document stays, from its struct ``j`` of :func:`judged`."""
    return F.expr(
        f"NOT j.base_failed AND j.score_sum >= {model.threshold} * j.n_grams"
        f" AND j.low_sum >= {model.low_threshold} * {WINDOW}L"
    )


def with_verdict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` and a struct ``quality`` with ``kept`` in it."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), judged(F.col(text), model.weights).alias("j"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in documents.columns], F.col("j").withField("kept", verdict(model)).alias("quality")
    )
