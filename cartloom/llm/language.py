"""Language ID: interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, and every run of characters that are not letters becomes one space.
The n-grams of ``ORDER`` characters of all learning texts are counted per language by Spark;
the shorter n-grams and the continuation counts follow from the distinct longer ones. Each
order is one sorted array of n-gram hashes with the interpolated probabilities of all
languages beside it, so a character costs one binary search, and a backoff only where no
language has the n-gram. A text gets the language of the lowest cross-entropy per character,
the first in order among equal ones.

A prediction is ``accepted`` if its cross-entropy is not above what ``QUANTILE`` of the
learning texts of that language reach, times ``SLACK``; all learning texts count.

The model holds every n-gram; the driver collects it once as plain columns and every task holds
it, so its size is bounded by their memory alone. Defined results: a text that is null or has no letter is
``und`` with score 0 and not accepted; learning rows without text, language or id are
ignored; with nothing to learn from every text is ``und``; repeated rows count as often as
they occur; rows without id are never held out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.operators.corpus import numbered
from cartloom.session import materialize

ORDER = 4
QUANTILE, SLACK = 0.995, 1.1
UNKNOWN = "und"
FOLDS = 5

_SPACE = 32
#: Odd random factors; n-gram keys are sums of characters times factors.
_FACTORS = np.random.default_rng(77).integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the number of the text of each; every text begins with spaces."""
    pad = " " * (ORDER - 1)
    lowered = [pad + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    codes = np.where(_letters()[codes], codes, np.uint32(_SPACE))
    # runs of spaces shrink to one; the padding is put back as ORDER - 1 columns by ngrams()
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE) | (doc[1:] != doc[:-1])
    return codes[keep], doc[keep]


def ngrams(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row of ``ORDER`` characters for each character but the first space of its text; spaces before."""
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    out = np.full((len(codes), ORDER), _SPACE, np.uint32)
    out[:, -1] = codes
    index = np.arange(len(codes))
    for back in range(1, ORDER):
        ok = np.flatnonzero(index - back >= start)
        out[ok, ORDER - 1 - back] = codes[ok - back]
    return out[~first]


def keys_of(grams: np.ndarray) -> np.ndarray:
    """One 64-bit key per row of characters."""
    key = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        key += grams[:, -1 - k].astype(np.uint64) * _FACTORS[k]
    return words.mixed(key)


def _count(batches):
    """Distinct n-grams of a partition with their counts, per language."""
    kept: dict[str, list] = {}

    def shrink(parts):
        grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, first, which = np.unique(keys_of(grams), return_index=True, return_inverse=True)
        return [(grams[first], np.bincount(which, weights=counts).astype(np.int64))]

    for batch in batches:
        texts, langs = batch.column(0), np.array(batch.column(1).to_pylist(), object)
        for first, last in words.blocks(texts, _BLOCK):
            block, own = texts.slice(first, last - first).to_pylist(), langs[first:last]
            codes, doc = characters(block)
            which = doc[np.concatenate([[False], doc[1:] == doc[:-1]])] if len(doc) else doc
            grams = ngrams(codes, doc)
            for lang in sorted(set(own.tolist())):
                mine = grams[(own == lang)[which]]
                if not len(mine):
                    continue
                _, at, n = np.unique(keys_of(mine), return_index=True, return_counts=True)
                parts = kept.setdefault(lang, [])
                parts.append((mine[at], n))
                if sum(len(p[0]) for p in parts) > 2_000_000:
                    kept[lang] = shrink(parts)
    for lang, parts in kept.items():
        [(grams, counts)] = shrink(parts)
        wide = grams.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(wide), pa.string()), pa.array(list(wide), pa.list_(pa.int64())), pa.array(counts)],
            ["lang", "gram", "n"],
        )


@dataclass(frozen=True)
class Model:
    """For each order a sorted array of keys beside the probabilities, and of contexts beside the backoffs."""

    langs: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    probs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    backoffs: tuple[np.ndarray, ...]
    limits: tuple[float, ...] = ()


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def probabilities(model: Model, grams: np.ndarray) -> np.ndarray:
    """Probability of the last character of each row after the others, for every language."""
    order = grams.shape[1]
    at, hit = _find(model.keys[order - 1], keys_of(grams))
    out = model.probs[order - 1][at]
    if not hit.all():
        miss = np.flatnonzero(~hit)
        if order == 1:
            out[miss] = model.backoffs[0]
            return out
        place, known = _find(model.contexts[order - 1], keys_of(grams[miss, :-1]))
        weight = np.where(known[:, None], model.backoffs[order - 1][place], np.float32(1))
        out[miss] = weight * probabilities(model, np.ascontiguousarray(grams[miss, 1:]))
    return out


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of the distinct ``grams`` with ``counts (n, languages)``."""
    n_langs = counts.shape[1]
    levels = [(grams, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):  # distinct left extensions per language
        longer, n = levels[0]
        tails = np.ascontiguousarray(longer[:, 1:])
        _, first, which = np.unique(keys_of(tails), return_index=True, return_inverse=True)
        cont = np.stack([np.bincount(which, weights=n[:, k] > 0, minlength=len(first)) for k in range(n_langs)], axis=1)
        levels.insert(0, (tails[first], cont))
    keys, probs, contexts, backoffs = [], [], [], []
    for order, (rows, n) in enumerate(levels, 1):
        one, two = (n == 1).sum(axis=0), (n == 2).sum(axis=0)
        discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95)
        context_keys, which = np.unique(keys_of(np.ascontiguousarray(rows[:, :-1])), return_inverse=True)
        total = np.stack([np.bincount(which, weights=n[:, k], minlength=len(context_keys)) for k in range(n_langs)], axis=1)
        types = np.stack([np.bincount(which, weights=n[:, k] > 0, minlength=len(context_keys)) for k in range(n_langs)], axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = np.where(total > 0, discount * types / total, 1.0)
            own = np.where(total[which] > 0, np.maximum(n - discount, 0) / total[which], 0.0)
        if order == 1:
            uniform = 1.0 / (len(rows) + 1)
            lower, weight = np.full(n.shape, uniform), weight
            backoffs.append((weight[0] * uniform).astype(np.float32))
        else:
            partial = Model((), tuple(keys), tuple(probs), tuple(contexts), tuple(backoffs))
            lower = probabilities(partial, np.ascontiguousarray(rows[:, 1:])).astype(np.float64)
            backoffs.append(weight.astype(np.float32))
        own_keys = keys_of(rows)
        sort = np.argsort(own_keys)
        keys.append(own_keys[sort])
        probs.append((own + weight[which] * lower).astype(np.float32)[sort])
        contexts.append(context_keys)
    return Model((), tuple(keys), tuple(probs), tuple(contexts), tuple(backoffs))


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character under every language, and the number of characters, of each text."""
    codes, doc = characters(texts)
    grams = ngrams(codes, doc)
    which = doc[np.concatenate([[False], doc[1:] == doc[:-1]])] if len(doc) else doc
    bits = -np.log2(probabilities(model, grams))
    n = np.bincount(which, minlength=len(texts))
    total = np.stack([np.bincount(which, weights=bits[:, k], minlength=len(texts)) for k in range(bits.shape[1])], axis=1)
    return total / np.maximum(n, 1)[:, None], n


def _measured(model: Model, text: Column) -> Column:
    """(best, bits, score) of each text: number of its language, its cross-entropy, and 0 to 1."""

    @F.arrow_udf("best int, bits double, score double")
    def measure(texts: pa.Array) -> pa.Array:
        best, least, score = [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0)]
        for first, last in words.blocks(texts, _BLOCK):
            bits, n = entropies(model, texts.slice(first, last - first).to_pylist())
            low = bits.min(axis=1)
            best.append(bits.argmin(axis=1).astype(np.int32))
            least.append(low)
            gap = np.minimum((bits - low[:, None]) * np.minimum(n, 50)[:, None], 60)
            score.append(1 / np.exp2(-gap).sum(axis=1))
        parts = [pa.array(np.concatenate(x)) for x in (best, least, score)]
        return pa.StructArray.from_arrays(parts, ["best", "bits", "score"])

    return measure(text)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(documents: DataFrame) -> Model | None:
    """The model of all rows of ``documents (text, lang)``; None if there is nothing to learn."""
    model = fit(documents)
    return model and with_limits(model, _rows_to_learn(documents).select("lang", _measured(model, F.col("text")).alias("m")))


def _rows_to_learn(documents: DataFrame) -> DataFrame:
    known = documents.where("text IS NOT NULL AND lang IS NOT NULL")
    return known.where(has_letter(F.col("text"))).select("text", "lang")


def with_limits(model: Model, measured: DataFrame) -> Model:
    """``model`` with the limits of acceptance of ``measured (lang, m)``, the measures of all learning texts.

    The exact quantile of every language: texts are put in order by range partitions, and two places
    of each language come to the driver.
    """
    names = F.array(*[F.lit(x) for x in model.langs])
    own = materialize(
        measured.where(F.col("lang") == names[F.col("m.best")]).select(
            F.col("m.best").alias("best"), F.col("m.bits").alias("bits"), F.col("m.bits").alias("value")
        ),
        "language-bits",
    )
    at = F.lit(QUANTILE) * (F.col("n") - 1)
    sizes = own.groupBy(F.col("best").alias("own")).agg(F.count(F.lit(1)).alias("n")).select(
        "own", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part")
    )
    placed = numbered(own, "best", "bits", "value").join(F.broadcast(sizes), F.col("best") == F.col("own"))  # a row per language
    ends = placed.where("position = low OR position = high").groupBy("best", "part").agg(
        F.min("value").alias("first"), F.max("value").alias("last")
    )
    found = {row.best: row.first_ + row.part * (row.last_ - row.first_) for row in ends.toDF("best", "part", "first_", "last_").collect()}
    limits = tuple(found[k] * SLACK if k in found else float("inf") for k in range(len(model.langs)))
    return replace(model, limits=limits)


def fit(documents: DataFrame) -> Model | None:
    """The model of :func:`learn` without the limits of acceptance."""
    rows = _rows_to_learn(documents)
    counted = materialize(
        rows.mapInArrow(_count, "lang string, gram array<long>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "language-ngrams",
    )
    letters = [F.col("gram")[k].cast("int").alias(f"c{k}") for k in range(ORDER)]
    table = counted.select("lang", "n", *letters).toPandas()
    if not len(table):
        return None
    langs = tuple(sorted(table["lang"].unique()))
    number = {lang: k for k, lang in enumerate(langs)}
    grams = table[[f"c{k}" for k in range(ORDER)]].to_numpy().astype(np.uint32)
    _, first, which = np.unique(keys_of(grams), return_index=True, return_inverse=True)
    counts = np.zeros((len(first), len(langs)))
    counts[which, table["lang"].map(number).to_numpy()] = table["n"].to_numpy()
    model = kneser_ney(np.ascontiguousarray(grams[first]), counts)
    return replace(model, langs=langs)


def predict(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and a struct ``language``: lang, score, bits, accepted."""
    if model is None:
        return documents.select("*", _unknown().alias("language"))
    # the inner select holds the columns in a struct, so that none of them clashes with ``m``
    rows = documents.select(F.struct(*documents.columns).alias("row"), _measured(model, F.col(text)).alias("m"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in documents.columns], _found(model, F.col("m"), has_letter(F.col("row")[text])).alias("language")
    )


def _found(model: Model, m: Column, letter: Column) -> Column:
    names, limits = F.array(*[F.lit(x) for x in model.langs]), F.array(*[F.lit(x) for x in model.limits])
    found = F.struct(
        names[m["best"]].alias("lang"), m["score"].alias("score"), m["bits"].alias("bits"),
        (m["bits"] <= limits[m["best"]]).alias("accepted"),
    )
    return F.when(letter, found).otherwise(_unknown())


def _unknown() -> Column:
    return F.struct(
        F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"),
        F.lit(False).alias("accepted"),
    )


def learn_and_predict(documents: DataFrame, learning: Column) -> DataFrame:
    """``doc_id`` of ``documents (doc_id, text, lang)`` and the ``language`` of :func:`predict`.

    The model and its limits are those of the rows where ``learning`` holds, which reads ``doc_id``
    alone. Each text is measured once, for its prediction and for the limits.
    """
    model = fit(documents.where(learning).select("text", "lang"))
    if model is None:
        return documents.select("doc_id", _unknown().alias("language"))
    measured = materialize(
        documents.select("doc_id", "lang", has_letter(F.col("text")).alias("letter"), _measured(model, F.col("text")).alias("m")),
        "language-measured",
    )
    model = with_limits(model, measured.where(learning & F.col("letter") & F.col("lang").isNotNull()).select("lang", "m"))
    return measured.select("doc_id", _found(model, F.col("m"), F.col("letter")).alias("language"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a fifth, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))
