"""Phrase collocations by SON partitioning.

Texts are cut at punctuation and line ends into pieces and those into words; a phrase is two to
five neighbouring words of a piece, and everything is counted per language.

The documents are ``SHARDS`` shards, each the tasks with one number modulo ``SHARDS``. A shard is
mined completely: its tasks count their phrases, a sum over the tasks gives the counts of the
block, and the phrases that reach the local support stay. The local support is the support times
the shard's share of all words, rounded up. A phrase that reaches the support over all shards
reaches the local support in at least one, as the shares add up to one, so the union over shards
loses nothing. A phrase stays a candidate only if its local counts, and one less than the local
support from each shard that did not report it, can reach the support. Then all candidates are
counted in all documents.

The number of shards is fixed, so that the local support does not fall to one as the documents
grow; a shard of any size is as many tasks as it needs, and a task counts blocks of about
``BLOCK_BYTES`` of text, more only where one text alone is longer. Words are counted first, and
pairs are mined before longer phrases: what holds a rare word or pair is rare. In a block every
word has a number, a phrase of n + 1 words is the number of its first n and that of its last, and
only phrases whose two parts were kept are formed.

Mining needs no texts: phrases travel as hashes, and what was found goes back to the tasks as
bitmaps of fixed size. Phrases that share a hash or a bit are counted in vain, and none is lost;
the counts of the result are by text.

Defined results: a null text is empty, a null language is ``und``; repeated rows count each time;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.operators.ranking import top_k
from cartloom.session import materialize

SUPPORT = 100
LONGEST = 5
SHARDS = 8
BLOCK_BYTES = 4 << 20
#: Phrases that are written out at once.
SLICE = 1 << 16
WORD_BITS, PHRASE_BITS = 1 << 24, 1 << 25
#: A table of at most so many languages, with names of so many characters in all, is broadcast.
BROADCAST_LANGS, BROADCAST_CHARS = 10_000, 1 << 20
COUNTS = "lang string, phrase string, n long"

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _hashes(texts: pa.Array) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for first, last in words.blocks(texts):
        data, starts = words.flat(texts.slice(first, last - first))
        parts.append(words.PrefixHashes(data).of(starts[:-1], starts[1:]))
    return np.concatenate(parts)


def _longer(hashes: np.ndarray, word_hashes: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    return words.mixed(hashes * np.uint64(3) + word_hashes)


class Block:
    """The words of some texts, one space apart, with the piece and the language of each.

    Every different word of a language has a number; ``first`` is a place of each number.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, starts = words.flat(texts)
        kind = _KIND[data]
        inside = kind == 0
        # places of bytes and words; of a text near 2 GB they do not fit into 32 bits
        places = np.int32 if len(data) < 1 << 30 else np.int64
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        bound = inside.copy()
        bound[1:] &= ~inside[:-1] | edge[1:-1]
        begins = np.flatnonzero(bound).astype(places)
        bound[:] = inside
        bound[:-1] &= ~inside[1:] | edge[1:-1]
        sizes = np.flatnonzero(bound).astype(places) + places(1) - begins
        del edge, bound
        doc = (np.searchsorted(starts, begins, "right") - 1).astype(np.int32)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), begins).astype(np.int32) + doc
        named = pc.dictionary_encode(pc.fill_null(langs, "und"))
        self.langs, self.lang = named.dictionary, named.indices.to_numpy()[doc]
        letters = words.lower_ascii(data[inside])
        del data, kind, inside, begins, doc
        self.ends = np.cumsum(sizes + places(1), dtype=places) - places(1)
        self.begins = self.ends - sizes
        held = np.ones(int(self.ends[-1]) + 1 if len(sizes) else 0, bool)
        held[self.ends] = False
        self.data = np.full(len(held), 32, np.uint8)
        self.data[held] = letters
        del held
        coded = pc.dictionary_encode(_strings(letters, sizes))
        key = self.lang.astype(np.int64) * len(coded.dictionary)
        key += coded.indices.to_numpy()
        del letters, sizes, coded
        self.number, self.first, self.count = _numbers(key)

    def __len__(self) -> int:
        return len(self.begins)

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words from the words ``at``."""
        begins, ends = self.begins[at], self.ends[at + n - 1]
        sizes = ends - begins
        before = np.cumsum(sizes) - sizes
        taken = self.data[np.repeat(begins - before, sizes) + np.arange(sizes.sum())]
        return _strings(taken, sizes)

    def word_hashes(self) -> np.ndarray:
        """The hash of every number: of the word and its language."""
        own = [_hashes(self.texts(part, 1)) for part in _slices(self.first)]
        return words.mixed(np.concatenate([np.zeros(0, np.uint64), *own]) ^ _hashes(self.langs)[self.lang[self.first]])


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _slices(at: np.ndarray) -> Iterator[np.ndarray]:
    for first in range(0, len(at), SLICE):
        yield at[first : first + SLICE]


def _numbers(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of every key; a place and the count of each number."""
    number = pc.dictionary_encode(pa.array(key)).indices.to_numpy()
    # numbers are given in the order of their first places
    new = np.empty(len(number), bool)
    new[:1] = True
    new[1:] = number[1:] > np.maximum.accumulate(number)[:-1]
    return number, np.flatnonzero(new), np.bincount(number)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    """Blocks over the batches of a partition with the columns lang and text."""
    parts, size = [], 0
    for batch in batches:
        for first, last in words.blocks(batch.column(1), block_bytes):
            part = batch.slice(first, last - first)
            own = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if parts and size + own > block_bytes:
                yield _block(parts)
                parts, size = [], 0
            parts.append(part)
            size += own
    if parts:
        yield _block(parts)


def _block(parts: list[pa.RecordBatch]) -> Block:
    return Block(pa.concat_arrays([part.column(1) for part in parts]), pa.concat_arrays([part.column(0) for part in parts]))


def _rows(block: Block, at: np.ndarray, n: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, own in zip(_slices(at), _slices(counts), strict=True):
        langs = block.langs.take(pa.array(block.lang[part]))
        columns = [langs, block.texts(part, n).cast(pa.string()), pa.array(own, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


def _levels(block: Block, word_bits: np.ndarray, longest: int, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) of the phrases of 2 to ``longest`` words that ``keep`` takes, level by level."""
    word_hash = block.word_hashes()
    ok = _has(word_bits, word_hash)[block.number]
    # the number of the phrase at each place, and the hash of each number
    parts, hashes, n_words = block.number, word_hash, len(block.first)
    for n in range(2, longest + 1):
        if len(block) < n:
            return
        size = len(block) - n + 1
        # both parts, of all but the last and of all but the first word, were kept
        at = np.flatnonzero(ok[:size] & ok[1 : size + 1] & (block.piece[:size] == block.piece[n - 1 :]))
        if not len(at):
            return
        key = parts[at] * np.int64(n_words)
        key += block.number[n - 1 :][at]
        own, place, count = _numbers(key)
        del key
        place = at[place]
        hashes = _longer(hashes[parts[place]], word_hash[block.number[place + n - 1]])
        kept = keep(n, count, hashes)
        ok, parts = np.zeros(len(block), bool), np.zeros(len(block), np.int32)
        ok[at], parts[at] = kept[own], own
        del own, at
        if kept.any():
            yield n, place[kept], count[kept]


def count_words(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, n) of every word, written once; ``documents`` holds (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_bytes):
            if len(block):
                yield from _rows(block, block.first, 1, block.count)

    return materialize(documents.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrases-words")


def _phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes of phrases of any number of words, as the levels of a block have them."""
    split = pc.split_pattern(phrases, " ")
    starts, word = split.offsets.to_numpy(), _hashes(split.values)
    sizes = np.diff(starts)
    word = words.mixed(word ^ np.repeat(_hashes(langs), sizes))
    out = word[starts[:-1] - starts[0]]
    for n in range(1, int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > n)
        out[more] = _longer(out[more], word[starts[more] - starts[0] + n])
    return out


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, those of the hashes of all (lang, phrase) set; its size does not depend on the table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _phrase_hashes(batch.column(0), batch.column(1)) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["bit"])

    return _bits(phrases.select("lang", "phrase").mapInArrow(hashed, "bit long"), bits)


def _bits(found: DataFrame, bits: int) -> np.ndarray:
    cells = found.groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("own")
    ).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("own").to_numpy()
    return out.view(np.uint8)


def _bit() -> Column:
    return F.col("hash").bitwiseAND(F.lit(PHRASE_BITS - 1)).alias("bit")


def mine(documents: DataFrame, support: int, longest: int, block_bytes: int, word_bits: np.ndarray,
         pair_bits: np.ndarray | None = None) -> DataFrame:
    """(hash) of the candidates: the union over shards of their locally frequent phrases, without those
    that cannot reach the support. Words must be among those set, and with ``pair_bits`` pairs too, which
    are not mined again then."""
    shared = documents.sparkSession.sparkContext.broadcast((word_bits, pair_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_pairs = shared.value
        shard = TaskContext.get().partitionId() % SHARDS
        for block in _blocks(batches, block_bytes):
            found: list[np.ndarray] = []

            def keep(n: int, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
                kept = _has(own_pairs, hashes) if n == 2 and own_pairs is not None else np.ones(len(counts), bool)
                found.append(hashes[kept].view(np.int64))
                return kept

            for n, _, counts in _levels(block, own_words, longest, keep):
                if n == 2 and own_pairs is not None:
                    continue
                for part, own in zip(_slices(found[-1]), _slices(counts), strict=True):
                    columns = [pa.array([shard] * len(part), pa.int32()), pa.array(part), pa.array(own, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "hash", "n"])

    least = -(-support // SHARDS)
    counted = documents.mapInArrow(count, "shard int, hash long, n long").groupBy("shard", "hash").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= least).groupBy("hash").agg(F.sum(F.col("n") - (least - 1)).alias("n"))
    return often.where(F.col("n") + SHARDS * (least - 1) >= support).select("hash")


def count_phrases(documents: DataFrame, word_bits: np.ndarray, phrase_bits: np.ndarray, longest: int, block_bytes: int) -> DataFrame:
    """(lang, phrase, n) of all phrases whose bit is set, counted over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast((word_bits, phrase_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_phrases = shared.value
        for block in _blocks(batches, block_bytes):
            for n, at, counts in _levels(block, own_words, longest, lambda n, counts, hashes: _has(own_phrases, hashes)):
                yield from _rows(block, at, n, counts)

    return documents.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST,
                     block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of the words and phrases that reach the support, and (lang, total) of all words."""
    texts = documents.select("lang", "text")
    counted = count_words(texts, block_bytes)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counted.where(F.col("n") >= support)
    word_bits = bitmap(often, WORD_BITS)
    pair_bits = _bits(mine(texts, support, 2, block_bytes, word_bits).select(_bit()), PHRASE_BITS)
    phrase_bits = pair_bits | _bits(mine(texts, support, longest, block_bytes, word_bits, pair_bits).select(_bit()), PHRASE_BITS)
    phrases = count_phrases(texts, word_bits, phrase_bits, longest, block_bytes)
    return materialize(often.unionByName(phrases.where(F.col("n") >= support)), "phrases-frequent"), totals


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): every frequent phrase at its lowest-scoring cut."""
    split = F.split("phrase", " ")
    phrases = frequent.withColumnRenamed("n", "a").withColumn("words", split).where(F.size("words") > 1)
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"),
    )
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    bound = totals.agg(F.count("*"), F.coalesce(F.sum(F.length("lang")), F.lit(0))).first()
    few = bound[0] <= BROADCAST_LANGS and bound[1] <= BROADCAST_CHARS
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    # counts of up to 14 digits keep the products within 38
    exact = {name: f"cast({name} as decimal(16, 0))" for name in ("a", "total", "l", "r")}
    score = F.expr(f"(1000BD * {exact['a']} * {exact['total']}) div ({exact['l']} * {exact['r']})")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r", F.col("total").alias("n")).alias("cut"))
    return best.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def held_by_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a phrase of one more word around each.

    A phrase of several more words is no more frequent than one in between.
    """
    longer = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    size = F.size("words")
    inner = F.array(_joined(F.slice("words", F.lit(1), size - 1)), _joined(F.slice("words", F.lit(2), size - 1)))
    return longer.select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(documents: DataFrame, k: int = 2000, support: int = SUPPORT, longest: int = LONGEST,
                 share: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best phrases of every language that no longer phrase holds in ``share`` percent of places."""
    frequent, totals = frequent_phrases(documents, support, longest, block_bytes)
    kept = scored(frequent, totals).join(held_by_longer(frequent), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    best = top_k(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], k)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
