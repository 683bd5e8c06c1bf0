"""Text corpora: line chunks, nested blocks, keyword search and ranking, ordered joins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.text import file_stem, file_suffix, split_lines, strip
from cartloom.operators.gram_index import GramIndex
from cartloom.operators.matching import term_hits, term_matches
from cartloom.operators.ranking import top_k
from cartloom.session import materialize

PIECE = 4096


def _with_lines(docs: DataFrame) -> DataFrame:
    """``path`` and the array of lines of every text."""
    return docs.select("path", split_lines(F.col("text")).alias("lines"))


def _chunk(path: Column, start: Column, end: Column, symbol: Column, kind: Column) -> Column:
    lines = F.slice(F.col("lines"), start, end - start + 1)
    return F.struct(
        path.alias("path"),
        symbol.alias("symbol"),
        kind.alias("kind"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        F.array_join(lines, "\n").alias("text"),
    )


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def chunk_lines(docs: DataFrame, step: int = fixed.CHUNK_LINES) -> DataFrame:
    """Every text ``(path, text)`` in chunks of ``step`` lines; line numbers are 1-based, inclusive.

    A text is cut inside its own row, so nothing is shuffled.
    """
    path, total = F.col("path"), F.size("lines")
    chunks = F.transform(
        F.sequence(F.lit(1), total, F.lit(step)),
        lambda start: _chunk(
            path,
            start,
            F.least(start + step - 1, total),
            F.concat(_file_name(path), F.lit(":"), start.cast("string")),
            F.lit("file"),
        ),
    )
    return _with_lines(docs.where(F.length("text") > 0)).select(F.inline(chunks))


def head_chunk(docs: DataFrame, head: int = fixed.HEAD_LINES) -> DataFrame:
    """One chunk per text with its first ``head`` lines, as kept for a file without headings."""
    return _with_lines(docs).select(_head(head).alias("chunk")).select("chunk.*")


def _head(head: int) -> Column:
    path = F.col("path")
    end = F.least(F.size("lines"), F.lit(head))
    return _chunk(path, F.lit(1), end, _file_name(path), F.lit("file"))


def heading_lines(docs: DataFrame, pattern: str = fixed.BLOCK_HEADING) -> DataFrame:
    """Lines that open a block: ``(doc, last, pos, level, name, word)``.

    ``pattern`` has three groups: the indentation, the opening word and the name. ``last``
    is the number of lines of the document.
    """
    line, java = F.col("line"), "(?U)" + pattern
    return (
        _with_lines(docs)
        .select(
            F.col("path").alias("doc"),
            F.size("lines").alias("last"),
            F.posexplode("lines").alias("at", "line"),
        )
        .where(F.col("line").rlike(java))
        .select(
            "doc",
            "last",
            (F.col("at") + 1).alias("pos"),
            F.length(F.regexp_extract(line, java, 1)).alias("level"),
            F.regexp_extract(line, java, 3).alias("name"),
            F.regexp_extract(line, java, 2).alias("word"),
        )
    )


def segment_blocks(headings: DataFrame, lasts: DataFrame, piece: int = PIECE) -> DataFrame:
    """The block of every heading: ``(doc, pos, level, name, end, symbol)``.

    ``headings`` holds ``(doc, pos, level, name)`` with one heading per position,
    ``lasts`` the last position of every document as ``(doc, last)``. A block ends
    before the next heading of its own or a smaller level; ``symbol`` joins the names of
    the enclosing headings and its own by dots.

    Every heading is repeated once per level of its document. At level L the headings of
    level up to L open or close blocks, and running values name the one open before and
    the one that comes next. Positions are cut into pieces whose summaries carry these
    values across, so a document that holds most of the lines is spread over tasks.
    """
    headings = headings.select("doc", "pos", "level", "name")
    levels = headings.select("doc", F.col("level").alias("at")).distinct()
    spread = headings.join(levels, "doc").withColumns(
        {
            "piece": F.floor(F.col("pos") / piece),
            "opener": F.when(F.col("level") <= F.col("at"), F.struct("pos", "level", "name")),
        }
    )
    keys = ["doc", "at"]
    inside = Window.partitionBy(*keys, "piece")
    local = spread.withColumns(
        {
            "open_here": _latest("opener", inside.orderBy("pos")),
            "next_here": _latest("opener", inside.orderBy(F.desc("pos")))["pos"],
        }
    )
    whole = Window.partitionBy(*keys)
    carried = (
        spread.groupBy(*keys, "piece")
        .agg(F.max("opener").alias("final"), F.min("opener").alias("first"))
        .select(
            *keys,
            "piece",
            _latest("final", whole.orderBy("piece")).alias("open_before"),
            _latest("first", whole.orderBy(F.desc("piece")))["pos"].alias("next_after"),
        )
    )
    placed = local.join(carried, [*keys, "piece"]).select(
        "doc",
        "pos",
        "level",
        "name",
        "at",
        F.coalesce("open_here", "open_before").alias("open"),
        F.coalesce("next_here", "next_after").alias("next"),
    )
    encloses = (F.col("at") < F.col("level")) & (F.col("open")["level"] == F.col("at"))
    own = F.col("at") == F.col("level")
    parents = F.sort_array(
        F.collect_list(
            F.when(
                encloses,
                F.struct(F.col("open")["pos"].alias("pos"), F.col("open")["name"].alias("name")),
            )
        )
    )
    return (
        placed.groupBy("doc", "pos", "level", "name")
        .agg(F.max(F.when(own, F.col("next"))).alias("next"), parents.alias("parents"))
        .join(lasts.select("doc", "last"), "doc")
        .select(
            "doc",
            "pos",
            "level",
            "name",
            F.coalesce(F.col("next") - 1, F.col("last")).alias("end"),
            F.array_join(
                F.concat(F.transform("parents", lambda p: p["name"]), F.array("name")), "."
            ).alias("symbol"),
        )
    )


def _latest(column: str, window) -> Column:
    """The last value before the current row that is not null."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.last(column, ignorenulls=True).over(before)


_HEAD = "struct<pos: int, level: int, name: string, word: string>"


def _row_headings(pattern: str) -> Column:
    """The lines of a row's text that open a block, in order."""
    java = "(?U)" + pattern
    heads = F.transform(
        "lines",
        lambda line, at: F.when(
            line.rlike(java),
            F.struct(
                (at + 1).cast("int").alias("pos"),
                F.length(F.regexp_extract(line, java, 1)).alias("level"),
                F.regexp_extract(line, java, 3).alias("name"),
                F.regexp_extract(line, java, 2).alias("word"),
            ),
        ),
    )
    return F.array_compact(heads).cast(f"array<{_HEAD}>")


def _blocks_of(heads: pa.Array, lasts: pa.Array) -> pa.Array:
    """Of every heading the names around it and its own, joined by dots, and the last line of its block.

    One pass over the headings: the open ones are a stack of growing levels, and a heading closes
    those of its own or a larger level.
    """
    symbols, ends = [], []
    bounds, held = heads.offsets.to_numpy(), heads.values
    levels, starts = held.field("level").to_pylist(), held.field("pos").to_pylist()
    names = held.field("name").to_pylist()
    for first, stop, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lasts.to_pylist(), strict=True):
        open_heads: list[int] = []
        symbols += names[first:stop]
        ends += [last] * (stop - first)
        base = len(symbols) - stop
        for at in range(first, stop):
            while open_heads and levels[open_heads[-1]] >= levels[at]:
                ends[base + open_heads.pop()] = starts[at] - 1
            if open_heads:
                symbols[base + at] = f"{symbols[base + open_heads[-1]]}.{names[at]}"
            open_heads.append(at)
    found = pa.StructArray.from_arrays([pa.array(symbols, pa.string()), pa.array(ends, pa.int32())], names=["symbol", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), found)


def chunk_blocks(
    docs: DataFrame,
    pattern: str = fixed.BLOCK_HEADING,
    kinds: Sequence[tuple[str, str]] = fixed.BLOCK_KINDS,
    head: int = fixed.HEAD_LINES,
) -> DataFrame:
    """Texts cut at their headings; a text without any gives its head chunk.

    A text is cut inside its own row, so nothing is shuffled, in time that grows with its lines and
    headings. For headings that come as rows see :func:`segment_blocks`.
    """
    path = F.col("path")
    heads = _with_lines(docs).withColumn("heads", _row_headings(pattern))
    blocks = F.zip_with(
        "heads",
        F.arrow_udf(_blocks_of, "array<struct<symbol: string, end: int>>")("heads", F.size("lines")),
        lambda head, block: F.struct(head.alias("head"), block.alias("block")),
    )

    def cut(block: Column) -> Column:
        opened, block = block["head"], block["block"]
        kind = F.lit(None).cast("string")
        for word, label in kinds:
            kind = F.when(opened["word"] == word, F.lit(label)).otherwise(kind)
        return _chunk(path, opened["pos"], block["end"], block["symbol"], kind)

    found = heads.select("path", "lines", blocks.alias("blocks"))
    chunks = F.when(F.size("blocks") > 0, F.transform("blocks", cut)).otherwise(F.array(_head(head)))
    return found.select(F.inline(chunks))


def index_files(docs: DataFrame) -> DataFrame:
    """Chunks of a file tree: code files at their headings, other files by lines."""
    is_code = file_suffix(F.col("path")) == ".py"
    return chunk_blocks(docs.where(is_code)).unionByName(chunk_lines(docs.where(~is_code)))


def select_chunks(
    chunks: DataFrame,
    prefixes: Sequence[str] = (),
    suffix: str = "",
    kinds: Sequence[str] = (),
) -> DataFrame:
    """Chunks whose path starts with one of ``prefixes`` and ends with ``suffix``, of given kinds."""
    if prefixes:
        chunks = chunks.where(_starts_with(F.col("path"), prefixes))
    if suffix:
        chunks = chunks.where(F.endswith(F.col("path"), F.lit(suffix)))
    return chunks.where(F.col("kind").isin(*kinds)) if kinds else chunks


def _starts_with(path: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(path, F.lit(prefix))
    return found


def counts(df: DataFrame, by: str) -> DataFrame:
    """One row: all rows, and distinct values of ``by``."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(by).alias("distinct_" + by))


FILE_ORDER = ("path", "start_line", "symbol")


def grep(terms: DataFrame, chunks: DataFrame | GramIndex, k: int = 25) -> DataFrame:
    """The first ``k`` chunks, in file order, whose text holds the term, ignoring case.

    ``chunks`` may be an index with the keys FILE_ORDER over the column ``text``.
    """
    indexed = isinstance(chunks, GramIndex)
    hits = chunks.matches(terms) if indexed else term_matches(terms, chunks, FILE_ORDER, "text")
    return top_k(hits, ["term"], [F.asc(column) for column in FILE_ORDER], k)


def find_symbol(terms: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Chunks whose symbol is the term; if there is none, chunks whose symbol contains it.

    A blank term finds nothing. Only terms without an exact match go to the substring
    search.
    """
    asked = terms.select("term", F.lower(strip(F.col("term"))).alias("name")).where(
        F.col("name") != ""
    )
    asked = asked.distinct()
    order = [F.asc(column) for column in FILE_ORDER]
    symbols = chunks.select(*FILE_ORDER, F.lower("symbol").alias("name"))
    names = symbols.select("name").distinct()
    exact = asked.join(symbols, "name")
    missing = asked.join(names, "name", "left_anti")
    partial = (
        term_matches(missing.select(F.col("name").alias("term")), names, ["name"], "name")
        .select(F.col("term").alias("wanted"), "name")
        .join(symbols, "name")
    )
    tail = (
        missing.withColumnRenamed("name", "wanted")
        .join(top_k(partial, ["wanted"], order, k).drop("rank"), "wanted")
    )
    tiers = (
        top_k(exact, ["term"], order, k)
        .withColumn("match", F.lit("exact"))
        .unionByName(top_k(tail, ["term"], order, k).withColumn("match", F.lit("partial")), True)
    )
    return tiers.select("term", "rank", "match", *FILE_ORDER)


def rank_chunks(
    terms: DataFrame,
    chunks: DataFrame | GramIndex,
    text_points: int = fixed.RANK_TEXT,
    symbol_points: int = fixed.RANK_SYMBOL,
    prefix_rules: Sequence[tuple[Sequence[str], int]] = (),
    k: int = 5,
) -> DataFrame:
    """The ``k`` best chunks per term with a positive score.

    A chunk scores points for the term in its text and in its symbol. ``prefix_rules`` add
    points, or take some off, by the start of its path whatever the term. Points for the term are not negative, so of the chunks
    without the term only the ``k`` best by path can be in any result; they are found
    once and added to every term. ``chunks`` may be an index with the keys FILE_ORDER over the
    columns ``text`` and ``symbol``; its texts are read for the chunks that are best by path only.
    """
    if text_points < 0 or symbol_points < 0:
        raise ValueError("points for a match must not be negative")
    order = [F.desc("score"), *[F.asc(column) for column in FILE_ORDER]]
    base = F.lit(0)
    for prefixes, points in prefix_rules:
        base = base + F.when(_starts_with(F.lower("path"), prefixes), points).otherwise(0)
    asked = terms.select("term").where(F.col("term").isNotNull()).distinct()
    keys = list(FILE_ORDER)

    indexed = isinstance(chunks, GramIndex)
    hits = chunks.hits(asked) if indexed else term_hits(asked, chunks, keys, ["text", "symbol"])
    points = sum(
        F.when(F.col("found")[at], gain).otherwise(0) for at, gain in enumerate((text_points, symbol_points))
    )
    # a chunk scores in its own row, so chunks with equal or null keys do not run together
    matches = hits.select("term", *keys, (points + base).cast("bigint").alias("score"))
    held = chunks.texts().select("part", "place", *keys) if indexed else chunks
    best = held.withColumn("score", base.cast("bigint")).where(F.col("score") > 0).orderBy(*order).limit(k)
    if indexed:
        best = best.join(chunks.texts().select("part", "place", "text"), ["part", "place"])
    favoured = best.agg(F.collect_list(F.struct(*keys, "score", "text")).alias("favoured"))
    # One row that holds at most k chunks; those with the term are already scored.
    held = F.lit(False)
    for column in ("text", "symbol"):
        held = held | F.coalesce(F.contains(F.lower(column), F.lower("term")), F.lit(False))
    offered = asked.withColumn("favoured", favoured.scalar()).select("term", F.inline("favoured"))
    scored = matches.unionByName(offered.where(~held).drop("text")).where(F.col("score") > 0)
    return top_k(scored, ["term"], order, k)


def numbered(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """``(key, position, *columns)``: rows counted from 0 in every group, by ``order``, equal ones by ``columns``.

    Rows are range-partitioned, sorted and written with the place they have there; a group that
    spans several partitions is put together from the row counts of its pieces, so no task
    holds a whole group.
    """
    group = [key, "piece"]
    placed = materialize(
        df.select(key, order, *columns)
        .repartitionByRange(key, order)
        .sortWithinPartitions(key, order, *columns)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("piece", F.shiftright("place", 33)),
        "numbered",
    )
    pieces = placed.groupBy(*group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that Spark knows their size and does not move all rows to meet a few offsets
    offsets = materialize(
        pieces.select(
            F.col(key).alias("own_key"), F.col("piece").alias("own_piece"), "first",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        ),
        "offsets",
    )
    same = F.col(key).eqNullSafe(F.col("own_key")) & (F.col("piece") == F.col("own_piece"))
    return placed.join(offsets, same).select(
        key, (F.col("place") - F.col("first") + F.col("offset")).alias("position"), *columns
    )


def concat_ordered(
    df: DataFrame, key: str, order: str, text: str, sep: str = "\n", part_rows: int = 10000
) -> DataFrame:
    """The texts of every group in order, as ``(key, part, text)``.

    The first ``part_rows`` rows of a group make part 0, and so on, whatever the values of
    ``order``, so that a group of any size is a series of bounded strings; joining the parts in
    order by ``sep`` gives the whole. Rows with equal ``order`` are in the order of their texts.
    """
    part = F.floor(F.col("position") / part_rows).cast("bigint").alias("part")
    pieces = F.sort_array(F.collect_list(F.struct("position", F.col(text).alias("piece"))))
    return (
        numbered(df, key, order, text)
        .groupBy(key, part)
        .agg(pieces.alias("pieces"))
        .select(
            key, "part", F.array_join(F.transform("pieces", lambda p: p["piece"]), sep).alias("text")
        )
    )


def module_names(chunks: DataFrame) -> DataFrame:
    """Chunks with ``module``, the stem of their path."""
    return chunks.withColumn("module", file_stem(F.col("path")))
