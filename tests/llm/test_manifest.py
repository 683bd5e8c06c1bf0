"""The Merkle manifest against a tree that is built in one list."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.llm import manifest
from cartloom.llm.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_addresses_are_those_of_the_recursive_layout():
    def lay_out(levels, depth, index):
        if levels == 1:
            return [(depth, index)]
        upper = levels // 2
        out = lay_out(upper, depth, index)
        for i in range(1 << upper):
            out += lay_out(levels - upper, depth + upper, (index << upper) + i)
        return out

    for levels in range(1, 9):
        order = lay_out(levels, 0, 0)
        assert len(set(order)) == (1 << levels) - 1
        for place, (depth, index) in enumerate(order):
            assert manifest.address(levels, depth, np.array([index]))[0] == place


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """The root, and the siblings of every leaf from bottom to top."""
    row, places, siblings = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(row) > 1:
        for own, place in zip(siblings, places, strict=True):
            if (place ^ 1) < len(row):
                own.append(row[place ^ 1])
        row = [_h(*row[i : i + 2]) for i in range(0, len(row), 2)]
        places = [p // 2 for p in places]
    return row[0], siblings


def _leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return _h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def _plain(rows):
    """(doc_id, leaf, subroot, root, proof) of rows of (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row), row[0]))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: _tree([leaf for _, _, leaf, _ in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    root, crown = _tree([trees[lang][0] for lang in order])
    return sorted(
        (str(doc), leaf, trees[lang][0], root, _h(*own, *up))
        for lang, up in zip(order, crown, strict=True)
        for (_, _, leaf, doc), own in zip(sorted(langs[lang], key=lambda x: x[:3]), trees[lang][1], strict=True)
    )


def _found(documents, height):
    columns = [F.col(c) for c in manifest.FIELDS]
    leaves = documents.select("lang", "doc_id", manifest.leaf(columns).alias("leaf"), F.struct("doc_id").alias("payload"))
    checked = manifest.verified(manifest.proofs(leaves, height), F.col("leaf"))
    rows = checked.select("payload.doc_id", *[F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof", "folded")]).collect()
    assert all(r[3] == r[5] for r in rows)
    return sorted((str(r[0]), *r[1:5]) for r in rows)


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_any_height_of_blocks_gives_the_plain_tree(spark, height):
    documents = table(spark, FOLDER, "documents").select(*manifest.FIELDS).where("doc_id % 3 = 0 OR lang = 'en'")
    assert _found(documents, height) == _plain([tuple(r) for r in documents.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 17])
def test_every_number_of_leaves(spark, n):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(n)] + [(100, "s", "de", 1, "alone")] * (n % 2)
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _found(documents, 2) == _plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 5, "x"), (None, "a", None, 5, "y"), (3, "é", "日", 1, "long " * 100_000),
            (5, "a", "en", 3, "tie"), (5, "a", "en", 3, "tie"), (5, "a", "en", 3, "tied"), (-7, "-", "-", -1, "-")]
    odd = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("tree", "position", "block", "count", "digest", "path", "own", "order", "at", "root")]
    )
    assert _found(odd, 2) == _plain(rows)
    assert _found(odd.limit(0), 2) == []


def test_a_changed_row_does_not_fold_to_the_root(spark):
    documents = table(spark, FOLDER, "documents").select(*manifest.FIELDS)
    values = {c: F.col(c) for c in manifest.FIELDS}
    for name, other in (("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" "))), ("source", F.lit(None))):
        leaves = documents.select(
            "lang", "doc_id", manifest.leaf(values.values()).alias("leaf"),
            F.struct(F.unhex(manifest.leaf((values | {name: other}).values())).alias("claimed")).alias("payload"),
        )
        checked = manifest.verified(manifest.proofs(leaves), F.col("payload.claimed"))
        assert checked.where("folded = root").count() == 0
