import json
import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cartloom import schemas
from cartloom.operators import corpus, lookup
from cartloom.plans import promote as promotion
from cartloom.plans.retrieve import build_store
from cartloom.session import materialize, scratch_path, scratch_scope, shared_dir
from cartloom.plans import index as indexing
from cartloom.sources import documents, roles, runlog, tables, text
from cartloom.streaming.requests import serve


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "lines.csv").write_text(
        "order_id,product_id,customer_id,order_ts,quantity\n"
        "1,2,3,2020-01-02 03:04:05,1.5\n"
        "x,2,3,2020-01-02 03:04:05,1.5\n"
        "2,2,3,,\n"
    )
    good, bad = tables.split_rejects(tables.read_transactions(spark, str(tmp_path)))
    assert good.schema.fieldNames() == schemas.ORDER_LINES.fieldNames()
    assert sorted(r.order_id for r in good.collect()) == [1, 2]
    assert [r._corrupt_record for r in bad.select("_corrupt_record").collect()] == ["x,2,3,2020-01-02 03:04:05,1.5"]
    assert [r.quantity for r in good.select("quantity").orderBy("quantity").collect()] == [None, 1.5]
    assert good.count() == 2
    dropped = tables.read_transactions(spark, str(tmp_path), mode="DROPMALFORMED")
    assert sorted(r.order_id for r in dropped.select("*").collect()) == [1, 2]


def test_schema_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "product_id int, text string")
    with pytest.raises(ValueError, match="product_id bigint"):
        schemas.require(df, schemas.DOCUMENTS)


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(5).withColumn("s", F.lit("a"))
    copy = materialize(df, "five")
    assert copy.schema.fieldNames() == ["id", "s"] and copy.count() == 5
    assert len(copy.inputFiles()) > 0


def test_documents_and_vectors(spark, catalogue, tmp_path):
    products, velocity, _ = catalogue
    vecs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (6, [0.0, 1.0])], "product_id long, embedding array<float>"
    )
    docs_path, vec_path = str(tmp_path / "docs"), str(tmp_path / "v1")
    report = build_store(products, velocity, vecs, docs_path, vec_path).first()
    assert (report.rows_written, report.rows_found, report.complete) == (2, 2, True)
    documents.write_documents(lookup.build_documents(products.limit(3), velocity), docs_path)
    assert documents.read_documents(spark, docs_path).count() == 3
    with pytest.raises(AnalysisException):
        documents.rebuild_vectors(documents.read_documents(spark, docs_path), vecs, vec_path)


def test_text_tree(spark, tmp_path):
    files = {
        "a.py": "def f(:\n", "sub dir/b+c.MD": "é\r\nx", "site/skip.md": "no", "sub/site/keep.md": "yes",
        "pic.png": "no", "d.sql": "", "venv/x.py": "no",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    got = {r.path: r.text for r in text.read_text_tree(spark, str(tmp_path)).collect()}
    assert got == {
        "a.py": "def f(:\n", "sub dir/b+c.MD": "é\r\nx", "sub/site/keep.md": "yes", "d.sql": "",
    }


def test_hidden_and_empty_files_are_read(spark, tmp_path):
    want = {
        "pkg/__init__.py": "", "pkg/_private.py": "x = 1\n", "pkg/mod.py": "y\n", ".github/build.yml": "on: push\n",
        "_build/é+ b.md": "text é", "pkg/empty.py": "", "pkg/part=1/m.md": "m",
    }
    for name, body in {**want, "__pycache__/c.py": "no", "pkg/_SUCCESS": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    got = [tuple(r) for r in text.read_text_tree(spark, str(tmp_path)).select("path", "text").collect()]
    assert sorted(got) == sorted(want.items())


def test_scratch_of_a_scope_is_deleted(spark):
    with scratch_scope(spark):
        inside = materialize(spark.range(3), "inside")
        path = inside.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert materialize(spark.range(3), "outside").count() == 3


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_chunks_round_trip(spark, tmp_path, file_format):
    docs = spark.createDataFrame([("a.md", 'l1\n"l2"\tü'), ("b.md", "x")], "path string, text string")
    chunks = corpus.chunk_lines(docs, 1)
    text.write_chunks(chunks, str(tmp_path / "index"), file_format)
    back = text.read_chunks(spark, str(tmp_path / "index"), file_format)
    assert back.schema == schemas.CHUNKS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect()))


def test_grouped_text_keeps_order(spark, tmp_path):
    """The files of a group, in name order, are its lines in order, however it was split."""
    rng = random.Random(8)
    rows = [("hot one", i, f"line {i}") for i in range(3000)] + [("small", i, f"s{i}") for i in range(9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "module string, pos int, body string").repartition(6)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_grouped_text(df, "module", "pos", "body", path, part_rows=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for module, prefix, n in (("hot one", "line ", 3000), ("small", "s", 9)):
        folder = os.path.join(path, f"module={module}")
        parts = sorted(os.listdir(folder))
        assert parts == [f"part={i:09d}" for i in range(-(-n // 1000))]
        files = [[f for f in os.listdir(os.path.join(folder, part)) if f.startswith("part-")] for part in parts]
        assert all(len(names) == 1 for names in files)
        body = "".join(open(os.path.join(folder, part, names[0])).read() for part, names in zip(parts, files))
        assert body.splitlines() == [f"{prefix}{i}" for i in range(n)]

def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """Hidden and empty files of many folders are found without asking the driver for each file."""

    def fail(*args):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(text, "_listed_by_driver", fail)
    want = {f"d{i}/sub é+/{name}": body for i in range(70) for name, body in (("_a b.md", "é"), ("empty.md", ""), ("c.md", "c"))}
    want |= {"top.md": "", ".git/x.md": "y"}
    for name, body in want.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    got = [tuple(r) for r in text.read_text_tree(spark, str(tmp_path)).select("path", "text").collect()]
    assert sorted(got) == sorted(want.items())


def test_small_groups_are_written_by_tasks(spark, tmp_path):
    """A file per group under the names that Spark gives to folders, nulls included, and no commit of each."""
    keys = [None, "", "a/b=c %1", "é ü", *[f"k{i}" for i in range(50)]]
    rows = [(key, i, None if i == 1 else f"{key} {i}\té") for key in keys for i in range(3)]
    df = spark.createDataFrame(rows, "module string, pos int, body string").repartition(3)
    path = str(tmp_path / "out")
    text.write_grouped_text(df, "module", "pos", "body", path, part_rows=2)
    old = str(tmp_path / "old")
    df.where("module <> ''").select("module", "body").write.partitionBy("module").text(old)
    own = {name for name in os.listdir(path) if name.startswith("module=")}
    assert own == {name for name in os.listdir(old) if name.startswith("module=")} | {"module=__HIVE_DEFAULT_PARTITION__"}
    names = sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)
    assert len(names) == 2 * len(keys) and not [n for n in names if n.endswith(".crc")]
    read = {r.path: r.text for r in text.read_text_tree(spark, path, (".txt",)).collect()}
    assert read["module=k7/part=000000000/part-00000.txt"] == "k7 0\té\n\n"
    assert read["module=a%2Fb%3Dc %251/part=000000001/part-00000.txt"] == "a/b=c %1 2\té\n"
    assert read["module=__HIVE_DEFAULT_PARTITION__/part=000000001/part-null.txt"] == "None 2\té\n"
    assert os.listdir(tmp_path) and not [n for n in os.listdir(tmp_path) if n.startswith("_out")]
    with pytest.raises(AnalysisException):
        text.write_grouped_text(df, "module", "pos", "body", path)



def promoted(spark, catalogue, queries):
    products, velocity, affinity = catalogue
    hits = spark.createDataFrame([], "query_id string, rank int, product_id long")
    return promotion.promote(queries, hits, products, velocity, affinity)


def test_run_log(spark, catalogue, tmp_path):
    queries = spark.createDataFrame(
        [("a", "eggs"), ("b", "zzz")], "query_id string, user_query string"
    )
    result = materialize(promoted(spark, catalogue, queries), "result")
    path = str(tmp_path / "log")
    runlog.append_run_log(runlog.run_log(result, "b1", latency_ms=F.lit(12.5)), path)
    runlog.append_run_log(
        runlog.run_log(result, "b2", debug=True, error=F.lit("e" * 600)), path
    )
    rows = {(r.query, r.debug): r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 4 and len({r.run_id for r in rows.values()}) == 4
    eggs = rows[("eggs", False)]
    assert (eggs.status, eggs.bundle_count, eggs.anchor_product_id) == ("ok", 1, 1)
    assert eggs.anchor_name == "Large Eggs" and eggs.latency_ms == 12.5
    payload = json.loads(eggs.payload)
    assert payload["query"] == "eggs" and payload["bundles"][0]["add_ons"][0]["product_id"] == 2
    failed = rows[("zzz", True)]
    assert failed.status == "error" and failed.error_message == "e" * 500
    assert failed.bundle_count == 0 and failed.anchor_name is None


def test_request_stream(spark, catalogue, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", "eggs"), ("b", "zzz")], "query_id string, user_query string").write.json(
        str(source)
    )
    stream = spark.readStream.schema("query_id string, user_query string").json(str(source))
    results, log = str(tmp_path / "results"), str(tmp_path / "log")
    run = serve(
        stream,
        lambda queries: promoted(spark, catalogue, queries),
        results,
        log,
        str(tmp_path / "checkpoint"),
        availableNow=True,
    )
    run.awaitTermination()
    assert {(r.query_id, r.status) for r in spark.read.parquet(results).collect()} == {
        ("a", "ok"), ("b", "no_anchor"),
    }
    assert spark.read.parquet(log).count() == 2


def test_index_of_a_tree_and_its_report(spark, tmp_path):
    root = tmp_path / "tree"
    for name, content in {"a/code.py": "def f(x):\n    pass\n", "a/empty.py": "", "b/.note.md": "hi\nyou", "site/x.md": "skipped", "c.bin": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    report = indexing.build_index(spark, str(root), str(tmp_path / "index"), (".py", ".md"), skip_prefixes=("site/",))
    assert report.first().asDict() == {"files": 3, "empty_files": 1, "chunks": 3}
    got = {(r.path, r.symbol, r.kind) for r in text.read_chunks(spark, str(tmp_path / "index")).collect()}
    assert got == {("a/code.py", "f", "function"), ("a/empty.py", "empty.py", "file"), ("b/.note.md", ".note.md:1", "file")}
    (root / "c.bin").rename(tmp_path / "c.bin")
    none = indexing.build_index(spark, str(root), str(tmp_path / "none"), (".nothing",))
    assert none.first().asDict() == {"files": 0, "empty_files": 0, "chunks": 0}


def test_a_warehouse_writes_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    """A query of demand needs neither the pairs of all baskets nor their neighbours."""
    rows = {
        "part": ([(1, "old bolt", "Brand#12", "SMALL"), (2, "new gear", "Brand#3", "LARGE")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "supplier": ([(1, "s", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "orders": ([(1, 7, "2024-01-01"), (2, 7, "2024-01-02")], "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": ([(1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0)], "l_orderkey long, l_partkey long, l_quantity double"),
    }
    for name, (held, schema) in rows.items():
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    written = []
    monkeypatch.setattr(roles, "read_table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}.parquet"))
    monkeypatch.setattr(roles, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    house = roles.warehouse(spark, str(tmp_path), "part")
    assert written == []
    assert sorted((r.product_id, r.total_orders) for r in house.velocity.collect()) == [(1, 2), (2, 1)]
    assert house.velocity is roles.warehouse(spark, str(tmp_path), "part").velocity and written == ["velocity-part"]
    assert [tuple(r) for r in house.affinity.collect()] == [(1, 2, 1)]
    assert sorted((r.product_id, r.other_id) for r in house.neighbours.all_pairs().collect()) == [(1, 2), (2, 1)]
    assert written == ["velocity-part", "affinity-part"]
    house.neighbours.drop()


def test_lines_stay_in_all_partitions(spark, tmp_path, monkeypatch):
    """Lines that compress well are not merged to few tasks, which group all of their rows in memory."""
    spark.range(1, 400).selectExpr("id AS l_orderkey", "1L AS l_partkey", "1D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 400).selectExpr("id AS o_orderkey", "7L AS o_custkey", "'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(roles, "read_table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}.parquet"))
    monkeypatch.setattr(spark.conf, "get", lambda key, *default: "9" if key == "spark.sql.shuffle.partitions" else type(spark.conf).get(spark.conf, key, *default))
    lines = roles.part_lines(spark, str(tmp_path))
    assert lines.count() == 399
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() == 9


def test_a_folder_is_hashed_without_its_joined_text(spark):
    rows = [(f"m={m}/part={p:03d}/f.txt", f"{m}é{p}\n" * (p + 1)) for m in ("a", "b", "") for p in range(12)]
    rows += [("m=a/part=003/f.txt", "aa"), ("m=a/part=003/f.txt", "aa"), ("m=b/part=1/n.txt", None), ("m=c/part=1/n.txt", None), ("top.txt", "x"), (None, "y")]
    files = spark.createDataFrame(rows, "path string, text string").repartition(5)
    want = text.joined_by_folder(files).select("folder", F.sha2("text", 256), F.length("text").cast("long")).collect()
    got = text.joined_by_folder(files, digest=True)
    assert {row[0]: tuple(row) for row in got.collect()} == {row[0]: tuple(row) for row in want}
    assert got.count() == len(want) == 6
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
