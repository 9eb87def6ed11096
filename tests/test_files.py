"""Files that Spark's writer does not make, many files, and writers that are lost on the way."""

import os
import signal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillnest.functions import access
from quillnest.sources import metadata
from quillnest.sources.footer import page_headers
from quillnest.sources.reader import ColumnReadError, check_columns, open_parquet, read_parquet
from quillnest.sources.writer import write_parquet

ODD = """message m {
  required int32 id;
  repeated int32 bare;
  repeated group pairs { required binary k (STRING); optional int32 v; }
  optional group keys (MAP) { repeated group key_value { required binary key (STRING); } }
  optional group old (LIST) { repeated int32 element; }
  optional group tuples (LIST) { repeated group tuples_tuple { optional int32 x; } }
}"""
#: A group that calls itself a list without being one: a struct in the plan, but Spark and Arrow refuse to read it.
WRONG = "message m { required int32 id; optional group wrong (LIST) { optional int32 a; optional int32 b; } }"


def example_writer(jvm, path, message):
    schema = jvm.org.apache.parquet.schema.MessageTypeParser.parseMessageType(message)
    out = jvm.org.apache.parquet.hadoop.example.ExampleParquetWriter.builder(jvm.org.apache.hadoop.fs.Path(path)).withType(schema).build()
    return jvm.org.apache.parquet.example.data.simple.SimpleGroupFactory(schema), out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Layouts of other writers, by the example writer of the format's own library."""
    jvm = spark._jvm
    path = str(tmp_path_factory.mktemp("odd") / "odd.parquet")
    groups, out = example_writer(jvm, path, ODD)
    g = groups.newGroup().append("id", 1).append("bare", 5).append("bare", 6)
    for k, v in (("a", 1), ("b", None)):
        p = g.addGroup("pairs").append("k", k)
        if v is not None:
            p.append("v", v)
    keys = g.addGroup("keys")
    keys.addGroup("key_value").append("key", "x")
    keys.addGroup("key_value").append("key", "y")
    g.addGroup("old").append("element", 7)
    t = g.addGroup("tuples")
    t.addGroup("tuples_tuple").append("x", 8)
    t.addGroup("tuples_tuple")
    out.write(g)
    out.write(groups.newGroup().append("id", 2))
    out.close()
    return path


def test_layouts_of_other_writers(spark, odd):
    plan = {r.key: (r.repetition, r.definition, r.item_definitions) for r in open_parquet(spark, odd).read_plan().collect()}
    assert plan == {
        "id": (0, 0, []), "bare": (1, 1, [1]), "pairs.k": (1, 1, [1]), "pairs.v": (1, 2, [1]), "keys": (1, 2, [2]), "old": (1, 2, [2]),
        "tuples.x": (1, 3, [2]),
    }
    got = [r.asDict(recursive=True) for r in read_parquet(odd, ["bare", "pairs", "old", "tuples"], spark).collect()]
    assert got == [
        {"bare": [5, 6], "pairs": [{"k": "a", "v": 1}, {"k": "b", "v": None}], "old": [7], "tuples": [{"x": 8}, {"x": None}]},
        {"bare": [], "pairs": [], "old": None, "tuples": None},
    ]
    assert [r["keys"] for r in read_parquet(odd, ["keys"], spark).collect()] == [["x", "y"], None]
    assert [r.asDict(recursive=True) for r in read_parquet(odd, ["pairs.v"], spark).collect()] == [{"pairs": [{"v": 1}, {"v": None}]}, {"pairs": []}]


def test_a_list_that_is_none(spark, tmp_path):
    path = str(tmp_path / "wrong.parquet")
    groups, out = example_writer(spark._jvm, path, WRONG)
    out.write(groups.newGroup().append("id", 3))
    out.close()
    pf = open_parquet(spark, path)
    assert pf.schema.simpleString() == "struct<id:int,wrong:struct<a:int,b:int>>"
    assert [r.id for r in read_parquet(pf, ["id"]).collect()] == [3]
    with pytest.raises(ColumnReadError, match="wrong"):
        check_columns(pf)


def test_a_late_file_with_another_codec(spark, tmp_path):
    for k in range(70):
        pq.write_table(pa.table({"x": [k]}), tmp_path / f"part-{k:03}.parquet", compression="brotli" if k == 69 else "snappy")
    pf = open_parquet(spark, str(tmp_path))
    assert pf.num_rows == pf.num_row_groups == 70
    assert sorted(r.x for r in read_parquet(pf).collect()) == list(range(70))
    assert metadata.column_chunks(spark, str(tmp_path)).groupBy("codec").count().count() == 2


def test_page_headers_are_read_without_the_pages(tmp_path):
    path = tmp_path / "long.parquet"
    rng = np.random.default_rng(1)
    texts = ["x" * 3000 + str(i) for i in range(50)]
    pq.write_table(pa.table({"v": rng.integers(0, 1 << 62, 600_000), "s": [texts[i % 50] for i in range(600_000)]}), path, compression="none", use_dictionary=["s"], write_statistics=True)
    size, got = path.stat().st_size, 0
    meta = pq.ParquetFile(path).metadata
    with open(path, "rb") as f:

        def read(start, n):
            nonlocal got
            got += n
            f.seek(start)
            return f.read(n)

        for c in range(2):
            m = meta.row_group(0).column(c)
            start = min(o for o in (m.dictionary_page_offset, m.data_page_offset) if o)
            heads = page_headers(read, start, m.total_compressed_size, m.num_values)
            assert sum(h["header_size"] + h["compressed_page_size"] for h in heads) == m.total_compressed_size
            assert sum(h["v1"]["num_values"] for h in heads if "v1" in h) == m.num_values
    assert got < size / 10


def test_a_lost_worker_leaves_nothing_in_the_table(spark, tmp_path):
    mark, out = str(tmp_path / "mark"), str(tmp_path / "t")
    old = spark.range(10).select(F.col("id").cast("double").alias("x"))
    write_parquet(old, out, encoding={"x": "byte_stream_split"})

    def die_once(batches):
        for k, b in enumerate(batches):
            yield b
            if k == 0 and not os.path.exists(mark):
                open(mark, "w").close()
                os.kill(os.getpid(), signal.SIGKILL)

    # In local mode a failed task fails the job: what was there before has to stay.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(0, 5000, 1, 2).select(F.col("id").cast("double").alias("x")).mapInPandas(die_once, "x double")
        with pytest.raises(Exception):  # noqa: B017
            write_parquet(rows, out, encoding={"x": "byte_stream_split"}, rowgroup_size=50)
        assert sorted(r.x for r in read_parquet(out, spark=spark).collect()) == [float(i) for i in range(10)]
        assert os.path.exists(mark)
        write_parquet(rows, out, encoding={"x": "byte_stream_split"}, rowgroup_size=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.x for r in read_parquet(out, spark=spark).collect()) == [float(i) for i in range(5000)]
    assert not [f for f in os.listdir(out) if f.startswith("_")]


def test_only_named_files_are_committed(tmp_path):
    """A task that ran twice, or was lost, leaves files that no message names."""
    from pyspark.sql import types as T

    from quillnest.sources.arrow_io import Written, _Writer

    w = _Writer(T.StructType(), {"path": str(tmp_path), "job": "j"}, False)
    folder = tmp_path / "_temporary" / "j"
    folder.mkdir(parents=True)
    for n in ("whole", "cut", "none"):
        (folder / f"part-{n}.parquet").write_text(n)
    w.commit([Written(str(folder / "part-whole.parquet"), 5), None, Written(str(folder / "part-none.parquet"), 0)])
    assert [p.name for p in tmp_path.iterdir()] == ["part-whole.parquet"]


def test_modes(spark, tmp_path):
    df, out = spark.range(3), str(tmp_path / "t")
    for how in ({}, {"compression": "brotli"}):
        write_parquet(df, out, **how)
        with pytest.raises(FileExistsError):
            write_parquet(df, out, mode="error", **how)
        write_parquet(df, out, mode="append", **how)
        assert read_parquet(out, spark=spark).count() == 6
        assert write_parquet(spark.range(1), out, mode="ignore", **how) == out
        write_parquet(df, out, **how)
        assert read_parquet(out, spark=spark).count() == 3
    one = write_parquet(df, str(tmp_path / "one.parquet"), single_file=True)
    with pytest.raises(Exception):  # noqa: B017
        write_parquet(df.select(F.raise_error(F.lit("x")).cast("int").alias("i")), one, single_file=True)
    assert read_parquet(one, spark=spark).count() == 3


def test_data_pages_of_version_two_and_delta_texts(spark, tmp_path):
    t = pa.table({"b": pa.array([True, None, False] * 50), "s": pa.array(["abc", None, "abd"] * 50), "l": pa.array([[1], [], None] * 50), "f": pa.array([b"abcd", b"abce", None] * 50, pa.binary(4))})
    path = str(tmp_path / "v2.parquet")
    pq.write_table(t, path, data_page_version="2.0", use_dictionary=False, column_encoding={"s": "DELTA_BYTE_ARRAY", "b": "RLE"})
    got = read_parquet(path, spark=spark).collect()
    assert [(r.b, r.s, r.l, r.f and bytes(r.f)) for r in got] == list(zip(*(t[c].to_pylist() for c in ("b", "s", "l", "f")), strict=True))
    assert {r.type for r in metadata.pages(spark, path).collect()} == {"DATA_PAGE_V2"}


def test_null_map_keys_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    with pytest.raises(Exception, match="NULL_MAP_KEY"):
        write_parquet(df.select(F.create_map("k", F.lit(1)).alias("m")), str(tmp_path / "m"))


def test_many_entries_and_vectors(spark):
    m = F.map_from_arrays(F.sequence(F.lit(1), F.lit(3000)), F.sequence(F.lit(1), F.lit(3000)))
    assert spark.range(1).select(F.size(access.map_last_wins(m))).first()[0] == 3000
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (None,)], ["v"])
    assert [r[0] for r in df.select(access.fixed_from_vectors(F.col("v"), 2)).collect()] == [[1.0, 2.0], None]


@pytest.mark.parametrize("files", [3, 40])
def test_footers_of_a_folder_are_those_of_one_table(spark, sf_dir, tmp_path, files):
    from quillnest.queries import QUERIES

    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    for name, n in (("one", 1), ("many", files)):
        os.makedirs(tmp_path / name / "embeddings.parquet")
        for k in range(n):
            pq.write_table(t.slice(k, 1), str(tmp_path / name / "embeddings.parquet" / f"part-{k}.parquet"))
    for query in ("schema_elements", "key_values"):
        one, many = (sorted(map(repr, QUERIES[query](spark, str(tmp_path / d)).collect())) for d in ("one", "many"))
        assert many == one
    pq.write_table(t.slice(0, 1).append_column("more", pa.array([1])), str(tmp_path / "many" / "embeddings.parquet" / "part-more.parquet"))
    got = QUERIES["schema_elements"](spark, str(tmp_path / "many")).collect()
    assert len(got) == 8 and {r.num_children for r in got if r.ordinal == 0} == {3, 4}


@pytest.mark.parametrize("name", ["overlapping_keys", "fsl_size_check", "list_of_list_member"])
def test_items_of_nested_tables_move_once_as_rows(spark, sf_dir, monkeypatch, name):
    """Lists are made after the only shuffle of their rows, by sorting, even where nothing is broadcast; the rows are those of the SQL."""
    import duckdb

    from quillnest import queries
    from quillnest.session import confs

    plans, written = [], queries._written
    monkeypatch.setattr(queries, "_FIXTURES", {})
    monkeypatch.setattr(queries, "_written", lambda s, df, **how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(s, df, **how))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with confs(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = sorted(map(repr, map(tuple, queries.QUERIES[name](spark, sf_dir).collect())))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    lines = plans[-1].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    made = [i for i, x in enumerate(lines) if "collect_list" in x]
    assert made and not any("ObjectHashAggregate" in x for x in lines)
    for i in (i for i, x in enumerate(lines) if " Exchange " in x):
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any(i < m < below for m in made), plans[-1]
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(map(repr, db.execute(queries.SQL[name]).fetchall()))
