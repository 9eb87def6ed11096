"""Queries over the driver's tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import access
from .operators import layout, levels, nullability
from .session import confs, scratch_path
from .sources import metadata
from .sources.arrow_io import read_ipc, write_ipc
from .sources.files import exists
from .sources.reader import open_parquet, read_parquet
from .sources.writer import CODECS, write_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A total order of line items.
ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ORDER = ", ".join(ITEM)
CHUNK_ROWS = 1000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(_path(sf_dir, name), columns, spark)


def _written(spark: SparkSession, df: DataFrame, **how) -> str:
    return write_parquet(df, scratch_path(spark), **how)


#: Paths of nested tables that queries read, by application, source and name: they are written once.
_FIXTURES: dict[tuple[str, str, str], str] = {}
#: Line items that a partition of a nested table gathers at most, on average, however few shuffle partitions are set.
SHARE = 500_000


def _gathering(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Confs for _gathered: sorted groups, and tasks small enough for neither side of a shuffle to spill."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), open_parquet(spark, _path(sf_dir, "lineitem")).num_rows // SHARE)
    return {
        "spark__sql__execution__useObjectHashAggregateExec": "false", "spark__sql__shuffle__partitions": str(parts),
        "spark__sql__files__maxPartitionBytes": "32m", "spark__sql__adaptive__advisoryPartitionSizeInBytes": "16m",
    }


def _fixture(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], str]:
    def path(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _FIXTURES or not exists(spark, _FIXTURES[key]):
            with confs(spark, **_gathering(spark, sf_dir)):
                _FIXTURES[key] = _written(spark, build(spark, sf_dir))
        return _FIXTURES[key]

    return path


def _gathered(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """The rows of each key as one sorted list. They move as plain rows and are sorted by key once, which the joins above use:
    lists begun before the shuffle save nothing, and hash aggregation gives up on many keys and sorts on both sides of it."""
    return rows.repartition(key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


@_fixture
def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_nested: cust struct and items list, written as Parquet; orders without items have a null list."""
    fields = [*ITEM, "l_shipdate", "l_returnflag"]
    items = _gathered(_read(spark, sf_dir, "lineitem", fields), "l_orderkey", fields, "items")
    cust = _read(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select("c_custkey", F.struct("c_custkey", "c_name").alias("cust"))
    orders = _read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    full = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")  # items move once
    return full.select("o_orderkey", "o_custkey", "cust", "items")


@_fixture
def _quantity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_map: position in the order to quantity."""
    items = _gathered(_read(spark, sf_dir, "lineitem", ITEM), "l_orderkey", ITEM, "i")
    entries = F.transform("i", lambda x, k: F.struct((k + 1).cast("long").alias("key"), x["l_quantity"].alias("value")))
    return items.select("l_orderkey", F.map_from_entries(entries).alias("qty"))


@_fixture
def _customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items, gathered by customer."""
    orders = read_parquet(_nested_orders(spark, sf_dir), ["o_custkey", "o_orderkey", "items"], spark)
    return _gathered(orders, "o_custkey", ["o_orderkey", "items"], "orders")


def _raise_if(df: DataFrame, says: str) -> None:
    """The physical effect of an option, asserted from footers."""
    if not df.isEmpty():
        raise AssertionError(says)


@query("SELECT * FROM lineitem")
def scan_lineitem(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem")


@query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def select_schema_order(spark, sf_dir):
    out = _read(spark, sf_dir, "lineitem", ["l_shipdate", "l_quantity", "l_orderkey"])
    assert out.columns == ["l_orderkey", "l_quantity", "l_shipdate"]
    return out


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def struct_member(spark, sf_dir):
    df = read_parquet(_nested_orders(spark, sf_dir), ["o_orderkey", "cust.c_name"], spark)
    return df.select("o_orderkey", access.member(df, "cust.c_name").alias("c_name"))


@query(f"SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS pos, l_quantity FROM lineitem")
def list_member(spark, sf_dir):
    df = read_parquet(_nested_orders(spark, sf_dir), ["o_orderkey", "items.l_quantity"], spark)
    out = df.select("o_orderkey", F.posexplode(access.member(df, "items.l_quantity")).alias("pos", "l_quantity"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS item, l_quantity FROM lineitem),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders)
SELECT o_custkey AS c_custkey, ord, item, l_quantity FROM o JOIN i ON o_orderkey = l_orderkey""")
def list_of_list_member(spark, sf_dir):
    df = read_parquet(_customer_orders(spark, sf_dir), ["o_custkey", "orders.items.l_quantity"], spark)
    one = df.select(F.col("o_custkey").alias("c_custkey"), F.posexplode(access.member(df, "orders.items.l_quantity")).alias("ord", "q"))
    out = one.select("c_custkey", F.col("ord").cast("long").alias("ord"), F.posexplode("q").alias("item", "l_quantity"))
    return out.withColumn("item", F.col("item").cast("long"))


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS key, l_quantity AS value FROM lineitem")
def map_keys_values(spark, sf_dir):
    df = read_parquet(_quantity_maps(spark, sf_dir), spark=spark)
    return df.select("l_orderkey", F.explode(F.map_entries("qty")).alias("e")).select("l_orderkey", "e.key", "e.value")


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS key FROM lineitem")
def map_side_selection(spark, sf_dir):
    df = read_parquet(_quantity_maps(spark, sf_dir), ["l_orderkey", "qty.key"], spark)
    return df.select("l_orderkey", F.explode("qty").alias("e")).select("l_orderkey", "e.key")


@query("""
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS last_open, count(*) AS entries, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 AS has_p
FROM orders GROUP BY o_custkey""")
def map_lookup_last_wins(spark, sf_dir):
    df = _status_maps(spark, sf_dir)
    m = F.col("m")
    return df.select("o_custkey", access.map_get(m, F.lit("O")).alias("last_open"), access.map_size(m).cast("long").alias("entries"), access.map_has(m, F.lit("P")).alias("has_p"))


def _status_maps(spark, sf_dir):
    """Maps with duplicate keys (status), which no constructor of Spark makes: stored as lists, read back as maps."""
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    lists = _read(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"]).groupBy("o_custkey").agg(pairs.alias("p"))
    as_map = lists.select("o_custkey", F.col("p.o_orderstatus").alias("k"), F.col("p.o_orderkey").alias("v"))
    return _duplicate_maps(as_map)


def _duplicate_maps(df: DataFrame) -> DataFrame:
    """(o_custkey, k, v lists) to (o_custkey, m) with all entries kept, through Arrow."""
    import pyarrow as pa

    def build(batches):
        for b in batches:
            k, v = b.column("k"), b.column("v")
            base = k.offsets[0].as_py()
            n = k.offsets[-1].as_py() - base
            offsets = pa.compute.subtract(k.offsets, pa.scalar(base, pa.int32()))
            vb = v.offsets[0].as_py()
            m = pa.MapArray.from_arrays(offsets, k.values.slice(base, n), v.values.slice(vb, n))
            yield pa.RecordBatch.from_arrays([b.column("o_custkey"), m], ["o_custkey", "m"])

    return df.mapInArrow(build, "o_custkey long, m map<string, long>")


@query("SELECT vec_id, embedding[1] AS e1, embedding[33] AS e33, embedding[64] AS e64 FROM embeddings")
def fsl_element(spark, sf_dir):
    df = access.declare_fixed(_read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), "embedding", 64)
    return df.select("vec_id", *(access.element(F.col("embedding"), j).alias(f"e{j}") for j in (1, 33, 64)))


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def fsl_flat(spark, sf_dir):
    flat = _read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select("vec_id", F.posexplode("embedding").alias("position", "value"))
    back = access.fixed_from_flat(flat, 64, "position", "value", ["vec_id"])
    return back.select("vec_id", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first"), F.col("values")[63].alias("last"))


@query("SELECT l_orderkey, count(*) <> 4 AS wrong FROM lineitem GROUP BY l_orderkey")
def fsl_size_check(spark, sf_dir):
    df = read_parquet(_quantity_maps(spark, sf_dir), spark=spark)
    return df.select("l_orderkey", access.wrong_size(F.map_values("qty"), 4).alias("wrong"))


@query("SELECT vec_id, label, embedding[64] AS last FROM embeddings")
def fsl_write_restored(spark, sf_dir):
    df = access.declare_fixed(_read(spark, sf_dir, "embeddings"), "embedding", 64)
    pf = open_parquet(spark, _written(spark, df))
    if pf.schema["embedding"].metadata.get("fixed_size") != 64:
        raise AssertionError("the fixed size was not restored")
    return read_parquet(pf).select("vec_id", "label", access.element(F.col("embedding"), 64).alias("last"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 5 <> 0 AS c, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'o_orderkey' AS node, bool_or(o_orderkey IS NULL) AS admits_null FROM o UNION ALL SELECT 'cust', bool_or(NOT c) FROM o UNION ALL
SELECT 'cust.c_name', bool_or(NOT c) FROM o UNION ALL SELECT 'items', bool_or(n = 0) FROM o UNION ALL SELECT 'items[]', false UNION ALL
SELECT 'items[].l_linenumber', (SELECT bool_or(l_linenumber % 7 = 0) FROM lineitem) UNION ALL SELECT 'items[].l_quantity', false""")
def exact_nullability(spark, sf_dir):
    df = read_parquet(_nested_orders(spark, sf_dir), ["o_orderkey", "o_custkey", "cust.c_name", "items.l_linenumber", "items.l_quantity"], spark)
    line = lambda x: F.struct(F.when(x["l_linenumber"] % 7 != 0, x["l_linenumber"]).alias("l_linenumber"), x["l_quantity"].alias("l_quantity"))
    out = df.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("cust")).alias("cust"), F.transform("items", line).alias("items"))
    return nullability.nullability(out)


@query("""
SELECT vec_id, CAST(i - 1 AS BIGINT) AS p1, CASE WHEN i = 1 THEN 0 ELSE 1 END AS rep, CASE WHEN vec_id % 11 = 0 THEN 0 WHEN vec_id % 7 = 0 THEN 1 WHEN (vec_id + i) % 5 = 0 THEN 2 ELSE 3 END AS def,
CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 OR (vec_id + i) % 5 = 0 THEN NULL ELSE embedding[i] END AS value
FROM embeddings, generate_series(1, 64) AS g(i) WHERE i = 1 OR (vec_id % 11 <> 0 AND vec_id % 7 <> 0)""")
def shred_embedding(spark, sf_dir):
    out = levels.shred(_null_embeddings(spark, sf_dir), "e", ["vec_id"])
    return out.withColumn("p1", F.col("p1").cast("long"))


def _null_embeddings(spark, sf_dir):
    """Embeddings with null lists, empty lists and null elements."""
    items = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i + 1) % 5 != 0, x))
    e = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 7 == 0, F.expr("CAST(array() AS array<float>)")).otherwise(items)
    return _read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select("vec_id", e.alias("e"))


@query("""
SELECT vec_id, vec_id % 11 = 0 AS is_null, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 0 ELSE 64 END AS n,
CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 THEN NULL ELSE len(list_filter(range(1, 65), lambda i: (vec_id + i) % 5 <> 0)) END AS filled FROM embeddings""")
def assemble_embedding(spark, sf_dir):
    lv = levels.shred(_null_embeddings(spark, sf_dir), "e", ["vec_id"])
    v = levels.assemble(lv, ["vec_id"], ["p1"])
    n = F.when(F.col("values").isNotNull(), F.size("values"))
    filled = F.when(n > 0, F.size(F.filter("values", lambda x: x.isNotNull()))).cast("long")
    return v.select("vec_id", F.col("values").isNull().alias("is_null"), n.alias("n"), filled.alias("filled"))


@query("""
SELECT 'e' AS leaf, sum(CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 THEN 1 ELSE len(list_filter(range(1, 65), lambda i: (vec_id + i) % 5 = 0)) END)::BIGINT AS null_count
FROM embeddings""")
def null_count_leaves(spark, sf_dir):
    return levels.null_count(_null_embeddings(spark, sf_dir), "e")


_CHUNKED = f"SELECT *, l_orderkey // {CHUNK_ROWS} AS chunk FROM lineitem"


def _chunks(spark, sf_dir, columns):
    return _read(spark, sf_dir, "lineitem", list(dict.fromkeys([*ITEM, *columns]))).withColumn("chunk", F.expr(f"l_orderkey DIV {CHUNK_ROWS}"))


@query(f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY {ORDER}) AS r, lag(l_returnflag) OVER (PARTITION BY chunk ORDER BY {ORDER}) AS p FROM ({_CHUNKED})),
u AS (SELECT *, sum(CASE WHEN r = 1 OR p <> l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) - 1 AS run FROM t)
SELECT chunk, CAST(run AS BIGINT) AS run, l_returnflag AS value, count(*) AS length FROM u GROUP BY ALL""")
def rle_runs(spark, sf_dir):
    return layout.runs(_chunks(spark, sf_dir, ["l_returnflag"]), "l_returnflag", ["chunk"], ITEM)


@query(f"""
WITH t AS (SELECT chunk, l_partkey - lag(l_partkey) OVER w AS delta, row_number() OVER w - 2 AS r, first_value(l_partkey) OVER w AS head FROM ({_CHUNKED}) WINDOW w AS (PARTITION BY chunk ORDER BY {ORDER})),
u AS (SELECT chunk, r // 128 AS block, r % 128 // 32 AS miniblock, head, delta, min(delta) OVER (PARTITION BY chunk, r // 128) AS min_delta FROM t WHERE r >= 0)
SELECT chunk, block, miniblock, head AS first, min_delta, CASE WHEN max(delta) = min_delta THEN 0 ELSE CAST(len(bin(max(delta) - min_delta)) AS BIGINT) END AS bit_width FROM u GROUP BY chunk, block, miniblock, head, min_delta""")
def delta_blocks(spark, sf_dir):
    return layout.deltas(_chunks(spark, sf_dir, ["l_partkey"]), "l_partkey", ["chunk"], ITEM)


@query(f"""
WITH t AS (SELECT chunk, l_suppkey AS value, row_number() OVER (PARTITION BY chunk ORDER BY {ORDER}) AS r FROM ({_CHUNKED})),
u AS (SELECT chunk, value, min(r) AS seen, count(*) AS n FROM t GROUP BY ALL)
SELECT chunk, value, row_number() OVER (PARTITION BY chunk ORDER BY seen) - 1 AS index, n AS count,
greatest(1, CASE WHEN count(*) OVER (PARTITION BY chunk) = 1 THEN 0 ELSE CAST(len(bin(count(*) OVER (PARTITION BY chunk) - 1)) AS BIGINT) END) AS index_bits FROM u""")
def dictionary_first_seen(spark, sf_dir):
    return layout.dictionary(_chunks(spark, sf_dir, ["l_suppkey"]), "l_suppkey", ["chunk"], ITEM)


@query("""
WITH t AS (SELECT DISTINCT p_size // 25 AS chunk, 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT DISTINCT p_size // 25, 'p_brand', p_brand FROM part)
SELECT chunk, "column", count(*) AS n_distinct, CAST(sum(strlen(v) + 4) AS BIGINT) AS bytes, sum(strlen(v) + 4) <= 1048576 AS fits FROM t GROUP BY ALL""")
def dictionary_fits(spark, sf_dir):
    df = _read(spark, sf_dir, "part", ["p_name", "p_brand", "p_size"]).withColumn("chunk", F.expr("p_size DIV 25").cast("int"))
    return layout.dictionary_fits(df, ["p_name", "p_brand"], ["chunk"])


@query()
def bss_streams(spark, sf_dir):
    return layout.byte_streams(_read(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"]), "s_acctbal", ["s_suppkey"])


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days, epoch_ms(o_orderdate) AS ms, epoch_us(o_orderdate) AS us FROM orders")
def epoch_units(spark, sf_dir):
    df = _read(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    c = F.col("o_orderdate")
    utc = F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())  # naive values count as UTC in any session
    parts = layout.epoch_units(utc, df.schema["o_orderdate"].dataType)
    return df.select("o_orderkey", *(v.alias(k) for k, v in parts.items()))


@query("SELECT CAST(r // 4000 AS BIGINT) AS row_group, count(*) AS num_rows FROM (SELECT row_number() OVER () - 1 AS r FROM orders) GROUP BY ALL")
def rowgroup_split(spark, sf_dir):
    path = _written(spark, _read(spark, sf_dir, "orders"), rowgroup_size=4000, single_file=True)
    return metadata.row_groups(spark, path).select("row_group", "num_rows")


@query("SELECT * FROM supplier")
def arrow_export(spark, sf_dir):
    df = _read(spark, sf_dir, "supplier")
    return read_ipc(write_ipc(df, scratch_path(spark)), df.schema)


@query("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS name, CAST(unnest(range(11)) AS BIGINT) AS at")
def column_names(spark, sf_dir):
    names = open_parquet(spark, _path(sf_dir, "lineitem")).column_names
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, at long")


@query("SELECT (SELECT count(*) FROM lineitem) AS num_rows, (SELECT count(*) FROM events) AS events, CAST(1 AS BIGINT) AS num_row_groups")
def num_rows(spark, sf_dir):
    pf = open_parquet(spark, _path(sf_dir, "lineitem"))
    return spark.createDataFrame([(pf.num_rows, open_parquet(spark, _path(sf_dir, "events")).num_rows, pf.num_row_groups)], "num_rows long, events long, num_row_groups long")


def _once(rows: DataFrame) -> DataFrame:
    """Rows of all files' footers as those of one table: what files have in common comes once, what one file repeats stays."""
    own = Window.partitionBy(*rows.columns).orderBy("file")
    return rows.withColumn("nth", F.row_number().over(own)).drop("file").distinct().drop("nth")


#: Where the reading of footers is compared with another reader's: it takes a literal path.
_FILES = "/root/testdata/sf0.01"


@query(f"""
SELECT row_number() OVER () - 1 AS ordinal, name, type, repetition_type AS repetition, num_children, converted_type FROM parquet_schema('{_FILES}/embeddings.parquet')""")
def schema_elements(spark, sf_dir):
    return _once(metadata.schema_elements(spark, _path(sf_dir, "embeddings")).select("file", "ordinal", "name", "type", "repetition", "num_children", "converted_type"))


@query(f"""
SELECT row_group_id AS row_group, column_id AS "column", replace(path_in_schema, ', ', '.') AS path, type, compression AS codec, num_values, total_compressed_size AS compressed_size,
total_uncompressed_size AS uncompressed_size, coalesce(dictionary_page_offset, data_page_offset) AS first_page_offset, stats_null_count AS null_count FROM parquet_metadata('{_FILES}/lineitem.parquet')""")
def column_chunks(spark, sf_dir):
    return metadata.column_chunks(spark, _path(sf_dir, "lineitem")).drop("file", "encodings", "min_value", "max_value")


@query(f"""
SELECT row_group_id AS row_group, column_id AS "column", num_values, total_compressed_size AS bytes, total_uncompressed_size AS plain_bytes,
CAST(list_sum(list_transform(encoding_stats, lambda x: x.count)) AS BIGINT) AS pages FROM parquet_metadata('{_FILES}/orders.parquet')""")
def page_headers(spark, sf_dir):
    """Pages of a chunk, with their headers, fill it."""
    p = metadata.pages(spark, _path(sf_dir, "orders"))
    return p.groupBy("row_group", "column").agg(
        F.sum(F.when(F.col("type") != "DICTIONARY_PAGE", F.col("num_values"))).alias("num_values"), F.sum(F.col("compressed_size") + F.col("header_size")).alias("bytes"),
        F.sum(F.col("uncompressed_size") + F.col("header_size")).alias("plain_bytes"), F.count(F.lit(1)).alias("pages"),
    )


@query(f"SELECT CAST(key AS VARCHAR) AS key, CAST(octet_length(value) AS BIGINT) AS bytes, sha256(value) AS sha256 FROM parquet_kv_metadata('{_FILES}/embeddings.parquet')")
def key_values(spark, sf_dir):
    kv = _once(metadata.key_values(spark, _path(sf_dir, "embeddings")))
    return kv.select("key", F.octet_length("value").cast("long").alias("bytes"), F.sha2(F.encode("value", "UTF-8"), 256).alias("sha256"))


@query("""
SELECT * FROM (VALUES (0, 'message schema {'), (1, '  optional int64 vec_id;'), (2, '  optional group embedding (LIST) {'), (3, '    repeated group list {'), (4, '      optional float element;'), (5, '    }'),
(6, '  }'), (7, '  optional int32 label;'), (8, '}')) AS t(line, text)""")
def schema_string(spark, sf_dir):
    text = open_parquet(spark, _path(sf_dir, "embeddings")).schema_string()
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query("""
SELECT key, type, CAST(repetition AS BIGINT) AS repetition, CAST(definition AS BIGINT) AS definition, items, path FROM (VALUES ('cust.c_name', 'string', 0, 2, '', 'cust.c_name'),
('items.l_quantity', 'double', 1, 4, '2', 'items.list.element.l_quantity')) AS t(key, type, repetition, definition, items, path)""")
def read_plan(spark, sf_dir):
    plan = open_parquet(spark, _nested_orders(spark, sf_dir)).read_plan(["cust.c_name", "items.l_quantity"])
    items = F.array_join(F.col("item_definitions").cast("array<string>"), ",")
    return plan.select("key", "type", "repetition", "definition", items.alias("items"), "path")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE false")
def zero_rows(spark, sf_dir):
    empty = _read(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"]).where("false")
    return read_parquet(_written(spark, empty, compression="brotli"), spark=spark)


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def overlapping_keys(spark, sf_dir):
    """A group's key covers its members; keys that overlap or come twice count once."""
    df = read_parquet(_nested_orders(spark, sf_dir), ["cust.c_name", "cust", "o_custkey", "o_orderkey", "cust.c_name"], spark)
    return df.select("o_orderkey", "o_custkey", "cust.c_custkey", "cust.c_name")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS done, CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_totalprice > 100000 THEN 'dear' ELSE 'cheap' END AS price FROM orders")
def roundtrip_boolean(spark, sf_dir):
    df = _read(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    made = df.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 100000).alias("dear"))
    back = read_parquet(_written(spark, made), spark=spark)
    return back.select("o_orderkey", "done", F.when(F.col("dear"), "dear").when(~F.col("dear"), "cheap").otherwise("null").alias("price"))


@query("SELECT * FROM orders")
def data_page_v2(spark, sf_dir):
    """Pages of the second kind, with the delta encodings that come with them."""
    path = scratch_path(spark)
    how = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
    _read(spark, sf_dir, "orders").write.options(**how).parquet(path)
    _raise_if(metadata.pages(spark, path).where("type <> 'DATA_PAGE_V2'"), "not all pages are of version 2")
    _raise_if(metadata.column_chunks(spark, path).where("path = 'o_orderstatus' AND NOT encodings LIKE '%DELTA_BYTE_ARRAY%'"), "no delta byte arrays")
    return read_parquet(path, spark=spark)


@query("SELECT * FROM customer")
def lz4_deprecated(spark, sf_dir):
    path = scratch_path(spark)
    _read(spark, sf_dir, "customer").write.option("compression", "lz4").parquet(path)
    _raise_if(metadata.column_chunks(spark, path).where("codec <> 'LZ4'"), "not all chunks are LZ4")
    return read_parquet(path, spark=spark)


@query("SELECT o_orderkey, CAST(CAST(CAST(o_orderkey AS DECIMAL(30, 0)) * 100000000000 + 7 AS DECIMAL(30, 2)) AS VARCHAR) AS d FROM orders")
def roundtrip_fixed_length(spark, sf_dir):
    d = (F.col("o_orderkey").cast("decimal(19,0)") * F.lit(100000000000).cast("decimal(12,0)") + 7).cast("decimal(30,2)")
    path = _written(spark, _read(spark, sf_dir, "orders", ["o_orderkey"]).select("o_orderkey", d.alias("d")))
    _raise_if(metadata.column_chunks(spark, path).where("path = 'd' AND type <> 'FIXED_LEN_BYTE_ARRAY'"), "not stored at fixed length")
    return read_parquet(path, spark=spark).select("o_orderkey", F.col("d").cast("string").alias("d"))


@query("SELECT vec_id, CAST(count(*) AS BIGINT) AS records FROM embeddings GROUP BY vec_id")
def record_starts(spark, sf_dir):
    lv = levels.shred(_null_embeddings(spark, sf_dir), "e", ["vec_id"])
    return levels.record_starts(lv).groupBy("vec_id").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def fsl_vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    df = _read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).select("vec_id", array_to_vector("embedding").alias("v"))
    lists = df.select("vec_id", access.fixed_from_vectors(F.col("v"), 64).alias("v"))
    return lists.select("vec_id", access.element(F.col("v"), 1).alias("first"), access.element(F.col("v"), 64).alias("last"))


@query("SELECT o_custkey, o_orderstatus AS key, max(o_orderkey) AS value FROM orders GROUP BY ALL")
def map_last_wins(spark, sf_dir):
    df = _status_maps(spark, sf_dir)
    return df.select("o_custkey", F.explode(access.map_last_wins(F.col("m"))).alias("key", "value"))


@query("SELECT o_custkey, max(o_orderkey) AS last_open FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def map_at_present(spark, sf_dir):
    """A missing key is an error, so only maps that have it are asked."""
    df = _status_maps(spark, sf_dir).where(access.map_has(F.col("m"), F.lit("O")))
    return df.select("o_custkey", access.map_at(F.col("m"), F.lit("O")).alias("last_open"))


@query("SELECT * FROM orders")
def roundtrip_table_encoding(spark, sf_dir):
    """One encoding for a whole table: plain where a column's type does not allow it."""
    path = _written(spark, _read(spark, sf_dir, "orders"), encoding="delta_binary_packed")
    delta = metadata.column_chunks(spark, path).select("path", (F.col("encodings").contains("DELTA_BINARY_PACKED")).alias("delta"))
    whole = F.col("path").isin("o_orderkey", "o_custkey", "o_orderdate")
    _raise_if(delta.where(F.col("delta") != whole), "not the columns that allow it")
    return read_parquet(path, spark=spark)


@query("SELECT 'o_comment' AS path, count(*) FILTER (o_orderkey % 4 = 0) AS null_count, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders")
def written_statistics(spark, sf_dir):
    df = _read(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    path = _written(spark, df.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_comment")))
    c = metadata.column_chunks(spark, path)
    number = lambda name: F.conv(F.hex(F.reverse(name)), 16, 10).cast("long")  # noqa: E731  little-endian, not negative here
    nulls = c.where("path = 'o_comment'").agg(F.lit("o_comment").alias("path"), F.sum("null_count").alias("null_count"))
    return nulls.crossJoin(c.where("path = 'o_orderkey'").agg(F.min(number("min_value")).alias("least"), F.max(number("max_value")).alias("most")))  # of one row each


def _codec_query(codec: str) -> None:
    def run(spark, sf_dir):
        path = _written(spark, _read(spark, sf_dir, "orders"), compression=codec)
        stored = {"lz4": "LZ4_RAW", "uncompressed": "UNCOMPRESSED"}.get(codec, codec.upper())
        _raise_if(metadata.column_chunks(spark, path).where(F.col("codec") != stored), f"not all chunks are {stored}")
        return read_parquet(path, spark=spark)

    run.__name__ = f"roundtrip_{codec}"
    query("SELECT * FROM orders")(run)


def _encoding_query(name: str, table: str, how: dict[str, str], stored: str) -> None:
    def run(spark, sf_dir):
        path = _written(spark, _read(spark, sf_dir, table), encoding=how)
        own = metadata.column_chunks(spark, path).where(F.col("path").isin(list(how)))
        _raise_if(own.where(~F.col("encodings").contains(stored)), f"not all chunks are {stored}")
        return read_parquet(path, spark=spark)

    run.__name__ = f"roundtrip_{name}"
    query(f"SELECT * FROM {table}")(run)


for _codec in dict.fromkeys(c for c in CODECS if c != "none"):
    _codec_query(_codec)
_encoding_query("plain", "customer", {"c_name": "plain"}, "PLAIN")
_encoding_query("dictionary", "customer", {"c_mktsegment": "dictionary", "c_nationkey": "dictionary"}, "DICTIONARY")
_encoding_query("delta_binary_packed", "orders", {"o_orderkey": "delta_binary_packed", "o_orderdate": "delta_binary_packed"}, "DELTA_BINARY_PACKED")
_encoding_query("delta_length_byte_array", "customer", {"c_name": "delta_length_byte_array"}, "DELTA_LENGTH_BYTE_ARRAY")
_encoding_query("byte_stream_split", "customer", {"c_acctbal": "byte_stream_split"}, "BYTE_STREAM_SPLIT")
