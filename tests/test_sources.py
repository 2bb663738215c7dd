from __future__ import annotations

import datetime as dt
import os
import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidymill.operators import fields as C
from tidymill.plans import cleaning as P
from tidymill.sources import guard, jdbc, versions
from tidymill.sources.encodings import detect_encodings
from tidymill.sources.text_tables import head_rows, list_tables, read_text_table


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_text_table_keeps_raw_text_and_file_order(spark, tmp_path, rows):
    write(tmp_path / "b.csv", "id,name\n003, x \n\n004,\"a,\"\"b\"\"\"\n")
    write(tmp_path / "a.csv", "id,name\n001,NA\n002,\n", "utf-8-sig")
    df = read_text_table(spark, str(tmp_path))
    assert dict(df.dtypes) == {"row_no": "bigint", "id": "string", "name": "string"}
    assert rows(df) == [(1, "001", "NA"), (2, "002", ""), (3, "003", " x "), (4, "004", 'a,"b"')]
    assert rows(head_rows(df, 2), "id") == ["001", "002"]


def test_row_numbers_across_many_splits(spark, tmp_path, rows):
    lines = "".join(f"{i},{'v' * (i % 50)}\n" for i in range(1, 3001))
    path = write(tmp_path / "big.csv", "id,v\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_text_table(spark, path)
        got = rows(df, "row_no", "id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, str(i)) for i in range(1, 3001)]


def test_quoted_line_breaks_and_gbk(spark, tmp_path, rows):
    path = write(tmp_path / "m.csv", 'id,note\n1,"two\nlines"\n')
    assert rows(read_text_table(spark, path, multi_line=True), "note") == ["two\nlines"]
    path = write(tmp_path / "g.csv", "编号,城市\n1,北京\n", "gbk")
    assert rows(read_text_table(spark, path, encoding="gbk"), "城市") == ["北京"]
    with pytest.raises(ValueError, match="is not one of"):
        read_text_table(spark, path, encoding="big5")


def test_files_are_matched_by_header_name(spark, tmp_path, rows):
    write(tmp_path / "a.csv", "id,name\n1,x\n2\n")
    write(tmp_path / "b.csv", "\n\nName,id,note\ny,3,first\nz,4,\n", "utf-8-sig")
    write(tmp_path / "c.csv", "note\n")
    write(tmp_path / "d.csv", 'id,"no, te","id",,note\n5,a,b,c,"say ""d"""\n')
    df = read_text_table(spark, str(tmp_path))
    assert df.columns == ["row_no", "id", "name", "note", "no, te", "id_2", "_c3"]
    assert rows(df) == [
        (1, "1", "x", "", "", "", ""), (2, "2", "", "", "", "", ""), (3, "3", "y", "first", "", "", ""),
        (4, "4", "z", "", "", "", ""), (5, "5", "", 'say "d"', "a", "b", "c"),
    ]
    assert rows(read_text_table(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]), "id") == ["1", "2", "3", "4"]
    assert read_text_table(spark, str(tmp_path), numbered=False).columns == df.columns[1:]
    assert df.select("note").where("note <> ''").count() == 2


def test_surplus_cells_stop_the_read_or_are_kept(spark, tmp_path, rows):
    write(tmp_path / "a.csv", 'a,b\n1,2\n3,4,5\n6\n7,8,,\n9,"x, y","p ""q""",,r\n')
    write(tmp_path / "b.csv", "b,a,c\n1,2,3\n4,5,6,7\n")
    write(tmp_path / "c.csv", 'b\n8,9,10\n11,""\n12\n')
    df = read_text_table(spark, str(tmp_path), surplus="more")
    assert rows(df) == [
        (1, "1", "2", "", ""), (2, "3", "4", "", '["5"]'), (3, "6", "", "", ""), (4, "7", "8", "", ""),
        (5, "9", "x, y", "", '["p \\"q\\"","","r"]'), (6, "2", "1", "3", ""), (7, "5", "4", "6", '["7"]'),
        (8, "", "8", "", '["9","10"]'), (9, "", "11", "", ""), (10, "", "12", "", ""),
    ]
    with pytest.raises(Exception, match="more cells than the header names in row"):
        read_text_table(spark, str(tmp_path)).collect()


def test_a_table_is_numbered_without_a_copy(spark, tmp_path, rows):
    for i, columns in enumerate(("id,v", "v,id")):
        lines = "".join(f"{n},{'v' * (n % 50)}\n" if i == 0 else f"w,{n}\n" for n in range(i * 2000, i * 2000 + 2000))
        write(tmp_path / f"{i}.csv", f"{columns}\n{lines}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_text_table(spark, str(tmp_path))
        assert rows(df, "row_no", "id") == [(n + 1, str(n)) for n in range(4000)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" in plan and "Window" not in plan and plan.count("FileScan parquet [_path") == plan.count("FileScan parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # other splits than those counted are noticed
    with pytest.raises(Exception, match="splits changed while reading"):
        df.select("id").collect()


def test_detect_encodings(spark, tmp_path):
    files = {
        "u.csv": ("城市\n" * 20000).encode(),
        "s.csv": "城市\n".encode("utf-8-sig"),
        "s no end.csv": "a\r\n城".encode("utf-8-sig"),
        "g.csv": "城市,北京\n".encode("gbk"),
        # plain for longer than any probe, then GBK; and cut inside a character
        "late.csv": b"plain\n" * 40000 + "城市".encode("gbk"),
        "cut.csv": "a\n城市".encode("gbk")[:-1],
        "bad.csv": b"\xff\xfe\x00\x81\x00",
        "mark.csv": b"\xef\xbb\xbf" + "城\n".encode("gbk"),
        "empty.csv": b"",
        "one.csv": b"x",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = detect_encodings(spark, str(tmp_path))
        got = {unquote(os.path.basename(r.path)): (r.encoding, r.ok) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = dict.fromkeys(("u.csv", "one.csv"), "utf-8") | dict.fromkeys(("s.csv", "s no end.csv"), "utf-8-sig")
    want |= dict.fromkeys(("g.csv", "late.csv"), "gbk") | dict.fromkeys(("cut.csv", "bad.csv", "mark.csv"))
    assert got == {name: (encoding, encoding is not None) for name, encoding in want.items()}
    assert "MapIn" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "sql",
    [
        "", "  -- only a comment", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t",
        "DROP TABLE t", "ALTER TABLE t ADD b INT", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) SELECT 1",
        "SELECT 1 /* c */ union select truncate(1)", "SELECT 'open", "'SELECT' 1", "( SELECT 1)",
    ],
)
def test_guard_refuses(sql):
    with pytest.raises(ValueError):
        guard.check_select(sql)


def test_guard_limits_on_request(spark):
    assert guard.check_select("select a from t;") == "select a from t"
    assert guard.check_select("SELECT a -- x\nFROM t limit 5") == "SELECT a  \nFROM t limit 5"
    assert guard.check_select("SELECT updated_at, created FROM t", limit=7).endswith("LIMIT 7")
    assert guard.guarded_select(spark, "SELECT id FROM {t} LIMIT 9", limit=3, t=spark.range(20)).count() == 3
    with pytest.raises(ValueError):
        guard.check_select("SELECT '" + "x" * 100 + "'", max_chars=100)


def test_guard_leaves_literals_alone(spark):
    row = guard.guarded_select(
        spark, "SELECT 'a--b' AS a, 'delete' AS b, 'the limit' AS c, '/* d */' AS d, 'it\\'s; drop' AS e -- update"
    ).first()
    assert tuple(row) == ("a--b", "delete", "the limit", "/* d */", "it's; drop")
    assert guard.check_select('SELECT "drop", `update` FROM t') == 'SELECT "drop", `update` FROM t'


def test_guarded_select_runs(spark):
    out = guard.guarded_select(spark, "SELECT id * 2 AS d FROM {t} WHERE id > 1", t=spark.range(4))
    assert sorted(r.d for r in out.collect()) == [4, 6]


def test_jdbc_options():
    config = {"type": "MySQL", "host": "h", "db_name": "d", "username": "u", "password": "p"}
    options = jdbc.query_options(config, "SELECT * FROM t")
    assert options["url"] == "jdbc:mysql://h:3306/d"
    assert options["query"] == "SELECT * FROM t"
    config["type"] = "postgresql"
    options = jdbc.table_options(config, 'a"b', partition_column="id", lower=1, upper=9, partitions=4)
    assert options["dbtable"] == '"a""b"'
    assert (options["lowerBound"], options["numPartitions"]) == ("1", "4")
    with pytest.raises(ValueError):
        jdbc.table_options(config, "t", partition_column="id")
    with pytest.raises(ValueError, match="no JDBC settings"):
        jdbc.connection_options({"type": "oracle"})
    with pytest.raises(ValueError):
        jdbc.query_options(config, "DROP TABLE t")


def test_list_tables_is_sorted(spark):
    for name in ("zeta_view", "alpha_view"):
        spark.range(1).createOrReplaceTempView(name)
    names = [r.table_name for r in list_tables(spark).collect()]
    assert names.index("alpha_view") < names.index("zeta_view")


def test_versions_ledger_and_rollback(spark, tmp_path, table, rows):
    base = str(tmp_path / "store")
    df = table("a b", [("1", " x"), ("", "y"), ("3", "z")])
    at = dt.datetime(2026, 9, 1, 12, 30)
    chain = [
        {"type": "fill_missing", "params": {"field": "a", "strategy": "drop_row"}},
        {"type": "strip_text", "params": {"field": "b"}},
    ]
    first = versions.write_version(df, chain, base, "data/orders.csv", preset_id=2, at=at)
    second = versions.write_version(df, chain[1:], base, "data/orders.csv", at=at)
    assert rows(versions.read_version(spark, base, first)) == [(1, "1", "x"), (2, "3", "z")]
    record = versions.ledger(spark, base).where(F.col("version") == first).first()
    assert record["product"] == "orders_cleaned_20260901_1230.csv"
    assert record.stats["rows_dropped_missing"] == "1"
    assert record.stats["strip_count"] == "1"
    assert versions.version_fields(spark, base, first).count() == 2

    versions.rollback(spark, base, first)
    live = versions.live_versions(versions.ledger(spark, base))
    assert [r.version for r in live.collect()] == [second]
    assert not os.path.exists(f"{base}/v={first}")
    assert versions.source_status(versions.ledger(spark, base), "data/orders.csv").first().status == "cleaned"
    versions.rollback(spark, base, second)
    assert versions.source_status(versions.ledger(spark, base), "data/orders.csv").first().status == "imported"
    with pytest.raises(ValueError, match="no run has the version"):
        versions.rollback(spark, base, first)


def test_two_writers_commit_one_after_the_other(spark, tmp_path, table):
    base, df = str(tmp_path / "store"), table("a b", [("1", " x"), ("1", " x"), ("", "y"), ("300", "z")])
    chain = [
        {"type": "strip_text", "params": {"field": "b"}},
        {"type": "drop_duplicates", "params": {"columns": None}},
        {"type": "fill_missing", "params": {"field": "a", "strategy": "drop_row"}},
    ]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: versions.write_version(df, chain, base, f"s{i}.csv"), range(4)))
    log = versions.ledger(spark, base)
    assert sorted(r.seq for r in log.collect()) == [0, 1, 2, 3]
    assert sorted(n for n in os.listdir(f"{base}/_log") if n.endswith(".json")) == [f"{i:020d}.json" for i in range(4)]
    assert {r.version for r in log.collect()} == set(made)
    stats = log.first().stats
    assert (stats["rows_before"], stats["rows_after"], stats["rows_dropped_dedup"], stats["strip_count"]) == ("4", "2", "1", "2")
    fields = {r.field_name: r.inferred_type for r in versions.version_fields(spark, base, made[0]).collect()}
    assert fields == {"a": "integer", "b": "text"}

    def undo(_):
        try:
            versions.rollback(spark, base, made[0])
            return "done"
        except ValueError as error:
            return str(error)

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(undo, range(2))) == ["done", f"no run has the version {made[0]}"]
    # a frame made before does not see the later commit
    assert log.count() == 4 and versions.ledger(spark, base).count() == 5
    states = {r.source: (r.status, r.live_cnt) for r in versions.source_states(versions.ledger(spark, base)).collect()}
    assert states == {"s0.csv": ("imported", 0), "s1.csv": ("cleaned", 1), "s2.csv": ("cleaned", 1), "s3.csv": ("cleaned", 1)}


def test_put_if_absent_never_replaces(spark, tmp_path):
    target = str(tmp_path / "log" / "one file")
    assert versions.put_if_absent(spark, target, "first")
    assert not versions.put_if_absent(spark, target, "second")
    assert open(target).read() == "first" and os.listdir(tmp_path / "log") == ["one file"]


def test_a_run_reads_its_source_once(spark, tmp_path, table):
    source = str(tmp_path / "in")
    table("order_date amount channel age", [("2026/1/2", "1,000", "", "5"), ("2026/1/2", "1,000", "", "5")]).write.parquet(source)
    frame = P.accounted(spark.read.parquet(source), P.PRESETS[P.ORDERS_PRESET])[-1].frame
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    stats = P.change_stats(spark.read.parquet(source), P.PRESETS[P.ORDERS_PRESET])
    stats.collect()
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"FileScan[^\n]*", plan))) == 1, plan


def test_a_failing_run_leaves_nothing_visible(spark, tmp_path, table):
    base = str(tmp_path / "store")
    df = table("a", [("x",), ("",)])
    good = [{"type": "strip_text", "params": {"field": "a"}}]
    versions.write_version(df, good, base, "s.csv")
    with pytest.raises(Exception, match="has no numbers to take the mean"):
        versions.write_version(
            df, [{"type": "fill_missing", "params": {"field": "a", "strategy": "mean"}}], base, "s.csv"
        )
    assert versions.ledger(spark, base).count() == 1


def test_exports(spark, tmp_path, table):
    events = spark.createDataFrame(
        [(1, "a", '{"k": 1}', "t"), (2, "a", "junk", "t"), (3, "b", None, "t")],
        "id bigint, event string, params_json string, created_at string",
    )
    versions.export_events(events, str(tmp_path / "e"))
    back = {r.id: r.params for r in spark.read.json(str(tmp_path / "e/events")).collect()}
    assert back[1].k == "1"
    counts = {r.event: r.cnt for r in spark.read.json(str(tmp_path / "e/summary")).collect()}
    assert counts == {"a": 2, "b": 1}
    df = table("a b", [(str(i), "") for i in range(20)])
    versions.export_table(df, str(tmp_path / "t"))
    again = read_text_table(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in again.orderBy("row_no").collect()] == [(i + 1, str(i), "") for i in range(20)]


# --- field catalog -----------------------------------------------------------------------------


def test_catalog_of_a_query_result(table):
    df = table(
        "id name amount created_at",
        [
            (str(i + 1), n, a, f"2026-08-0{i + 1}")
            for i, (n, a) in enumerate(
                zip(["甲", "乙", "丙", "丁", "戊"], ["1,200.50", "3,400", "560.25", "", "7,890.00"])
            )
        ],
    )
    got = {r.field_name: r for r in C.field_catalog(df).collect()}
    labels = {k: (r.inferred_type, r.hint) for k, r in got.items()}
    assert labels == {
        "id": ("integer", ""),
        "name": ("text", ""),
        "amount": ("mixed", "contains thousands text"),
        "created_at": ("date", "suspected date"),
    }
    assert got["amount"].missing_rate == 0.2
    assert got["amount"].sample_values == ["1,200.50", "3,400", "560.25"]


@pytest.mark.parametrize(
    ("values", "label"),
    [
        (["", "NA"], ("text", "")),
        (["yes", "N", "是"], ("boolean", "")),
        (["1", "2.5"], ("decimal", "")),
        (["1,000", "2,000.5"], ("text", "suspected number")),
        (["1", "x"], ("mixed", "")),
        (["2026/1/1", "x"], ("date", "suspected date")),
        (["2026/1/1", "1,000"], ("text", "")),
        (["1", "2026/1/1"], ("text", "")),
        (["x", "y"], ("text", "")),
    ],
)
def test_type_rules(table, values, label):
    row = C.infer_types(table("v", [(v,) for v in values])).first()
    assert (row.inferred_type, row.hint) == label


def test_inference_looks_at_all_values(table):
    df = table("v", [("1",)] * 5000 + [("x",)])
    assert C.infer_types(df).first().inferred_type == "mixed"
    assert P.column_types(C.infer_types(df.where("row_no > 1"))) == {"v": "mixed"}
