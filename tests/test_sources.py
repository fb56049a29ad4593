import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.plans.frontend import PlanService, StatementError, summarize
from quillon.repl import Prompt, aligned
from quillon.session import Engine
from quillon.sources import catalog, dsn, innodb
from quillon.sources.extract import extract_tables
from quillon.streaming.windows import drained, event_stream, tumbling


def test_strict_dsn():
    found = dsn.strict("mysql://ana:geheim@db1:3307/shop")
    assert (found.driver, found.native) == ("mysql", "ana:geheim@tcp(db1:3307)/shop")
    assert found.jdbc_url == "jdbc:mysql://db1:3307/shop"
    found = dsn.strict("postgres://bo:tajna@db2:5433/depot")
    assert (found.driver, found.native) == ("postgres", "postgres://bo:tajna@db2:5433/depot")
    for wrong in ("postgresql://a:b@c/d", "oracle://u:p@db3/x", "nothing", "mysql://root@localhost", "mysql://u@h:port/d"):
        with pytest.raises(dsn.DsnError):
            dsn.strict(wrong)


def test_lenient_dsn():
    assert dsn.lenient("postgres://bo:tajna@db2:5433/depot").native.endswith("/depot?sslmode=disable")
    assert dsn.lenient("postgresql://u@h/d?x=1").native.endswith("?x=1&sslmode=disable")
    assert dsn.lenient("postgres://u@h/d?sslmode=require").options == {"sslmode": "require"}
    assert dsn.lenient("oracle://u:p@db3/x").driver == "mysql"
    assert dsn.lenient("u:p@tcp(h:3306)/d").native == "u:p@tcp(h:3306)/d"
    found = dsn.lenient("mysql://u:p@ss%2Fw@h/d")
    assert (found.user, found.password, found.host, found.port) == ("u", "p@ss/w", "h", None)
    assert found.jdbc_properties["password"] == "p@ss/w" and "p@ss" not in repr(found)


def test_guided_dsn():
    found = dsn.guided("PostgreSQL", "d")
    assert (found.driver, found.host, found.port, found.user, found.options) == ("postgres", "localhost", 5432, "postgres", {"sslmode": "disable"})
    assert dsn.guided("mysql", "d").native == "root@tcp(localhost:3306)/d"
    for kind, name, port in (("oracle", "d", ""), ("mysql", " ", ""), ("mysql", "d", "x")):
        with pytest.raises(dsn.DsnError):
            dsn.guided(kind, name, port=port)


def test_quoted_names():
    assert catalog.quoted("mysql", "a.b`c") == "`a`.`b``c`"
    assert catalog.quoted("postgres", 'x"y') == '"x""y"'


def test_csv_and_sql(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,grade\n1,8\n2,\n3,K\n")
    engine = Engine(spark)
    assert engine.register_csv("csv_t", str(tmp_path / "t.csv")).dtypes == [("id", "int"), ("grade", "string")]
    assert "csv_t" in engine.tables()
    assert [r.id for r in engine.sql("select id from csv_t where grade = '8'").collect()] == [1]
    assert engine.register_csv("csv_s", str(tmp_path / "t.csv"), schema="id long, grade string").dtypes[0] == ("id", "bigint")
    for change in ("delete from csv_t", "update csv_t set id = 1", "insert into csv_t values (1, 'x')"):
        with pytest.raises(StatementError):
            engine.sql(change)


def test_functions_and_persist(spark):
    import pandas as pd

    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    engine = Engine(spark)
    engine.register_function("twice", twice, "long")
    spark.range(3).createOrReplaceTempView("kept_t")
    assert engine.persist("kept_t").is_cached
    assert [r[0] for r in engine.sql("select twice(id) from kept_t order by 1").collect()] == [0, 2, 4]
    spark.catalog.uncacheTable("kept_t")


def test_extract(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    assert extract_tables(spark, "", ["a", "b"], str(tmp_path), tables.__getitem__) == {"a": 3, "b": 0}
    assert spark.read.parquet(str(tmp_path / "a.parquet")).count() == 3
    with pytest.raises(KeyError):
        extract_tables(spark, "", ["a", "none"], str(tmp_path), tables.__getitem__)
    with pytest.raises(dsn.DsnError):
        extract_tables(spark, "oracle://u:p@h/d", ["a"], str(tmp_path))


@pytest.mark.parametrize(
    ("text", "kind", "tables"),
    [
        ("SELECT marks.score FROM marks, enrollments WHERE subjects.name='x' AND classrooms.grade='8'", "SELECT", ["marks", "enrollments"]),
        ("select * from a join b on a.k=b.k join c on b.k=c.k order by 1 limit 3", "SELECT", ["a", "b", "c"]),
        ("select * from db.a x, (select * from b where k in (select k from c)) y", "SELECT", ["a", "b", "c"]),
        ("with x as (select * from t), y as (select * from x) select distinct * from y join x on true", "SELECT", ["t"]),
        ("select (select max(k) from u) from t where exists (select 1 from v where v.k = t.k)", "SELECT", ["t", "u", "v"]),
        ("insert into t select * from s", "INSERT", []),
        ("update t set a = 1", "UPDATE", []),
        ("delete from t", "DELETE", []),
    ],
)
def test_summary(spark, text, kind, tables):
    found = summarize(spark, text)
    assert found.query_type == kind and sorted(found.table_names) == sorted(tables)


@pytest.mark.parametrize("text", ["select 1 union select 2", "create table t (k int)", "drop table t", "show tables", "selec 1", ""])
def test_summary_refuses(spark, text):
    with pytest.raises(StatementError):
        summarize(spark, text)


def test_plan_service(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("three")
    service = PlanService(spark)
    assert service.submit_plan("q", "select count(*) n from three").success
    assert '"plan"' in service.optimize("q").message
    assert service.execute_plan("q").message == '{"n":3}'
    assert not service.execute_plan("none").success and not service.optimize("none").success
    service.submit_plan("r", "select id from three order by id")
    assert service.execute_plan("r").message == "\n".join(f'{{"id":{k}}}' for k in range(3))
    found = json.loads(service.execute_plan("r", out=str(tmp_path / "rows")).message)
    assert found == {"path": str(tmp_path / "rows"), "rows": 3} and spark.read.json(found["path"]).count() == 3
    service.submit_plan("long", "select id from range(20000)")
    assert service.execute_plan("long").message.count("\n") == 19_999
    assert [r.success for r in service.apply(["select 1", "bad sql", "select none from three", "select 2", "delete from three"])] == [True, False, False, True, False]


PAGE_PARTS = [(24, b"\x45\xbf"), (38, b"\x00\x01"), (113, b"\x04"), (120, b"\x00\x00\x00\x00\x0a\x1b"), (126, b"\x80\x00\x00\x01\x02\x03\x04"), (133, b"\x00\x00\x00\x5f"), (137, b"CBSE"), (16382, b"\x00\x78")]


def page(parts):
    data = bytearray(16384)
    for at, raw in parts:
        data[at : at + len(raw)] = raw
    return bytes(data)


def test_pages_and_rows(spark, tmp_path):
    three = [(38, b"\x00\x03"), (16380, b"\x00\x78"), (16378, b"\x00\x78")]
    high = [(133, b"\x80\x00\x00\x01"), (0, b"\xff" * 4), (16, b"\xff" * 8)]
    (tmp_path / "t.ibd").write_bytes(page(PAGE_PARTS) + page([]) + page(PAGE_PARTS + three + high))
    pages = innodb.read_pages(spark, str(tmp_path / "t.ibd"))
    same = innodb.read_tablespace(spark, str(tmp_path / "t.ibd"), pages_per_task=2)
    assert sorted(map(tuple, same.select("page_no", "page").collect())) == sorted(map(tuple, pages.select("page_no", "page").collect()))
    rows = sorted(map(tuple, innodb.rows_of(same).select("page_no", "slot", "place", "score", "board").collect()))
    assert rows == [(0, 0, 120, 95, "CBSE"), *[(2, k, 120, 2**31 + 1, "CBSE") for k in range(3)]]
    first = innodb.rows_of(pages).where("page_no = 0").first()
    assert bytes(first.transaction_id).hex() == "000000000a1b" and bytes(first.roll_pointer).hex() == "80000001020304"
    assert innodb.rows_of(pages, n_var=0).where("page_no = 0").first().board is None
    head = pages.where("page_no = 2").select(innodb.fil_header(F.col("page")).alias("h"), innodb.page_header(F.col("page")).alias("p")).first()
    assert (head.h.checksum, int(head.h.lsn), head.h.page_type, head.p.n_dir_slots) == (2**32 - 1, 2**64 - 1, 17855, 3)
    assert innodb.rows_of(pages, index_only=True).count() == 4


def test_lengths_with_nine_nullable_columns(spark):
    data = page([(38, b"\x00\x01"), (120 - 5 - 2 - 2, b"\x02\x09"), (133, b"\x00\x00\x00\x01ABCD"), (16382, b"\x00\x78")])
    frame = spark.createDataFrame([("m", 0, data)], "path string, page_no int, page binary")
    assert innodb.rows_of(frame, n_nullable=9, n_var=2).first().board == "AB"


def test_short_file(spark, tmp_path):
    (tmp_path / "s.ibd").write_bytes(b"x" * 20_000)
    for read in (innodb.read_pages, innodb.read_tablespace):
        with pytest.raises(Exception, match="ends inside a page"):
            read(spark, str(tmp_path / "s.ibd")).collect()


def test_header_of_a_short_page(spark):
    frame = spark.createDataFrame([(bytearray(37),), (bytearray(93),)], "page binary")
    rows = frame.select(innodb.fil_header(F.col("page")), innodb.page_header(F.col("page"))).collect()
    assert rows[0][0] is None and rows[1][0] is not None and rows[1][1] is None


def test_prompt(spark):
    spark.createDataFrame([(1, None), (22, "x")], "id int, name string").createOrReplaceTempView("prompt_t")
    lines = iter(["bad", "1", "nonsense", "3", "", "select * from prompt_t order by id;", "selec", "delete from prompt_t", "/dc", "2", "oracle", "mysql", "", "", "", "", "d", "/q"])
    out, seen = io.StringIO(), []
    Prompt(Engine(spark), lambda _: next(lines), out, connect=seen.append).run()
    text = out.getvalue()
    assert "id  | name" in text and "\n1   |\n" in text and "\n22  | x\n" in text and "[2 rows in set (" in text
    assert text.count("error: ") == 2 and "connection failed" in text
    assert [s.native for s in seen] == ["root@tcp(localhost:3306)/d"]


def test_prompt_ends_with_its_input(spark):
    def closed(_):
        raise EOFError

    Prompt(Engine(spark), closed, io.StringIO()).run()


def test_aligned_prints_all_rows():
    out = io.StringIO()
    assert aligned(["k"], ([str(k)] for k in range(2500)), out) == 2500
    assert out.getvalue().count("\n") == 2501


def test_stream_matches_the_table(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 5:02d}:{k % 60:02d}:00", "a" if k % 2 else "b", float(k)) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id int, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    streamed = drained(tumbling(event_stream(spark, str(tmp_path / "in")), late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    table = tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    closed = {tuple(r) for r in streamed.collect()}
    whole = {tuple(r) for r in table.collect()}
    last = max(r[0] for r in whole)
    assert closed == {r for r in whole if r[0] < last}


def test_rows_that_cannot_be_shown_are_skipped():
    class Narrow(io.StringIO):
        def write(self, text):
            return super().write(text.encode("ascii").decode())

    out = Narrow()
    assert aligned(["k"], [["a"], ["é"], ["b"]], out) == 2
    assert "row skipped: UnicodeEncodeError" in out.getvalue() and "\nb\n" in out.getvalue()


def test_connect_asks_the_database_first(spark, monkeypatch):
    from quillon import session

    asked = []
    monkeypatch.setattr(session.catalog, "ping", lambda _, found: bool(asked.append(found.host)) or found.host == "up")
    monkeypatch.setattr(session.catalog, "attach", lambda _, found: ["t"])
    engine = Engine(spark)
    assert engine.connect(dsn.lenient("mysql://u:p@up/d")) == ["t"]
    lines, out = iter(["1", "mysql://u:p@down/d", "exit"]), io.StringIO()
    Prompt(engine, lambda _: next(lines), out).run()
    assert asked == ["up", "down"] and "connection failed: no answer from down" in out.getvalue()


@pytest.mark.parametrize("kind", ["orc", "json", "csv", "parquet"])
def test_files_of_other_kinds(spark, tmp_path, kind):
    engine = Engine(spark)
    spark.range(10).selectExpr("id", "id % 2 as odd").createOrReplaceTempView("written")
    engine.write("select id, odd from written", str(tmp_path / "t"), kind, by=["odd"])
    engine.register_files("read_back", str(tmp_path / "t"), kind, schema="id long, odd long")
    assert tuple(engine.sql("select sum(id), sum(odd), count(*) from read_back").first()) == (45, 5, 10)
    with pytest.raises(Exception, match="already exists"):
        engine.write("select 1", str(tmp_path / "t"), kind)


def test_functions_that_sql_can_call(spark):
    class Letters:
        def eval(self, text: str):
            for c in text:
                yield (c,)

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    engine = Engine(spark)
    engine.register_aggregate("spread", spread, "double")
    engine.register_table_function("letters", Letters, "c string")
    assert engine.sql("select spread(id) from range(3, 9)").first()[0] == 5
    assert [r.c for r in engine.sql("select c from letters('abc')").collect()] == ["a", "b", "c"]
