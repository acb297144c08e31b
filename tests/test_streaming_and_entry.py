import os

import pytest

import __spark_entry__ as entry
from tidebook import cli
from tidebook.operators import ledger, matching
from tidebook.plans import ledger_queries
from tidebook.schemas import COMMANDS
from tidebook.sources import partition_map
from tidebook.streaming.ledger_stream import ledger_stream
from tidebook.streaming.match_stream import acked_sink, callback_sink, match_stream

from .test_matching import flow, frame

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch_across_micro_batches_and_restart(spark, tmp_path):
    rows = flow(31, 240)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    c = frame(spark, rows)

    def feed(lo, hi):
        c.filter(f"iseq > {lo} and iseq <= {hi}").coalesce(1).write.mode("append").parquet(src)

    def drain():
        q = match_stream(spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.option("checkpointLocation", ck).foreachBatch(acked_sink(out)).trigger(availableNow=True).start()
        q.awaitTermination()

    feed(0, 70)
    feed(70, 150)
    drain()
    feed(150, 240)
    feed(200, 240)  # delivered twice
    drain()  # a new query from the same checkpoint
    got = spark.read.parquet(out).drop("batch")
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: x[:3]) == sorted((tuple(r) for r in matching.match(c).collect()), key=lambda x: x[:3])


def test_callback_sink_hands_over_each_partition_in_order(spark, tmp_path):
    c, out = frame(spark, flow(8, 120)), str(tmp_path / "log")

    def handle(partition, e):
        with open(f"{out}-{partition}", "a") as f:
            f.write(f"{e['symbol']} {e['iseq']} {e['ordinal']}\n")

    src = str(tmp_path / "in")
    c.coalesce(1).write.parquet(src)
    match_stream(spark.readStream.schema(COMMANDS).parquet(src)).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(callback_sink(handle, 3)).trigger(availableNow=True).start().awaitTermination()
    from tidebook.functions import routing

    want = {}
    for r in routing.with_partition(matching.match(c), 3).orderBy("iseq", "ordinal").collect():
        want.setdefault(r.partition, []).append(f"{r.symbol} {r.iseq} {r.ordinal}")
    assert {p: open(f"{out}-{p}").read().splitlines() for p in want} == want


def test_ledger_stream_equals_batch(spark, tmp_path):
    names = [x.split(" ", 1)[0] for x in ledger.CMDS.split(", ")]
    rows = [{"shard": n % 2, "lsn": n, "cmd": "deposit", "account": n % 3, "asset": 2, "amount": 100 + n, "external_id": n % 25} if n % 4 < 2 else {"shard": n % 2, "lsn": n, "cmd": "reserve", "account": n % 3, "symbol": 10, "side": "buy", "price": 7, "qty": 1 + n % 5} for n in range(80)]
    df = ledger_queries.cmds(spark.createDataFrame([tuple(r.get(f) for f in names) for r in rows], ledger.CMDS.replace("decimal(38,0)", "long")))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 30):
        df.filter(f"lsn >= {lo} and lsn < {lo + 50}").coalesce(1).write.mode("append").parquet(src)  # 30 to 49 arrive twice
    q = ledger_stream(spark.readStream.schema(ledger.CMDS).option("maxFilesPerTrigger", 1).parquet(src), ledger_queries.SYMBOLS).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(acked_sink(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["shard", "lsn", "outcome", "reject", "order_id", "outbox_idx"]
    want = ledger.run_ledger(df, ledger_queries.SYMBOLS, 0, False).select(*cols)
    assert sorted(map(repr, spark.read.parquet(out).select(*cols).collect())) == sorted(map(repr, want.collect()))


def test_partition_table_file(spark, tmp_path):
    f = tmp_path / "t.map.jsonl"
    f.write_text('{"format":"x-partition-map/1","partitions":4}\n{"symbol":5,"partition":3}\n\n{"symbol":9,"partition":0}\n')
    assert sorted(map(tuple, partition_map.read(spark, str(f), 4).collect())) == [(5, 3), (9, 0)]
    with pytest.raises(ValueError):
        partition_map.read(spark, str(f), 5)
    f.write_text('{"format":"x-partition-map/1","partitions":4}\n{"symbol":5,"partition":4}\n')
    with pytest.raises(ValueError):
        partition_map.read(spark, str(f), 4)


def test_cli_runs_a_command_file(spark, tmp_path, capsys):
    f = tmp_path / "a.cmd.jsonl"
    new = '{"cmd":"new","order_id":%d,"side":"%s","otype":"limit","price":5,"qty":2,"tif":"gtc"}'
    f.write_text("\n".join(['{"format":"x","pmin":0,"pmax":9}', new % (1, "bid"), "", new % (2, "ask")]) + "\n")
    assert cli.main(["run", str(f)]) == 0
    assert capsys.readouterr().out.splitlines()[1] == '{"seq":2,"ev":"trade","maker":1,"taker":2,"price":5,"qty":2}'
    f.write_text('{"format":"x"}\nnonsense\n')
    assert cli.main(["run", str(f)]) == 2
    assert cli.main(["fuzz", "--commands", "300", "--seed", "4"]) == 0
    f.write_text(capsys.readouterr().out)
    assert cli.main(["run", str(f), "--partitions", "2"]) == 0
    assert len(capsys.readouterr().out.splitlines()) >= 300
    assert cli.main(["bench", "--commands", "2000", "--symbols", "5"]) == 0
    assert '"commands": 2000' in capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def engine_names():
    from tidebook.plans import queries

    return sorted(queries.ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", engine_names())
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    df, sql = entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    pick = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, con.sql(f"select {pick} from sql").fetchall()))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Events of which some 139,000 rest in one book: more, and half of them as well, than a book of the default configuration takes."""
    folder = str(tmp_path_factory.mktemp("wide"))
    e = spark.range(140_000).selectExpr("id as event_id", "id % 3 * 8 as user_id", "if(id % 700 = 699, 'error', if(id % 2 = 0, 'click', 'view')) as event_type", "cast(id % 50 as double) as value")
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


WIDE = ["command_file_events", "event_journal_of_records", "match_table_function", "passive_events_streamed", "snapshot_round_trip", "book_at_cut_passive", "book_counts", "book_depth", "book_levels", "event_listing", "level_total", "merged_events", "passive_events", "resting_orders", "snapshot_file_passive"]


@pytest.mark.parametrize("name", WIDE)
def test_closed_forms_know_no_full_book(spark, wide, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{wide}/events.parquet/*.parquet'")
    df, sql = entry.queries()[name](spark, wide), con.sql(entry.oracle_sql()[name])
    pick = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(f"select {pick} from sql").fetchall()))
