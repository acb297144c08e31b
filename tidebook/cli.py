"""python -m tidebook.cli run|recover|snap|bench|fuzz: exit code 0, 2 for corrupt input, 1 otherwise."""

from __future__ import annotations

import argparse
import json
import random
import sys
import time

from pyspark.sql import SparkSession


def fuzz(seed: int, commands: int, symbols: int):
    """Lines of a command file whose orders rest, cross, are replaced and cancelled."""
    r = random.Random(seed)
    yield '{"format":"fuzz/1","engine":true,"pmin":0,"pmax":1000000,"max_orders":65536,"index":"ladder"}'
    for n in range(1, commands + 1):
        head, old = {"symbol": r.randrange(symbols)}, r.randrange(1, n + 1)
        kind = r.random()
        if kind < 0.7:
            c = {"cmd": "new"} | head | {"order_id": n, "side": r.choice(["bid", "ask"]), "otype": "limit" if r.random() < 0.9 else "market", "price": 1000 + r.randrange(-20, 21), "qty": r.randrange(0, 30), "tif": r.choice(["gtc", "gtc", "ioc", "fok", "post_only"])}
        elif kind < 0.85:
            c = {"cmd": "cancel"} | head | {"order_id": old}
        else:
            c = {"cmd": "replace"} | head | {"order_id": old, "price": 1000 + r.randrange(-20, 21), "qty": r.randrange(0, 30)}
        yield json.dumps(c, separators=(",", ":"))


def random_commands(spark, commands: int, symbols: int):
    """The same mixture as a DataFrame made on the executors, by hashes of the command's number."""
    h = lambda k, n: f"pmod(xxhash64(id, {k}), {n})"
    return spark.range(1, commands + 1).selectExpr(
        "id as iseq", f"{h(1, symbols)} as symbol", f"case when {h(2, 100)} < 70 then 'new' when {h(2, 100)} < 85 then 'cancel' else 'replace' end as cmd", f"if({h(2, 100)} < 70, id, 1 + {h(3, 'id')}) as order_id",
        f"if({h(4, 2)} = 0, 'bid', 'ask') as side", f"if({h(5, 10)} = 0, 'market', 'limit') as otype", f"980 + {h(6, 41)} as price", f"{h(7, 30)} as qty", f"element_at(array('gtc', 'gtc', 'ioc', 'fok', 'post_only'), cast(1 + {h(8, 5)} as int)) as tif",
    )


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidebook")
    sub = p.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="match a command file (JSON lines with a header)")
    run.add_argument("file")
    run.add_argument("--partitions", type=int, default=1)
    for name in ("recover", "snap"):
        q = sub.add_parser(name, help="replay a journal folder")
        q.add_argument("folder")
        q.add_argument("--snapshot")
        q.add_argument("--cut", type=int, default=0)
        q.add_argument("--repair", action="store_true")
    load = sub.add_parser("fuzz", help="print a random command file")
    load.add_argument("--seed", type=int, default=1)
    load.add_argument("--commands", type=int, default=1000)
    load.add_argument("--symbols", type=int, default=4)
    bench = sub.add_parser("bench", help="match random commands; prints one JSON line")
    bench.add_argument("--commands", type=int, default=1_000_000)
    bench.add_argument("--symbols", type=int, default=64)
    a = p.parse_args(argv)
    if a.cmd == "fuzz":
        for line in fuzz(a.seed, a.commands, a.symbols):
            print(line)
        return 0

    from .functions import lines, routing
    from .operators import matching
    from .plans.recovery import Corrupt, recover
    from .sources import corpus

    spark = SparkSession.builder.getOrCreate()
    try:
        if a.cmd == "bench":
            began = time.perf_counter()
            events = matching.match(random_commands(spark, a.commands, a.symbols)).count()
            took = time.perf_counter() - began
            print(json.dumps({"commands": a.commands, "events": events, "seconds": round(took, 3), "commands_per_s": round(a.commands / took)}))
            return 0
        if a.cmd == "run":
            cmds, config, tagged = corpus.read(spark, a.file)
            out = routing.with_partition(matching.match(cmds, config), a.partitions).orderBy("partition", "iseq", "ordinal").select(lines.event_line(tagged).alias("line"))
        else:
            state = recover(spark, a.folder, a.snapshot, a.cut, "repair" if a.repair else "strict")
            if a.cmd == "recover":
                out = matching.events_of(state).orderBy("iseq", "ordinal").select(lines.event_line().alias("line"))
            else:
                out = lines.snapshot_lines(matching.books_of(state), matching.resting_of(state)).orderBy("n1", "n2", "n3").select("line")
        for r in out.toLocalIterator():
            print(r["line"])
    except (Corrupt, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
