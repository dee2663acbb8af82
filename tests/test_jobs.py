"""Chains, packed hubs, cheapest paths, case lookup, pages, dated sinks and streams against plain versions."""

import heapq
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerhop.operators import lookup, paths, risk
from ledgerhop.sources import sinks
from ledgerhop.streaming import transfers as streaming
from samples import case, edges, transfers


def plain_chains(nxt):
    before = set(nxt.values())
    out = {}
    for start in nxt:
        seen, at = [start], nxt[start]
        while at is not None and at not in seen:
            seen.append(at)
            at = nxt[at]
        if start not in before:
            out[start] = (seen[-1], len(seen), at is not None)
        elif at == start and start == min(seen) and not any(b in seen and a not in seen for a, b in nxt.items()):
            out[start] = (seen[-1], len(seen), True)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_maximal_chains(spark, seed):
    rng = random.Random(seed)
    nxt = {i: rng.choice([None, rng.randrange(60)]) for i in range(60)}
    nxt |= {100: 101, 101: 102, 102: 100, 110: 110, 120: 121, 121: 122, 122: 121}
    nxt |= {200 + i: 201 + i for i in range(40)} | {240: None}
    found = risk.maximal_chains(spark.createDataFrame(list(nxt.items()), "id bigint, nxt bigint").repartition(3))
    assert {r["head"]: (r["last"], r["steps"], r["looped"]) for r in found.collect()} == plain_chains(nxt)
    straight = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id bigint, nxt bigint")
    assert [tuple(r) for r in risk.maximal_chains(straight).select("head", "last", "steps", "looped").collect()] == [(1, 3, 3, False)]


def test_peel_chains_go_on_over_the_days(spark):
    rows, holder = [], "a0"
    for n in range(5):
        rows += [(f"l{n}", holder, f"a{n + 1}", "9.5"), (f"s{n}", holder, f"b{n}", "0.5")]
        holder = f"a{n + 1}"
    e = edges(spark, rows).withColumn("day", F.concat(F.lit("d"), F.substring("transfer_id", 2, 1)))
    found = risk.maximal_peel_chains(e, ["chain"], "day").collect()
    assert [(r["head"]["node"], r["last"]["node"], r["steps"], r["change_address"]) for r in found] == [("a0", "a4", 5, "a5")]
    back = e.withColumn("day", F.translate("day", "01234", "43210"))  # each split a day before the one it should follow
    assert risk.maximal_peel_chains(back, ["chain"], "day").count() == 0


@pytest.mark.parametrize("hub_load", [1, 60, 10**9])
def test_reconvergence_with_and_without_words(spark, hub_load, monkeypatch):
    rng = random.Random(7)
    pairs = {(f"s{rng.randrange(40)}", f"m{rng.randrange(70)}") for _ in range(900)} | {(f"m{rng.randrange(70)}", f"t{rng.randrange(15)}") for _ in range(500)}
    pairs |= {(f"s{rng.randrange(40)}", f"x{rng.randrange(400)}") for _ in range(300)} | {(f"x{rng.randrange(400)}", f"t{rng.randrange(15)}") for _ in range(300)}
    pairs |= {(f"m{rng.randrange(70)}", f"s{rng.randrange(40)}") for _ in range(100)}
    monkeypatch.setattr(risk, "WORD_ROWS", 50)
    e = edges(spark, [(f"e{n}", a, b, 1) for n, (a, b) in enumerate(sorted(pairs))])
    out, count = defaultdict(set), Counter()
    for a, b in pairs:
        out[a].add(b)
    for a in list(out):
        for m in out[a]:
            for b in out.get(m, ()):
                if a != b:
                    count[a, b] += 1
    for more_than in (2, 5):
        got = {(r["source"], r["target"]): r["middles"] for r in risk.reconvergence(e, ["chain"], more_than, hub_load).collect()}
        assert got == {k: n for k, n in count.items() if n > more_than}


def test_cheapest_paths(spark):
    rng = random.Random(5)
    rows = [(f"t{n}", f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.randint(1, 50)) for n in range(120)]
    rows += [(f"c{n}", f"k{n}", f"k{n + 1}", 10) for n in range(30)] + [("j", "n0", "k0", 10)]
    cost = {}
    for _, a, b, v in rows:
        if a != b:
            cost[a, b] = min(cost.get((a, b), 9.0), 1.0 / v)
    best, queue = {}, [(0.0, "n0")]
    while queue:
        d, at = heapq.heappop(queue)
        if at not in best:
            best[at] = d
            for (a, b), c in cost.items():
                if a == at:
                    heapq.heappush(queue, (d + c, b))
    for bottleneck in (False, True):
        found = {r["node"]: r for r in paths.highest_value_paths(case(spark, "n0"), edges(spark, rows), bottleneck=bottleneck).collect()}
        assert set(found) == set(best)
        for node, r in found.items():
            steps = list(zip(r["path"], r["path"][1:]))
            assert r["path"][0] == "n0" and r["path"][-1] == node and len(set(r["path"])) == len(r["path"])
            if bottleneck:
                assert node == "n0" or r["value"] == min(1.0 / cost[s] for s in steps)
            else:
                assert r["cost"] == pytest.approx(best[node]) == pytest.approx(sum(cost[s] for s in steps))


def test_names_that_contain_names(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab_") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"", "abab%", "x"})
    df = spark.createDataFrame([(n,) for n in names], "inner string")
    got = {tuple(r) for r in lookup.containing_names(df, df.withColumnRenamed("inner", "outer")).collect()}
    assert got == {(a, b) for a in names for b in names if a and a in b}


def test_cases_are_answered_in_order(spark):
    rows = [("t1", "a", "b", 1), ("t2", "b", "c", 1), ("t3", "x", "y", 1), ("t4", "q", "z", 1)]
    e = edges(spark, rows).withColumn("alias", F.when(F.col("transfer_id") == "t3", "File_X")).withColumn(
        "chain", F.when(F.col("transfer_id") == "t4", "polygon").otherwise(F.col("chain"))
    )
    cases = [("File_X", "eth", "a"), ("my FILE_x case", "eth", "a"), ("ile", None, None), ("c1", "eth", "A"), ("c2", "eth", "none"), ("c3", None, "a"),
             ("c4", "tron", "a"), (None, "eth", "a"), ("c1", "eth", "A")]
    found = lookup.case_edges_of(spark.createDataFrame(cases, "case_id string, chain string, suspect string"), e)
    got = sorted((r["case_id"], r["answered_by"], r["transfer_id"]) for r in found.collect())
    want = [("File_X", "ALIAS", "t3"), ("my FILE_x case", "NAME", "t3"), ("ile", "NAME", "t3"), ("c1", "CLOSURE", "t1"), ("c1", "CLOSURE", "t2")]
    want += [("c2", "CHAIN", t) for t in ("t1", "t2", "t3")] + [("c3", "ALL", t) for t in ("t1", "t2", "t3", "t4")]
    assert got == sorted(want)


def test_deep_pages_read_their_parts_only(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n")).repartition(5)
    table = lookup.ordered_table(df, [F.desc("n")], parts=8)
    assert sum(n for _, _, n in table.parts) == 1000 and len(table.parts) > 1
    for offset in (0, 333, 990):
        rows = table.page(20, offset).orderBy("position").collect()
        assert [(r["n"], r["position"]) for r in rows] == [(999 - k, k + 1) for k in range(offset, min(1000, offset + 20))]
        assert all(r["has_more"] == (offset + 20 < 1000) for r in rows)
    assert table.page(10, 5000).count() == 0
    read = {r[0] for r in table.page(20, 333).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(read) <= 2


def test_insert_reads_the_folders_of_the_batch_only(spark, tmp_path):
    root = str(tmp_path / "db")
    sinks.reset_tables(spark, root)
    rows = transfers(spark, [(f"t{n}", "a", "b", n + 1) for n in range(40)])
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.substring("transfer_id", 2, 5).cast("int") * 86400 * 9))
    odd = transfers(spark, [("t900", "a", "b", 1)]).withColumns({"ts": F.lit(None).cast("timestamp"), "chain": F.lit("")})
    sinks.insert_absent(spark, root, "transfers", rows.filter("transfer_id < 't2'").unionByName(odd))
    sinks.insert_absent(spark, root, "transfers", rows.unionByName(rows).unionByName(odd))
    got = sinks.read_table(spark, root, "transfers")
    assert got.count() == 41 and got.select("transfer_id").distinct().count() == 41
    assert got.filter("transfer_id = 't900'").first()["chain"] == ""
    batch = sinks._with_partitions(sinks.typed_rows("transfers", rows.filter("transfer_id in ('t3', 't5')")), "transfers")
    known = sinks.stored_keys(spark, root, "transfers", batch, 2)
    plan = known._jdf.queryExecution().explainString(known._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "p_chain" in scan and "p_month" in scan
    assert {"t3", "t5"} <= {r["transfer_id"] for r in known.collect()}
    moved = rows.filter("transfer_id = 't7'").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    sinks.insert_absent(spark, root, "transfers", moved, any_time=True)
    assert sinks.read_table(spark, root, "transfers").count() == 41


def test_audit_batches_are_written_once(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "db")
    schema = "case_id string, actor string, action string, detail string, created_at timestamp"
    for n in range(3):
        rows = spark.range(n * 10, n * 10 + 10).select(
            F.lit("c").alias("case_id"), F.lit("a").alias("actor"), F.lit("read").alias("action"), F.col("id").cast("string").alias("detail"),
            F.lit(None).cast("timestamp").alias("created_at"),
        )
        rows.coalesce(1).write.mode("append").parquet(path)
        for _ in range(2):  # the second run has nothing to do
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            sinks.append_audit(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    folder = f"{root}/audit_log_stream/stream=audit/batch=1"
    again = spark.read.parquet(folder)
    assert again.count() == 10  # a batch that runs again overwrites its own folder
    got = sinks.read_audit(spark, root)
    assert got.count() == 30 and got.select("event_hash").distinct().count() == 30


def test_stream_bursts_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(6)
    at = [(f"t{n}", rng.choice(["a", "b", "c"]), "z", 1_700_000_000 + rng.randrange(40_000)) for n in range(400)]
    at += [(f"x{n}", "hot", "z", 1_700_020_000) for n in range(9)] + [("none", "a", "z", None)]
    arrive = sorted(at, key=lambda r: 0 if r[3] is None else r[3] + rng.randrange(3000))
    path = str(tmp_path / "in")
    for n in range(0, len(arrive), 70):
        rows = spark.createDataFrame(arrive[n : n + 70], "transfer_id string, from_address string, to_address string, s bigint")
        rows.select("transfer_id", "from_address", "to_address", F.lit("ethereum").alias("chain"), F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = streaming.read_transfers(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    streaming.write_available(streaming.exact_burst_alerts(stream, 4, 600, "1 hour"), out, str(tmp_path / "cp")).awaitTermination()
    got = {(r["source"], r["ts_us"] // 10**6): r["transfers"] for r in spark.read.schema(streaming.BURSTS).parquet(out).collect()}
    last = max(r[3] for r in at if r[3]) - 3600
    want = {}
    for _, a, _, t in at:
        if t is not None and t <= last:
            n = sum(1 for _, b, _, u in at if b == a and u is not None and t - 600 <= u <= t)
            if n >= 4:
                want[a, t] = n
    assert got == want and ("hot", 1_700_020_000) in want
