"""Laundering patterns on case graphs and on transfer tables.

Evidence of unbounded length (all transactions of a node) is returned in long form;
only lists with a fixed length are arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerhop.functions.amounts import is_dust
from ledgerhop.operators.graph import EDGE_ORDER
from ledgerhop.operators.ordering import exact_median, row_numbers_upto, running_max, top_rows, trailing_counts
from ledgerhop.staging import stage, stage_counted

SEVERITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
LAYERING_HOPS = 3


def breakpoints(nodes: DataFrame, edges: DataFrame, fan_out: int = 3) -> DataFrame:
    """Nodes where the flow fans out or meets a mixer or bridge.

    Fan-out counts transfers, not distinct recipients, and skips the suspect.
    """
    out = edges.groupBy("case_id", F.col("source").alias("node")).agg(
        F.count(F.lit(1)).alias("outgoing")
    )
    n = F.coalesce("outgoing", F.lit(0))
    kind = F.col("node_type")
    special = kind.isin("MIXER", "BRIDGE")
    fans = (n >= fan_out) & (kind != "SUSPECT")
    signals = F.filter(
        F.array(
            F.when(fans, "ANOMALOUS_FAN_OUT"),
            F.when(special, F.concat(F.lit("DIRECT_"), kind, F.lit("_INTERACTION"))),
        ),
        lambda s: s.isNotNull(),
    )
    reasons = F.concat_ws(
        "; ",
        F.when(fans, F.concat(F.lit("Fans out into "), n, F.lit(" transfers"))),
        F.when(special, F.concat(F.lit("Flow meets a known "), F.lower(kind))),
    )
    return (
        nodes.join(out, ["case_id", "node"], "left")
        .withColumn("signals", signals)
        .filter(F.size("signals") > 0)
        .select(
            "case_id",
            "node",
            "address",
            "node_type",
            F.get("signals", F.lit(0)).alias("breakpoint_type"),
            F.when(F.array_contains("signals", "DIRECT_MIXER_INTERACTION"), "HIGH")
            .otherwise("MEDIUM")
            .alias("severity"),
            "signals",
            reasons.alias("reasoning"),
            n.alias("transactions"),
        )
    )


def breakpoint_transactions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing transactions of each breakpoint, one row each."""
    at = points.select("case_id", F.col("node").alias("source"))
    return edges.join(at, ["case_id", "source"], "left_semi").select(
        "case_id", F.col("source").alias("node"), "tx_hash", "transfer_id"
    )


def mark_breakpoints(nodes: DataFrame, points: DataFrame) -> DataFrame:
    details = points.select("case_id", "node", "breakpoint_type", "severity", "reasoning")
    return nodes.join(details, ["case_id", "node"], "left").withColumn(
        "is_breakpoint", F.col("breakpoint_type").isNotNull()
    )


def layering(totals: DataFrame, cases: DataFrame, edges: DataFrame, min_depth: int = LAYERING_HOPS) -> DataFrame:
    """TYP-01 for cases at least ``min_depth`` deep, with their first four transactions."""
    deep = totals.filter(F.col("hop_depth") >= min_depth)
    first = (
        top_rows(edges, ["case_id"], EDGE_ORDER, 4, "n")
        .groupBy("case_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "tx_hash"))).alias("e"))
    )
    return (
        deep.join(cases.select("case_id", "root"), "case_id")
        .join(first, "case_id", "left")
        .select(
            "case_id",
            F.lit("TYP-01").alias("typology_code"),
            F.lit("HIGH").alias("severity"),
            F.col("root").alias("affected_address"),
            F.lit(0.88).alias("confidence"),
            F.col("hop_depth").cast("bigint").alias("measure"),
            F.col("e.tx_hash").alias("evidence_head"),
        )
    )


def exposure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TYP-04 per mixer node and TYP-05 per bridge node; ``measure`` counts touching edges."""
    touching = edges.select(
        "case_id",
        F.explode(
            F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(
                F.array("source", "target")
            )
        ).alias("node"),
    )
    counts = touching.groupBy("case_id", "node").agg(F.count(F.lit(1)).alias("measure"))
    mixer = F.col("node_type") == "MIXER"
    return (
        nodes.filter(F.col("node_type").isin("MIXER", "BRIDGE"))
        .join(counts, ["case_id", "node"], "left")
        .select(
            "case_id",
            F.when(mixer, "TYP-04").otherwise("TYP-05").alias("typology_code"),
            F.when(mixer, "CRITICAL").otherwise("MEDIUM").alias("severity"),
            F.col("address").alias("affected_address"),
            F.when(mixer, 0.95).otherwise(0.90).alias("confidence"),
            F.coalesce("measure", F.lit(0)).alias("measure"),
            F.lit(None).cast("array<string>").alias("evidence_head"),
        )
    )


def exposure_transactions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every transaction touching a mixer or bridge node, in long form."""
    special = nodes.filter(F.col("node_type").isin("MIXER", "BRIDGE")).select(
        "case_id", "node", "node_type"
    )
    ends = F.array_distinct(F.array("source", "target"))
    touching = edges.select("case_id", "tx_hash", "transfer_id", F.explode(ends).alias("node"))
    return touching.join(special, ["case_id", "node"])


def findings(totals: DataFrame, cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return layering(totals, cases, edges).unionByName(exposure(nodes, edges))


def risk_summary(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Number of findings and the highest severity per case, LOW without findings."""
    levels = F.array(*[F.lit(s) for s in SEVERITY])
    grouped = found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.max(F.array_position(levels, F.col("severity"))).alias("_level"),
    )
    return cases.select("case_id").join(grouped, "case_id", "left").select(
        "case_id",
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        F.element_at(levels, F.coalesce("_level", F.lit(1)).cast("int")).alias("overall_risk_level"),
    )


def fan_out_bursts(
    edges: DataFrame, scope: Sequence[str], at_least: int = 4, seconds: int = 15 * 60
) -> DataFrame:
    """Times at which a sender made ``at_least`` transfers within the last ``seconds``."""
    ones = edges.select(*scope, "source", "ts", F.lit(1).cast("bigint").alias("transfers"))
    return trailing_counts(
        ones.filter(F.col("ts").isNotNull()), [*scope, "source"], "ts", seconds, "transfers"
    ).filter(F.col("transfers") >= at_least)


def smurfing(
    edges: DataFrame,
    scope: Sequence[str],
    below: str,
    at_least: int = 4,
    seconds: int = 3600,
) -> DataFrame:
    """TYP-02: times at which a funded sender made ``at_least`` small transfers in a window."""
    small = edges.select(
        *scope,
        F.col("source").alias("node"),
        "ts",
        F.when(is_dust(F.col("amount"), below), 1).otherwise(0).cast("bigint").alias("small"),
    ).filter(F.col("ts").isNotNull())
    funded = edges.select(*scope, F.col("target").alias("node")).distinct()
    counted = trailing_counts(small, [*scope, "node"], "ts", seconds, "small")
    return counted.filter(F.col("small") >= at_least).join(funded, [*scope, "node"], "left_semi")


def last_inflow(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Edges with ``inflow_ts``: the last time at or before ``ts`` their sender was paid.

    Both sides are combined per distinct (node, time), then one running maximum finds the
    last inflow, so no pair of inflow and outflow is ever formed.  Self transfers are no
    inflow.
    """
    keys = [*scope, "node"]
    timed = edges.filter(F.col("ts").isNotNull())
    moments = timed.select(
        *scope,
        "ts",
        F.explode(
            F.array(
                F.struct(F.col("source").alias("node"), F.lit(None).cast("timestamp").alias("paid")),
                F.struct(
                    F.col("target").alias("node"),
                    F.when(F.col("source") != F.col("target"), F.col("ts")).alias("paid"),
                ),
            )
        ).alias("m"),
    ).select(*scope, "ts", "m.*")
    per_time = moments.groupBy(*keys, "ts").agg(F.max("paid").alias("paid"))
    asof = running_max(per_time, keys, ["ts"], "paid", "inflow_ts").select(*keys, "ts", "inflow_ts")
    return timed.withColumn("node", F.col("source")).join(asof, [*keys, "ts"]).drop("node")


def held_seconds():
    return (F.unix_micros("ts") - F.unix_micros("inflow_ts")) / 1e6


def rapid_relays(edges_with_inflow: DataFrame, scope: Sequence[str], seconds: float = 90.0) -> DataFrame:
    """Senders whose median holding time is at most ``seconds``."""
    held = edges_with_inflow.filter(F.col("inflow_ts").isNotNull()).select(
        *scope, F.col("source").alias("node"), held_seconds().alias("held")
    )
    return exact_median(held, [*scope, "node"], "held", "median_held").filter(
        F.col("median_held") <= seconds
    )


def fragmentation(
    edges_with_inflow: DataFrame, scope: Sequence[str], parts: int = 3, spread: float = 0.1
) -> DataFrame:
    """Inflows followed by ``parts`` or more outflows of nearly the same amount.

    ±5 % around the mean is taken as (max - min) / mean <= 0.1.
    """
    value = F.col("amount").cast("double")
    return (
        edges_with_inflow.filter(F.col("inflow_ts").isNotNull())
        .groupBy(*scope, F.col("source").alias("node"), "inflow_ts")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.min(value).alias("smallest"),
            F.max(value).alias("largest"),
            F.sum("amount").cast("double").alias("total"),
        )
        .filter(
            (F.col("parts") >= parts)
            & (F.col("total") > 0)
            & ((F.col("largest") - F.col("smallest")) * F.col("parts") <= spread * F.col("total"))
        )
    )


def rapid_layering(edges: DataFrame, scope: Sequence[str], hops: int = 3, seconds: int = 600) -> DataFrame:
    """Edges that complete ``hops`` consecutive transfers in less than ``seconds``.

    For every edge the latest start of a chain of k transfers ending with it is the
    running maximum, over the inflows of its sender up to its time, of the latest start of
    chains of k-1 transfers.  That replaces a time-range self join; each step costs one
    range shuffle.
    """
    keys = [*scope, "node"]
    chains = edges.filter(F.col("ts").isNotNull()).withColumn("started", F.col("ts"))
    base = chains.columns
    for step in range(hops - 1):
        if step:
            # Read by both sides, the join and the range bounds: written once.
            chains = stage(chains, "layering")
        arrivals = chains.select(
            *scope, F.col("target").alias("node"), "ts", "started"
        )
        departures = chains.select(
            *scope, F.col("source").alias("node"), "ts", F.lit(None).cast("timestamp").alias("started")
        )
        moments = arrivals.unionByName(departures).groupBy(*keys, "ts").agg(
            F.max("started").alias("started")
        )
        # Strictly later: a transfer cannot continue one of the same instant.
        before = running_max(moments, keys, ["ts"], "started", "_before", include_current=False)
        strict = before.select(*keys, "ts", F.col("_before").alias("started"))
        chains = (
            chains.drop("started")
            .withColumn("node", F.col("source"))
            .join(strict, [*keys, "ts"])
            .filter(F.col("started").isNotNull())
            .select(*base)
        )
    elapsed = (F.unix_micros("ts") - F.unix_micros("started")) / 1e6
    return chains.withColumn("elapsed", elapsed).filter(F.col("elapsed") < seconds)


def split_shapes(edges: DataFrame, scope: Sequence[str], major: float = 0.8) -> DataFrame:
    """Senders with exactly two outgoing transfers, one holding ``major`` of the value."""
    keys = [*scope, F.col("source").alias("node")]
    grouped = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"),
        F.max("amount").cast("double").alias("large"),
        F.sum("amount").cast("double").alias("total"),
        F.max_by("target", F.struct("amount", "target")).alias("nxt"),
    )
    return grouped.filter(
        (F.col("parts") == 2) & (F.col("total") > 0) & (F.col("large") >= major * F.col("total"))
    )


def peel_chains(edges: DataFrame, scope: Sequence[str], steps: int = 3, major: float = 0.8) -> DataFrame:
    """Runs of ``steps`` senders, each passing its large part to the next one.

    A sender has one large branch, so every join matches at most one row.
    """
    splits = split_shapes(edges, scope, major).select(*scope, "node", "nxt")
    chain = splits.select(*scope, F.col("node").alias("head"), "nxt", F.array("node").alias("nodes"))
    for _ in range(steps - 1):
        following = splits.select(*scope, F.col("node").alias("at"), F.col("nxt").alias("onward"))
        chain = (
            chain.join(following.withColumnRenamed("at", "nxt"), [*scope, "nxt"])
            .filter(~F.array_contains("nodes", F.col("nxt")))
            .select(
                *scope,
                "head",
                F.concat("nodes", F.array("nxt")).alias("nodes"),
                F.col("onward").alias("nxt"),
            )
        )
    return chain.select(*scope, "head", "nodes", F.col("nxt").alias("change_address"))


def next_splits(splits: DataFrame, scope: Sequence[str], period: str | None = None) -> DataFrame:
    """Links ``(id, nxt)`` from each split to the next one along its large branch: that of the receiver,
    the first in the same or a later ``period``.  ``nxt`` is NULL where the chain ends.

    ``splits(scope…, node, nxt, period)`` as of :func:`split_shapes`; an id is the struct of its columns.
    """
    at = [period] if period else []
    key = F.struct(*scope, *at, "node")
    rows = splits.select(*scope, *at, "node", "nxt", key.alias("id"))
    if not period:
        ahead = rows.select(*scope, F.col("node").alias("nxt"), F.col("id").alias("_next"))
        return rows.join(ahead, [*scope, "nxt"], "left").select("id", F.col("_next").alias("nxt"))
    # One row per receiver and period asks, however many senders a receiver has.
    asks = rows.select(*scope, F.col("nxt").alias("node"), period).distinct()
    marks = rows.select(*scope, "node", period, F.col("id").alias("_split")).unionByName(
        asks.withColumn("_split", F.lit(None).cast(rows.schema["id"].dataType))
    )
    later = Window.partitionBy(*scope, "node").orderBy(period).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("_next", F.min("_split").over(later)).filter("_split is null")
    onward = found.select(*scope, F.col("node").alias("nxt"), period, "_next")
    return rows.join(onward, [*scope, "nxt", period], "left").select("id", F.col("_next").alias("nxt"))


def _doubled(links: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Where each id's chain ends: (id, at, steps, least) and the rows that still run after ``rounds``.

    Pointer doubling: a round joins every running row with the row of the id it has reached, so chains
    of length n take log n rounds.  Only running rows are joined and written; ``least`` is the
    smallest id passed on the way.
    """
    start = links.select(
        "id", F.coalesce("nxt", "id").alias("at"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.col("id").alias("least"), F.col("nxt").isNull().alias("done"),
    )
    written, running = stage_counted(start, "chains0", F.count_if(~F.col("done")))
    done, number = [written.filter("done")], 0
    active = written.filter("not done")
    while running and (rounds is None or number < rounds):
        number += 1
        ahead = reduce(DataFrame.unionByName, [*done, active]).select(
            F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"),
            F.col("least").alias("_least"), F.col("done").alias("_done"),
        )
        written, running = stage_counted(
            active.join(ahead, "at").select(
                "id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"),
                F.least("least", "_least").alias("least"), F.col("_done").alias("done"),
            ),
            f"chains{number}", F.count_if(~F.col("done")),
        )
        done.append(written.filter("done"))
        active = written.filter("not done")
    ends = reduce(DataFrame.unionByName, done).drop("done")
    return ends, active.drop("done") if running else None


def maximal_chains(links: DataFrame) -> DataFrame:
    """(head, last, steps, looped) of every maximal chain of ``links(id, nxt)``, ``steps`` its ids.

    A chain starts at an id that none leads to and ends where there is no next one, or where it would
    meet itself again.  A loop that nothing leads into starts at its least id.
    """
    links, total = stage_counted(links, "links")
    ends, running = _doubled(links, max(1, total).bit_length())
    straight = ends.select("id", F.col("at").alias("last"), (F.col("steps") + 1).alias("steps"), F.lit(False).alias("looped"))
    heads = links.select("id").join(links.select(F.col("nxt").alias("id")), "id", "left_anti")
    if running is None:
        return straight.join(heads, "id").withColumnRenamed("id", "head")
    # After as many steps as there are ids every running row stands on a loop, and on each of its ids
    # stands the row of some id of the loop.
    on_loop = stage(
        running.select(F.col("at").alias("id")).distinct().join(running.select("id", F.col("least").alias("loop")), "id"), "loops"
    )
    size = on_loop.groupBy("loop").agg(F.count(F.lit(1)).alias("_size"))
    before = links.join(on_loop.select("id"), "id").select(F.col("nxt").alias("at"), F.col("id").alias("last"))
    cut = links.join(on_loop.select("id", "loop"), "id", "left").join(running.select("id"), "id", "left_semi").select(
        "id", F.when(F.col("loop").isNull(), F.col("nxt")).alias("nxt")
    )
    entries, _ = _doubled(cut)
    looped = (
        entries.join(on_loop.select(F.col("id").alias("at"), "loop"), "at").join(size, "loop").join(before, "at")
        .select("id", "last", (F.col("steps") + F.col("_size")).alias("steps"), F.lit(True).alias("looped"))
    )
    entered = links.join(on_loop.select("id"), "id", "left_anti").select(F.col("nxt").alias("id")).join(on_loop, "id").select("loop")
    alone = on_loop.filter("id = loop").join(entered, "loop", "left_anti").select("id")
    found = straight.unionByName(looped).join(heads.unionByName(alone), "id")
    return found.withColumnRenamed("id", "head")


def maximal_peel_chains(
    edges: DataFrame, scope: Sequence[str], period: str | None = None, at_least: int = 3, major: float = 0.9
) -> DataFrame:
    """Peel chains of any length from ``at_least`` splits on, each sender passing the ``major`` part on.

    With ``period``, a column of the edges such as the day, a sender splits once per period and the chain
    goes on with the receiver's next split.  Returns (head, last, steps, looped, change_address); head
    and last are structs of scope, period and node.
    """
    keys = [*scope, *([period] if period else [])]
    splits = stage(split_shapes(edges, keys, major).select(*keys, "node", "nxt"), "splits")
    chains = maximal_chains(next_splits(splits, scope, period)).filter(F.col("steps") >= at_least)
    change = splits.select(F.struct(*keys, "node").alias("last"), F.col("nxt").alias("change_address"))
    return chains.join(change, "last").select("head", "last", "steps", "looped", "change_address")


#: Middle nodes with so many two-step rows are packed into words.
HUB_LOAD = 256
#: Two-step rows of a word per task, before its senders are dealt over several.
WORD_ROWS = 2_000_000


def _hub_words(pairs: DataFrame, load: DataFrame, scope: Sequence[str], hub_load: int) -> DataFrame:
    """(scope, mid, word, bit) of the busy middle nodes whose word pays.

    Hubs with like senders come next to each other (by the least hash of their senders), 63 to a word.
    A word pays where its senders times its receivers are fewer than the two-step rows of its hubs.
    """
    hubs, n = stage_counted(load.filter(F.col("_load") >= hub_load), "hubs")
    if not n:
        return hubs.select(*scope, "mid", F.lit(0).cast("bigint").alias("word"), F.lit(0).alias("bit"), F.lit(1).alias("_split")).limit(0)
    numbered = row_numbers_upto(hubs, list(scope), ["_like", "mid"], "_n", n)
    words = stage(
        numbered.select(*scope, "mid", "_load", F.floor((F.col("_n") - 1) / 63).alias("word"), ((F.col("_n") - 1) % 63).cast("int").alias("bit")),
        "hub-words",
    )
    rows = words.groupBy(*scope, "word").agg(F.sum("_load").alias("_rows"))
    for near, far, out in (("source", "target", "_senders"), ("target", "source", "_receivers")):
        ends = pairs.select(*scope, F.col(near).alias("_end"), F.col(far).alias("mid")).join(words, [*scope, "mid"])
        rows = rows.join(ends.select(*scope, "word", "_end").distinct().groupBy(*scope, "word").agg(F.count(F.lit(1)).alias(out)), [*scope, "word"])
    pays = rows.filter(F.col("_senders") * F.col("_receivers") < F.col("_rows"))
    split = F.ceil(F.col("_senders") * F.col("_receivers") / WORD_ROWS).cast("int")
    return stage(words.drop("_load").join(pays.select(*scope, "word", split.alias("_split")), [*scope, "word"]), "words-that-pay")


def reconvergence(edges: DataFrame, scope: Sequence[str], more_than: int = 5, hub_load: int = HUB_LOAD) -> DataFrame:
    """Pairs (source, target) joined by more than ``more_than`` different middle nodes.

    Heavy and light middles part.  Hubs are packed 63 to a word: a sender's hubs, and a receiver's, are
    one number per word, so a pair costs one row per word whatever number of hubs it shares, and
    no word is used that would cost more than its two-step rows.  Of the other middles each
    sender's ``more_than`` busiest make no candidates: a pair that shares no packed hub still meets in
    another one.  What candidates share of those few is looked up, so counts are exact.
    """
    scope = list(scope)
    wide = edges.filter(F.col("source") != F.col("target")).select(*scope, "source", "target").distinct()
    pairs = stage(wide, "two-step-pairs")
    fan_in = pairs.groupBy(*scope, F.col("target").alias("mid")).agg(
        F.count(F.lit(1)).alias("_in"), F.min(F.xxhash64("source")).alias("_like")
    )
    fan_out = pairs.groupBy(*scope, F.col("source").alias("mid")).agg(F.count(F.lit(1)).alias("_out"))
    load = stage(
        fan_in.join(fan_out, [*scope, "mid"]).select(*scope, "mid", "_like", (F.col("_in") * F.col("_out")).alias("_load")), "middles"
    )
    words = _hub_words(pairs, load, scope, hub_load)
    first = pairs.select(*scope, "source", F.col("target").alias("mid"))
    second = pairs.select(*scope, F.col("source").alias("mid"), "target")
    elsewhere = F.col("source") != F.col("target")

    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
    by_word = [*scope, "word"]
    sent = first.join(words, [*scope, "mid"]).groupBy(*by_word, "_split", "source").agg(mask.alias("_a"))
    got = second.join(words, [*scope, "mid"]).groupBy(*by_word, "_split", "target").agg(mask.alias("_b"))
    # A large word meets in several tasks: its senders are dealt out, its receivers copied to each.
    sent = sent.withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_split"))).drop("_split")
    got = got.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_split") - 1))).drop("_split")
    packed = (
        sent.join(got, [*by_word, "_part"]).filter(elsewhere & (F.col("_a").bitwiseAND(F.col("_b")) != 0))
        .select(*scope, "source", "target", F.bit_count(F.col("_a").bitwiseAND(F.col("_b"))).cast("bigint").alias("n"))
    )

    light = load.join(words, [*scope, "mid"], "left_anti")
    useful, n = stage_counted(first.join(light.select(*scope, "mid", "_load"), [*scope, "mid"]), "light-steps")
    met = packed
    if n:
        ranked = top_rows(useful, [*scope, "source"], [F.desc("_load"), F.asc("mid")], more_than, "_n").select(*scope, "source", "mid")
        busiest = stage(ranked, "busiest-middles")
        rest = useful.join(busiest, [*scope, "source", "mid"], "left_anti").drop("_load")
        met = packed.unionByName(
            rest.join(second, [*scope, "mid"]).filter(elsewhere).select(*scope, "source", "target", F.lit(1).cast("bigint").alias("n"))
        )
    counted = met.groupBy(*scope, "source", "target").agg(F.sum("n").alias("middles"))
    if n:
        spare = busiest.groupBy(*scope, "source").agg(F.count(F.lit(1)).alias("_spare"))
        few = counted.join(spare, [*scope, "source"], "left")
        counted = stage(few.filter(F.col("middles") + F.coalesce("_spare", F.lit(0)) > more_than).drop("_spare"), "candidates")
        more = (
            counted.select(*scope, "source", "target").join(busiest, [*scope, "source"])
            .join(second, [*scope, "mid", "target"]).groupBy(*scope, "source", "target").agg(F.count(F.lit(1)).alias("_more"))
        )
        counted = counted.join(more, [*scope, "source", "target"], "left").withColumn(
            "middles", F.col("middles") + F.coalesce("_more", F.lit(0))
        ).drop("_more")
    return counted.filter(F.col("middles") > more_than)


def wallet_anomalies(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Robust z-scores of each sender's transfer count and mean amount.

    0.6745 scales the median absolute deviation to a standard deviation.
    """
    keys = list(scope)
    features = edges.groupBy(*keys, F.col("source").alias("node")).agg(
        F.count(F.lit(1)).cast("double").alias("frequency"),
        (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("mean_amount"),
    )
    out = features
    for name in ("frequency", "mean_amount"):
        middle = exact_median(features, keys, name, "_mid")
        distance = features.join(middle, keys).select(
            *keys, F.abs(F.col(name) - F.col("_mid")).alias("_dist")
        )
        spread = exact_median(distance, keys, "_dist", "_mad")
        out = out.join(middle, keys).join(spread, keys).withColumn(
            f"{name}_z",
            F.when(F.col("_mad") > 0, 0.6745 * (F.col(name) - F.col("_mid")) / F.col("_mad")).otherwise(0.0),
        ).drop("_mid", "_mad")
    return out.withColumn(
        "anomaly_score", F.greatest(F.abs("frequency_z"), F.abs("mean_amount_z"))
    )


def dust_flags(transfers: DataFrame, threshold: str = "0.0001") -> DataFrame:
    return transfers.withColumn("is_dust", is_dust(F.col("amount"), threshold))

