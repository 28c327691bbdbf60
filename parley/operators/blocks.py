"""The context block: what a session's graph says, in twelve sections, as much of it as a budget of tokens holds.

Each section takes its nodes in its own order up to its cap, so a session has at most 45 items whatever its size, and only
they are brought together. They are admitted in rounds: the first item of every section, the most urgent section first, then
every second one; an item that does not fit is passed over, and smaller ones may still go in. What items cost is counted
one by one, so the whole text is counted at the end: while it is over, the last item of the least urgent section goes.

No nodes: no block. A null label, summary or importance counts as empty or 0; equal places go by ``node_id``. A budget
below the first item gives an empty block. Cold nodes (``evicted``) stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.weave import let
from parley.operators.requests import transition_line
from parley.operators.vocabulary import rationale, short_path

DAY_US = 86_400_000_000
# Sections as they are shown, with what parts their items, their urgency (0 first) and how many they show.
SECTIONS = {
    "goal": ("Goal", " | ", 0, 2), "wip": ("Working on", " | ", 2, 8), "done": ("Done", " | ", 5, 6), "decided": ("Decided", " | ", 3, 6),
    "conflicting": ("Conflicting (unresolved)", " | ", 1, 3), "changes": ("Changes", " | ", 4, 3), "note": ("Note", " | ", 4, 1), "avoid": ("Avoid", " | ", 1, 2),
    "noted": ("Noted", " | ", 6, 1), "files": ("Files", ", ", 7, 10), "env": ("Env", ", ", 8, 4), "errors": ("Open issues", " | ", 1, 3),
}
# Headings that a domain's pack has in place of the usual ones.
VOCABULARY = {
    "research": {"goal": "Question", "wip": "Investigating", "done": "Found", "decided": "Concluded", "errors": "Contradictions", "files": "Sources"},
    "ops": {"goal": "Incident", "wip": "Mitigating", "done": "Done", "decided": "Decided", "errors": "Symptoms"},
    "product": {"goal": "Outcome", "wip": "In flight", "done": "Shipped", "decided": "Decided", "errors": "Blockers"},
}
EACH = 4  # tasks in progress, and tasks to come
ALIKE = 20  # finished tasks whose labels begin alike count as one
RECENT_DAYS = 3
ITEM = "struct<place:int,urgency:int,section:int,item:string>"


def headings(domain: str = "coding") -> list[str]:
    return [VOCABULARY.get(domain, {}).get(key, name) for key, (name, *_) in SECTIONS.items()]


def _section(key: str) -> int:
    return list(SECTIONS).index(key)


def _part() -> Column:
    """Which list of the block a node is in, null for none."""
    kind, status = F.col("type"), F.col("status")
    task = F.when(status == "in_progress", "open").when(status == "pending", "next").when(status == "completed", "done")
    choice = F.when(status == "completed", "decided").when(status == "invalidated", "avoid")
    out = F.when(kind == "task", task).when(kind == "decision", choice).when((kind == "error") & (status == "failed"), "errors")
    return out.when(kind == "goal", "goal").when(kind == "file", "files").when(kind == "environment", "env").when(kind == "summary", "noted")


def node_items(nodes: DataFrame) -> DataFrame:
    """``(session_id, section, place, item)`` of what stands in a node by itself."""
    label = F.coalesce("label", F.lit(""))
    summary = F.col("summary") if "summary" in nodes.columns else F.lit("")
    # Goals and decisions are shown by weight, notes and finished work by time, the rest by weight and time.
    weight, time = F.coalesce("importance", F.lit(0.0)), F.coalesce("valid_from", F.lit(0)).cast("double")
    part, newest, neither = F.col("part"), F.col("part").isin("done", "noted"), F.col("part").isin("avoid", "env")
    n = nodes.select("session_id", "node_id", label.alias("label"), F.coalesce(summary, F.lit("")).alias("summary"), weight.alias("weight"), time.alias("time"), _part().alias("part")).filter("part IS NOT NULL AND label <> ''")
    n = n.withColumn("first", F.when(newest, F.col("time")).when(neither, 0.0).otherwise(F.col("weight"))).withColumn("second", F.when(newest, F.col("weight")).when(neither | part.isin("goal", "decided"), 0.0).otherwise(F.col("time")))
    order = [F.desc("first"), F.desc("second"), "node_id"]
    # Of finished tasks that begin alike only the first counts: folded before anything is ranked.
    best = F.min_by(F.struct("label", "summary"), F.struct(-F.col("first"), -F.col("second"), F.col("node_id")))
    done = n.filter("part = 'done'").groupBy("session_id", "part", F.substring(T.normal_label(F.col("label")), 1, ALIKE).alias("begin"))
    done = done.agg(best.alias("b"), F.max(F.struct("first", "second")).alias("o"), F.min_by("node_id", F.struct(-F.col("first"), -F.col("second"), F.col("node_id"))).alias("node_id"))
    done = done.select("session_id", "node_id", "b.label", "b.summary", "part", "o.first", "o.second")
    all_ = n.filter("part <> 'done'").select(*done.columns).unionByName(done)
    most = max(cap for *_, cap in SECTIONS.values())
    ranked = all_.withColumn("place", F.row_number().over(W.partitionBy("session_id", "part").orderBy(*order)) - 1).filter(F.col("place") < most)
    caps = {**{k: cap for k, (*_, cap) in SECTIONS.items()}, "open": EACH, "next": EACH}
    cap = F.coalesce(*(F.when(part == k, F.lit(v)) for k, v in caps.items()))
    ranked = ranked.filter(F.col("place") < cap)
    # Work at hand and work to come take turns while both last; the longer list goes on alone.
    shorter = F.least(*(F.count(F.when(part == k, 1)).over(W.partitionBy("session_id")) for k in ("open", "next")))
    turn = F.when(F.col("place") >= shorter, shorter + F.col("place")).otherwise(2 * F.col("place") + (part == "next").cast("int"))
    ranked = ranked.withColumn("place", F.when(part.isin("open", "next"), turn).otherwise(F.col("place")).cast("int"))
    number = F.coalesce(*(F.when(part == k, F.lit(_section(s))) for k, s in {**{k: k for k in SECTIONS}, "open": "wip", "next": "wip"}.items()))
    shown = F.when(part == "decided", F.concat("label", rationale(F.col("label"), F.col("summary")))).when(part == "avoid", F.concat(F.lit("[DO NOT USE] "), F.substring("label", 1, 40)))
    shown = shown.when(part == "files", short_path(F.col("label"))).otherwise(F.col("label"))
    return ranked.select("session_id", number.alias("section"), "place", shown.alias("item"))


def _first(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(*order)) - 1).filter(F.col("place") < most)


def conflict_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both sides of an open conflict, each pair once."""
    open_ = nodes.filter("type = 'decision' AND status = 'contested'").select("session_id", "node_id", F.substring(F.coalesce("label", F.lit("")), 1, 45).alias("label"))
    a, b = F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    pairs = edges.filter("type = 'CONFLICTS_WITH'").select("session_id", a, b).distinct()
    told = pairs.join(open_.select("session_id", F.col("node_id").alias("a"), F.col("label").alias("one")), ["session_id", "a"]).join(open_.select("session_id", F.col("node_id").alias("b"), F.col("label").alias("other")), ["session_id", "b"])
    item = F.concat(F.lit("'"), F.col("one"), F.lit("' vs '"), F.col("other"), F.lit("'"))
    return _first(told, SECTIONS["conflicting"][3], "a", "b").select("session_id", F.lit(_section("conflicting")).alias("section"), "place", item.alias("item"))


def change_items(nodes: DataFrame, transitions: DataFrame, now: int | Column) -> DataFrame:
    """The latest changes of decisions; where none is on record, how many decisions were replaced of late."""
    latest = _first(transitions, SECTIONS["changes"][3], F.desc("ts_us"), "to_id")
    told = latest.select("session_id", F.lit(_section("changes")).alias("section"), "place", transition_line(F.col("from_label"), F.col("to_label"), F.col("confidence_delta")).alias("item"))
    clock = now if isinstance(now, Column) else F.lit(now)
    gone = nodes.filter((F.col("type") == "decision") & (F.col("status") == "superseded") & (clock - F.col("valid_from") < RECENT_DAYS * DAY_US)).groupBy("session_id").agg(F.count("*").alias("n"))
    silent = gone.join(transitions.select("session_id").distinct(), "session_id", "left_anti")
    note = F.concat(F.col("n").cast("string"), F.lit(" decision(s) changed recently"))
    return told.unionByName(silent.select("session_id", F.lit(_section("note")).alias("section"), F.lit(0).alias("place"), note.alias("item")))


def items(nodes: DataFrame, edges: DataFrame, transitions: DataFrame, now: int | Column) -> DataFrame:
    """``(session_id, section, place, item)``: at most ``cap`` items a section, places from 0."""
    warm = nodes.filter(~F.coalesce("evicted", F.lit(False))) if "evicted" in nodes.columns else nodes
    return node_items(warm).unionByName(conflict_items(warm, edges)).unionByName(change_items(warm, transitions, now))


def _rendered(kept: Column, names: list[str]) -> Column:
    def line(k: int) -> Column:
        own = F.transform(F.filter(kept, lambda x: x["section"] == k), lambda x: x["item"])
        return F.when(F.size(own) > 0, F.concat(F.lit(names[k] + ": "), F.array_join(own, list(SECTIONS.values())[k][1])))

    return F.array_join(F.array(*map(line, range(len(names)))), "\n")


def _without_last(kept: Column) -> Column:
    """Without the last item of the least urgent section; of equally urgent ones the longer, then the upper one."""
    size = lambda x: F.size(F.filter(kept, lambda y: y["section"] == x["section"]))
    worst = F.array_max(F.transform(kept, lambda x: F.struct(x["urgency"].alias("u"), size(x).alias("n"), (-x["section"]).alias("s"))))
    return let(-worst["s"], lambda s: let(F.array_max(F.transform(kept, lambda x, i: F.when(x["section"] == s, i))), lambda last: F.filter(kept, lambda x, i: i != last)))


def pack(items: DataFrame, budget: int, domain: str = "coding") -> DataFrame:
    """``(session_id, n_items, tokens, block)``: what of each session's items fits the budget, as one text."""
    names, apart = headings(domain), [s for _, s, *_ in SECTIONS.values()]
    urgency = F.get(F.array(*(F.lit(u) for *_, u, _ in SECTIONS.values())), F.col("section"))
    own = items.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("place", urgency.alias("urgency"), "section", "item").cast(ITEM))).alias("own"))

    def admit(acc: Column, x: Column) -> Column:
        new = ~F.exists(acc["kept"], lambda k: k["section"] == x["section"])
        lead = F.when(new, F.concat(F.get(F.array(*map(F.lit, names)), x["section"]), F.lit(": "))).otherwise(F.get(F.array(*map(F.lit, apart)), x["section"]))
        used = acc["used"] + T.count_tokens(F.concat(lead, x["item"])) + new.cast("bigint")
        return F.when(used <= budget, F.struct(used.alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{ITEM}>").alias("kept"))
    packed = own.select("session_id", F.aggregate("own", none, admit, lambda acc: acc["kept"]).alias("kept"))
    over = lambda k: T.count_tokens(_rendered(k, names)) > budget
    counted = F.aggregate(F.sequence(F.lit(0), F.size("kept")), F.col("kept"), lambda k, _: F.when(over(k), _without_last(k)).otherwise(k))
    fitted = packed.select("session_id", F.when(over(F.col("kept")), counted).otherwise(F.col("kept")).alias("kept")).withColumn("block", _rendered(F.col("kept"), names))
    return fitted.select("session_id", F.size("kept").cast("bigint").alias("n_items"), T.count_tokens(F.col("block")).alias("tokens"), "block")
