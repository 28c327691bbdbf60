"""Queries over the temporal property graph: ranking, points in time, closure, impact, audit, decay, communities."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.sources.settle import settled
from parley.sources.tables import DAY_US, INACTIVE, OPEN

# Weights of node types, in ranking now and at a point in time.
BOOSTS = {"goal": 1.25, "decision": 1.20, "task": 1.0, "error": 0.95, "file": 0.90, "endpoint": 0.90, "schema": 0.85, "dependency": 0.70, "environment": 0.70}
BOOSTS_AT = {"goal": 1.25, "decision": 1.20, "task": 1.0, "error": 0.90, "file": 0.85}
# Daily rates of decay by type and status; days of grace by type.
DECAY = {("task", "completed"): 0.15, ("error", "completed"): 0.20, ("decision", "superseded"): 0.30, ("decision", "archived"): 0.25, ("task", "failed"): 0.10, ("task", "in_progress"): 0.05}
GRACE = {"task": 3, "error": 1}
DECAY_FLOOR, DECAY_MOST, DECAY_LEAST_CHANGE = 0.10, 0.5, 0.005
# Which statuses may follow one another ("modified" is another name for "superseded").
STATUS_MOVES = {
    "pending": ["in_progress", "completed", "failed", "invalidated"],
    "in_progress": ["completed", "failed", "pending", "invalidated"],
    "completed": ["superseded", "modified", "invalidated", "in_progress", "contested"],
    "failed": ["in_progress", "completed", "invalidated"],
    "superseded": ["archived", "invalidated"],
    "modified": ["archived", "invalidated"],
    "invalidated": [],
    "archived": [],
    "contested": ["completed", "superseded", "modified", "invalidated"],
}
# Types that an edge may start and end at.
EDGE_ENDS = {"FIXES": (["task", "decision"], ["error"]), "PART_OF": (["task"], ["goal"]), "DEPENDS_ON": (["file", "task", "decision"], ["dependency", "file", "task"])}


def _by_type(weights: dict[str, float], default: float = 1.0) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for kind, weight in weights.items():
        out = out.when(F.col("type") == kind, F.lit(weight))
    return out.otherwise(F.lit(default))


def live(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("status").isin(INACTIVE))


def score_nodes(nodes: DataFrame, question: str, now: int | Column, kinds: list[str] | None = None, present: bool = False) -> DataFrame:
    """``(0.6 overlap + 0.3 importance + 0.1 recency) * boost`` of live nodes, those above 0.05."""
    asked = sorted({w for w in question.lower().replace("?", " ").split() if len(w) > 2})
    recency = 1 / (1 + 0.1 * (F.lit(now) - F.col("valid_from")) / DAY_US)
    boost = _by_type(BOOSTS)
    if kinds:
        boost = F.when(F.col("type").isin(kinds), boost * 1.5).when(F.col("type").isin(list(BOOSTS)), boost / 1.25).otherwise(boost)
    if present:
        boost = F.when(F.col("status").isin(OPEN), boost * 1.3).otherwise(boost)
    score = (0.6 * T.overlap(asked, T.words(F.col("label"))) + 0.3 * F.col("importance") + 0.1 * recency) * boost
    return live(nodes).withColumn("score", F.round(score, 6)).filter("score > 0.05")


def top_nodes(nodes: DataFrame, question: str, now: int | Column, k: int = 12, **how) -> DataFrame:
    return score_nodes(nodes, question, now, **how).orderBy(F.desc("score"), "node_id").limit(k).select("node_id", "session_id", "type", "label", "status", "score")


def top_nodes_by_session(nodes: DataFrame, question: str, now: int | Column, k: int = 3) -> DataFrame:
    """The best of every session at once: a rank within the session, not a query a session."""
    w = W.partitionBy("session_id").orderBy(F.desc("score"), "node_id")
    return score_nodes(nodes, question, now).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("session_id", "rank", "node_id", "score")


def search_pool(nodes: DataFrame, question: str, now: int | Column, wanted: list[str], k: int = 6) -> DataFrame:
    """Of the best ``2 k``, those of the wanted types, at most ``k``: the pool is cut before the types are."""
    pool = score_nodes(nodes, question, now).orderBy(F.desc("score"), "node_id").limit(2 * k)
    return pool.filter(F.col("type").isin(wanted)).orderBy(F.desc("score"), "node_id").limit(k).select("node_id", "type", "score")


def valid_at(nodes: DataFrame, at: int) -> DataFrame:
    return nodes.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def query_at_time(nodes: DataFrame, question: str, at: int, k: int = 12) -> DataFrame:
    """What was in force at a time, best first: words and importance by type, above 0.05. Without a question, by importance."""
    asked = sorted({w.strip(".,!?:;()[]") for w in question.lower().split() if len(w) > 2})
    value = (0.7 * T.overlap(asked, T.words(F.col("label"), 1)) + 0.3 * F.col("importance")) * _by_type(BOOSTS_AT) if asked else F.col("importance")
    scored = valid_at(nodes, at).withColumn("score", F.round(value, 6))
    if asked:
        scored = scored.filter("score > 0.05")
    return scored.orderBy(F.desc("score"), "node_id").limit(k).select("node_id", "session_id", "type", "label", "score")


def history(nodes: DataFrame, question: str, at: int, now: int | Column, k: int = 12) -> DataFrame:
    """What was in force at a time; at time 0, what is now."""
    return query_at_time(nodes, question, at, k) if at else top_nodes(nodes, question, now, k)


def decay(nodes: DataFrame, now: int | Column) -> DataFrame:
    """New importance of the nodes that lose more than the least change.

    Whether a node decays is by its age, how much by the time since ``last_decayed_at`` (its ``valid_from`` where that is
    null or no column), so a second run at the same time changes nothing if that is set to ``now`` for all nodes.
    """
    rate = F.when(F.lit(False), F.lit(0.0))
    for (kind, status), r in DECAY.items():
        rate = rate.when((F.col("type") == kind) & (F.col("status") == status), F.lit(r))
    grace = F.when(F.lit(False), F.lit(0))
    for kind, days in GRACE.items():
        grace = grace.when(F.col("type") == kind, days)
    since = F.coalesce("last_decayed_at", "valid_from") if "last_decayed_at" in nodes.columns else F.col("valid_from")
    clock = now if isinstance(now, Column) else F.lit(now)
    age, elapsed = (clock - F.col("valid_from")) / DAY_US, F.greatest(F.lit(0.0), (clock - since) / DAY_US)
    factor = F.greatest(F.lit(DECAY_MOST), F.pow(1 - F.col("rate"), elapsed))
    out = nodes.withColumn("rate", rate).filter(F.col("rate").isNotNull() & (age > grace.otherwise(0)))
    out = out.withColumn("decayed", F.greatest(F.lit(DECAY_FLOOR), F.round(F.col("importance") * factor, 3)))
    return out.filter(F.abs(F.col("importance") - F.col("decayed")) > DECAY_LEAST_CHANGE).select("node_id", "importance", "decayed")


def archive_superseded(nodes: DataFrame, now: int | Column, days: int = 7) -> DataFrame:
    """Decisions that were superseded so many days ago, by the end of their validity, are archived."""
    clock = now if isinstance(now, Column) else F.lit(now)
    old = (F.col("type") == "decision") & F.col("status").isin("superseded", "modified") & (clock - F.col("valid_until") >= days * DAY_US)
    return nodes.select("node_id", F.when(old, "archived").otherwise(F.col("status")).alias("status"))


def prune(nodes: DataFrame, most: int) -> DataFrame:
    """Per session, which nodes go to cold storage: unprotected ones, least important first, down to ``most`` nodes."""
    size = F.count("*").over(W.partitionBy("session_id"))
    loose = (F.col("type") != "goal") & ~((F.col("type") == "decision") & ~F.col("status").isin(INACTIVE))
    order = W.partitionBy("session_id", "loose").orderBy("importance", F.when(F.col("status").isin(INACTIVE), 0).otherwise(1), "valid_from", "node_id")
    ranked = nodes.withColumn("size", size).withColumn("loose", loose).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("loose") & (F.col("place") <= F.col("size") - most)).select("session_id", "node_id", "importance")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("session_id").agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("goal", "decision", "task", "error", "file")),
        F.count_if(~F.col("status").isin(INACTIVE)).alias("n_live"),
    )
    return n.join(edges.groupBy("session_id").agg(F.count("*").alias("n_edges")), "session_id", "left").fillna(0, ["n_edges"])


def session_summaries(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("session_id", "type").agg(F.count("*").alias("n"), F.max("valid_from").alias("updated_at"))


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends live: two semi joins."""
    ids = live(nodes).select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select("session_id", "source_id", "target_id", "type", "weight")


def impact(nodes: DataFrame, edges: DataFrame, word: str) -> DataFrame:
    """One hop around the nodes whose label has the word, in either direction: edge ends are stacked, so the join is equi."""
    hit = nodes.filter(F.array_contains(T.words(F.col("label")), word)).select(F.col("node_id").alias("match_id"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("match_id"), F.col("target_id").alias("other_id"), F.lit("out").alias("way")), F.struct(F.col("target_id").alias("match_id"), F.col("source_id").alias("other_id"), F.lit("in").alias("way")))).alias("e"), F.col("type").alias("edge_type"))
    near = ends.select("e.*", "edge_type").join(hit, "match_id").distinct()
    return near.join(nodes.select(F.col("node_id").alias("other_id"), F.col("type").alias("other_type"), F.col("label").alias("other_label")), "other_id").select("match_id", "way", "edge_type", "other_id", "other_type", "other_label")


def why(transitions: DataFrame, word: str) -> DataFrame:
    """All decisions that change chains lead to or from those whose label has the word; a set, so cycles end."""
    seeds = transitions.filter(F.array_contains(T.words(F.col("from_label")), word)).select(F.col("from_id").alias("node_id"))
    seeds = seeds.unionByName(transitions.filter(F.array_contains(T.words(F.col("to_label")), word)).select(F.col("to_id").alias("node_id"))).distinct()
    chains = chain_ids(transitions)
    mine = chains.join(seeds, "node_id", "left_semi").select("chain").distinct()
    return chains.join(mine, "chain", "left_semi").select("chain", "node_id")


def chain_ids(transitions: DataFrame) -> DataFrame:
    """``(node_id, chain)``: the smallest node that change links reach in either direction.

    Links are contracted by pointer jumping, so the number of rounds is logarithmic in the longest chain.
    """
    both = transitions.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(F.col("a").alias("node_id")).distinct().withColumn("chain", F.col("node_id"))
    both, label = settled(both), settled(label)
    while True:
        near = both.join(label.withColumnRenamed("node_id", "b"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("chain").alias("low"))
        lower = label.join(near, "node_id", "left").select("node_id", F.least("chain", "low").alias("chain"))
        jump = lower.select(F.col("node_id").alias("chain"), F.col("chain").alias("root"))
        new = settled(lower.join(jump, "chain", "left").select("node_id", F.least("chain", "root").alias("chain")))
        if not new.exceptAll(label).limit(1).count():
            return new
        label = new


def decision_history(nodes: DataFrame) -> DataFrame:
    """Decisions in order within each topic of a session."""
    d = nodes.filter("type = 'decision'")
    w = W.partitionBy("session_id", "topic").orderBy("valid_from", "node_id")
    return d.select("session_id", "topic", F.row_number().over(w).cast("bigint").alias("step"), "node_id", "label", F.lead("node_id").over(w).alias("superseded_by"))


def audit(nodes: DataFrame, edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """Findings: superseded decisions without a transition, edges at dead ends, edge types at wrong ends, low confidence."""
    d = nodes.filter((F.col("type") == "decision") & (F.col("status") == "superseded"))
    missing = d.join(transitions.select(F.col("from_id").alias("node_id")), "node_id", "left_anti").select(F.lit("missing_transition").alias("finding"), "session_id", F.col("node_id").alias("ref"))
    dead = nodes.filter(F.col("status").isin(INACTIVE)).select(F.col("node_id").alias("target_id"))
    dangling = edges.join(dead, "target_id", "left_semi").select(F.lit("edge_to_inactive").alias("finding"), "session_id", F.col("source_id").alias("ref"))
    kinds = nodes.select("node_id", F.col("type").alias("kind"))
    typed = edges.join(kinds.withColumnRenamed("node_id", "source_id").withColumnRenamed("kind", "source_kind"), "source_id").join(kinds.withColumnRenamed("node_id", "target_id").withColumnRenamed("kind", "target_kind"), "target_id")
    wrong = F.lit(False)
    for kind, (starts, ends) in EDGE_ENDS.items():
        wrong = wrong | ((F.col("type") == kind) & ~(F.col("source_kind").isin(starts) & F.col("target_kind").isin(ends)))
    off = typed.filter(wrong).select(F.lit("edge_ends").alias("finding"), "session_id", F.col("source_id").alias("ref"))
    weak = live(nodes).filter("confidence < 0.55").select(F.lit("low_confidence").alias("finding"), "session_id", F.col("node_id").alias("ref"))
    return missing.unionAll(dangling).unionAll(off).unionAll(weak)


def contradictions(nodes: DataFrame) -> DataFrame:
    """Pairs of live decisions of a session on one topic with the same subject and another verb.

    Paired through their common subject; only pairs that contradict are formed.
    """
    parts = F.split("label", " ")
    d = live(nodes).filter("type = 'decision'").select("session_id", "node_id", "topic", parts[0].alias("verb"), parts[2].alias("noun"), "valid_from")
    a, b = d.alias("a"), d.alias("b")
    on = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.topic") == F.col("b.topic")) & (F.col("a.noun") == F.col("b.noun")) & (F.col("a.node_id") < F.col("b.node_id")) & (F.col("a.verb") != F.col("b.verb"))
    return a.join(b, on).select(F.col("a.session_id").alias("session_id"), F.col("a.node_id").alias("first_id"), F.col("b.node_id").alias("second_id"))


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    inbound = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("n_in"))
    return nodes.join(inbound, "node_id").orderBy(F.desc("n_in"), F.desc("importance"), "label", "node_id").limit(k).select("node_id", "label", "n_in", "importance")


def type_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select("node_id", "type")
    s, t = kinds.select(F.col("node_id").alias("source_id"), F.col("type").alias("source_type")), kinds.select(F.col("node_id").alias("target_id"), F.col("type").alias("target_type"))
    return edges.join(s, "source_id").join(t, "target_id").groupBy("source_type", "target_type").agg(F.count("*").alias("n"))


def error_task_links(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Errors and tasks of a session that share words: FIXES if the task is done, BLOCKS if both are open."""
    w = nodes.select("session_id", "node_id", "type", "status", T.words(F.col("label")).alias("words"))
    e = w.filter("type = 'error'").select("session_id", F.col("node_id").alias("error_id"), F.col("status").alias("error_status"), F.explode("words").alias("word"), F.size("words").alias("n_error"))
    t = w.filter("type = 'task'").select("session_id", F.col("node_id").alias("task_id"), F.col("status").alias("task_status"), F.explode("words").alias("word"), F.size("words").alias("n_task"))
    shared = e.join(t, ["session_id", "word"]).groupBy("session_id", "error_id", "task_id", "error_status", "task_status", "n_error", "n_task").agg(F.count("*").alias("shared"))
    fixes = (F.col("shared") / F.least("n_error", "n_task") >= 0.6) & (F.col("task_status") == "completed")
    blocks = (F.col("shared") >= least) & F.col("error_status").isin(OPEN) & F.col("task_status").isin(OPEN)
    return shared.withColumn("relation", F.when(fixes, "FIXES").when(blocks, "BLOCKS")).filter("relation IS NOT NULL").select("session_id", "error_id", "task_id", "relation", "shared")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes added, removed or of another status between two snapshots."""
    b = before.select("node_id", F.col("status").alias("old_status"))
    a = after.select("node_id", F.col("status").alias("new_status"))
    joined = b.join(a, "node_id", "full_outer")
    change = F.when(F.col("old_status").isNull(), "added").when(F.col("new_status").isNull(), "removed").when(F.col("old_status") != F.col("new_status"), "status_changed")
    return joined.withColumn("change", change).filter("change IS NOT NULL").select("node_id", "change", "old_status", "new_status")


def status_moves(nodes: DataFrame) -> DataFrame:
    """Consecutive statuses of a session's nodes of a type and topic, and whether the state machine has the move."""
    w = W.partitionBy("session_id", "type", "topic").orderBy("valid_from", "node_id")
    moves = nodes.select("session_id", "node_id", "status", F.lag("status").over(w).alias("before")).filter("before IS NOT NULL")
    ok = F.col("status") == F.col("before")
    for start, ends in STATUS_MOVES.items():
        ok = ok | ((F.col("before") == start) & F.col("status").isin(ends))
    return moves.groupBy("before", "status").agg(F.count("*").alias("n"), F.max(ok).alias("allowed"))


def communities(edges: DataFrame, rounds: int = 20, small: int = 3) -> DataFrame:
    """Communities of each session by weighted label propagation: labels change in place, in the order of (degree, id).

    The sweep is sequential within a session, so a session's edges are one group.
    """

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["source_id"]) | set(pdf["target_id"]))
        weight: dict[int, dict[int, float]] = {i: {} for i in ids}
        for s, t, w in zip(pdf["source_id"], pdf["target_id"], pdf["weight"], strict=True):
            if s != t:
                weight[s][t] = weight[s].get(t, 0.0) + w
                weight[t][s] = weight[t].get(s, 0.0) + w
        label = {node: k for k, node in enumerate(ids)}

        def best(pull: dict[int, float], current: int) -> int:
            top = max(pull.values())
            tied = [k for k, v in pull.items() if v >= top - 1e-12]
            return current if current in tied else min(tied)

        order = sorted(ids, key=lambda i: (len(weight[i]), i))
        for _ in range(rounds):
            moved = False
            for node in order:
                pull: dict[int, float] = {}
                for other, w in weight[node].items():
                    pull[label[other]] = pull.get(label[other], 0.0) + w
                if pull:
                    new = best(pull, label[node])
                    moved |= new != label[node]
                    label[node] = new
            if not moved:
                break
        groups: dict[int, list[int]] = {}
        for node, k in label.items():
            groups.setdefault(k, []).append(node)
        for k in sorted(groups, key=lambda k: (len(groups[k]), min(groups[k]))):
            members = groups.get(k)
            if members is None or len(members) >= small:
                continue
            pull = {}
            for node in members:
                for other, w in weight[node].items():
                    if label[other] != k:
                        pull[label[other]] = pull.get(label[other], 0.0) + w
            if pull:
                into = best(pull, -1)
                for node in members:
                    label[node] = into
                groups[into] += groups.pop(k)
        dense = {k: n for n, k in enumerate(sorted(groups, key=lambda k: (-len(groups[k]), min(groups[k]))))}
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "node_id": ids, "community": [dense[label[i]] for i in ids]})

    return edges.select("session_id", "source_id", "target_id", "weight").groupBy("session_id").applyInPandas(sweep, "session_id bigint, node_id bigint, community bigint")


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a session: nodes, and the edges between live nodes."""
    n = live(nodes).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "type", "label", "status"))).alias("nodes"))
    e = live_edges(nodes, edges).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "target_id", "type"))).alias("edges"))
    return n.join(e, "session_id", "left").select("session_id", F.to_json(F.struct("nodes", "edges")).alias("json"), F.size("nodes").cast("bigint").alias("n_nodes"), F.coalesce(F.size("edges"), F.lit(0)).cast("bigint").alias("n_edges"))


def resume_lines(nodes: DataFrame, now: int | Column, caps: dict[str, int]) -> DataFrame:
    """The newest live nodes of each type of a session, as many as its cap, as numbered lines."""
    w = W.partitionBy("session_id", "type").orderBy(F.desc("valid_from"), F.desc("importance"), "node_id")
    ranked = live(nodes).filter(F.col("valid_from") <= now).withColumn("place", F.row_number().over(w).cast("bigint"))
    cap = F.when(F.lit(False), F.lit(0))
    for kind, most in caps.items():
        cap = cap.when(F.col("type") == kind, most)
    return ranked.filter(F.col("place") <= cap).select("session_id", "type", "place", F.concat(F.col("type"), F.lit(": "), F.col("label")).alias("line"))


def pack_sections(lines: DataFrame, budget: int) -> DataFrame:
    """Lines that fit a budget of tokens: sections take turns by priority, a line that does not fit is skipped.

    Skipping one line changes which later ones fit, so a session's capped lines are folded in order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = {"goal": 0, "decision": 1, "error": 2, "task": 3, "file": 4}
        pdf = pdf.assign(rank=pdf["type"].map(rank).fillna(9)).sort_values(["place", "rank"])
        used, kept = 0, []
        for line in pdf["line"]:
            cost = max(1, len(line) // 4)
            fits = used + cost <= budget
            kept.append(fits)
            used += cost * fits
        out = pdf[kept]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[:1], "n_lines": [len(out)], "tokens": [used], "block": ["\n".join(out["line"])]})

    return lines.groupBy("session_id").applyInPandas(fold, "session_id bigint, n_lines bigint, tokens bigint, block string")


