"""The session graph as a fold over facts in order of arrival.

Merges depend on what came before and rename what they merge into, so no set operation gives the same graph: each
session's facts are folded by one function, in batch (``fold_sessions``) and in a stream (``parley.streaming.sessions``).
A session is the unit of state. Beyond ``MOST_NODES`` active nodes the least important unprotected ones go to cold storage:
their rows stay, marked ``evicted``, and come back when they are mentioned again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 500
# Rank of statuses, importance of kinds, reinforcement.
RANK = {"pending": 0, "in_progress": 1, "completed": 2, "failed": 3, "archived": 4, "superseded": 5, "modified": 5, "invalidated": 6}
IMPORTANCE = {"goal": 1.0, "task": 0.6, "decision": 0.9, "file": 0.7, "error": 0.9, "dependency": 0.6, "environment": 0.8, "endpoint": 0.7}
REINFORCE = 0.05
# Technologies that fill one slot; another of the same slot supersedes.
SLOTS = {
    "database": ["postgres", "postgresql", "mysql", "sqlite", "mongodb", "dynamodb", "cassandra"], "cache": ["redis", "memcached"], "auth": ["jwt", "oauth", "sessions", "saml"],
    "queue": ["kafka", "rabbitmq", "sqs", "celery"], "frontend": ["react", "vue", "svelte", "angular"], "deploy": ["docker", "kubernetes", "heroku", "lambda"],
}
INJECTION = re.compile(r"ignore (all |any )?(previous|prior|above) (instructions|rules)|reveal (your|the) (system )?prompt|</?(system|instructions?)>", re.I)
SAME = 0.82
NODE_FIELDS = ["node_id", "type", "label", "status", "importance", "first_turn", "last_turn", "mentions", "superseded_by", "evicted"]
TYPES = {"importance": pa.float64(), "first_turn": pa.int64(), "last_turn": pa.int64(), "mentions": pa.int64(), "evicted": pa.bool_()}
SCHEMA = "session_id bigint, node_id string, type string, label string, status string, importance double, first_turn bigint, last_turn bigint, mentions bigint, superseded_by string, evicted boolean"


@dataclass
class Session:
    """Nodes by id. ``at`` finds candidates for a merge: ids by what their labels must have in common."""

    nodes: dict[str, dict] = field(default_factory=dict)
    at: dict[tuple, dict[str, None]] = field(default_factory=lambda: defaultdict(dict))
    place: dict[str, int] = field(default_factory=dict)
    active: int = 0

    def __post_init__(self):
        for node in self.nodes.values():
            self._index(node)
            self.active += not node["evicted"]

    def _keys(self, kind: str, label: str) -> list[tuple]:
        if kind == "file":
            return [(kind, label.rsplit("/", 1)[-1])]
        return [(kind, w) for w in words_of(label)] if kind in ("decision", "error", "task") else []

    def _index(self, node: dict) -> None:
        self.place.setdefault(node["node_id"], len(self.place))
        for key in self._keys(node["type"], node["label"]):
            self.at[key][node["node_id"]] = None
        if node["type"] == "decision" and node["superseded_by"] is None and (slot := slot_of(node["label"])):
            self.at["slot", slot][node["node_id"]] = None

    def add(self, kind: str, label: str, status: str, turn: int, old: str = "") -> str | None:
        """Merge a fact into the graph; returns the node's id, or nothing if the text is refused.

        ``old`` is what a decision says that it replaces: decisions in force that name it are superseded by this one.
        """
        key = self._merged(kind, label, status, turn)
        if key and old and kind == "decision":
            for other in [i for i in self.at.get((kind, old.lower()), ()) if i != key and self.nodes[i]["superseded_by"] is None]:
                self.nodes[other]["status"], self.nodes[other]["superseded_by"] = "superseded", key
                self.at["slot", slot_of(self.nodes[other]["label"])].pop(other, None)
        return key

    def _merged(self, kind: str, label: str, status: str, turn: int) -> str | None:
        label = plain(label)
        if not label:
            return None
        key = node_id(kind, label)
        node = self.nodes.get(key) or self._same(kind, label)
        if node:
            node["last_turn"], node["mentions"] = max(node["last_turn"], turn), node["mentions"] + 1
            node["importance"] = min(1.0, round(node["importance"] + REINFORCE, 3))
            if kind == "error" or RANK[status] > RANK[node["status"]]:
                node["status"] = status
            if len(label) > len(node["label"]) and kind in ("file", "task"):
                node["label"] = label
                self._index(node)
            if node["evicted"]:  # it is talked about again
                node["evicted"], self.active = False, self.active + 1
            return node["node_id"]
        node = {"node_id": key, "type": kind, "label": label, "status": status, "importance": IMPORTANCE.get(kind, 0.5), "first_turn": turn, "last_turn": turn, "mentions": 1, "superseded_by": None, "evicted": False}
        if kind == "decision" and (slot := slot_of(label)):
            for other in self.at.pop(("slot", slot), {}):
                self.nodes[other]["status"], self.nodes[other]["superseded_by"] = "superseded", key
        self.nodes[key], self.active = node, self.active + 1
        self._index(node)
        if self.active > MOST_NODES:
            self._prune()
        return key

    def _same(self, kind: str, label: str) -> dict | None:
        words = words_of(label)
        found = {i for key in self._keys(kind, label) for i in self.at.get(key, ())}
        for node in map(self.nodes.__getitem__, sorted(found, key=self.place.__getitem__)):
            if kind == "file":
                a, b = node["label"], label
                if a.endswith("/" + b) or b.endswith("/" + a):
                    return node
                continue
            own = words_of(node["label"])
            shared = len(words & own)
            # Two technologies of one slot are two decisions, however alike the rest is.
            if kind == "decision" and technologies(label) != technologies(node["label"]):
                continue
            if (shared >= 2 and shared == min(len(words), len(own))) or shared >= SAME * max(len(words), len(own)):
                return node
        return None

    def _prune(self) -> None:
        """The least important unprotected nodes go to cold storage: they keep their rows, marked ``evicted``."""
        loose = [n for n in self.nodes.values() if not n["evicted"] and n["type"] != "goal" and not (n["type"] == "decision" and n["superseded_by"] is None)]
        for node in heapq.nsmallest(self.active - MOST_NODES, loose, key=lambda n: (n["importance"], n["last_turn"], n["node_id"])):
            node["evicted"], self.active = True, self.active - 1


# Sessions say much alike, so what only depends on a label is kept for the last labels that a task has met.
@lru_cache(50_000)
def plain(label: str) -> str:
    """A label in one line of at most 120 characters; empty if the text is refused."""
    label = " ".join(label.split())[:120]
    return "" if INJECTION.search(unicodedata.normalize("NFKC", label)) else label


@lru_cache(50_000)
def words_of(label: str) -> frozenset[str]:
    return frozenset(label.lower().split())


@lru_cache(50_000)
def node_id(kind: str, label: str) -> str:
    return hashlib.sha1(f"{kind}:{label.lower().strip().rstrip('.,!?')}".encode()).hexdigest()[:12]


@lru_cache(50_000)
def technologies(label: str) -> frozenset[str]:
    words = set(re.findall(r"[a-z]+", label.lower()))
    return frozenset(w for own in SLOTS.values() for w in own if w in words)


@lru_cache(50_000)
def slot_of(label: str) -> str | None:
    found = technologies(label)
    return next((slot for slot, own in SLOTS.items() if found & set(own)), None)


#: Kind and status of a node by the kind of fact.
FACTS = {
    "goal": ("goal", "in_progress"), "task_done": ("task", "completed"), "task_wip": ("task", "in_progress"), "task_todo": ("task", "pending"), "decision": ("decision", "completed"), "file": ("file", "completed"),
    "error": ("error", "failed"), "status": ("error", "failed"), "dependency": ("dependency", "completed"), "environment": ("environment", "completed"), "endpoint": ("endpoint", "completed"),
}


def fold(session: Session, facts: pd.DataFrame) -> Session:
    """Facts in order of turn, kind and label."""
    old = facts["old"].fillna("") if "old" in facts else ""
    for kind, label, turn, replaced in facts.assign(old=old).sort_values(["turn", "kind", "label"])[["kind", "label", "turn", "old"]].itertuples(index=False):
        if kind in FACTS:
            session.add(FACTS[kind][0], label, FACTS[kind][1], int(turn), replaced)
    return session


def rows(session_id: int, session: Session) -> pd.DataFrame:
    out = pd.DataFrame(list(session.nodes.values()), columns=NODE_FIELDS)
    out.insert(0, "session_id", session_id)
    return out


def fold_sessions(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """Nodes of every session from its facts ``(session_id, turn, kind, label)`` and perhaps ``old``, what a decision replaces.

    Facts are sorted by session and in the order of ``fold`` and stream through it, so of a task's sessions one at a time is
    held, without its facts, and a session costs nothing beside its facts and nodes. Without ``parts`` Spark fits tasks by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, own, done = Session(), None, []
        for batch in batches:
            for session_id, turn, kind, label, old in zip(*map(_values, batch.columns), strict=True):
                if session_id != own:
                    done.append((own, session))
                    session, own = Session(), session_id
                if kind in FACTS:
                    session.add(FACTS[kind][0], label, FACTS[kind][1], turn, old)
            yield _batch(done)
            done = []
        yield _batch([(own, session)])

    old = F.coalesce("old", F.lit("")) if "old" in facts.columns else F.lit("")
    own = facts.select("session_id", "turn", "kind", "label", old.alias("old"))
    own = own.repartition(parts, "session_id") if parts else own.repartition("session_id")
    return own.sortWithinPartitions("session_id", "turn", "kind", "label", "old").mapInArrow(run, SCHEMA)


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _batch(done: list[tuple[int | None, Session]]) -> pa.RecordBatch:
    """``rows`` of sessions."""
    nodes = [(session_id, node) for session_id, session in done for node in session.nodes.values()]
    columns = [pa.array([session_id for session_id, _ in nodes], pa.int64()), *(pa.array([node[f] for _, node in nodes], TYPES.get(f, pa.string())) for f in NODE_FIELDS)]
    return pa.RecordBatch.from_arrays(columns, names=["session_id", *NODE_FIELDS])
