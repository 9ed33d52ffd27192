"""Notes: filters, single notes, and decisions kept from a workflow.

notes: display_id, content, tags, source_type, memory_type, decision_status, session_id, confidence, evidence, agent,
trust_level, created_at, expires_at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long a kept decision holds, in seconds.
HOLDS = 30 * 24 * 3600


def listed(notes: DataFrame, source: str | None = None, kind: str | None = None, status: str | None = None, session: str | None = None) -> DataFrame:
    """The notes that agree with every filter given, the latest first."""
    for column, value in (("source_type", source), ("memory_type", kind), ("decision_status", status), ("session_id", session)):
        if value:
            notes = notes.filter(F.col(column) == value)
    return notes.orderBy(F.col("created_at").desc(), "display_id")


def counted(notes: DataFrame, source: str | None = None, kind: str | None = None) -> DataFrame:
    return listed(notes, source, kind).agg(F.count("*").alias("notes"))


def get(notes: DataFrame, number: int) -> DataFrame:
    return notes.filter(F.col("display_id") == number)


def forget(notes: DataFrame, number: int) -> DataFrame:
    """The notes without one of them."""
    return notes.filter(~F.col("display_id").eqNullSafe(number))


def decision(query: str, target: str, files: list[str], at: float, *, file: str = "", line: int = 0, confidence: float = 0.7, session: str = "", source: str = "auto-workflow", agent: str = "lodestone") -> dict | None:
    """The note of a workflow that chose a target, or none if it chose nothing."""
    if not target:
        return None
    focus = ", ".join(sorted({f for f in files if f})[:3]) or file
    asked = hashlib.sha1(re.sub(r"\s+", " ", query.lower()).strip().encode()).hexdigest()[:12]
    slug = re.sub("[^a-z0-9_.:-]+", "-", target.strip().lower()).strip("-")[:64] or "na"
    return {
        "content": f"Workflow decision: query='{query}' -> deep_target='{target}'. Focus files: {focus}",
        "tags": f"workflow,decision,q:{asked},t:{slug}",
        "source_type": source, "memory_type": "decision", "decision_status": "active", "session_id": session,
        "confidence": float(confidence), "evidence": f"{file}:{line}" if file else "", "agent": agent, "trust_level": "local_verified",
        "created_at": float(at), "expires_at": float(at) + HOLDS,
    }


def captured(notes: DataFrame, note: dict, at: float) -> DataFrame:
    """notes and the decision, numbered on, unless an active decision of its source that hasn't expired has both of its
    tags or its text. Which of the two is decided in the same pass, not on the driver."""
    asked, slug = note["tags"].split(",")[2:]
    tags = F.split(F.coalesce("tags", F.lit("")), ",")
    x = F.col("expires_at").cast("string")
    holds = x.isNull() | (x == "") | (x.try_cast("double") > at)
    same = (F.array_contains(tags, asked) & F.array_contains(tags, slug)) | (F.col("content") == note["content"])
    active = (F.col("source_type") == note["source_type"]) & (F.col("memory_type") == "decision") & (F.col("decision_status") == "active") & holds & same
    state = notes.agg(F.coalesce(F.max(F.coalesce(active, F.lit(False)).cast("int")), F.lit(0)).alias("there"), F.coalesce(F.max("display_id"), F.lit(0)).cast("long").alias("last"))
    kinds = dict(notes.dtypes)
    new = state.filter("there = 0").select(*[(F.col("last") + 1 if c == "display_id" else F.lit(note.get(c))).cast(kinds[c]).alias(c) for c in notes.columns])
    return notes.unionByName(new)
