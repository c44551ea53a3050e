"""Write-back plans: freeze rows behind a fingerprint, approve once, then hand them to a writer."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, functions as F

from lakesync.operators.writeback import map_fields, plan_hash
from lakesync.workspace import fresh_dir

EXPIRY = dt.timedelta(hours=24)
#: Actions that take rows away at the destination, and what has to be typed to run a plan of them.
DESTRUCTIVE_ACTIONS = frozenset({"delete", "remove", "truncate", "replace"})
DESTRUCTIVE = "destructive"


@dataclass(frozen=True)
class ReversePlan:
    plan_id: str
    source_table: str
    action: str
    mappings: Mapping[str, str]
    settings: Mapping[str, str]
    record_count: int
    plan_hash: str
    expires_at: dt.datetime
    token_hash: str | None
    status: str = "planned"
    challenge: str = ""


def token_digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def make_plan(
    rows: DataFrame, plan_id: str, source_table: str, action: str, mappings: Mapping[str, str],
    settings: Mapping[str, str], token: str, now: dt.datetime, max_rows: int = 0, challenge: str | None = None,
) -> ReversePlan:
    """Fingerprint the mapped rows and open the plan for approval.

    ``max_rows`` is a safety limit a caller may give: more rows refuse the plan
    rather than being cut off.  ``challenge`` is a word that has to be typed
    when the plan is run; destructive actions have one of their own.
    """
    if not mappings:
        raise ValueError("a plan maps at least one field")
    found = plan_hash(map_fields(rows, mappings), dict(settings)).first()
    if max_rows and found.row_count > max_rows:
        raise ValueError(f"plan holds {found.row_count} rows, more than the limit of {max_rows}")
    return ReversePlan(
        plan_id, source_table, action or "upsert", dict(mappings), dict(settings), found.row_count,
        found.plan_hash, now + EXPIRY, token_digest(token),
        challenge=challenge_of(action) if challenge is None else challenge.strip(),
    )


def challenge_of(action: str) -> str:
    return DESTRUCTIVE if action.strip().lower() in DESTRUCTIVE_ACTIONS else ""


def approve(plan: ReversePlan, token: str, now: dt.datetime, confirmation: str = "") -> None:
    """Refuse a plan that may not run; nothing is read or used up before all checks have passed."""
    if plan.status != "planned":
        raise ValueError(f"plan {plan.plan_id!r} cannot run: it is {plan.status}")
    if now > plan.expires_at:
        raise ValueError(f"plan {plan.plan_id!r} could be approved until {plan.expires_at}")
    if not plan.token_hash:
        raise ValueError("the approval token was used before")
    if token_digest(token) != plan.token_hash:
        raise ValueError("this is not the approval token of the plan")
    if plan.challenge and confirmation.strip() != plan.challenge:
        raise ValueError(f"action {plan.action!r} needs the confirmation {plan.challenge!r}, typed out")


RowSink = Callable[[Iterator[Row]], None]


def run_plan(
    plan: ReversePlan, rows: DataFrame, token: str, now: dt.datetime, sink: RowSink,
    save: Callable[[ReversePlan], None], confirmation: str = "",
) -> ReversePlan:
    """Check, re-read, compare and send; every change of status is saved before the next step.

    The mapped rows are written once; the fingerprint is taken from the written rows, and they are what is sent, so nothing
    that happens to the source in between can reach the destination.  The token is used up before the first row is sent, so a plan is never sent
    twice by approval.  ``sink`` runs per partition and must itself be safe to
    repeat, because a lost task is run again.
    """
    approve(plan, token, now, confirmation)
    path = fresh_dir(rows.sparkSession, "plan_rows")
    mapped = map_fields(rows, plan.mappings)
    mapped.write.parquet(path)
    staged = rows.sparkSession.read.schema(mapped.schema).parquet(path)
    current = plan_hash(staged, dict(plan.settings)).first()
    if current.plan_hash != plan.plan_hash:
        save(replace(plan, status="invalidated", token_hash=None))
        raise ValueError("the rows are not those the plan was made for")
    running = replace(plan, status="executing", token_hash=None)
    save(running)
    try:
        staged.withColumn("_sync_reverse_plan_id", F.lit(plan.plan_id)).foreachPartition(sink)
    except Exception:
        save(replace(running, status="failed"))
        raise
    done = replace(running, status="executed")
    save(done)
    return done
