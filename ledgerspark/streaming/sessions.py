"""Session state with pending offers, as windows over a table and as a stateful stream (ST-08, G-06).

An answer may offer to check something. The offer lives until a message accepts or declines it, the
next answer replaces it, the session is cleared, or it is older than its time to live. Rules about
texts are column expressions in both forms; the stream's state holds an offer and a few flags.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerspark.functions.text import once
from ledgerspark.operators.conversation import said_no, said_yes, stands_alone

# How an answer offers to check something, and the requests that offers stand for.
OFFERS = [
    r"would you like (?:me to )?check (?:for )?(?:any other )?([^?]+)\?",
    r"should i (?:check|look for|verify) ([^?]+)\?",
    r"shall i (?:check|look for|verify) ([^?]+)\?",
]
PAYMENT_REQUEST = "Check the document for other payment-related terms such as payment terms, early settlement discounts, due dates, or contractual penalties."
DECLINED = "The user declined the offer. Acknowledge politely without calling retrieval tools."

#: Turns of a session that one task looks through.
BLOCK_TURNS = 4096


def offer_of(answer: Column) -> Column:
    """The request that an answer's offer stands for, or null: the first pattern that fits decides."""
    low = F.lower(answer)
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in OFFERS])
    request = lambda t: F.when(t.rlike("payment|term"), PAYMENT_REQUEST).otherwise(F.concat(F.lit("Check the document for "), t, F.lit(".")))
    return once(found, lambda t: F.when(t.isNotNull(), request(t)))


def proposal_of(answer: Column) -> Column:
    """What agreeing to an answer without a plain offer means, if it speaks of checking or looking."""
    low = F.lower(answer)
    text = F.when(low.rlike("payment|terms"), PAYMENT_REQUEST).otherwise(
        F.concat(F.lit("Proceed with checking the details mentioned in: '"), F.substring(answer, 1, 120), F.lit("'")))
    return F.when(low.rlike("check|look"), text)


def marked(turns: DataFrame, session: str = "session", turn: str = "turn", at: str = "at", role: str = "role", text: str = "text") -> DataFrame:
    """-> (session, turn, at, role, text, offer, proposal, yes, no, alone): all that the state needs to know of a turn; a role ``clear`` empties the session."""
    user, answer = F.coalesce(F.col(role) == "user", F.lit(False)), F.coalesce(F.col(role) == "assistant", F.lit(False))
    message = F.coalesce(F.col(text), F.lit(""))
    return turns.select(
        F.col(session).alias("session"), F.col(turn).cast("long").alias("turn"), F.col(at).cast("timestamp").alias("at"), F.coalesce(role, F.lit("")).alias("role"), message.alias("text"),
        F.when(answer, offer_of(message)).alias("offer"), F.when(answer, proposal_of(message)).alias("proposal"),
        (user & said_yes(message)).alias("yes"), (user & said_no(message)).alias("no"), (user & stands_alone(message)).alias("alone"))


def _resolved(history: Column, offer: Column, proposal: Column) -> list[Column]:
    """(action, request): null request where the message stands for itself."""
    agreed = F.when(F.col("yes"), F.coalesce(offer, proposal))
    action = F.when(~history, "none").when(agreed.isNotNull(), "confirmation_affirmative").when(F.col("no"), "confirmation_negative").when(F.col("alone"), "none").otherwise("reference")
    request = F.when(~history, F.lit(None)).otherwise(F.coalesce(agreed, F.when(F.col("no"), DECLINED)))
    return [action.alias("action"), F.coalesce(request, F.trim("text")).alias("request")]


def resolve_table(turns: DataFrame, ttl_seconds: float) -> DataFrame:
    """Marked turns -> (session, turn, action, request) of every user turn, from the turns before it.

    What the state would hold is the last of a few events, so it is a last-value window; sessions of any
    length are looked through in blocks whose last values are carried on.
    """
    user = F.col("role") == "user"
    events = {
        # null: no effect; an empty offer ends the one that is pending
        "_offer": F.when(F.col("role") == "assistant", F.struct("turn", "at", F.col("offer").alias("request"))).when(
            (user & (F.col("yes") | F.col("no"))) | (F.col("role") == "clear"), F.struct("turn", "at", F.lit(None).cast("string").alias("request"))),
        "_answer": F.when(F.col("role") == "assistant", F.struct("turn", "proposal")),
        "_clear": F.when(F.col("role") == "clear", F.col("turn")),
        "_any": F.when(F.col("role") != "clear", F.col("turn")),
    }
    rows = turns.withColumns({**events, "_block": F.floor(F.col("turn") / BLOCK_TURNS)})
    before = Window.partitionBy("session", "_block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("session", "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c) for c in events])
    earlier = Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("session", "_block", *[F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_0") for c in events])
    inner = rows.select("*", *[F.last(c, ignorenulls=True).over(before).alias(f"{c}_1") for c in events])
    seen = inner.where(user).join(carried, ["session", "_block"])
    last = {c: F.coalesce(f"{c}_1", f"{c}_0") for c in events}
    seen = seen.select("session", "turn", "at", "text", "yes", "no", "alone", *[v.alias(f"{c}_last") for c, v in last.items()])
    since = lambda t: F.coalesce(t > F.col("_clear_last"), t.isNotNull())
    alive = F.col("at").cast("double") - F.col("_offer_last.at").cast("double") <= ttl_seconds
    offer = F.when(alive, F.col("_offer_last.request"))
    proposal = F.when(since(F.col("_answer_last.turn")), F.col("_answer_last.proposal"))
    return seen.select("session", "turn", *_resolved(since(F.col("_any_last")), offer, proposal))


_STATE = "next bigint, history boolean, offer string, offer_at double, proposal string, waiting string"
_OUT = "session bigint, turn bigint, action string, request string"


def _fold(state: dict, r: dict, ttl: float) -> tuple[str, str] | None:
    """One turn; the same rules as :func:`resolve_table`, over flags that columns have made."""
    if r["role"] == "clear":
        state.update(history=False, offer=None, proposal=None)
        return None
    out = None
    if r["role"] == "user":
        offer = state["offer"] if state["offer"] is not None and r["at"] - state["offer_at"] <= ttl else None
        agreed = (offer or state["proposal"]) if r["yes"] else None
        if not state["history"]:
            out = "none", r["text"]
        elif agreed:
            out = "confirmation_affirmative", agreed
        elif r["no"]:
            out = "confirmation_negative", DECLINED
        else:
            out = ("none" if r["alone"] else "reference"), r["text"]
        if r["yes"] or r["no"]:
            state.update(offer=None)
    elif r["role"] == "assistant":
        state.update(offer=r["offer"], offer_at=r["at"], proposal=r["proposal"])
    state.update(history=True)
    return out


def resolve_stream(turns: DataFrame, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """Marked turns of a stream -> rows as of :func:`resolve_table`, in append mode.

    Turns of a session are numbered from 0 and may arrive in any order, and again: those ahead of
    their turn wait in the state, those seen before are left out. Where a number never comes, the wait
    ends with a timer that follows the watermark, and what waits is taken in order; an offer beyond its
    time is dropped by the same timer.
    """
    ttl = float(ttl_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        fields = [c.split()[0] for c in _STATE.split(", ")]
        state = dict(zip(fields, group.get)) if group.exists else dict(zip(fields, (0, False, None, None, None, "[]")))
        waiting = {r["turn"]: r for r in json.loads(state["waiting"])}
        for batch in batches if not group.hasTimedOut else ():
            for r in batch.drop(columns=["session", "at"]).rename(columns={"seconds": "at"}).to_dict("records"):
                if r["turn"] >= state["next"]:
                    waiting[r["turn"]] = {k: None if v is None or v is pd.NaT or v != v else v for k, v in r.items()}
        out = []
        while waiting and (group.hasTimedOut or state["next"] in waiting):
            turn = min(waiting) if group.hasTimedOut else state["next"]
            got = _fold(state, waiting.pop(turn), ttl)
            state["next"] = turn + 1
            if got:
                out.append((key[0], turn, got[0], got[1]))
        if group.hasTimedOut and state["offer"] is not None and group.getCurrentWatermarkMs() / 1000 - state["offer_at"] > ttl:
            state["offer"] = None
        state["waiting"] = json.dumps(list(waiting.values()))
        group.update(tuple(state[f] for f in fields))
        if waiting or state["offer"] is not None:
            newest = max([r["at"] for r in waiting.values()], default=0)
            due = max(newest, (state["offer_at"] or 0) + ttl) * 1000 if state["offer"] is not None else newest * 1000
            group.setTimeoutTimestamp(int(max(due, group.getCurrentWatermarkMs() + 1)) + 1)
        yield pd.DataFrame(out, columns=["session", "turn", "action", "request"], dtype=object)

    shown = turns.withColumns({"text": F.trim("text"), "seconds": F.col("at").cast("double")}).withWatermark("at", late)
    return shown.groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
