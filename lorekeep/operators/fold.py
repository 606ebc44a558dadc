"""The general fold of an operation log, for logs whose updates may change slots, states and texts.

An ordered fold cannot be split within a conversation; each conversation is one group, so its log must fit in a task.
Logs that only ever add, supersede, close and count are folded by windows instead (``oplog.slot_versions``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDED = ("closed", "superseded", "invalid")
SCHEMA = (
    "conv_id long, id string, kind string, slot string, text string, status string, importance string, valid_from long, valid_until long, "
    "created_seq long, reinforcement long, confirmed long, supersedes string, superseded_by string, owns boolean"
)


class Store:
    """Memories and slot owners of one conversation."""

    def __init__(self) -> None:
        self.memories: dict[str, dict] = {}
        self.slots: dict[str, str] = {}
        self.errors = 0

    def _own(self, m: dict, msg: int) -> None:
        if not m["slot"] or m["status"] != "active":
            return
        old = self.memories.get(self.slots.get(m["slot"], ""))
        if old is not None and old is not m:
            old.update(status="superseded" if m["kind"] in ("belief", "knowledge") else "closed", valid_until=msg, superseded_by=m["id"])
        self.slots[m["slot"]] = m["id"]

    def _leave(self, m: dict) -> None:
        if m["slot"] and self.slots.get(m["slot"]) == m["id"]:
            del self.slots[m["slot"]]

    def _end(self, m: dict, status: str, msg: int) -> None:
        m.update(status=status, valid_until=msg)
        self._leave(m)

    def _add(self, r, status: str | None, kind: str) -> dict:
        status = status or ("closed" if kind == "event" else "active")
        m = {
            "id": f"m{r.msg}_{r.op_idx}", "kind": kind, "slot": r.slot, "text": r.text, "status": status, "importance": r.importance or "medium", "valid_from": r.msg,
            "valid_until": r.msg if status in ENDED else None, "created_seq": len(self.memories) + 1, "reinforcement": 0, "confirmed": 0, "supersedes": None, "superseded_by": None,
        }
        return self.memories.setdefault(m["id"], m)

    def target(self, r) -> dict | None:
        """By id, else the slot's owner, else any active memory with the slot."""
        if r.target_id and r.target_id in self.memories:
            return self.memories[r.target_id]
        if r.target_slot:
            m = self.memories.get(self.slots.get(r.target_slot, ""))
            return m or next((x for x in self.memories.values() if x["slot"] == r.target_slot and x["status"] == "active"), None)
        return None

    def apply(self, r) -> None:
        if r.op == "noop":
            return
        if r.op == "add":
            owner = self.memories.get(self.slots.get(r.slot or "", ""))
            if owner and owner["status"] == "active" and (r.status or ("closed" if r.kind == "event" else "active")) == "active" and owner["kind"] == r.kind and " ".join(owner["text"].split()) == " ".join(r.text.split()):
                owner["confirmed"] += 1
                return
            self._own(self._add(r, r.status, r.kind), r.msg)
            return
        m = self.target(r)
        if m is None:
            self.errors += 1
        elif r.op == "reinforce":
            m["reinforcement"] += 1
        elif r.op in ("close", "invalidate"):
            self._end(m, "closed" if r.op == "close" else "invalid", r.msg)
        elif r.op == "supersede":
            self._end(m, "superseded", r.msg)
            if r.kind and r.text:
                new = self._add(r, r.status or "active", r.kind)
                new["supersedes"], m["superseded_by"] = m["id"], new["id"]
                self._own(new, r.msg)
        elif r.op == "update":
            old = m["slot"]
            m.update({k: getattr(r, "new_" + k) for k in ("kind", "slot", "text", "status", "importance") if getattr(r, "new_" + k)})
            if old and old != m["slot"] and self.slots.get(old) == m["id"]:
                del self.slots[old]
            if m["status"] in ENDED:
                m["valid_until"] = r.msg
                self._leave(m)
            else:
                m["valid_until"] = None
                self._own(m, r.msg)


OPTIONAL = ("op_idx", "kind", "slot", "text", "status", "importance", "target_id", "target_slot", "new_kind", "new_slot", "new_text", "new_status", "new_importance")


def apply_ops(ops: DataFrame) -> DataFrame:
    """G1: the memories after the whole log. ops: (conv_id, msg, op, ...) with any of OPTIONAL."""
    have = ops.select("conv_id", "msg", "op", *[(F.col(c) if c in ops.columns else F.lit(0 if c == "op_idx" else None).cast("int" if c == "op_idx" else "string")).alias(c) for c in OPTIONAL])

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store = Store()
        rows = rows.sort_values(["msg", "op_idx"]).astype(object)
        for r in rows.where(rows.notna(), None).itertuples():
            store.apply(r)
        out = [{"conv_id": key[0], **m, "owns": store.slots.get(m["slot"]) == m["id"]} for m in store.memories.values()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"valid_until": "Int64"})

    return have.groupBy("conv_id").applyInPandas(fold, SCHEMA)


def replay(pairs: DataFrame, extractions: DataFrame, ops: DataFrame) -> DataFrame:
    """The memories from the records whose turn pair still stands. pairs, extractions: (conv_id, pair_key, ...); ops: (conv_id, pair_key, msg, ...)."""
    live = extractions.join(pairs.select("conv_id", "pair_key"), ["conv_id", "pair_key"], "left_semi")
    return apply_ops(ops.join(live.select("conv_id", "pair_key").distinct(), ["conv_id", "pair_key"], "left_semi"))
