"""R2: a stream of operations folded with Spark's keyed state: a conversation's memories, slots and log live in map states.

A call of the state costs far more than an entry, so entries are kept in blocks (``Blocks``), a short conversation is a single
value, and the key of the state is a bucket of conversations, whose rows come together; a bucket's state is keyed by conversation.

An operation after all earlier ones touches its slot, its target and the slot's owner, and nothing else is read or written,
so a batch costs what it brings. What does not come in order, and a message that is extracted again (a higher transaction
number), changes what was folded before: then the conversation's log, which is in the state as well, is folded anew, and
what no longer follows from it is withdrawn. Operations that are delivered twice, and those of a transaction that has been
replaced, change nothing.

The output is a change log: rows of SCHEMA with version (of the conversation's state) and gone. ``current`` gives the
memories as of its newest rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import OPTIONAL, SCHEMA, Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of conversations, which a stream keeps for good; entries of a block of a map, about.
BUCKETS, BLOCK = 1024, 128
FIELDS = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("conv_id", "owns")]
MEMORY = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] not in ("conv_id", "owns"))
CHANGES = SCHEMA + ", version long, gone boolean"
LOGGED = ("op", *OPTIONAL)
_LOG = "tx long, op string, " + ", ".join(f"{c} {'int' if c == 'op_idx' else 'string'}" for c in OPTIONAL)


class Kept(dict):
    """A dictionary over a map state: rows are read when they are asked for, and written back when the batch ends."""

    def __init__(self, state, load, dump) -> None:
        super().__init__()
        self.state, self.load, self.dump = state, load, dump
        self.absent: set = set()
        self.read: dict[Any, tuple] = {}

    def _fetch(self, key) -> None:
        if dict.__contains__(self, key) or key in self.absent or not key:
            return
        row = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        if row is None:
            self.absent.add(key)
        else:
            self.read[key] = tuple(row)
            dict.__setitem__(self, key, self.load(row))

    def get(self, key, default=None):
        self._fetch(key)
        return super().get(key, default)

    def __contains__(self, key) -> bool:
        self._fetch(key)
        return super().__contains__(key)

    def __getitem__(self, key):
        self._fetch(key)
        return super().__getitem__(key)

    def setdefault(self, key, value):
        self._fetch(key)
        return super().setdefault(key, value)

    def __delitem__(self, key) -> None:
        super().__delitem__(key)
        self.absent.add(key)

    def store(self) -> list:
        """Writes what has changed; returns its keys, those that went included."""
        changed = [k for k, v in self.items() if self.dump(v) != self.read.get(k)]
        gone = [k for k in self.read if not dict.__contains__(self, k)]
        for k in changed:
            self.state.updateValue((k,), self.dump(self[k]))
        for k in gone:
            self.state.removeKey((k,))
        return changed + gone


class Row:
    """An operation with the fields that Store reads."""

    def __init__(self, msg: int, values: tuple) -> None:
        self.msg = msg
        self.__dict__.update(zip(("tx", *LOGGED), values))


class Blocks:
    """A map of a conversation with the methods of a map state, in blocks of about BLOCK entries, each a single value of the state.

    A block is read when a key of it is asked for, and written if it has changed. A map of one block is kept with the
    conversation's head; the number of blocks doubles as entries come.
    """

    def __init__(self, state, conv: int, name: str, n: int = 1, count: int = 0, only: list | None = None) -> None:
        self.state, self.conv, self.name, self.n, self.count = state, conv, name, n, count
        self.held: dict[int, dict] = {0: self._load(only or [])} if n == 1 else {}
        self.changed: set[int] = set()

    @staticmethod
    def _load(rows: list) -> dict:
        return {tuple(k): tuple(v) for k, v in rows}

    def _at(self, key: tuple) -> int:
        return (zlib.crc32(key[0].encode()) if isinstance(key[0], str) else key[0]) % self.n

    def _block(self, b: int) -> dict:
        if b not in self.held:
            self.held[b] = self._load(json.loads(self.state.getValue((self.conv, self.name, b))[0]))
        return self.held[b]

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return key in self._block(self._at(key))

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        return self._block(self._at(key)).get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        b = self._at(key)
        self.count += key not in self._block(b)
        self.held[b][key] = value
        self.changed.add(b)

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        b = self._at(key)
        self.count -= self._block(b).pop(key, None) is not None
        self.changed.add(b)

    def beside(self, first) -> list[tuple]:
        """The keys that begin so."""
        return [k for k in self._block(self._at((first,))) if k[0] == first]

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        for b in range(self.n):
            yield from self._block(b).items()

    def clear(self) -> None:
        self.held, self.changed, self.count = {b: {} for b in range(self.n)}, set(range(self.n)), 0

    def store(self) -> list:
        """Writes what has changed; returns the arguments with which the map is made again."""
        if self.count > BLOCK * self.n:
            rows = list(self.iterator())
            while self.count > BLOCK * self.n // 2:
                self.n *= 2
            self.clear()
            for k, v in rows:
                self.updateValue(k, v)
        if self.n == 1:
            return [1, self.count, list(self.held[0].items())]
        for b in self.changed:
            self.state.updateValue((self.conv, self.name, b), (json.dumps(list(self.held[b].items())),))
        return [self.n, self.count]


#: The maps of a conversation: memories by id, ids by slot, operations by message and place, transactions by message.
MAPS = ("memories", "slots", "log", "current")


class Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", "conv_id long", "head string")
        self.blocks = handle.getMapState("blocks", "conv_id long, name string, block int", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).astype(object)
        batch = batch.where(batch.notna(), None).sort_values(["conv_id", "msg", "tx", "op_idx"])
        frames = (self._handled(conv, own) for conv, own in groupby(batch.itertuples(index=False), lambda r: r.conv_id))
        out = [x for own in frames for x in own]
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
            yield frame.astype({c: "Int64" for c in ("valid_from", "valid_until", "created_seq", "reinforcement", "confirmed")} | {"conv_id": "int64"})

    def _handled(self, conv: int, batch: Iterator[Any]) -> list[dict]:
        """The changes of a conversation that these operations, in order, bring."""
        stored = self.heads.getValue((conv,)) if self.heads.containsKey((conv,)) else None
        head = json.loads(stored[0]) if stored else {"last": [None, None, 0, 0]}
        maps = {m: Blocks(self.blocks, conv, m, *head.get(m, [])) for m in MAPS}
        self.memories, self.slots, self.log, self.current = (maps[m] for m in MAPS)
        msg, idx, made, version = head["last"]
        fresh, again = [], False
        brought: set[int] = set()
        for r in batch:
            tx = (self.current.getValue((r.msg,)) or (None,))[0]
            if tx is not None and r.tx < tx or tx == r.tx and self.log.containsKey((r.msg, r.op_idx)):
                continue
            if tx is not None and r.tx > tx:  # the message's earlier operations are replaced
                again = True
                for k in self.log.beside(r.msg):
                    self.log.removeKey(k)
                if r.msg in brought:
                    fresh = [x for x in fresh if x.msg != r.msg]
            brought.add(r.msg)
            self.current.updateValue((r.msg,), (r.tx,))
            row = (r.tx, *[getattr(r, c) for c in LOGGED])
            self.log.updateValue((r.msg, r.op_idx), row)
            again = again or msg is not None and (r.msg, r.op_idx) <= (msg, idx)
            fresh.append(Row(r.msg, row))
        if not fresh:
            return []
        version += 1
        if again:
            out, made = self._refold(version)
        else:
            out, made = self._advance(sorted(fresh, key=lambda r: (r.msg, r.op_idx)), made, version)
        top = max((r.msg, r.op_idx) for r in fresh)
        last = [*(max(top, (msg, idx)) if msg is not None else top), made, version]
        self.heads.updateValue((conv,), (json.dumps({"last": last} | {m: maps[m].store() for m in MAPS}),))
        return [{"conv_id": conv, **x} for x in out]

    @staticmethod
    def _loaded(row) -> dict:
        return dict(zip(FIELDS, row))

    @staticmethod
    def _dumped(m: dict) -> tuple:
        return tuple(m[c] for c in FIELDS)

    def _advance(self, rows: list[Row], made: int, version: int) -> tuple[list[dict], int]:
        """Applies operations that come after all others."""
        store = Store()
        store.memories = Kept(self.memories, self._loaded, self._dumped)
        store.slots = Kept(self.slots, lambda row: row[0], lambda i: (i,))
        for r in rows:
            new = f"m{r.msg}_{r.op_idx}"
            known = new in store.memories
            store.apply(r)
            if not known and dict.__contains__(store.memories, new):
                made += 1
                store.memories[new]["created_seq"] = made
        slots = store.slots.store()
        touched = set(store.memories.store()) | {i for s in slots for i in (store.slots.get(s), (store.slots.read.get(s) or (None,))[0]) if i}
        return [self._change(store, i, version) for i in sorted(touched)], made

    def _refold(self, version: int) -> tuple[list[dict], int]:
        """Folds the whole log again."""
        before = {k[0]: (tuple(v), self._owned(k[0], v)) for k, v in self.memories.iterator()}
        store = Store()
        for (msg, _), values in sorted((tuple(k), tuple(v)) for k, v in self.log.iterator()):
            store.apply(Row(msg, values))
        self.memories.clear()
        self.slots.clear()
        for i, m in store.memories.items():
            self.memories.updateValue((i,), self._dumped(m))
        for s, i in store.slots.items():
            self.slots.updateValue((s,), (i,))
        out = [self._change(store, i, version) for i, m in store.memories.items() if before.get(i) != (self._dumped(m), store.slots.get(m["slot"]) == i)]
        for i in before.keys() - store.memories.keys():
            out.append({**self._loaded(before[i][0]), "owns": False, "version": version, "gone": True})
        return out, len(store.memories)

    def _owned(self, i: str, row) -> bool:
        slot = self._loaded(row)["slot"]
        return bool(slot) and self.slots.containsKey((slot,)) and self.slots.getValue((slot,))[0] == i

    @staticmethod
    def _change(store: Store, i: str, version: int) -> dict:
        m = store.memories.get(i)
        return {**m, "owns": bool(m["slot"]) and store.slots.get(m["slot"]) == i, "version": version, "gone": False}


def changes(stream: DataFrame) -> DataFrame:
    """CHANGES of a stream of operations (conv_id, msg, op, ...) with any of OPTIONAL and tx, the transaction's number (0 if there is none)."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one with map states
    col = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in stream.columns else F.lit(default).cast(kind)).alias(c)
    rows = stream.select("conv_id", F.col("msg").cast("long").alias("msg"), "op", col("tx", "long", 0), *[col(c, "int" if c == "op_idx" else "string", 0 if c == "op_idx" else None) for c in OPTIONAL])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(Fold(), CHANGES, "update", "none")


def ingest(stream: DataFrame, changes_path: str, checkpoint: str):
    """Starts the stream: every batch's changes become a folder of their own, which a batch that is run again overwrites."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes_path}/batch={batch_id}")

    return changes(stream).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """The memories (SCHEMA) as the change log leaves them."""
    newest = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy(F.desc("version")))
    return changes.withColumn("_n", newest).where("_n = 1 and not gone").select(*[c.split()[0] for c in SCHEMA.split(", ")])
