"""The stream's state in blocks: few calls of the state for many operations, and maps of many blocks hold what they were given."""

from __future__ import annotations

import random

import pandas as pd

from lorekeep.operators.fold import OPTIONAL, Store
from lorekeep.streaming import state


class Calls:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.n = {}, 0

    def getValue(self, key):  # noqa: N802
        self.n += 1
        return self.held.get(key)

    def containsKey(self, key):  # noqa: N802
        self.n += 1
        return key in self.held

    def updateValue(self, key, value):  # noqa: N802
        self.n += 1
        self.held[key] = value


def test_late_and_replaced_in_many_blocks():
    rng = random.Random(9)
    ops = [(c, i, rng.choice(["add", "add", "supersede", "close", "reinforce"]), 1, 0, "state", s := f"s{rng.randrange(5)}", f"v{rng.randrange(9)}", None, None, None, s, *[None] * 5) for i in range(3000) for c in [rng.choice([1, 1, 1, 2, 3])]]
    again = [(*o[:2], "noop", 2, *o[4:]) for o in ops if o[1] % 10 == 3]
    fold, out = state.Fold(), []
    fold.heads, fold.blocks = Calls(), Calls()
    columns = ["conv_id", "msg", "op", "tx", *OPTIONAL]
    for rows in ([o for o in ops if o[1] % 2], [o for o in ops if o[1] % 2 == 0], again):
        out += list(fold.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None))
    assert fold.heads.n + fold.blocks.n < len(ops) / 3  # several calls for each operation before
    newest = {}
    for r in pd.concat(out).itertuples():
        if (r.conv_id, r.id) not in newest or newest[r.conv_id, r.id].version < r.version:
            newest[r.conv_id, r.id] = r
    want = set()
    for c in (1, 2, 3):
        store = Store()
        for o in ops:
            if o[0] == c and o[1] % 10 != 3:
                store.apply(state.Row(o[1], (1, o[2], *o[4:])))
        want |= {(c, i, m["status"], m["text"], m["reinforcement"], m["created_seq"]) for i, m in store.memories.items()}
    assert {(c, i, r.status, r.text, r.reinforcement, r.created_seq) for (c, i), r in newest.items() if not r.gone} == want
    assert max(len(v[0]) for v in fold.blocks.held.values()) < 100_000
