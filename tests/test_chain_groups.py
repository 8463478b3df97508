"""The chain stream's step goes through a whole group of chains at once, as a loop over each chain would."""

import random

import pandas as pd
import pytest

from ledgerline.schemas import GENESIS
from ledgerline.streaming import watch as live

HOLD, KEEP = 50, 100


class Held:
    """A group's state as Spark holds it."""

    def __init__(self):
        self.exists, self.get, self.watermark, self.timeout, self.updates = False, None, 0, None, 0

    def update(self, new):
        self.exists, self.get, self.updates = True, new, self.updates + 1

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.timeout = at


def frame(rows):
    """Rows (chain, seq, hash, prev, expected, corruption, ts) with a place, as the step gets them."""
    df = pd.DataFrame(rows, columns=["chain_id", "seq", "record_hash", "prev_hash", "expected", "corruption", "ts_ms"]).astype({"seq": "int64"})
    df["ts_ms"] = pd.Series([live.UNTIMED if r[6] is None else r[6] for r in rows], dtype="int64")
    df["placed"] = df["numbered"] = True
    return df


def stepped(state, rows):
    state.timeout = None
    out = pd.concat(live.chains_step((0,), iter([frame(x) for x in (rows[:20], rows[20:]) if x]), state, HOLD, KEEP, 0))
    return sorted([(r[0], r[1], int(r[2]), *[None if pd.isna(x) else x for x in r[3:]]) for r in out.itertuples(index=False)], key=str)


def walk(chain, last, waiting, passed):
    """One chain by a plain loop: breaks, head, records that wait."""
    waiting = sorted(waiting, key=lambda r: (r[1], r[2]))
    now = max([passed + KEEP, *[r[6] for r in waiting if r[6] is not None]])
    waiting = [r if r[6] is not None else (*r[:6], now) for r in waiting]
    out = []
    for i, (_, seq, found, prev, expected, corruption, ts) in enumerate(waiting):
        if last is not None and seq <= last[0]:
            out.append((chain, "LATE_RECORD", seq, str(last[0] + 1), str(seq)))
            continue
        if seq != (0 if last is None else last[0] + 1) and (passed <= 0 or passed + KEEP < ts + HOLD):
            return out, last, waiting[i:]
        if corruption:
            out.append((chain, "CORRUPT", seq, None, corruption))
        elif expected:
            out.append((chain, "HASH_MISMATCH", seq, expected, found))
        elif last is None:
            if prev != GENESIS:
                out.append((chain, "BAD_GENESIS", seq, GENESIS, prev))
        elif seq != last[0] + 1:
            out.append((chain, "SEQ_GAP", seq, str(last[0] + 1), str(seq)))
        elif prev != last[1]:
            out.append((chain, "BROKEN_LINK", seq, last[1], prev))
        last = (seq, found)
    return out, last, []


@pytest.mark.parametrize("seed", range(12))
def test_a_group_is_gone_through_as_its_chains_would_be(seed):
    r, state, chains, kinds = random.Random(seed), Held(), {}, set()
    for turn in range(8):
        state.watermark = [0, 0, 60, 60, 200, 230, 400, 10_000][turn]
        rows = []
        for _ in range(r.randrange(0, 60) if turn < 7 else 0):
            prev = r.choice([GENESIS, "h1", "h2", None])
            corruption = "prev_hash" if prev is None else r.choice([None] * 5 + ["payload"])
            expected = None if corruption else r.choice([None] * 5 + ["e"])
            rows.append((f"c{r.randrange(9)}", r.randrange(-1, 10), r.choice(["h1", "h2"]), prev, expected, corruption, r.choice([None, *range(0, 400, 20)])))
        for x in rows:
            chains.setdefault(x[0], (None, []))[1].append(x)
        want = []
        for c, (last, waiting) in chains.items():
            told, last, waiting = walk(c, last, waiting, state.watermark)
            want += told
            chains[c] = (last, waiting)
        kinds |= {w[1] for w in want}
        assert stepped(state, rows) == sorted(want, key=str)
        first = [w[0][6] for _, w in chains.values() if w]
        assert state.timeout == (max(min(first) + HOLD - KEEP, state.watermark + 1, 1) if first else None)
    assert {"LATE_RECORD", "CORRUPT", "SEQ_GAP"} <= kinds and not any(w for _, w in chains.values())


def test_chains_of_a_group_share_one_state_of_bounded_size():
    """Where each chain was a call and a state, and each waiting record a JSON list of 230 bytes or more read again in every batch."""
    r, state = random.Random(1), Held()
    digest = lambda: f"{r.getrandbits(256):064x}"
    rows = [(f"chain {c}", s, digest(), digest(), None, None, 10**12 + s) for c in range(3000) for s in range(1, 6)]
    assert stepped(state, rows) == [] and state.updates == 1  # number 0 is missing, so all wait
    assert sum(len(x) for x in state.get) < 110 * len(rows)
    assert stepped(state, [(f"chain {c}", 0, "h", GENESIS, None, None, 10**12) for c in range(3000)]) != []
    assert sum(len(x) for x in state.get) < 110 * 3000  # only heads are left


def test_rows_without_a_place_leave_no_state():
    state, lost = Held(), frame([("a", 0, None, "p", None, "record_hash", 1), (None, 7, "h", "p", None, "chain_id", 1), (None, 0, None, None, None, live.EMPTY, 1)])
    lost["placed"], lost["numbered"] = False, [False, True, False]
    out = pd.concat(live.chains_step((0,), iter([lost]), state, HOLD, KEEP, 0))
    assert [tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False)] == [("a", "CORRUPT", None, None, "record_hash"), (None, "CORRUPT", 7, None, "chain_id")]
    assert not state.exists
