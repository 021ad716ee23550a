import hashlib
import random
import re
import zlib

import pytest

from geotables.llm import structure_repair as R
from geotables.llm.structure_queries import COUNTS, damaged

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, edits string"
INITIALS = "suax"


def solve(letters):
    """Least (cost, edits) by a dynamic programme over rows, comparing whole strings."""
    best = {0: (0, "")}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for s, (c, e) in list(states.items()):
                to = 3 if s == 2 else 2
                states[to] = min(states.get(to, (c + 5, e + "I")), (c + 5, e + "I"))
        return states

    for x in letters:
        initial, fault = divmod(ord(x) - 65, 4)
        after = {}
        for s, (c, e) in inserted(best).items():
            moves = [("D", 2, s)]
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s].get(INITIALS[initial])
                moves += [("K", more, to)] * (to is not None) + [("R", more + 1, 3 if s == 2 else 2)]
            for edit, cost, to in moves:
                found = (c + cost, e + edit)
                after[to] = min(after.get(to, found), found)
        best = after
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_auction_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(3000):
        letters = "".join(rng.choice("ABCDEFGHIJKLMNOP" if rng.random() < 0.5 else "AEIEIEIH") for _ in range(rng.randrange(1, 14)))
        cost, edits, state = R.cheapest(letters, R.END, True, (0,))[0]
        assert (cost, edits) == solve(letters) and state in (0, 3)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_equal_the_whole(size):
    rng = random.Random(size)
    for _ in range(600):
        letters = "".join(rng.choice("AAEEIIHLDBCMN") for _ in range(rng.randrange(1, 17)))
        blocks = [letters[i:i + size] for i in range(0, len(letters), size)]
        exits = [R.END]
        for i in range(len(blocks) - 1, 0, -1):
            cross = R.crossing(blocks[i], i == len(blocks) - 1)
            exits.insert(0, tuple(min(cross[4 * s + t] + exits[0][t] for t in range(4)) for s in range(4)))
        state, out, cost = 0, "", None
        for i, (b, e) in enumerate(zip(blocks, exits)):
            c, edits, state = R.cheapest(b, e, i == len(blocks) - 1, (state,))[0]
            out, cost = out + edits, c if i == 0 else cost
        assert (cost, out) == solve(letters)


def test_prices_are_duals():
    lattice = R.Lattice("EEHADIMNIE" * 3, R.END, True)
    lattice.auction(0)
    for at in range(31):
        for state in range(4):
            for _, cost, to in lattice.offers((at, state)):
                assert lattice.price[at, state] <= cost + (0 if to is None else lattice.price[to])


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role if role is not None else " ",
                                        text if text is not None else " "))
    out = {}
    for c, v in convs.items():
        v.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        letters, seen, faults = "", set(), [0] * 4
        for _, _, role, text in v:
            said = text.rstrip(" \t\n\x0b\f\r")
            fault = 1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3
            seen.add((role, text))
            faults[fault] += 1
            letters += chr(65 + 4 * "suax".find(role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
        turns = {t for known, t, _, _ in v if known}
        gaps = min(max(turns) - min(turns) + 1 - len(turns), 2**63 - 1) if turns else 0
        pairs = list(zip(letters, letters[1:]))
        names = lambda x: INITIALS[(ord(x) - 65) // 4]
        illegal = sum(names(a) + names(b) not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = solve(letters)
        repaired, at, state = [], 0, 0
        for edit in audit:
            role, text = (v[at][2], v[at][3]) if edit != "I" else (None, "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            repaired.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in repaired))
        out[c] = (gaps, faults[1], faults[2], faults[3], illegal, cost, audit,
                  hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    report, edits = R.repair_report(df)
    texts = {r.conv_id: r.repaired_sha256 for r in R.digests(R.repaired_rows(df, edits)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*[r[c] for c in COUNTS], r.audit, texts.get(r.conv_id, empty)) for r in report.collect()}


def sample():
    rng = random.Random(7)
    rows = []
    for c in [*range(-3, 60), None]:
        for turn in range(rng.randrange(1, 10) if c != 5 else 300):
            rows.append((c, rng.choice([turn, turn, turn + 3, None]),
                         rng.choice(["user", "assistant", "assistant", "system", "User", "ux", "", None]),
                         rng.choice(["Yes.", f"No {turn}!", "so\n", f"what{turn}?  \n", "", " \x0b", None, "é…"])))
    rows += [rows[3]] * 4 + [(9, -2**63, "user", "z" * 300_000 + "."), (9, 2**63 - 1, "assistant", "ok.")]
    return rows


def test_tables_equal_brute_force(spark, monkeypatch):
    rows = sample()
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(R, "BLOCK", 3)
    assert run(spark, rows) == want


def test_repaired_rows_and_empty(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "user", "What?"), (2, 0, "user", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    report, edits = R.repair_report(df)
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (4, "RRD"), 2: (2, "D")}
    got = [tuple(r) for r in R.repaired_rows(df, edits).collect()]
    assert got == [(1, 1, 0, "user", "Hi.", "R"), (1, 2, 1, "assistant", "What?", "R")]
    assert run(spark, []) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    got = sorted(((r.conv_id is None, r.conv_id, r.turn, r.role, r.text) for r in damaged(
        spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role or " ", {1: "", 2: "One Two"}.get(kind, text) if c is not None else text or " "
        want += [(c is None, c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=str)
