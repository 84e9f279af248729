"""The repair of conversations against a plain search over all cheapest edits."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from topicvote.llm import conversation_repair as cr
from topicvote.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SHAPE = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        if not words:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): states by what was said last, whole audits compared."""
    found = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in "ua":
                    to = step.get((state, role))
                    new = (cost + 3, audit + "I", [*lines, name[role] + ":"])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, found, strict=True):
        after = {}

        def offer(state, new, after=after):
            if state is not None and (state not in after or new[:2] < after[state][:2]):
                after[state] = new

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            offer(step.get((state, role[:1])), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for r in "ua":
                offer(step.get((state, r)), (cost + more + 3, audit + "R", [*lines, f"{name[r]}:{text}"]))
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(rows):
    """The contract's row for the damaged (turn, role, text) of a conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    turns = [t for t, *_ in rows if t is not None]
    said = [(r, t) for _, r, t in rows]
    found = faults(said)
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(said)]
    cost, audit, lines = cheapest(said) if said else (0, "", [])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


def talk(rng, conv, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    texts = ["Hi.", "Yes!", "no", "", " \t", "Why?  ", "Done. ", None, "a\nb", "é "]
    return [(conv, k + rng.choice([0, 0, 0, 1]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"T{k}{rng.choice('.,')}")
            for k in range(n)]


def answer(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_least_paths_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(r or " ", t or " ") for _, _, r, t in talk(rng, 0, rng.randrange(1, 12))]
        codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        fault = np.array([codes[f] for f in faults(rows)])
        kind = np.array(["sua".find(r[0]) if r[0] in "sua" else 3 for r, _ in rows])
        sizes, ends = np.array([len(rows)]), cr.AT_END[None]
        cost = cr.sweep(kind, fault, np.array([0]), sizes, ends)[0, 0]
        audit, _, last = cr.least_paths(kind, fault, sizes, ends, np.array([[0, 0]]))[0]
        assert (cost, audit.decode() + "I" * (cr.AT_END[last] // 3)) == cheapest(rows)[:2]


def test_contract(spark, tmp_path):
    rng = random.Random(7)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randrange(1, 14))]
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Hi."), (900, None, "user", "A."), (900, None, "user", "B.")]
    rows += [(901, 5, "system", "Only.")]
    rows += [(conv, 0, "user", "x") for conv in range(2000, 2040)]  # some have no row after damage
    got = answer(spark, tmp_path, rows)
    left = by_conversation(damage(rows))
    assert any(c not in left for c in got)
    assert got.keys() == {r[0] for r in rows}
    turns = {c: [r[1] for r in rows if r[0] == c] for c in got}
    for c in got:  # the order within a turn is that of the files
        if len(set(turns[c])) == len(turns[c]):
            assert got[c] == expected(left.get(c, [])), c


@pytest.mark.parametrize("n", [1, 2])
def test_long_conversations_cross_segments_and_tasks(spark, tmp_path, n):
    rng = random.Random(n)
    rows = []
    for conv, size in ((1, 5000), (2, 3), (3, 2048), (4, 2049), (5, 700)):
        roles = ("user", "assistant") if n == 1 else ("system", "user", "assistant", "tool")
        rows += [(conv, k, rng.choice(roles), f"{k if rng.random() < 0.9 else 'again'}{rng.choice('.. ,')}") for k in range(size)]
    rng.shuffle(rows)
    got = answer(spark, tmp_path, rows)
    left = by_conversation(damage(rows))
    assert got == {c: expected(left[c]) for c in got}


def test_small_segments():
    """Costs and paths put together from segments equal those of the whole."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        kind, fault = rng.integers(0, 4, n), rng.integers(0, 4, n)
        whole = cr.least_paths(kind, fault, np.array([n]), cr.AT_END[None], np.array([[0, 0]]))[0]
        cut = int(rng.integers(1, n))
        sizes, starts = np.array([cut, n - cut]), np.array([0, cut])
        unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, cr.FAR), (2, 4, 4))
        matrices = cr.sweep(kind, fault, starts, sizes, unit)
        go = (matrices[1] + cr.AT_END).min(axis=1)
        paths = cr.least_paths(kind, fault, sizes, np.stack([go, cr.AT_END]), np.array([[0, 0], [1, 0], [1, 1], [1, 2], [1, 3]]))
        second = paths[1 + paths[0][2]]
        assert (paths[0][0] + second[0], paths[0][1] + second[1], second[2]) == whole


def test_steps_rebuild_the_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "x")]
    docs = spark.createDataFrame([(*r, 9, 8, 7) for r in rows], SCHEMA + ", segment int, action int, `a.b` int")
    fixed = cr.repair(docs)
    steps = fixed.steps.orderBy("segment", "at").collect()
    lines = [r for r in steps if r["action"] != "D"]
    assert SHAPE.fullmatch("".join(r["role"][0] for r in lines))
    assert "".join(r["action"] for r in steps) == cheapest([r[2:] for r in rows])[1]
    assert [r["text"] for r in lines if r["action"] in "KR"] == [r[3] for r, s in zip(rows, [s for s in steps if s["action"] != "I"], strict=True) if s["action"] != "D"]


def test_empty_table_and_long_text(spark, tmp_path):
    assert answer(spark, tmp_path / "a", []) == {}
    rows = [(1, 1, "user", "word " * 200_000 + "."), (1, 2, "assistant", " " * 100_000 + "?" + " " * 100_000)]
    got = answer(spark, tmp_path / "b", rows)
    assert got == {1: expected(by_conversation(damage(rows))[1])}
