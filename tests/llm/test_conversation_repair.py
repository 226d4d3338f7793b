import hashlib
import itertools
import random
import re
import zlib

import pytest

from galeframe.llm.conversation_repair import answers, back, forward, fronts, repair, repair_conversations, summaries, written

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out += [(c, t, role, text)] * (2 if d == 3 else 1)
    return out


def told(rows):
    """Counts, and (role, text, must go, truncated) of each row of a conversation in order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r[1] for r in rows if r[1] is not None}
    n["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    n["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return n, out


def least(rows):
    """(cost, audit, lines) by a table over the roles written so far."""
    best = {}

    def at(i, q):
        """From row i on, after a turn of role q ("" at the start), with up to two inserted turns first: a third would lead
        back to where the first began."""
        if (i, q) not in best:
            found, state, lines = [core(i, q)], q, ()
            for count in (1, 2):
                state = "a" if state == "u" else "u"
                lines += ({"u": "user:", "a": "assistant:"}[state],)
                tail = core(i, state)
                found.append(tail and (tail[0] + 3 * count, "I" * count + tail[1], lines + tail[2]))
            best[i, q] = min(f for f in found if f)
        return best[i, q]

    def core(i, q):
        """As at(), with a row or the end next."""
        if i == len(rows):
            return (0, "", ()) if q in ("", "a") else None
        to = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
        role, text, gone, cut = rows[i]
        steps = [(4, "D", (), q)]
        if not gone:
            if role[:1] and role[:1] in to:
                steps.append((3 * cut, "K", (f"{role}:{text}",), role[:1]))
            steps += [(3 + 3 * cut, "R", (f"{name}:{text}",), name[0]) for name in ("user", "assistant") if name[0] in to]
        tails = [at(i + 1, then) for *_, then in steps]
        return min((c + cost, letter + a, line + lines) for (cost, letter, line, _), (c, a, lines) in zip(steps, tails))

    for i in range(len(rows), -1, -1):  # from the end, so that nothing recurs deeply
        for q in ("", "s", "u", "a"):
            at(i, q)
    return best[0, ""]


def tried(rows):
    """(cost, audit, lines) by trying all edits with up to two inserted turns before each row and at the end."""
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for role, text, gone, cut in rows:
        acts = [("D", 4, None)]
        if not gone:
            acts += [("K", 3 * cut, (role, text)), ("R", 3 + 3 * cut, ("user", text)), ("R", 3 + 3 * cut, ("assistant", text))]
        choices.append([(ins, *a) for ins in inserts for a in acts])
    choices.append([(ins, "", 0, None) for ins in inserts])
    found = []
    for way in itertools.product(*choices):
        cost, audit, turns = 0, "", []
        for ins, letter, c, turn in way:
            cost += c + 3 * len(ins)
            audit += "I" * len(ins) + letter
            turns += [(r, "") for r in ins] + ([turn] if turn else [])
        if all(r[:1] for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
            found.append((cost, audit, tuple(f"{r}:{t}" for r, t in turns)))
    return min(found)


def plain(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    after = {}
    for r in damage(rows):
        after.setdefault(r[0], []).append(r)
    for c, part in after.items():
        n, turns = told(part)
        cost, audit, lines = least(turns)
        out[c] = (n["gaps"], n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(rnd, n, conv=1):
    texts = ["", " \t", "Yes.", "No", "Why?", "so it goes!", "half a sent", "ä.", ". \n"]
    return [(conv, rnd.choice([None, *range(n)]) if rnd.random() < 0.1 else i + i // 7, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts) + rnd.choice(["", str(i)])) for i in range(n)]


def test_plain_version_tries_everything():
    rnd = random.Random(1)
    for _ in range(150):
        _, turns = told(damage(random_rows(rnd, rnd.randint(0, 3), rnd.randint(0, 99))))
        if len(turns) <= 3:
            assert least(turns) == tried(turns)


def as_rows(turns):
    """What the parser gets of one conversation, from right to left."""
    return [(0 if gone else 1 + 2 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + cut, 1, not gone, role[:1], None, role, text) for role, text, gone, cut in reversed(turns)]


def test_parser_finds_the_least_cost_and_audit():
    rnd = random.Random(2)
    for _ in range(600):
        _, turns = told(damage(random_rows(rnd, rnd.choice([1, 2, 5, 9, 30]), rnd.randint(0, 999))))
        table, rows = fronts(), as_rows(turns)
        front, cost, steps = forward(rows, table.start)
        right, edits = back(steps, table.best[front])
        audit, kept = written(edits + [(a, 1, t, None) for a, t in table.trailing[right]])
        assert (cost + table.rest[front], audit, tuple(f"{t['role']}:{t['text']}" for t in kept)) == least(turns)
        to, gained, tops = answers(rows, block=3)
        for f in range(len(table.fronts)):
            end, cost, steps = forward(rows, f)
            assert (end, cost) == (to[f], gained[f])
            assert all(tops[f][n] == back(steps, n)[0] for n in range(len(table.nodes)) if table.nodes[n] in table.fronts[end])


@pytest.mark.parametrize("pieces", [{}, {"piece_rows": 3}, {"piece_bytes": 40}])
def test_against_plain_version(spark, pieces):
    rnd = random.Random(3)
    rows = [r for c in range(60) for r in random_rows(rnd, rnd.choice([1, 2, 4, 8, 20]), c)]
    rows += random_rows(rnd, 700, 1000)  # a hot conversation
    rows += [(1001, 5, "user", "the same turn again and again.")] * 300 + [(1001, t, "assistant", "and its answer.") for t in range(300)]
    rnd.shuffle(rows)
    want = plain(rows)
    got = found(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), **pieces))
    assert got.keys() == want.keys()
    assert {c for c in got if got[c] != want[c]} == set()


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, None, None), (2, None, "user", "x" * 100_000 + "."), (2, -(2**63), "assistant", "a."), (2, 2**63 - 1, "assistant", "b."),
            (3, 1, "user", "퟿ é\x00."), (3, 1, "assistant", "same turn."), (4, 0, "", "."), (5, 1, "USER", "Hi."), (5, 2, "aide", "Kept by its letter.")] + [(c, 1, "user", "Hi.") for c in range(10, 60)]
    want = {c: (min(w[0], 2**63 - 1), *w[1:]) for c, w in plain(rows).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repair_conversations(df)) == want
    assert any(w[6] == "" for w in want.values())  # one of the last loses its only row
    assert found(repair_conversations(df.selectExpr("*", "1 AS n", "'x' AS audit", "2 AS part", "3 AS kind"))) == want
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "Are you there", 1), (1, 2, "assistant", "Yes.", 1), (1, 2, "assistant", "Yes.", 1)]
    pieces = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long"))
    turns = [tuple(t) for r in pieces.collect() for t in r["turns"]]
    _, audit, lines = least(told([r[:4] for r in rows])[1])
    assert [f"{role}:{text}" for _, role, text in turns] == list(lines)
    assert [r["audit"] for r in summaries(pieces).collect()] == [audit]
