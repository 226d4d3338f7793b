"""Repair of conversations by generalised LR parsing with weighted edits.

Turns are parsed from the last to the first, by the LR automaton of the role grammar read backwards. A graph-structured
stack holds all parses at once: a node is an automaton state above another node, and a row leads from a node to others
by keeping it, giving it another role or deleting it, with any inserted turns before it. Nodes with equal stacks merge
by the smaller (cost, audit). Read from the end, an audit grows at its front, so the smaller of two audits stays the
smaller whatever comes before, and it is enough to know the order of the audits of a stack's tops, not the audits.

A stack of this grammar has few shapes, and costs matter up to their smallest, so there are finitely many fronts (costs
and audit order of all tops). They are listed once, with what each kind of row does to them and where each top came from.

Rows are sorted by conversation and turn over range partitions. A conversation that lies inside one is repaired there. Of
one that may go on beyond its partition, or is long, each piece says where it leads from every front; these answers are
chained by conversation, which tells every piece its front and top, and the pieces are then repaired on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, small_batches, stash

#: Roles of a conversation read backwards: an optional system turn first, then pairs of user and assistant.
RULES = (("goal", ()), ("goal", ("pairs",)), ("goal", ("pairs", "s")), ("pairs", ("pairs", "pair")), ("pairs", ("pair",)), ("pair", ("a", "u")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Kinds of rows: 0 must be deleted; then each initial (s, u, a, any other) in good order and truncated.
KINDS = 9
INITIALS = "sua"
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

Item = tuple[int, int]
Node = tuple  # (state, node below or None)


_MADE: dict[str, object] = {}


def once(make: Callable) -> Callable:
    """A table that a process makes at its first use; unlike the standard cache it travels to tasks as plain code."""
    def table():
        if make.__name__ not in _MADE:
            _MADE[make.__name__] = make()
        return _MADE[make.__name__]
    return table


@once
def automaton() -> tuple[dict[tuple[int, str], int], list[list[tuple[str, int]]], list[bool]]:
    """LR(0) automaton of the grammar: transitions, reductions (left side, length) and whether the input may end, by state."""
    def closed(items: set[Item]) -> frozenset[Item]:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            right = RULES[rule][1]
            for k, (left, _) in enumerate(RULES):
                if dot < len(right) and right[dot] == left and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    states = [closed({(k, 0) for k, (left, _) in enumerate(RULES) if left == "goal"})]
    goto: dict[tuple[int, str], int] = {}
    for s, items in enumerate(states):  # grows on the way
        for symbol in sorted({RULES[r][1][d] for r, d in items if d < len(RULES[r][1])}):
            to = closed({(r, d + 1) for r, d in items if d < len(RULES[r][1]) and RULES[r][1][d] == symbol})
            if to not in states:
                states.append(to)
            goto[s, symbol] = states.index(to)
    complete = [[RULES[r] for r, d in items if d == len(RULES[r][1])] for items in states]
    return goto, [[(left, len(right)) for left, right in c if left != "goal"] for c in complete], [any(left == "goal" for left, _ in c) for c in complete]


def pushed(node: Node, symbol: str) -> list[Node]:
    """Stack tops after a terminal, when all reductions are done."""
    goto, reductions, _ = automaton()
    if (node[0], symbol) not in goto:
        return []
    out, todo = [], [(goto[node[0], symbol], node)]
    while todo:
        top = todo.pop()
        if not reductions[top[0]]:
            out.append(top)
        for left, length in reductions[top[0]]:
            below = top
            for _ in range(length):
                below = below[1]
            todo.append((goto[below[0], left], below))
    return out


@once
def stacks() -> tuple[list[Node], dict[Node, set[Node]]]:
    """All stacks of the grammar, and for each the stacks that can read at least what it can."""
    ends, nodes = automaton()[2], [(0, None)]
    for node in nodes:  # grows on the way
        for t in INITIALS:
            nodes += [new for new in pushed(node, t) if new not in nodes]
    wider = {a: {b for b in nodes if ends[b[0]] or not ends[a[0]]} for a in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in list(wider[a]):
                if not all(any(y in wider[x] for y in pushed(b, t)) for t in INITIALS for x in pushed(a, t)):
                    wider[a].discard(b)
                    changed = True
    return nodes, wider


def merged(tops: dict[Node, tuple]) -> dict[Node, tuple]:
    """Tops without those that a top of no greater (cost, audit) can stand for; of equal ones the first stays."""
    nodes, wider = stacks()
    gone = {a for a in tops for b in tops if a != b and b in wider[a]
            and (tops[b][:2] < tops[a][:2] or tops[b][:2] == tops[a][:2] and (a not in wider[b] or nodes.index(b) < nodes.index(a)))}
    return {n: v for n, v in tops.items() if n not in gone}


def with_inserts(tops: dict[Node, tuple]) -> dict[Node, tuple]:
    """Tops after any inserted turns; values are (cost, audit, top before the row, edits from left to right)."""
    changed = True
    while changed:
        changed = False
        for node, (cost, audit, came, edits) in list(tops.items()):
            for t in ROLES:
                for new in pushed(node, t):
                    found = (cost + INSERT, ("I", *audit), came, (("I", t), *edits))
                    if new not in tops or found[:2] < tops[new][:2]:
                        tops[new], changed = found, True
    return merged(tops)


def after(tops: dict[Node, tuple[int, int]], kind: int) -> dict[Node, tuple]:
    """Tops after a row of a kind, from the cost and audit rank of every top before it."""
    out: dict[Node, tuple] = {}
    for node, (cost, rank) in tops.items():
        found = [(node, cost + DELETE, "D", ())]
        if kind:
            initial, late = (INITIALS + "-")[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
            found += [(new, cost + late, "K", (("K", initial),)) for new in pushed(node, initial)]
            found += [(new, cost + late + REROLE, "R", (("R", t),)) for t in ROLES for new in pushed(node, t)]
        for new, total, letter, edits in found:
            value = (total, (letter, rank), node, edits or (("D", ""),))
            if new not in out or value[:2] < out[new][:2]:
                out[new] = value
    return with_inserts(out)


class Fronts:
    """All fronts: from each, by kind of row, the next front, what the smallest cost gains, and for each top the top it came
    from and the edits between. Front 0 is the end of a conversation."""

    def __init__(self) -> None:
        first: Node = (0, None)
        tops = with_inserts({first: (0, (), first, ())})
        self.nodes = stacks()[0]
        self.known: dict[tuple, int] = {}
        self.fronts: list[dict[Node, tuple[int, int]]] = []
        self.start, _ = self._settle(tops)
        self.trailing = {self._index(n): edits for n, (_, _, _, edits) in tops.items()}
        self.next: list[list[int]] = []
        self.gain: list[list[int]] = []
        self.came: list[list[dict[int, tuple[int, tuple]]]] = []
        for front in self.fronts:  # grows on the way
            moves = [after(front, kind) for kind in range(KINDS)]
            settled = [self._settle(m) for m in moves]
            self.next.append([f for f, _ in settled])
            self.gain.append([g for _, g in settled])
            self.came.append([{self._index(n): (self._index(old), edits) for n, (_, _, old, edits) in m.items()} for m in moves])
        ends = automaton()[2]
        self.best = [self._index(min((v, n) for n, v in front.items() if ends[n[0]])[1]) for front in self.fronts]
        self.rest = [front[self.nodes[b]][0] for front, b in zip(self.fronts, self.best)]
        #: Fronts that a deleted row changes only by its cost.
        self.still = [self.next[f][0] == f and all(old == n and edits == (("D", ""),) for n, (old, edits) in self.came[f][0].items()) for f in range(len(self.fronts))]

    def _index(self, node: Node) -> int:
        return self.nodes.index(node)

    def _settle(self, tops: dict[Node, tuple]) -> tuple[int, int]:
        """Number of the front with these tops, and the smallest cost, which leaves it."""
        least = min(v[0] for v in tops.values())
        audits = sorted({v[1] for v in tops.values()})
        front = {n: (v[0] - least, audits.index(v[1])) for n, v in tops.items()}
        key = tuple(sorted(((self._index(n), *v) for n, v in front.items())))
        if key not in self.known:
            self.known[key] = len(self.fronts)
            self.fronts.append(front)
        return self.known[key], least


@once
def fronts() -> Fronts:
    return Fronts()


def kinds(rows: list[tuple]) -> Iterator[tuple[int, int, tuple | None]]:
    """(kind, times, row) from right to left; a row that occurs n times is n - 1 deleted copies and the row itself."""
    for row in rows:
        kind, n, first = row[:3]
        if kind and first:
            if n > 1:
                yield 0, n - 1, None
            yield kind, 1, row
        elif n:
            yield 0, n, None


def forward(rows: list[tuple], front: int) -> tuple[int, int, list[tuple[int, int, tuple | None, int]]]:
    """Front after the rows, their cost, and the steps (front before, kind, row, times)."""
    table, cost, steps = fronts(), 0, []
    for kind, times, row in kinds(rows):
        while times:
            run = times if kind == 0 and table.still[front] else 1
            steps.append((front, kind, row, run))
            cost += table.gain[front][kind] * run
            front, times = table.next[front][kind], times - run
    return front, cost, steps


def back(steps: list[tuple[int, int, tuple | None, int]], node: int) -> tuple[int, list[tuple[str, int, str, tuple | None]]]:
    """From the left end: the top right of the rows, and the edits (letter, times, terminal, row)."""
    table, out = fronts(), []
    for front, kind, row, times in reversed(steps):
        node, edits = table.came[front][kind][node]
        out += [(letter, times, t, None if letter in "ID" else row) for letter, t in edits]
    return node, out


def answers(rows: list[tuple], block: int = 64) -> tuple[list[int], list[int], list[list[int]]]:
    """For every front right of the rows: the front left of them, the cost, and for each top there the top it came from (-1: no
    such top). Fronts soon run into each other, and each is walked once a block."""
    table = fronts()
    every = range(len(table.nodes))
    to, gained = list(range(len(table.fronts))), [0] * len(table.fronts)
    tops = [[n if table.nodes[n] in front else -1 for n in every] for front in table.fronts]
    for start in range(0, len(rows), block):
        moved = {}
        for front in set(to):
            end, cost, steps = forward(rows[start:start + block], front)
            came = [n if table.nodes[n] in table.fronts[end] else -1 for n in every]
            for before, kind, _, _ in reversed(steps):
                came = [n if n < 0 else table.came[before][kind][n][0] for n in came]
            moved[front] = end, cost, came
        for f, front in enumerate(to):
            end, cost, came = moved[front]
            to[f], gained[f], tops[f] = end, gained[f] + cost, [-1 if n < 0 else tops[f][n] for n in came]
    return to, gained, tops


def written(edits: list[tuple[str, int, str, tuple | None]]) -> tuple[str, list[dict]]:
    """Audit and repaired turns."""
    turns = [{"edit": letter, "role": row[5] if letter == "K" else ROLES[t], "text": row[6] if row else ""} for letter, _, t, row in edits if letter != "D"]
    return "".join(letter * times for letter, times, _, _ in edits), turns


def facts(rows: list[tuple]) -> dict:
    """Counts of faults of a piece, and what its neighbours must know of its ends."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns_seen": 0, "low": None, "high": None, "left": None, "right": None}
    for kind, n, first, initial, turn, *_ in rows:  # from right to left
        if not n:
            continue
        out["blank"] += 0 if kind else n
        out["duplicate"] += n - bool(first) if kind else 0
        out["truncated"] += bool(first and kind and (kind - 1) % 2)
        out["illegal"] += n - 1 + (out["left"] is not None and initial + out["left"] not in LEGAL)
        out["left"] = initial
        out["right"] = initial if out["right"] is None else out["right"]
        if turn is not None and turn != out["low"]:
            out["turns_seen"] += 1
            out["low"] = turn
            out["high"] = turn if out["high"] is None else out["high"]
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = "turns array<struct<edit:string,role:string,text:string>>"
RESULT = "conv_id long, part long, piece long, whole boolean, " + ", ".join(f"{c} long" for c in COUNTS) + f", audit string, {TURNS}"
OPEN = ("turns_seen long, low long, high long, left string, right string, "
        "rows array<struct<kind:int,n:long,first:boolean,initial:string,turn:long,role:string,text:string>>, to array<int>, gained array<long>, tops array<array<int>>")


def damaged(conversations: DataFrame, *, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, n): n is how often the row occurs after damage; a dropped row is an empty one that occurs 0 times."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_d", F.crc32(name.cast("binary")) % 20)
    drop = F.col("_d") == 0
    return rows.select("conv_id", F.when(~drop, F.col("turn")).alias("turn"), F.when(drop, F.lit("")).when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("_d") <= 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(drop, 0).when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("n"))


def kind_of() -> Column:
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    late = (~F.substring(body, -1, 1).isin(".", "!", "?")).cast("int")
    initial = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 3).when(F.col("initial") == "a", 5).otherwise(7)
    return F.when(F.length(body) == 0, 0).otherwise(initial + late).cast("int")


def repair(rows: DataFrame, *, piece_rows: int = 20_000, piece_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of repaired conversations: conv_id, part, piece (larger ones further left), whole (nothing else belongs to the
    conversation), gaps, blank, duplicate, truncated, illegal, cost, audit and the turns kept, reroled or inserted.

    ``rows`` are conv_id, turn, role, text (not null) and n, how often the row occurs; n = 0 only names the conversation. The
    counts of a conversation stand in one of its pieces and are 0 in the others. Equal rows are counted before they are
    shuffled. The order of a conversation is by turn (nulls first), then role, then the md5 of the text.
    """
    small_batches(rows.sparkSession)
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("initial", F.substring("role", 1, 1))
    bodies = grouped.select("conv_id", "turn", "role", digest, F.lit(False).alias("mark"), kind_of().alias("kind"), "n", "initial", "text")
    seen = rows.filter("n > 0").groupBy("conv_id", "role", digest).agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))).alias("at"))
    marks = seen.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(True).alias("mark"), F.lit(None).cast("int").alias("kind"),
                        F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("text"))
    order = ["conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc()]
    ordered = bodies.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, names = fronts(), [p.split()[0] for p in (RESULT + ", " + OPEN).split(", ")]
        part, piece, size, run, conv, started, cut = None, 0, 0, [], None, False, True  # cut: the conversation may lie in other pieces too
        out: list[dict] = []

        def close(more: bool) -> None:
            nonlocal run, size, piece
            told = facts(run)
            row = dict.fromkeys(names) | {"conv_id": conv, "part": part, "piece": piece} | {c: told[c] for c in ("blank", "duplicate", "truncated", "illegal")}
            if not (cut or more):
                front, cost, steps = forward(run, table.start)
                right, edits = back(steps, table.best[front])
                audit, turns = written(edits + [(a, 1, t, None) for a, t in table.trailing[right]])
                gaps = told["high"] - told["low"] + 1 - told["turns_seen"] if told["turns_seen"] else 0
                row |= {"whole": True, "gaps": min(gaps, 2**63 - 1), "cost": cost + table.rest[front], "audit": audit, "turns": turns}
            else:
                to, gained, tops = answers(run)
                row |= {k: told[k] for k in ("turns_seen", "low", "high", "left", "right")}
                row |= {"whole": False, "rows": [dict(zip(("kind", "n", "first", "initial", "turn", "role", "text"), r)) for r in run],
                        "to": to, "gained": gained, "tops": tops}
            out.append(row)
            run, size, piece = [], 0, piece + 1

        def emitted() -> dict:
            done = {n: [r[n] for r in out] for n in names}
            out.clear()
            return done

        pending = None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for c, turn, role, dig, mark, kind, n, initial, text in zip(*(columns[x] for x in ("conv_id", "turn", "role", "digest", "mark", "kind", "n", "initial", "text"))):
                if not started:
                    part, conv, started = columns["_part"][0], c, True
                if c != conv:
                    close(False)
                    conv, cut = c, False
                if mark:
                    pending = (c, turn, role, dig)
                    continue
                first = pending == (c, turn, role, dig) and n > 0
                if run and (len(run) >= piece_rows or size >= piece_bytes):
                    close(True)
                    cut = True
                run.append((kind, n, first, initial, turn, role, text))
                size += len(text)
            if out:
                yield emitted()
        if started:
            close(True)
            yield emitted()

    pieces = stash(map_batches(ordered.withColumn("_part", F.spark_partition_id().cast("long")), parse, RESULT + ", " + OPEN))
    done = pieces.filter("whole").select(*[p.split()[0] for p in RESULT.split(", ")])
    return done.unionByName(chained(pieces.filter("NOT whole")))


def chained(pieces: DataFrame) -> DataFrame:
    """Repair pieces of conversations that lie in several: each learns its front and its left top, one row a piece."""
    def chain(group: pd.DataFrame) -> pd.DataFrame:
        table = fronts()
        p = group.sort_values(["part", "piece"]).reset_index(drop=True)  # from right to left
        front, cost, entries = table.start, 0, []
        for to, gained in zip(p["to"], p["gained"]):
            entries.append(front)
            cost, front = cost + int(gained[front]), int(to[front])
        node, lefts = table.best[front], []
        for tops, entry in zip(reversed(p["tops"].tolist()), reversed(entries)):
            lefts.append(node)
            node = int(tops[entry][node])
        total = {c: int(p[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost + table.rest[front]}
        seen, low, high, left = 0, None, None, None
        for k in range(len(p)):
            if p["turns_seen"][k]:
                seen += int(p["turns_seen"][k]) - (low is not None and int(p["high"][k]) == low)
                low, high = int(p["low"][k]), int(p["high"][k]) if high is None else high
            if p["left"][k] is not None:
                total["illegal"] += left is not None and p["right"][k] + left not in LEGAL
                left = p["left"][k]
        total["gaps"] = min(high - low + 1 - seen, 2**63 - 1) if seen else 0
        out = p[["part", "piece"]].assign(entry=entries, node=lefts[::-1], last=[True] + [False] * (len(p) - 1))
        for c in COUNTS:
            out[c] = [total[c]] + [0] * (len(p) - 1)
        return out

    ends = [F.coalesce(c, F.lit(0)).alias(c) for c in ("low", "high")]
    narrow = pieces.select("conv_id", "part", "piece", "blank", "duplicate", "truncated", "illegal", "turns_seen", *ends, "left", "right", "to", "gained", "tops")
    told = narrow.groupBy("conv_id").applyInPandas(chain, "part long, piece long, entry int, node int, last boolean, " + ", ".join(f"{c} long" for c in COUNTS))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = fronts()
        for batch in batches:
            audits, turns = [], []
            for rows, entry, node, last in zip(batch.column("rows").to_pylist(), *(batch.column(c).to_pylist() for c in ("entry", "node", "last"))):
                _, _, steps = forward([tuple(r.values()) for r in rows], entry)
                right, edits = back(steps, node)
                audit, kept = written(edits + ([(a, 1, t, None) for a, t in table.trailing[right]] if last else []))
                audits.append(audit)
                turns.append(kept)
            yield {n: batch.column(n) for n in ("conv_id", "part", "piece", "whole", *COUNTS)} | {"audit": audits, "turns": turns}

    return map_batches(pieces.drop(*COUNTS).join(told, ["part", "piece"]), finish, RESULT)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its counts, its audit and the digest of its repaired ``role:text`` lines.

    Conversations in one piece are digested where they lie. Pieces of the others come in order to a task that feeds the
    digest piece by piece, as it has to be fed in order.
    """
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    done = pieces.filter("whole").select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, counts, audits, digest, lead = None, None, [], None, b""

        def row() -> dict:
            return {"conv_id": [conv], **{c: [n] for c, n in zip(COUNTS, counts)}, "audit": ["".join(audits)], "repaired_sha256": [digest.hexdigest()]}

        for batch in batches:
            for c, audit, turns, *more in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "lines", *COUNTS))):
                if counts is None or c != conv:
                    if counts is not None:
                        yield row()
                    conv, counts, audits, digest, lead = c, [0] * len(COUNTS), [], hashlib.sha256(), b""
                counts = [a + b for a, b in zip(counts, more)]
                audits.append(audit)
                for turn in turns:
                    digest.update(lead + turn.encode())
                    lead = b"\n"
        if counts is not None:
            yield row()

    rest = pieces.filter("NOT whole").select("conv_id", "part", "piece", lines.alias("lines"), "audit", *COUNTS)
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc(), F.col("piece").desc())
    return done.unionByName(map_batches(rest, join, done.schema))


def repair_conversations(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **pieces) -> DataFrame:
    """Damage a table of conversations by the crc32 of ``conv_id:turn``, repair it, and return one row a conversation.

    Nulls in role or text, and in the name that is hashed, are one space; a null turn comes first in its conversation; rows
    without a conversation are one of their own. A conversation without rows after damage has zeros, an empty audit and the
    digest of the empty string. Repeated rows are duplicates. Roles go by their first letter; one that is not s, u or a can
    only be deleted or reroled. ``gaps`` ends at 64 bits. An empty table gives no rows. Other columns are not read.
    """
    return summaries(repair(damaged(conversations, conv_id=conv_id, turn=turn, role=role, text=text), **pieces))
