"""Repair of the structure of conversations by iterative-deepening A*.

The turns of a conversation reach a task twice, in one sorted stream: first as a few bytes each
(role initial, faults, a digest), from which the cheapest edits are searched, then with their
texts, which pass through one at a time while the edits are applied. No text is held.

The search goes through the edits in ASCII order, depth first, under a bound on the cost; a state
(turns consumed, place in the order of roles) that fails keeps what its completion costs at least,
so no state is tried again with too little left. The next bound is the least cost that exceeded
the last one. The first path that is accepted is the cheapest and the ASCII-least of its cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs: another role, deletion, insertion, a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places in ``(s?(ua)+)?``: at the start, after s, after u, after a. A conversation may end at the start or after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The one role that may be made or put in at a place.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: Turns that one search crosses at most before its bound is right.
WINDOW = 16


def _moves(turn: tuple | None, place: int) -> list[tuple[str, int, int, int]]:
    """Edits at a place in ASCII order: (initial, turns consumed, next place, cost). ``turn`` is None at the end."""
    out = []
    if turn is not None:
        out.append(("D", 1, place, DELETE))
    out.append(("I", 0, _NEXT[place], INSERT))
    if turn is not None and not turn[1]:
        stays = place if turn[0] == "" else _STEP.get((place, turn[0]))
        if stays is not None:
            out.append(("K", 1, stays, turn[2] * TRUNCATED))
        out.append(("R", 1, _NEXT[place], REROLE + turn[2] * TRUNCATED))
    return out


def _estimates(turns: list[tuple]) -> list[int]:
    """Lower bounds of the cost from each of some turns on to their end, where every place is taken as good."""
    out, costs = [], [0] * 4
    for turn in reversed(turns):
        costs = [min(cost + costs[to] for _, eaten, to, cost in _moves(turn, place) if eaten) for place in range(4)]
        for _ in range(2):  # one or two insertions before the turn
            costs = [min(costs[place], INSERT + costs[_NEXT[place]]) for place in range(4)]
        out.append(min(costs))
    return out[::-1]


def _search(turns: list[tuple], least: list[int], i0: int, place0: int, stop: int) -> tuple[int, str]:
    """Cost of the rest from a state on and the edits up to turn ``stop``, where ``least`` is exact (or the conversation ends)."""
    n = len(turns)
    moves = lambda i, place: _moves(turns[i] if i < n else None, place)
    bound = least[4 * i0 + place0]
    while True:
        edits, path, beyond = [], [], None
        i, place, spent, options = i0, place0, 0, iter(moves(i0, place0))
        while True:
            for edit, eaten, to, cost in options:
                need = spent + cost + least[4 * (i + eaten) + to]
                if need <= bound:
                    break
                beyond = need if beyond is None else min(beyond, need)
            else:  # failed with bound - spent left: remembered, and one step back
                at = 4 * i + place
                least[at] = max(least[at], bound - spent + 1, min(cost + least[4 * (i + eaten) + to] for _, eaten, to, cost in moves(i, place)))
                if not path:
                    break
                i, place, spent, options = path.pop()
                edits.pop()
                continue
            path.append((i, place, spent, options))
            edits.append(edit)
            i, place, spent = i + eaten, to, spent + cost
            if i == stop and (stop < n or place in (_START, _ASSISTANT)):
                return need, "".join(edits)
            options = iter(moves(i, place))
        bound = beyond


def cheapest(turns: list[tuple]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair, the ASCII-least of those, for (role initial, must be deleted, truncated).

    A conversation of many windows is solved from its end: the states before a window have exact costs once the
    states behind it have them, so that a search never crosses more than one window before its bound is right.
    """
    n = len(turns)
    if not n:
        return 0, ""
    least = [0] * (4 * n + 4)  # what completion costs at least, by turn and place
    for begin in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
        end = min(begin + WINDOW, n)
        behind = min(least[4 * end : 4 * end + 4])
        least[4 * begin : 4 * end] = [behind + e for e in _estimates(turns[begin:end]) for _ in range(4)]
        for place in range(4) if begin else ():
            least[4 * begin + place] = _search(turns, least, begin, place, end)[0]
    return _search(turns, least, 0, _START, n)


#: Any character but white space, and a last such character that ends no sentence.
_WORDED, _CUT = r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def damage(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted faults, by crc32(`conv_id:turn`) % 20.

    0 drops the turn, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it with the same number,
    4 makes it the user's. A null is written as one space (also in the key); turn and conv_id stay null in their columns.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


#: A row of ``repair``: position 0 tells of the conversation, the others of one edit each.
_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = "conv_id long, position long, edit string, turn long, role string, text string, " + ", ".join(f"{c} long" for c in _FACTS) + ", audit string"


class _Faults:
    """What the short rows of one conversation say, in their order."""

    def __init__(self):
        self.turns, self.seen, self.numbers = [], set(), [None, None, 0]
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn, initial, blank, cut, digest):
        if turn is not None:  # turns come in order
            low, high, distinct = self.numbers
            self.numbers = [turn if low is None else low, turn, distinct + (turn != high)]
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if cut else None
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.turns.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def facts(self) -> tuple[dict, str]:
        low, high, distinct = self.numbers
        cost, audit = cheapest(self.turns)
        gaps = 0 if low is None else min(high - low + 1 - distinct, 2**63 - 1)
        return {"gaps": gaps, **self.counts, "cost": cost}, audit


def _applied(audit: str, turns: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, turn, role, text) of every edit; a deleted turn has no role and text. ``turns``: (turn, role, text)."""
    place = _START
    for edit in audit:
        turn, role, text = (None, None, "") if edit == "I" else next(turns)
        if edit == "D":
            yield edit, turn, None, None
            continue
        if edit in "IR":
            place = _NEXT[place]
            role = ROLES[place]
        elif role:
            place = _STEP[place, role[0]]
        yield edit, turn, role, text


def repair(turns: DataFrame) -> DataFrame:
    """Cheapest edits that make every conversation's roles follow ``(s?(ua)+)?`` (role initials, in order of turn).

    Takes conv_id, turn, role and text. Faults of a turn: blank (only white space), duplicate (role and
    text came before), truncated (does not end in ``.``, ``!`` or ``?``); the first one counts. Keep costs 0,
    Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate), Insert 2, a truncated turn that stays 1.

    Returns for each conversation a row of position 0 with gaps, blank, duplicate, truncated, illegal
    (neighbours whose initials are not su, ua or au), cost and audit, and then for each edit a row of
    positions from 1 on: edit, turn, role, text (role and text null where deleted). These rows stand
    together, in order, in one partition; ``summaries`` relies on it.

    * Turns are ordered by turn (nulls first), those of one number by role and a digest; equal rows are duplicates.
    * A null role or text is one space. An empty role has no initial: kept, it changes nothing.
    * A null conv_id is a conversation too. Extra columns are ignored. No rows give no rows.
    * A conversation is one task's work, since its turns are searched together: some hundred bytes a turn are held, no text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    digest = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\x00"), F.col("text"))))
    rows = rows.withColumn("digest", digest)
    short = F.struct(
        F.lit(0).alias("kind"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(_WORDED)).alias("blank"),
        F.col("text").rlike(_CUT).alias("cut"),
        F.lit(None).cast("string").alias("text"),
    )
    full = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.col("text"))
    both = rows.select("conv_id", "turn", "role", "digest", F.explode(F.array(short, full)).alias("s")).select("conv_id", "turn", "role", "digest", "s.*")
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.mapInArrow(_repaired, _REPAIRED)


def _runs(batches) -> Iterator[tuple]:
    columns = ("conv_id", "kind", "turn", "role", "digest", "initial", "blank", "cut", "text")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # texts become Python objects a few at a time
            yield from zip(*(batch.column(c).slice(at, 256).to_pylist() for c in columns), strict=True)


def _repaired(batches):
    names = [c.split()[0] for c in _REPAIRED.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _REPAIRED.split(", ")]
    out, held = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for row in _conversations(_runs(batches)):
        out.append(row)
        held += 100 + len(row[5] or "")
        if held > 1_000_000:
            yield flush()
            out, held = [], 0
    if out:
        yield flush()


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    row = next(rows, None)
    while row is not None:
        conv, faults = row[0], _Faults()
        while row is not None and row[0] == conv and row[1] == 0:
            faults.add(row[2], row[5], row[6], row[7], row[4])
            row = next(rows, None)
        facts, audit = faults.facts()
        yield (conv, 0, None, None, None, None, *(facts[c] for c in _FACTS), audit)

        def full():
            nonlocal row
            while row is not None and row[0] == conv and row[1] == 1:
                now, row = row, next(rows, None)
                yield now[2], now[3], now[8]

        for position, edit in enumerate(_applied(audit, full()), 1):
            yield (conv, position, *edit, *[None] * len(_FACTS), None)


def summaries(repaired: DataFrame) -> DataFrame:
    """One row a conversation: the facts of ``repair`` and the hash of the repaired ``role:text`` lines.

    Takes the rows of ``repair`` as they come: a conversation's rows follow each other in a partition, and texts are hashed as they pass.
    """
    names = ["conv_id", *_FACTS, "audit", "repaired_sha256"]

    def run(batches):
        now, digest, lines = None, None, 0
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in zip(*(part.column(c).to_pylist() for c in ("position", "role", "text")), range(part.num_rows), strict=True):
                    position, role, text, k = row
                    if position == 0:
                        if now:
                            done.append((*now, digest.hexdigest()))
                        now = tuple(part.column(c)[k].as_py() for c in ["conv_id", *_FACTS, "audit"])
                        digest, lines = hashlib.sha256(), 0
                    elif role is not None:
                        digest.update((("\n" if lines else "") + role + ":" + text).encode())
                        lines += 1
            if done:
                yield record(done)
        if now:
            yield record([(*now, digest.hexdigest())])

    def record(rows):
        kinds = [*[pa.int64()] * (1 + len(_FACTS)), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return repaired.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-2]) + ", audit string, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conv_id of the table with the summary of its repair after ``damage``; zeros and the hash of nothing if no turn is left."""
    found = summaries(repair(damage(conversations))).withColumnRenamed("conv_id", "_id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    facts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FACTS]
    return joined.select("conv_id", *facts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
