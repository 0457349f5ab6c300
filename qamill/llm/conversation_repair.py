"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Its rows are taken by turn (nulls
first; rows of one turn by role, then text) and each is blank, a duplicate, truncated or sound.
Lattice node (i, state) means: i rows are consumed and the messages kept so far end in nothing, a system, a
user or an assistant message. Edges keep (0), re-role to user or assistant (2), delete (3; the only
one for blank and duplicate rows) or insert an empty user or assistant message (2); a truncated row that
stays costs 1 more. One heap runs from the start, one from the two legal ends; they go on until no path as
cheap as the best crossing can be missing, so that every node of a cheapest path is settled on one side at
least. The least audit is then read off along the cheapest edges, letter by letter: equal costs never
leave one audit a prefix of another one to the same node, so the least letter that stays on a cheapest path
is right, and no strings are kept in the search.

Spark deals conversations out by id and sorts them; a task streams its rows. Of the open conversation a task
holds a byte and a digest a row; messages are spooled, to the task's scratch disk when they are many, since a
repair is known only at the conversation's end. One conversation is one result with one running hash, so it
isn't split over tasks.

Defined results: nulls in role or text are one space, so such a row is blank or has no legal role; null
turns come first and count in no gap; null ids form one conversation; rows of equal role and text after the
first are duplicates, whatever their turn; texts and conversations may have any length; an empty table gives
an empty result; extra columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.llm.common import table

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States: nothing yet, after a system, a user, an assistant message.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant message that is added or re-roled.
NEXT = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
BEFORE = {USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
#: Bytes of an open conversation that a task holds in memory.
SPOOL = 8 << 20

_INK = re.compile(r"[^\x20\x09-\x0d]")
_INF = float("inf")


def kept_state(state: int, initial: str) -> int | None:
    """State after keeping a message, None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def edges(row: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows consumed, state after, cost) in the letters' order. ``row`` is the code of the next
    row: "" at the end, "d" must go, else its initial (or "-") with "!" if truncated."""
    out = []
    if row:
        out.append(("D", 1, state, DELETE))
    out.append(("I", 0, NEXT[state], INSERT))
    if row and row != "d":
        more = TRUNCATED if row[1:] else 0
        after = kept_state(state, row[0])
        if after is not None:
            out.append(("K", 1, after, KEEP + more))
        out.append(("R", 1, NEXT[state], REROLE + more))
    return out


def reverse_edges(row: str, state: int) -> list[tuple[int, int, int]]:
    """(rows given back, state before, cost) of the edges into a state; ``row`` is the row before."""
    out = [(0, s, INSERT) for s in BEFORE.get(state, ())]
    if row:
        out.append((1, state, DELETE))
        if row != "d":
            more = TRUNCATED if row[1:] else 0
            out += [(1, s, REROLE + more) for s in BEFORE.get(state, ())]
            out += [(1, s, KEEP + more) for s in range(4) if kept_state(s, row[0]) == state]
    return out


def cheapest(rows: list[str]) -> tuple[int, str]:
    """(cost, least audit) of a conversation of row codes."""
    n = len(rows)
    start, ends = (0, NONE), ((n, NONE), (n, ASSISTANT))
    seen = ({start: 0}, dict.fromkeys(ends, 0))
    done: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, start)], [(0, x) for x in ends])
    best = 0 if start in ends else _INF
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = cost
        i, state = node
        if side == 0:
            steps = [((i + k, s), c) for _, k, s, c in edges(rows[i] if i < n else "", state)]
        else:
            steps = [((i - k, s), c) for k, s, c in reverse_edges(rows[i - 1] if i else "", state)]
        own, other = seen[side], seen[1 - side]
        for node, c in steps:
            c += cost
            if c < own.get(node, _INF):
                own[node] = c
                heappush(heaps[side], (c, node))
                if node in other and c + other[node] < best:
                    best = c + other[node]
    ahead, back = done[0], done[1] | dict.fromkeys(ends, 0)
    good = set()  # nodes settled from the start that lie on a cheapest path

    def on_path(node: tuple[int, int], cost: int) -> bool:
        return back.get(node, _INF) + cost == best or (node in good and ahead[node] == cost)

    for node, cost in sorted(ahead.items(), key=lambda x: (-x[1], -x[0][0])):
        i, state = node
        if back.get(node, _INF) + cost == best or any(
                on_path((i + k, s), cost + c) for _, k, s, c in edges(rows[i] if i < n else "", state)):
            good.add(node)
    audit, node, cost = [], start, 0
    while cost < best or node not in ends:
        i, state = node
        for letter, k, s, c in edges(rows[i] if i < n else "", state):
            if on_path((i + k, s), cost + c):
                audit.append(letter)
                node, cost = (i + k, s), cost + c
                break
        else:
            raise RuntimeError("no edge goes on")
    return int(best), "".join(audit)


class Conversation:
    """One conversation as its rows stream by."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.known: set[bytes] = set()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.initial = None
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: int | None, role: str, text: str) -> None:
        from xxhash import xxh3_128_digest
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        own, said = role.encode(), text.encode()
        self.spool.write(struct.pack("<QQ", len(own), len(said)) + own + said)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = initial
        digest = xxh3_128_digest(struct.pack("<Q", len(own)) + own + said)
        again = digest in self.known
        self.known.add(digest)
        last = next((c for c in reversed(text) if _INK.match(c)), None)
        if last is None:
            self.blank += 1
        elif again:
            self.duplicate += 1
        if last is None or again:
            self.codes.append("d")
        else:
            cut = last not in ".!?"
            self.truncated += cut
            self.codes.append((initial if initial in ("s", "u", "a") else "-") + "!" * cut)

    def repaired(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of the repaired conversation's messages."""
        self.spool.seek(0)
        state = NONE
        for letter in audit:
            own = said = b""
            if letter != "I":
                a, b = struct.unpack("<QQ", self.spool.read(16))
                own, said = self.spool.read(a), self.spool.read(b)
            if letter == "D":
                continue
            if letter == "K":
                state = kept_state(state, own.decode()[:1])
            else:
                state = NEXT[state]
                own = ROLE[state].encode()
            yield letter, own, said

    def close(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.codes)


def conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Conversation]]:
    """Closed conversations of sorted rows (_id, _turn, _role, _text as texts), one at a time."""
    own, held = None, None
    for b in batches:
        for name, turn, role, text in zip(*(b[c].tolist() for c in ("_id", "_turn", "_role", "_text"))):
            name = None if name is None or name != name else name
            if held is None or name != own:
                if held is not None:
                    yield own, held
                    held.spool.close()
                own, held = name, Conversation()
            held.add(None if turn is None or turn != turn else int(turn), role, text)
    if held is not None:
        yield own, held
        held.spool.close()


def _dealt(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of a conversation together and in order."""
    sent = rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("bigint").alias("_at"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("_text"))
    order = ["_conv", F.col("_at").asc_nulls_first(), "_role", "_text"]
    # turns travel as text: nulls would turn whole numbers into floats
    return sent.repartition("_conv").sortWithinPartitions(*order) \
        .select(F.col("_conv").cast("string").alias("_id"), F.col("_at").cast("string").alias("_turn"), "_role", "_text")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row a conversation: its faults, the cheapest repair and the repaired text's hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for name, held in conversations(batches):
            found = held.close()
            sha, first = hashlib.sha256(), True
            for _, own, said in held.repaired(found[-1]):
                sha.update(own if first else b"\n" + own)
                sha.update(b":")
                sha.update(said)
                first = False
            out.append((name, *found, sha.hexdigest()))
            if len(out) == 1000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["_id", *columns], dtype=object)

    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = ["bigint"] * 6 + ["string"] * 2
    made = _dealt(rows, conv, turn, role, text).mapInPandas(
        run, "_id string, " + ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    return made.select(F.col("_id").cast(rows.schema[conv].dataType).alias(conv), *columns)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """The repaired messages: conversation, place (from 0), edit (K, R or I), role, text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, held in conversations(batches):
            out, size = [], 0
            for place, (letter, own, said) in enumerate(held.repaired(held.close()[-1])):
                out.append((name, place, letter, own.decode(), said.decode()))
                size += len(said)
                if size > SPOOL:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = ["_id", "place", "edit", "role", "text"]
    made = _dealt(rows, conv, turn, role, text).mapInPandas(
        run, "_id string, place bigint, edit string, role string, text string")
    return made.select(F.col("_id").cast(rows.schema[conv].dataType).alias(conv), "place", "edit",
                       F.col("role").alias(role), F.col("text").alias(text))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that the row's key decides: of 20 remainders, 0 drops it, 1
    empties its text, 2 removes its full stops and marks, 3 repeats it, 4 makes it a user's."""
    def word(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("_role"))
    coded = rows.select("conv_id", "turn", word("role").alias("_role"), word("text").alias("_text"), code.alias("_code"))
    times = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return coded.where("_code != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                            F.explode(times).alias("_time")).drop("_time")


def repaired_damage(rows: DataFrame) -> DataFrame:
    """The report of every conversation of ``rows`` after damage."""
    found = report(damaged(rows))
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} \
        | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    ids = rows.select(F.col("conv_id").alias("_conv")).distinct()
    return ids.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(v).cast(found.schema[c].dataType)).alias(c)
                                           for c, v in none.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every conversation, damaged and repaired."""
    return repaired_damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
