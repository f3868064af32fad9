"""Repair of the structure of conversations: cheapest edits that give an optional system turn and pairs of user and
assistant turns.

A dynamic program over the turns that are retained: what a turn costs as the last one before the rest is its own price
(kept, or given another role) and the least over the next retained turn, of the prices of the turns between (a
difference of prefix sums of deletions), of the turns that the pair of roles makes necessary between them, and of the rest
from there on. For each role the running minimum over the later turns is at hand, so a turn takes constant time. Of equal
prices the edits' letters decide: the next retained turn as late as possible (D is least), then with most inserted turns
(I before K and R).

What a conversation's plan needs, one byte a turn and role, is held by the task that has the conversation, as its audit
is; texts stream past it into the hash or the output. Repeated turns are found by an aggregate on the hashes of their
texts before, so that nothing else is remembered of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import ready, tidy

# The prices of edits and of a truncated turn that stays, the roles, the blanks.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
NAMES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = range(4)
END, USER, ASSISTANT, SYSTEM, OTHER = range(5)
STATE = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
#: Turns to insert between a retained turn (or the start, OTHER) and the next retained one or the end.
BETWEEN = {
    OTHER: {END: 0, USER: 0, ASSISTANT: 1, SYSTEM: 0}, SYSTEM: {END: 2, USER: 0, ASSISTANT: 1},
    USER: {END: 1, USER: 1, ASSISTANT: 0}, ASSISTANT: {END: 0, USER: 0, ASSISTANT: 1},
}


def plan(roles: bytes, faults: bytes) -> tuple[int, str]:
    """The price of the cheapest edits and their letters: K(eep), R(erole), D(elete), I(nsert).

    roles: USER, ASSISTANT, SYSTEM or OTHER of each turn; faults: FINE, BLANK, DUPLICATE or CUT.
    """
    n = len(roles)
    deleted = DELETE * n  # the prefix sum of deletions before the next turn
    chosen = {r: bytearray(n) for r in (USER, ASSISTANT, SYSTEM)}  # what follows a turn that is retained so
    nearer = {r: bytearray(n) for r in (USER, ASSISTANT, SYSTEM)}  # whether the turn is the running minimum from there on
    least: dict[int, tuple[int, int]] = {END: (DELETE * n, -n)}  # of each role: price with the sum before, turn

    def rest(role: int) -> tuple[int, int]:
        """What is cheapest after role, with the prefix sum: price, what it is. A system turn that stays (K) goes before
        one that becomes a user's (R)."""
        price, _, _, r = min((least[r][0] + INSERT * k, least[r][1], -k, -r) for r, k in BETWEEN[role].items() if r in least)
        return price, -r

    for j in range(n - 1, -1, -1):
        deleted -= DELETE
        fault, own = faults[j], roles[j]
        if fault == BLANK or fault == DUPLICATE:
            continue
        extra = TRUNCATED if fault == CUT else 0
        new = []
        for role in (USER, ASSISTANT, SYSTEM) if own == SYSTEM else (USER, ASSISTANT):
            price, chosen[role][j] = rest(role)
            new.append((role, price - DELETE + extra + (0 if role == own else REROLE)))
        for role, price in new:
            if role not in least or price < least[role][0]:
                least[role], nearer[role][j] = (price, -j), 1
    cost, role = rest(OTHER)
    audit, at, last = [], 0, OTHER
    while True:
        to = n if role == END else nearer[role].index(1, at)
        audit += ["D" * (to - at), "I" * BETWEEN[last][role]]
        if role == END:
            return cost, "".join(audit)
        audit.append("K" if roles[to] == role else "R")
        at, last, role = to + 1, role, chosen[role][to]


@dataclass
class Conversation:
    """A conversation as it passes: first all its turns without their texts, then the texts, in the same order."""

    name: str | None
    roles: bytearray = field(default_factory=bytearray)
    faults: bytearray = field(default_factory=bytearray)
    illegal: int = 0
    last: str | None = None
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    audit: str | None = None
    cost: int = 0
    at: int = 0
    lines: int = 0
    expected: str = "u"

    def add(self, turn: int | None, role: str, fault: int, first: bool, n: int) -> None:
        """n equal turns, the first of their kind in the conversation or not."""
        if not n:
            return
        initial = role[:1]
        faults = [fault] * n if fault == BLANK else [fault if first else DUPLICATE, *[DUPLICATE] * (n - 1)]
        self.roles += bytes([STATE.get(initial, OTHER)]) * n
        self.faults += bytes(faults)
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = plan(bytes(self.roles), bytes(self.faults))

    def line(self, edit: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.expected = "a" if role[:1] == "u" else "u"
        self.lines += 1
        return self.lines - 1, edit, role, text

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.line("I", NAMES[self.expected], "")

    def text(self, role: str, text: str, n: int) -> Iterator[tuple[int, str, str, str]]:
        """(position, edit, role, text) of the repaired turns that n equal turns give."""
        self.settle()
        for _ in range(n):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self.line(edit, role if edit == "K" else NAMES[self.expected], text)

    def end(self) -> Iterator[tuple[int, str, str, str]]:
        self.settle()
        yield from self.inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that crc32(conv_id:turn) % 20 gives them; _copies says how often each stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"),
    )


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition and in order: its turns without texts (kind 0), then with their texts (kind 1)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("_copies") if "_copies" in rows.columns else F.lit(1)
    own = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), copies.cast("long").alias("n"))
    own = own.withColumn("hash", F.unhex(F.md5("text")))
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))  # nulls first
    turns = own.groupBy("conv", "turn", "role", "hash", fault.alias("fault")).agg(F.sum("n").alias("n"))
    firsts = own.filter("n > 0").groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash")).agg(F.min(place).alias("_first"))
    turns = turns.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash")), "left")
    turns = turns.select("conv", F.lit(0).alias("kind"), "turn", "role", "hash", "n", "fault", (F.col("_first") == place).alias("first"), F.lit(None).cast("string").alias("text"))
    texts = own.filter("n > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "hash", "n", F.lit(FINE).alias("fault"), F.lit(True).alias("first"), "text")
    return turns.union(texts).repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "hash")


def _passed(rows: DataFrame, take: Callable[[Conversation, Iterator], None], close: Callable[[Conversation], None], give: Callable[[bool], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Let the stream pass: take(conversation, repaired turns) as they come, close(conversation) at its end, give() what
    is ready after each batch."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None

        def over() -> None:
            if now is not None:
                take(now, now.end())
                close(now)

        for batch in batches:
            for conv, kind, turn, role, n, fault, first, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "n", "fault", "first", "text"))):
                if now is None or now.name != conv:
                    over()
                    now = Conversation(conv)
                if kind:
                    take(now, now.text(role, text, n))
                else:
                    now.add(turn, role, fault, bool(first), n)
            if (made := give()) is not None:
                yield made
        over()
        if (made := give()) is not None:
            yield made

    return _stream(rows).mapInArrow(tidy(run), schema)


def _typed(found: DataFrame, rows: DataFrame) -> DataFrame:
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def _columns(made: list[tuple], schema: str) -> Callable[[], pa.RecordBatch | None]:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))

    def give() -> pa.RecordBatch | None:
        if not made:
            return None
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*made), kinds)], list(names))
        made.clear()
        return batch

    return give


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of every conversation of rows (conv_id, turn, role, text; other columns are ignored): conv_id,
    position (from 0), edit (K, R or I), role, text.

    Turns are taken by turn, nulls first; equal turns by role, then by the hash of their texts. Null roles and texts count
    as one space, rows without conv_id as one conversation. A conversation may come out empty and then has no row.
    """
    schema, made = "conv_id string, position long, edit string, role string, text string", []
    return _typed(_passed(rows, lambda c, lines: made.extend((c.name, *x) for x in lines), lambda c: None, _columns(made, schema), schema), rows)


def digest(rows: DataFrame) -> DataFrame:
    """Of every conversation of rows (conv_id, turn, role, text; other columns are ignored) after `damaged`: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired role:text, one a line).

    Order, nulls and repeated rows as in `repaired`. A conversation without rows after damage has zeros, an empty audit
    and the hash of an empty text; an empty table gives no rows.
    """
    schema, made, hashes = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", [], {}

    def take(c: Conversation, lines: Iterator[tuple[int, str, str, str]]) -> None:
        for at, _, role, text in lines:
            if not at:
                hashes["now"] = hashlib.sha256()
            hashes["now"].update(f"{chr(10) if at else ''}{role}:{text}".encode())

    def close(c: Conversation) -> None:
        done = hashes.pop("now", None) or hashlib.sha256()
        made.append((c.name, c.gaps, *(c.faults.count(k) for k in (BLANK, DUPLICATE, CUT)), c.illegal, c.cost, c.audit, done.hexdigest()))

    return _typed(_passed(damaged(rows), take, close, _columns(made, schema), schema), rows)
