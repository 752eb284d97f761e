"""Repair of conversations by a dynamic program over edits, with an audit of what was done.

A conversation's role initials must read (s?(ua)+)?: an optional system turn, then user and assistant in turn. ``State``
is how far that pattern has come. The program goes from the last row to the first: of an edit and what follows it, the
cheapest wins, and of equally cheap ones the least audit. Only in this direction are least audits made of least audits,
since of two prefixes the one that is less need not stay so where it is the beginning of the other. An audit is a
linked list of edits that shares what follows with the other states' audits (``Audits``). Each node has the nodes 1, 2,
4, ... edits further on and the rolling hash of the edits up to there, so the longest common prefix of two audits is
found in steps of powers of two. Equal hashes are verified: two stretches are equal where they are the same nodes, or
both halves are, down to single edits; what was verified is remembered.

What the program reads of a row is its role, a digest and three flags, no text. Rows are sorted and streamed, so a task
holds one conversation's linked edits, not its texts. A second stream, of the texts with the audit in front, digests the repaired conversation. A
conversation that holds a third of all rows is one task in both streams: its result is one digest of its whole text in
order, which cannot be split; sorting spills, texts pass by one at a time.

Null ids are one conversation. Null roles and texts count as one space. Rows are in order of turn, nulls first, then of
role and of digest; equal rows are adjacent. Repeated rows are damaged alike. Long texts are read whole. A conversation
without rows after damage has zeros, an empty audit and the digest of the empty text. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3  # added where a truncated row stays
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", "sound"
_VISIBLE = r"[^\x20\x09-\x0D]"
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003

START, SYSTEM, USER, ASSISTANT = range(4)  # what the initials so far end with
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ROLES = {"u": "user", "a": "assistant"}


class Audits:
    """Nodes of linked edits; node 0 is the empty audit. A node is an edit and the node of what follows it."""

    def __init__(self) -> None:
        self.edit = [""]
        self.ahead: list[list[int]] = [[]]  # the nodes 1, 2, 4, ... edits on
        self.hash: list[list[int]] = [[]]  # of the next 1, 2, 4, ... edits
        self.power = [_BASE]
        self.verified: set[tuple[int, int, int]] = set()

    def add(self, edit: str, after: int) -> int:
        ahead, hashes = [after], [ord(edit)]
        level = 0
        while level < len(self.ahead[ahead[level]]):
            middle = ahead[level]
            if len(self.power) <= level:
                self.power.append(self.power[-1] ** 2 % _MODULUS)
            hashes.append((hashes[level] * self.power[level] + self.hash[middle][level]) % _MODULUS)
            ahead.append(self.ahead[middle][level])
            level += 1
        self.edit.append(edit)
        self.ahead.append(ahead)
        self.hash.append(hashes)
        return len(self.edit) - 1

    def equal(self, a: int, b: int, level: int) -> bool:
        """Whether the next 2 ** level edits from a and b are the same: by hash, and verified where the hashes agree."""
        if a == b:
            return True
        if self.hash[a][level] != self.hash[b][level]:
            return False
        if level == 0:
            return self.edit[a] == self.edit[b]
        if (a, b, level) not in self.verified:
            halves = self.equal(a, b, level - 1) and self.equal(self.ahead[a][level - 1], self.ahead[b][level - 1], level - 1)
            if not halves:
                return False
            self.verified.add((a, b, level))
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before audit b: after their longest common prefix, by the next edit or the end."""
        for level in range(min(len(self.ahead[a]), len(self.ahead[b])) - 1, -1, -1):
            # after a step of this length the rest may have fewer levels
            while a != b and level < len(self.ahead[a]) and level < len(self.ahead[b]) and self.equal(a, b, level):
                a, b = self.ahead[a][level], self.ahead[b][level]
        return a != b and self.edit[a] < self.edit[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.ahead[node][0]
        return "".join(out)


def cheapest_audit(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of the cheapest, then least, edits of (role initial, fault) rows in order."""
    audits = Audits()

    def best(options: list[tuple[int, str, int]]) -> tuple[int, str, int]:
        """The cheapest of (cost, edit, what follows), then the least: the edit decides before what follows it."""
        found = options[0]
        for option in options[1:]:
            if option[:2] < found[:2] or (option[:2] == found[:2] and audits.less(option[2], found[2])):
                found = option
        return found

    def with_inserts(done: list[tuple[int, str, int] | None]) -> list[tuple[int, int]]:
        """Cost and node of each state, once rows may also be inserted before what ``done`` does."""
        at: list[tuple[int, int] | None] = [None] * 4
        open_states = {q: [option] for q, option in enumerate(done) if option}
        # an insert costs more than what it leads to, so states are settled in order of cost; of equal cost, none depends on another
        while len([q for q in at if q]) < 4:
            cost = min(min(o[0] for o in options) for q, options in open_states.items() if not at[q])
            settled = [q for q in open_states if not at[q] and min(o[0] for o in open_states[q]) == cost]
            for q in settled:
                chosen = best(open_states[q])
                at[q] = (chosen[0], audits.add(chosen[1], chosen[2]) if chosen[1] else chosen[2])
            for q in range(4):
                for initial, to in NEXT[q].items():
                    if initial in ROLES and to in settled:
                        open_states.setdefault(q, []).append((at[to][0] + INSERT, "I", at[to][1]))
        return at

    at = with_inserts([(0, "", 0), None, None, (0, "", 0)])
    for initial, fault in reversed(rows):
        done: list[tuple[int, str, int] | None] = []
        for q in range(4):
            options = [(at[q][0] + DELETE, "D", at[q][1])]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                if initial in NEXT[q]:
                    to = NEXT[q][initial]
                    options.append((at[to][0] + KEEP + extra, "K", at[to][1]))
                options += [(at[to][0] + REROLE + extra, "R", at[to][1]) for role, to in NEXT[q].items() if role in ROLES]
            done.append(best(options))
        at = with_inserts(done)
    cost, node = at[START]
    return cost, audits.text(node)


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of what an audit makes of (role, text) rows."""
    state = START
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = next(rows) if edit in "KR" else ("", "")
        if edit != "K":
            role = next(ROLES[initial] for initial in NEXT[state] if initial in ROLES)
        state = NEXT[state][role[0]]
        yield f"{role}:{text}"


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone of ``rows`` after damage; dropped rows stay, marked as gone."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(fate == 4, F.lit("user")).otherwise(part("role"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (fate == 0).alias("gone"))


def _sign() -> Column:
    """A digest of a row's role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _flags(rows: DataFrame) -> DataFrame:
    """What the program reads of each row, in order; computed before the rows are moved, so no text is."""
    blank = ~F.col("text").rlike(_VISIBLE)
    ended = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")
    fault = F.when(blank, F.lit(BLANK)).when(~ended, F.lit(CUT)).otherwise(F.lit(SOUND))
    small = rows.select("conv_id", "turn", "role", _sign().alias("sign"), "copy", "gone", fault.alias("fault")).repartition("conv_id")
    order = [F.asc_nulls_first("turn"), F.asc("copy")]
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "sign").orderBy(*order)) > 1
    fault = F.when((F.col("fault") != BLANK) & earlier, F.lit(DUPLICATE)).otherwise(F.col("fault"))
    small = small.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    return small.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sign", "copy", F.col("fault") == DUPLICATE).select("conv_id", "turn", "gone", "initial", "fault")


def audits_of(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``damaged`` rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, turns, seen = object(), [], [0, None, None], []

        def close() -> None:
            faults = [fault for _, fault in found]
            pairs = [a[0] + b[0] for a, b in zip(found, found[1:], strict=False)]
            cost, audit = cheapest_audit(found)
            distinct, low, high = turns
            gaps = high - low + 1 - distinct if distinct else 0
            seen.append((at, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit))

        def flushed() -> pa.RecordBatch:
            kinds = [of, *[pa.int64()] * 6, pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*seen, strict=True), kinds, strict=True)], names)
            seen.clear()
            return out

        of, begun = None, False
        for batch in batches:
            of = batch.schema.field("conv_id").type
            for conv, turn, gone, initial, fault in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if not begun or conv != at:
                    if begun:
                        close()
                    at, found, turns, begun = conv, [], [0, None, None], True
                if not gone:
                    found.append((initial, fault))
                    if turn is not None and turn != turns[2]:
                        turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
            if len(seen) >= 1000:
                yield flushed()
        if begun:
            close()
            yield flushed()

    return _flags(rows).mapInArrow(run, schema)


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: texts stream behind their conversation's audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("sign"), F.lit(-1).alias("copy"))
    kept = rows.filter("not gone").select("conv_id", "turn", "role", "text", _sign().alias("sign"), "copy")
    both = first.unionByName(kept).repartition("conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), (F.col("copy") >= 0).asc(), F.asc_nulls_first("turn"), "role", "sign", "copy").select("conv_id", "copy", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for batch in batches:
                kinds.append(batch.schema.field("conv_id").type)
                yield from zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)

        kinds: list[pa.DataType] = []
        stream = cells()
        head = next(stream, None)
        done: list[tuple] = []
        while head:
            conv, _, _, audit = head
            head = None

            def own() -> Iterator[tuple[str, str]]:
                nonlocal head
                for cell in stream:
                    if cell[1] < 0:  # the next conversation's audit
                        head = cell
                        return
                    yield cell[2], cell[3]

            digest, rest = hashlib.sha256(), own()
            for number, line in enumerate(repaired_lines(audit, rest)):
                digest.update((("\n" if number else "") + line).encode())
            if next(rest, None) is not None:
                raise ValueError(f"conversation {conv} has more rows than its audit")
            done.append((conv, digest.hexdigest()))
            if len(done) >= 1000 or not head:
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[-1]), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])
                done = []

    return both.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations`` (conv_id, turn, role, text) and repair them; a row for each conversation.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, as the module describes.
    """
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    audits = written(audits_of(rows), "llm-audits")
    digests = _digests(rows, audits)
    same = audits["conv_id"].eqNullSafe(digests["conv_id"])
    return audits.join(digests, same).select(audits["*"], "repaired_sha256")
