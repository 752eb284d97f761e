"""Repair of conversations against a search over all edit sequences and a plain reading of the rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from actlake.llm import repair
from actlake.llm.common import read
from actlake.llm.queries import REGISTRY

SPACES = " \t\n\x0b\x0c\r"
PATTERN = re.compile("(s?(ua)+)?")


def brute_repair(rows):
    """(cost, audit, lines) of the best of all edit sequences of (role, text, fault) rows, by plain search."""
    found = []

    def search(at, inserted, cost, audit, lines, initials):
        if at == len(rows) and PATTERN.fullmatch(initials):
            found.append((cost, audit, lines))
        if inserted < 2:
            for role in ("user", "assistant"):
                search(at, inserted + 1, cost + 3, audit + "I", [*lines, f"{role}:"], initials + role[0])
        if at < len(rows) and (not initials or re.fullmatch("s?(ua)*u?", initials)):
            role, text, fault = rows[at]
            search(at + 1, 0, cost + 4, audit + "D", lines, initials)
            if fault in ("sound", "truncated"):
                more = 3 * (fault == "truncated")
                search(at + 1, 0, cost + more, audit + "K", [*lines, f"{role}:{text}"], initials + (role[:1] or "-"))
                for new in ("user", "assistant"):
                    search(at + 1, 0, cost + 3 + more, audit + "R", [*lines, f"{new}:{text}"], initials + new[0])

    search(0, 0, 0, "", [], "")
    return min(found)


def plain(conversation):
    """All but cost, audit and digest of one conversation's (turn, role, text) rows after damage, and the rows' faults."""
    faults, seen = [], set()
    for _, role, text in conversation:
        stripped = text.strip(SPACES)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "sound" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in conversation if t is not None}
    initials = [role[:1] for _, role, _ in conversation]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "illegal": illegal, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}}, faults


def damage(table):
    out = defaultdict(list)
    for conv, turn, role, text in table:
        rows = out[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (turn, "user" if fate == 4 else role, text)
        rows += [row, row] if fate == 3 else [row]
    return {conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())) for conv, rows in out.items()}


def expected(table, audits=True):
    out = {}
    for conv, rows in damage(table).items():
        counts, faults = plain(rows)
        if audits:
            cost, audit, lines = brute_repair([(role, text, fault) for (_, role, text), fault in zip(rows, faults, strict=True)])
            counts |= {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        out[conv] = counts
    return out


def check(got, want):
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == len(want)
    for row in rows:
        conv = row.pop("conv_id")
        assert {k: row[k] for k in want[conv]} == want[conv], conv


def test_query_against_the_rules(spark):
    table = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    check(REGISTRY["op11_repair"].run(spark, "/root/testdata/sf0.001"), expected(table, audits=False))


def random_conversations(count, turns, seed=3):
    chance = random.Random(seed)
    texts = ["One thing.", "One thing", "No?", " ", "", "Yes! ", "more", "end.\n\t"]
    return [(conv, chance.choice([turn, turn, turn + 1]), chance.choice(["user", "assistant", "system", "user", "assistant", "tool"]), chance.choice(texts)) for conv in range(count) for turn in range(chance.randrange(1, turns))]


def test_against_all_edit_sequences(spark):
    table = random_conversations(250, 6)
    check(repair.repair_conversations(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(7)), expected(table))


def test_edges(spark):
    table = [
        (None, None, "user", "no id."),
        (None, None, None, "neither role."),
        (1, None, "user", None),
        (1, 2, None, "no role."),
        (2, 5, "", "empty role."),
        (2, 5, "", "empty role."),
        (3, 10**15, "assistant", "late."),
        (3, -(10**15), "user", "Ünï 😀?"),
        (4, 0, "system", "only system."),
        (5, 0, "user", "very long " * 40_000 + "."),
        (5, 1, "assistant", " "),
    ]
    table += [(i, 1, "user", "all dropped.") for i in range(100, 140) if zlib.crc32(f"{i}:1".encode()) % 20 == 0]
    assert len(table) > 11
    docs = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, copy string, gone int")
    want = expected(table)
    for i in (r[0] for r in table):
        want.setdefault(i, {"gaps": 0, "cost": 0, "audit": "", "illegal": 0, "repaired_sha256": hashlib.sha256(b"").hexdigest()})
    got = repair.repair_conversations(docs)
    check(got, want)
    assert got.dtypes == [("conv_id", "bigint"), *((n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
    assert repair.repair_conversations(docs.limit(0)).count() == 0
    named = spark.createDataFrame([(f"c{a}", b, c, d) for a, b, c, d in random_conversations(20, 4)], "conv_id string, turn int, role string, text string")
    assert repair.repair_conversations(named).count() == 20


def plain_audit(rows):
    """The program over whole strings in place of linked edits."""
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(at):
        for _ in range(3):
            for q in nexts:
                for i, to in nexts[q].items():
                    if i in "ua" and to in at:
                        at[q] = min(at.get(q, (10**9, "")), (at[to][0] + 3, "I" + at[to][1]))
        return at

    at = inserted({"": (0, ""), "a": (0, "")})
    for initial, fault in reversed(rows):
        new = {}
        for q in nexts:
            options = [(at[q][0] + 4, "D" + at[q][1])]
            if fault in ("sound", "truncated"):
                more = 3 * (fault == "truncated")
                options += [(at[to][0] + more, "K" + at[to][1]) for i, to in nexts[q].items() if i == initial]
                options += [(at[to][0] + 3 + more, "R" + at[to][1]) for i, to in nexts[q].items() if i in "ua"]
            new[q] = min(options)
        at = inserted(new)
    return at[""]


@pytest.mark.parametrize("length", [0, 1, 5, 60, 700])
def test_linked_audits_equal_plain_strings(length):
    chance = random.Random(length)
    for case in range(60 if length < 100 else 6):
        rows = [(chance.choice("uaus" if case % 2 else "us"), chance.choice(["sound", "sound", "truncated", "blank", "duplicate"])) for _ in range(length)]
        assert repair.cheapest_audit(rows) == plain_audit(rows)


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that says nothing, least audits stay the same."""
    monkeypatch.setattr(repair, "_MODULUS", 1)
    chance = random.Random(9)
    for _ in range(40):
        rows = [(chance.choice("uas"), chance.choice(["sound", "truncated", "blank"])) for _ in range(40)]
        assert repair.cheapest_audit(rows) == plain_audit(rows)


def test_long_conversation_in_one_task(spark):
    """One conversation with a third of all rows; its audit is that of the plain program."""
    table = [(i if i % 3 else 0, i, "user" if i % 2 else "assistant", f"text {i}.") for i in range(12_000)]
    got = repair.repair_conversations(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(16))
    row = got.filter("conv_id = 0").head()
    rows = damage(table)[0]
    _, faults = plain(rows)
    assert (row["cost"], row["audit"]) == plain_audit([(role[0], fault) for (_, role, _), fault in zip(rows, faults, strict=True)])
    assert Counter(row["audit"])["K"] > 1000
