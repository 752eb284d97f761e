import random

from actlake.operators.ordered import number_gaps, order_violations, with_neighbour, with_position


def sample(seed, n=400):
    rng = random.Random(seed)
    rows = {(rng.randint(1, 3), rng.randint(1, 300)): rng.randint(1, 50) for _ in range(n)}
    # group 1 holds most rows
    rows |= {(1, o): rng.randint(1, 50) for o in range(0, 900, 3)}
    return [(g, o, v) for (g, o), v in rows.items()]


def groups(rows):
    out = {}
    for g, o, v in rows:
        out.setdefault(g, []).append((o, v))
    return {g: sorted(x) for g, x in out.items()}


def test_chunks_agree_with_plain_order(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, "g int, o int, v int")
    for chunk in (1, 7, 50, 10_000):
        got = {(r.g, r.o): r.p for r in with_neighbour(df, group="g", order="o", value="v", name="p", chunk=chunk).collect()}
        ahead = {(r.g, r.o): r.p for r in with_neighbour(df, group="g", order="o", value="v", name="p", ahead=True, chunk=chunk).collect()}
        ranks = {(r.g, r.o): r.position for r in with_position(df, group="g", order="o", chunk=chunk).collect()}
        for g, seq in groups(rows).items():
            for i, (o, _) in enumerate(seq):
                assert got[g, o] == (seq[i - 1][1] if i else None)
                assert ahead[g, o] == (seq[i + 1][1] if i + 1 < len(seq) else None)
                assert ranks[g, o] == i + 1


def test_gaps_and_violations(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, "g int, o int, v int")
    for chunk in (1, 13, 10_000):
        gaps = {tuple(r) for r in number_gaps(df, group="g", number="o", chunk=chunk).collect()}
        breaks = {(r.g, r.o, r.previous) for r in order_violations(df, group="g", order="o", number="v", chunk=chunk).collect()}
        want_gaps, want_breaks = set(), set()
        for g, seq in groups(rows).items():
            for (a, va), (b, vb) in zip(seq, seq[1:]):
                if b - a > 1:
                    want_gaps.add((g, a + 1, b - 1, b - a - 1))
                if va > vb:
                    want_breaks.add((g, b, va))
        assert gaps == want_gaps and breaks == want_breaks


def test_positions_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 70), (None, 3), (None, None)], "g string, o long")
    got = sorted(((r.g, r.o, r.position) for r in with_position(df, group="g", order="o", chunk=10).collect()), key=str)
    assert got == sorted([("a", None, 1), ("a", 5, 2), ("a", 70, 3), (None, None, 1), (None, 3, 2)], key=str)
