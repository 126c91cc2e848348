"""Line differences against the table of all lengths, and chains of versions with forks, gaps and cycles."""

import random
import tracemalloc

from notelake.operators import versions


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_scripts_are_shortest():
    r = random.Random(2)
    for _ in range(400):
        a, b = ([r.choice("abcde"[: r.randrange(1, 6)]) + "x" * (r.random() < 0.1) for _ in range(r.randrange(30))] for _ in range(2))
        script = versions.line_diff(a, b)
        assert [x for t, x in script if t != "+"] == a and [x for t, x in script if t != "-"] == b
        assert sum(t == " " for t, _ in script) == longest(a, b) == int(versions.common_before(a, b)[-1])


def test_many_different_lines_take_little_memory():
    old, new = [f"old {i}" for i in range(20_000)], [f"new {i}" for i in range(20_000)]
    mixed = [f"line {i * 7919 % 20_000}" for i in range(20_000)]
    tracemalloc.start()
    assert len(versions.line_diff(old, new)) == 40_000
    assert sum(t == " " for t, _ in versions.line_diff(mixed[:4000], sorted(mixed[:4000]))) >= 2
    assert int(versions.common_before(mixed, sorted(mixed))[-1]) > 100
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_differences_of_versions(spark):
    r = random.Random(3)
    rows = [(i, s, "\n".join(r.choice(["a", "b", "c", "", "dd"]) for _ in range(r.randrange(12)))) for i in range(12) for s in range(4)]
    rows += [(20, 0, None), (20, 1, ""), (20, 2, "one\ntwo"), (20, 3, "one\ntwo"), (21, 5, "alone")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "note_id long, seq long, text string, line string, place int")
    text = {(i, s): t or "" for i, s, t in rows}
    want = {}
    for (i, s), t in text.items():
        if (i, s - 1) in text:
            a, b = text[i, s - 1].split("\n"), t.split("\n")
            n = longest(a, b)
            want[i, s] = (len(b) - n, len(a) - n)
    assert {(x.note_id, x.seq): (x.added, x.deleted) for x in versions.diffs(df).collect()} == want
    script = {}
    for x in versions.diff_lines(df).orderBy("place").collect():
        script.setdefault((x.note_id, x.seq), []).append((x.tag, x.line))
    for (i, s), (added, deleted) in want.items():
        tags = [t for t, _ in script[i, s]]
        assert (tags.count("+"), tags.count("-")) == (added, deleted)
        assert [x for t, x in script[i, s] if t != "-"] == text[i, s].split("\n")
    assert versions.diffs(df.limit(0)).count() == 0 and versions.diff_lines(df.limit(0)).count() == 0


def test_chains_follow_their_pointers(spark):
    linear = [(1, s, s - 1 if s else None) for s in range(21)]
    fork = [(2, 0, None), (2, 1, 0), (2, 2, 0), (2, 3, 1), (2, 4, 2), (2, 5, 3)]  # 2 and 4 are another branch
    gap = [(3, 4, 3), (3, 5, 4), (3, 1, 0), (3, 0, None)]  # 3 is missing
    cycle = [(4, 1, 3), (4, 2, 1), (4, 3, 2), (4, 0, None)]
    own = [(5, 0, 0), (6, 2, None), (6, 1, None)]
    rows = linear + fork + gap + cycle + own
    df = spark.createDataFrame([(i, s, p, f"{i}/{s}", 0) for i, s, p in rows], "note_id long, seq long, prev long, content_hash string, depth int")
    want = {}
    back = {(i, s): p for i, s, p in rows}
    for i in {i for i, _, _ in rows}:
        at, depth = max(s for j, s, _ in rows if j == i), 0
        while at is not None and (i, at) in back and (i, at) not in want:
            want[i, at] = depth
            at, depth = back[i, at], depth + 1
    assert {(r.note_id, r.seq): r["depth"] for r in versions.history(df).collect()} == want
    assert [r.seq for r in versions.history(df, 2).orderBy("depth").collect()] == [5, 3, 1, 0]
    assert [r.seq for r in versions.history(df, 1).orderBy("depth").collect()] == list(range(20, -1, -1))  # a linear one, by its order
    assert versions.history(df.limit(0)).count() == 0
