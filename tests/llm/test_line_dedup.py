import random
from collections import defaultdict

from llm_support import ODD, prose, table

from cohortlab.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """Brute force: documents are distinct (id, text) pairs."""
    holders = defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            holders[line.strip(SPACES).translate(LOWER)].add((row[0], row[1] or ""))
    common = {k: max((d for d, _ in h if d is not None), default=None) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if common.get(k := x.strip(SPACES).translate(LOWER), doc_id) == doc_id or k not in common]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_equals_brute_force(spark, partitions):
    draw = random.Random(3)
    pool = [prose(i, 6) + " and so on, at length" for i in range(30)]
    dress = [str, str.upper, lambda x: f" \t{x}\r", lambda x: x + "\x0b\x0c", lambda x: " " + x, lambda x: "É" + x]
    rows = [(i, "\n".join(draw.choice(dress)(draw.choice(pool)) if draw.random() < 0.7 else draw.choice(["", "short", " "]) for _ in range(draw.randint(0, 12)))) for i in range(200)]
    rows += [(500 + i, "the one line that everybody holds\n" * draw.randint(1, 4)) for i in range(150)] + ODD
    assert result(line_dedup.dedup_lines(table(spark, rows).repartition(partitions))) == plain(rows)


def test_null_and_repeated_ids_and_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (None, f"{line}\nx"), (None, line), (4, line), (4, f"y\n{line}"), (4, f"y\n{line}"), (2, line)]
    assert result(line_dedup.dedup_lines(table(spark, rows))) == plain(rows)
    nulls = [(None, f"{line}\n{i}") for i in range(4)]
    assert result(line_dedup.dedup_lines(table(spark, nulls))) == plain(nulls)
    two = [(1, line), (1, line), (2, line)]
    assert result(line_dedup.dedup_lines(table(spark, two))) == plain(two)


def test_twenty_code_points_and_three_documents(spark):
    long, short = "é" * 19 + "\U0001f600", "é" * 19
    rows = [(i, f"{long}\n{short}\nonly in the first two of them") for i in range(2)] + [(9, f"{short}\n  {long} "), (10, "")]
    got = result(line_dedup.dedup_lines(table(spark, rows)))
    assert got == plain(rows) and [r[2] for r in sorted(got)] == [1, 1, 0, 0]


def test_bitmaps_are_runs_and_long_text_stays_whole(spark):
    line = "this line stands in every document"
    long = "\n".join(line if i % 1000 < 3 else f"line number {i} of the very long text" for i in range(20_000))
    rows = [(1, long), (2, line), (3, f"{line}\n{line}")]
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(table(spark, rows)).collect()}
    assert set(maps) == {1, 2} and maps[1].n_dropped == 60 and maps[1].keep_runs == [0, 3] + [997, 3] * 19 and maps[2].keep_runs == [0, 1]
    assert result(line_dedup.dedup_lines(table(spark, rows))) == plain(rows)


def test_hot_keys_are_bounded_and_sweep_needs_no_second_exchange(spark):
    rows = [(i, "the line that a third of all rows hold\n" + prose(i, 9) + f" {i} is its own") for i in range(300)]
    lines = line_dedup.hashed_lines(table(spark, rows))
    assert line_dedup.hot_keys(lines, 64, lines.count()).count() == 1
    assert line_dedup.hot_keys(lines, 64, 64).count() < 4 * 64
    hot = line_dedup.hot_keys(lines, 64, lines.count())
    plan = line_dedup._swept_drops(lines, hot, 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning(h1" not in plan.split("rangepartitioning(h1")[0]


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    line = "some common line with enough characters"
    rows = [(i, line) for i in range(3)]
    odd = table(spark, rows).selectExpr("*", "1 as pos", "2 as h1", "3 as text_key", "4 as `keep_runs.x`", "5 as flags", "null as mark_id")
    assert result(line_dedup.dedup_lines(odd)) == plain(rows)
