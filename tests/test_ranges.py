"""Cells in rectangles against brute force, and that only true pairs are formed."""

import random

from corpusloom.operators import ranges


def test_dyadic_pieces_cover_once(spark):
    rnd = random.Random(4)
    spans = [(a, b) for a, b in ((rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(300))] + [(0, 1048575), (5, 5), (1048575, 1048575), (7, 6), (3, 4000000)]
    rows = spark.createDataFrame(spans, "a int, b int")
    for a, b, pieces in rows.select("a", "b", ranges.dyadic(rows.a, rows.b, ranges.ROW_LEVELS).alias("p")).collect():
        spread = sorted((p.node << p.level, (p.node + 1) << p.level) for p in pieces)
        covered = spread[:1] and [spread[0][0], spread[-1][1]]
        assert all(x[1] == y[0] for x, y in zip(spread, spread[1:]))
        assert covered == ([a, b + 1] if a <= b else []) and (b > 2 << 20 or len(pieces) <= 2 * ranges.ROW_LEVELS)


def test_cells_in_ranges_equal_brute_force(spark):
    rnd = random.Random(9)
    cells = [(rnd.choice(["a", "b", None]), rnd.randint(0, 70), rnd.randint(0, 30), k) for k in range(900)]
    boxes = [(rnd.choice(["a", "b", None]), f"n{k}", r, c, r + rnd.choice([0, 0, 3, 60, -1]), c + rnd.choice([0, 1, 25])) for k in range(120) for r, c in [(rnd.randint(0, 60), rnd.randint(0, 20))]]
    got = ranges.cells_in_ranges(spark.createDataFrame(cells, "sheet string, row int, col int, id int"),
                                 spark.createDataFrame(boxes, "sheet string, name string, row1 int, col1 int, row2 int, col2 int"), ["sheet"])
    want = sorted((i, n) for s, r, c, i in cells for t, n, r1, c1, r2, c2 in boxes if s == t and s is not None and r1 <= r <= r2 and c1 <= c <= c2)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == want


def test_many_ranges_do_not_multiply_cells(spark):
    """20,000 ranges of one cell's height over the same rows: the join makes the true pairs and no others."""
    cells = spark.range(100_000).selectExpr("'s' AS sheet", "cast(id % 1000 AS int) AS row", "cast(id div 1000 AS int) AS col")
    boxes = spark.range(20_000).selectExpr("'s' AS sheet", "id AS name", "0 AS row1", "999 AS row2", "cast(200 + id AS int) AS col1", "cast(200 + id AS int) AS col2")
    few = boxes.unionByName(spark.createDataFrame([("s", -1, 10, 12, 5, 6)], "sheet string, name long, row1 int, row2 int, col1 int, col2 int"))
    assert ranges.cells_in_ranges(cells, few, ["sheet"]).count() == 6
