"""Open headings over pages against a fold of each file."""

import random

from corpusloom.sources import paged


def test_summaries_compose():
    rnd = random.Random(2)
    for _ in range(500):
        pushes = [(f"t{k}", rnd.randint(1, 6)) for k in range(rnd.randint(0, 12))]
        cut = rnd.randint(0, len(pushes))
        first, second = paged.Opened(), paged.Opened()
        for k, p in enumerate(pushes):
            (first if k < cut else second).push(*p)
        both = first.then(second)
        for n in range(paged.LEVELS + 1):
            stack = [f"s{k}" for k in range(n)]
            want = stack
            for title, depth in pushes:
                want = want[: depth - 1] + [title]
            assert both.after(stack) == second.after(first.after(stack)) == want


def test_files_of_any_size_equal_the_fold(spark):
    rnd = random.Random(3)
    lines = ["1. Scope", "1.2 Rates", "2.1.1 Deep", "3.1.2.4.5.6 Deepest", "GENERAL RULES", "plain text, no heading.", "4.1 Other", ""]
    depth = {"1. Scope": 1, "1.2 Rates": 2, "2.1.1 Deep": 3, "3.1.2.4.5.6 Deepest": 6, "GENERAL RULES": 1, "4.1 Other": 2}
    files = {"big": 3000, "a": 1, "b": 40, "c": 200, None: 30}
    rows, want = [], {}
    for f, n in files.items():
        stack = []
        for p in range(n):
            text = "\n".join(rnd.choices(lines, k=rnd.choice([0, 0, 1, 2])))
            for line in text.split("\n"):
                if line in depth:
                    stack = stack[: depth[line] - 1] + [line]
            rows.append((f, p, text if text else None, f"row{p}"))
            want[f, p] = stack
    rnd.shuffle(rows)
    out = paged.heading_paths(spark.createDataFrame(rows, "source_id string, page int, text string, path string")).collect()
    assert len(out) == len(rows) and {(r.source_id, r.page): r.title_path for r in out} == want
    assert paged.heading_paths(spark.createDataFrame([], "source_id string, page int, text string")).collect() == []
