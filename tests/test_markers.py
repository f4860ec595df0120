"""Markers among rows, by one sort."""

from __future__ import annotations

import random

from revdiff.operators import rows as row_ops

ROWS = "pair_id bigint, row_no int, left struct<page:int>, right struct<page:int>"
MARKERS = "pair_id bigint, page int, last int, unreadable boolean"


def plain(rows, markers):
    """Each pair's list of ("row", number) and ("mark", page, unreadable)."""
    out = {}
    for pair in {r[0] for r in rows} | {m[0] for m in markers}:
        own = sorted((r for r in rows if r[0] == pair), key=lambda r: r[1])
        left = sorted((m for m in markers if m[0] == pair), key=lambda m: (m[1], m[3]))
        made = []
        for _, no, a, b in own:
            page = a[0] if a is not None and a[0] is not None else b[0] if b is not None else None
            while left and page is not None and page > left[0][1]:
                made.append(("mark", left[0][1], left[0][3]))
                left.pop(0)
            made.append(("row", no))
        out[pair] = made + [("mark", m[1], m[3]) for m in left]
    return out


def test_markers_stand_before_the_first_later_page(spark):
    r = random.Random(3)
    rows, markers = [], []
    for pair in range(60):
        page = 1
        for no in range(r.randint(0, 25)):
            page = max(1, page + r.choice([0, 0, 1, 1, 3, -2]))
            side = r.choice(["both", "left", "right", "none", "left without"])
            rows.append((pair, no, None if side == "right" else (None if side in ("none", "left without") else page,), None if side == "left" else (None if side == "none" else page + 1,)))
        for p in sorted(r.sample(range(0, 30), r.randint(0, 6))):
            markers.append((pair, p, p + r.randint(0, 2), False))
            if r.random() < 0.3:
                markers.append((pair, p, p, True))
    made = row_ops.rows_with_markers(spark.createDataFrame(rows, ROWS), spark.createDataFrame(markers, MARKERS))
    got = {}
    for x in made.orderBy("pair_id", "place").collect():
        got.setdefault(x.pair_id, []).append(("row", x.row_no) if x.row_no is not None else ("mark", x.page, x.unreadable))
    assert got == {k: v for k, v in plain(rows, markers).items() if v}


def test_no_rows_meet_markers_in_a_join(spark):
    made = row_ops.rows_with_markers(spark.createDataFrame([], ROWS), spark.createDataFrame([(1, 2, 3, False)], MARKERS))
    assert [(x.place, x.page) for x in made.collect()] == [(0, 2)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
