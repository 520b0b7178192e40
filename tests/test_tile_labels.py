from __future__ import annotations

import random

import pytest

from gridloom.operators import zones


def flooded(cells, columns):
    """Cell -> least number of its 8-connected set, by flooding."""
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        found = list(todo)
        while todo:
            r, c = todo.pop()
            for x in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if x in left:
                    left.remove(x)
                    todo.append(x)
                    found.append(x)
        out |= dict.fromkeys(found, min(r * columns + c for r, c in found))
    return out


@pytest.mark.parametrize(("tile", "share"), [(256, 0.4), (4, 0.35), (4, 0.6), (1, 0.3)])
def test_components_of_tiles_equal_flooding(spark, monkeypatch, tile, share):
    monkeypatch.setattr(zones, "LABEL_TILE", tile)
    rng = random.Random(tile + int(share * 100))
    cells = [(r, c) for r in range(-7, 23) for c in range(-3, 31) if rng.random() < share]
    rows = spark.createDataFrame([*cells, *cells[:5]], "r int, c int")
    found = {(x.r, x.c): x.component for x in zones.cell_components(rows, 100).collect()}
    assert found == flooded(cells, 100)


def test_no_cells(spark):
    assert zones.cell_components(spark.createDataFrame([], "r long, c long"), 10).collect() == []
