import numpy as np
from pyspark.sql import functions as F

from inkfold.operators import pixels

X_RULES, Y_RULES, WIDTH, HEIGHT = [60, 140, 260, 380, 470, 560, 650, 740], [80, 140, 200, 260, 320, 380], 800, 460


def table():
    page = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    for x in X_RULES:
        page[Y_RULES[0] : Y_RULES[-1] + 1, x - 1 : x + 2] = 0
    for y in Y_RULES:
        page[y - 1 : y + 2, X_RULES[0] : X_RULES[-1] + 1] = 0
    page[30:42, 100:400:9] = 0  # a title of strokes
    page[30:42, 101:400:9] = 0
    return page


def near(got, want, by=2.0):
    return len(got) == len(want) and max(abs(a - b) for a, b in zip(got, want)) <= by


def test_rules_of_a_table():
    _, grid = pixels.grid_of(table())
    assert grid["error"] is None and near(grid["x_rules"], X_RULES) and near(grid["y_rules"], Y_RULES) and grid["skew"] == 0.0
    assert pixels.grid_of(np.full((200, 300, 3), 255, np.uint8))[1]["error"].startswith("no table grid: 0 columns")


def test_tilted_and_turned_pages_come_upright():
    for tilt in (1.0, -1.5):
        straight, grid = pixels.grid_of(pixels.turned(table(), -tilt))
        assert abs(grid["skew"] - tilt) < 0.15 and near(grid["x_rules"], X_RULES, 6.0) and straight.shape == (HEIGHT, WIDTH, 3)
    for quarter in (0, 1, 2, 3):
        page, rotation = pixels.oriented(np.rot90(table(), quarter))
        assert rotation == 90 * quarter % 360 and (page == table()).all()


def test_ink_is_darker_than_its_surroundings():
    page = np.tile(np.linspace(60, 255, 200).astype(np.uint8), (100, 1))
    page[50, 20:180] = np.maximum(page[50, 20:180].astype(int) - 50, 0)
    mask = pixels.ink(page)
    assert mask[50, 25:175].all() and not mask[:30].any()
    row = np.zeros((1, 40), bool)
    row[0, 3:9] = row[0, 20:23] = True
    assert np.flatnonzero(pixels.long_runs(row, 5, grown=False)[0]).tolist() == [3, 4, 5, 6, 7, 8]
    assert np.flatnonzero(pixels.long_runs(row, 5)[0]).tolist() == list(range(1, 11))
    assert (pixels.long_runs(row.T, 5, across=False, grown=False).T == pixels.long_runs(row, 5, grown=False)).all()


def test_pen_and_rules_are_no_print():
    page = table()
    page[150:170, 70:130] = (255, 60, 60)
    page[210:222, 160:170] = 0
    mask, clean = pixels.printed(page)
    assert not mask[150:170, 70:130].any() and mask[212:220, 160:170].any() and not mask[Y_RULES[2], 300:330].any()
    assert (clean[150:170, 70:130] == 255).all() and (clean[Y_RULES[2], 300:330] == 255).all()


def test_lines_words_and_leaders():
    mask = np.zeros((60, 120), bool)
    mask[10:22, 5:30] = mask[10:22, 40:60] = mask[10:22, 62:70] = True
    mask[6:8, 10:16] = True  # a mark above the line
    mask[40:52, 5:50] = True
    mask[57, 100] = True  # a speck
    assert pixels.line_bands(mask) == [(6, 22), (40, 52)]
    assert pixels.word_spans(mask[10:22]) == [(5, 30), (40, 70)]
    dots = np.zeros((30, 120), bool)
    for x in range(10, 60, 10):
        dots[20:22, x : x + 2] = True
    dots[20:22, 90:92] = True  # a single stop
    dots[5:20, 70:80] = True
    left = pixels.without_leaders(dots)
    assert not left[:, :60].any() and left[20:22, 90:92].all() and left[5:20, 70:80].all()
    owner, _ = pixels.pieces(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert len(set(owner.tolist())) == 2


def test_cells_are_read_word_by_word():
    page = table()
    page[160:172, 70:84] = page[160:172, 90:104] = page[280:292, 400:420] = 0
    seen = []

    def read(crops):
        seen.extend(c.shape[0] for c in crops)
        return [(f"w{n}", 0.9 - n / 10) for n in range(len(crops))]

    boxes = pixels.read_cells(page, X_RULES, Y_RULES, read)
    assert [(b["ord"], b["text"], round(b["confidence"], 1)) for b in boxes] == [(0, "w0 w1", 0.8), (1, "w2", 0.7)]
    assert near([boxes[0][c] for c in ("x0", "y0", "x1", "y1")], [70, 160, 104, 172]) and set(seen) == {pixels.READ_HEIGHT}


def test_grids_of_a_table_of_pictures(spark):
    page = table()
    rows = [(1, 1, HEIGHT, WIDTH, 3, bytearray(page.tobytes())), (1, 2, 50, 60, 1, bytearray(b"\xff" * 3000)), (1, 3, 9, 9, 3, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "doc int, page int, h int, w int, c int, data binary")
    got = {r.page: r for r in pixels.grids(df, ["doc", "page"]).orderBy(F.col("page")).collect()}
    assert near(got[1].x_rules, X_RULES) and got[1].error is None and got[1].width == WIDTH
    assert got[2].error.startswith("no table grid") and got[3].error.startswith("ValueError")
