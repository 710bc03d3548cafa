"""Tables from positioned text: gap clusters, columns, regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE, ROW_GAP, COLUMN_GAP, WIDEST_COLUMN = 0.20, 0.6, 1.5, 55


def gap_clusters(df: DataFrame, by: list[str], value: Column, tolerance: Column, name: str) -> DataFrame:
    """df with the number of each row's cluster: a gap over the tolerance begins a new one, an equal one doesn't."""
    w = Window.partitionBy(*by).orderBy("v__")
    rows = df.withColumn("v__", value).withColumn("t__", tolerance)
    rows = rows.withColumn("g__", (F.col("v__") - F.lag("v__").over(w) > F.col("t__")).cast("int"))
    return rows.withColumn(name, F.sum(F.coalesce("g__", F.lit(0))).over(w).cast("bigint")).drop("v__", "t__", "g__")


def cells_to_grid(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """page, row_no, col_no, text of cells (page, x0, x1, y, h, text, conf)."""
    sure = cells.filter(F.col("conf") >= LEAST_CONFIDENCE)
    height = sure.groupBy(page).agg(F.median("h").alias("mid_h"))
    rows = gap_clusters(sure.join(height, page), [page], F.col("y") + F.col("h") / 2, F.col("mid_h") * ROW_GAP, "row_no")
    grid = gap_clusters(rows, [page], F.col("x0"), F.col("mid_h") * COLUMN_GAP, "col_no")
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return grid.groupBy(page, "row_no", "col_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def merge_wrapped(rows: list[list[str]]) -> list[list[str]]:
    """A row whose single filled cell lies under a filled one, not in the first column and no total, joins the row above."""
    out: list[list[str]] = []
    for row in rows:
        filled = [i for i, x in enumerate(row) if x]
        if out and len(filled) == 1 and filled[0] and out[-1][filled[0]] and "total" not in row[filled[0]].lower():
            out[-1][filled[0]] += " " + row[filled[0]]
        else:
            out.append(list(row))
    return out


def reconstruct(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """page, table_text: pages whose grid has at least two rows and two columns, none too wide, as pipe rows."""
    grid = cells_to_grid(cells, page)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = sorted(pdf["col_no"].unique())
        rows = [["" for _ in columns] for _ in range(int(pdf["row_no"].max()) + 1)]
        for r, c, t in zip(pdf["row_no"], pdf["col_no"], pdf["text"]):
            rows[int(r)][columns.index(c)] = t
        rows = merge_wrapped([r for r in rows if any(r)])
        widths = [sum(len(r[i]) for r in rows) / len(rows) for i in range(len(columns))]
        is_table = len(rows) >= 2 and len(columns) >= 2 and max(widths) <= WIDEST_COLUMN
        text = "\n".join("| " + " | ".join(r) + " |" for r in rows) if is_table else None
        return pd.DataFrame({page: [pdf[page].iloc[0]], "table_text": [text]})

    kind = cells.schema[page].dataType.simpleString()
    return grid.groupBy(page).applyInPandas(run, f"{page} {kind}, table_text string").filter("table_text is not null")


def regions(rows: DataFrame, page: str = "page_id", least: int = 4) -> DataFrame:
    """page, first_row, n_rows: islands of at least `least` rows that follow one another and are tabular."""
    w = Window.partitionBy(page).orderBy("row_no")
    island = F.col("row_no") - F.row_number().over(w)
    return rows.filter("tabular").withColumn("island", island).groupBy(page, "island").agg(F.min("row_no").alias("first_row"), F.count("*").alias("n_rows")).filter(F.col("n_rows") >= least).drop("island")


def column_bands(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """page, band, lo, hi: columns from the gap clusters of left edges; each reaches to the next, the last to the right end of all."""
    sure = cells.filter(F.col("conf") >= LEAST_CONFIDENCE)
    frame = sure.groupBy(page).agg(F.median("h").alias("mid_h"), (F.max("x1") + 1.0).alias("end"))
    grid = gap_clusters(sure.join(frame, page), [page], F.col("x0"), F.col("mid_h") * COLUMN_GAP, "band")
    lefts = grid.groupBy(page, "band").agg(F.avg("x0").alias("lo"), F.first("end").alias("end"))
    right = F.coalesce(F.lead("lo").over(Window.partitionBy(page).orderBy("band")), F.col("end"))
    return lefts.select(page, "band", "lo", F.greatest(right, F.col("lo") + 1.0).alias("hi"))


def by_overlap(cells: DataFrame, bands: DataFrame, page: str = "page_id") -> DataFrame:
    """cells with the band that each overlaps most, the first of equal ones. A page has few bands, so they travel as one array."""
    listed = bands.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("band", "lo", "hi"))).alias("bands"))
    over = lambda b: F.least(F.col("x1"), b["hi"]) - F.greatest(F.col("x0"), b["lo"])
    best = F.array_max(F.transform("bands", lambda b: F.struct(F.greatest(over(b), F.lit(-1.0)).alias("o"), (-b["band"]).alias("b"))))
    return cells.join(listed, page).withColumn("band", -best["b"]).drop("bands")


def nearest_row(cells: DataFrame, page: str = "page_id") -> DataFrame:
    """cells with the row whose mean centre is nearest; rows are the gap clusters of the centres, ties go up."""
    sure = cells.filter(F.col("conf") >= LEAST_CONFIDENCE)
    height = sure.groupBy(page).agg(F.median("h").alias("mid_h"))
    rows = gap_clusters(sure.join(height, page), [page], F.col("y") + F.col("h") / 2, F.col("mid_h") * ROW_GAP, "row_no")
    centres = rows.groupBy(page, "row_no").agg(F.avg(F.col("y") + F.col("h") / 2).alias("v__"))
    # cells and centres in one order: the nearest centre is the last before or the first behind
    both = cells.withColumn("v__", F.col("y") + F.col("h") / 2).withColumn("own__", F.lit(None).cast("bigint"))
    names = [c for c in cells.columns if c != page]
    marks = centres.select(page, *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in names], "v__", F.col("row_no").alias("own__"))
    order, back = (Window.partitionBy(page).orderBy(c) for c in (F.col("v__"), F.col("v__").desc()))
    mark = F.when(F.col("own__").isNotNull(), F.struct("v__", "own__"))
    placed = both.select(page, *names, "v__", "own__").unionByName(marks)
    placed = placed.withColumn("before", F.last(mark, ignorenulls=True).over(order)).withColumn("behind", F.last(mark, ignorenulls=True).over(back))  # a frame open at its end would be read anew for each cell
    up, down = F.col("v__") - F.col("before.v__"), F.col("behind.v__") - F.col("v__")
    row = F.when(F.col("behind").isNull() | (up <= down), F.col("before.own__")).otherwise(F.col("behind.own__"))
    return placed.filter(F.col("own__").isNull()).withColumn("row_no", row).select(*cells.columns, "row_no")
