"""CSV cells land as the parser gives them (F1, F2): no cell that no row has, none lost where rows are wide."""

import os

import pytest
from pyspark.sql import functions as F

from defectlens.functions.text import split_tags
from defectlens.session import scratch_path
from defectlens.sources import header_map as HM
from defectlens.streaming import jobs as J

# quoted cells that a parser which skips columns reads wrong (SPARK-46862)
ODD = ['"5"', '","', '"a ""b"" \nc"', "", '""', "x"]


def folder_of(spark, widths, name="csv [1]{a}"):
    folder = scratch_path(spark, name)
    os.makedirs(folder)
    for i, w in enumerate(widths):
        lines = [",".join(["Sprint", "Status", *[f"h{k}" for k in range(min(w, 90) - 2)]])]
        lines += [",".join([f"Sprint {r}", "Done", *[ODD[(r + k) % len(ODD)] for k in range(w - 2)]]) for r in range(5)]
        with open(os.path.join(folder, f"up*{i}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write("\n".join(lines) + "\n")
    return folder


def texts(cells):
    last = max((i for i, c in enumerate(cells) if c is not None), default=-1)
    return tuple(cells[:last + 1])


def by_file(df):
    return [(r.file, texts(r.cells)) for r in df.orderBy("file", "row").collect()]


@pytest.mark.parametrize("widths,kept", [((3, 24), 24), ((24, 25, 101), 101), ((3, 101, 102, 130), 101)])
def test_landed_cells_are_those_read(spark, widths, kept):
    folder = folder_of(spark, widths)
    files = [os.path.join(folder.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"), f"up\\*{i}.csv") for i in range(len(widths))]
    path = scratch_path(spark, "cells")

    def land(rows):
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    landed = HM.land_cells(spark, files, land)
    want = by_file(HM.in_file_order(HM.read_cells(spark, files)))
    assert len(want) == 6 * len(widths) and by_file(landed) == want
    assert {r.n for r in landed.select(F.size("cells").alias("n")).distinct().collect()} == {kept}
    issues = HM.issues_of(landed, HM.file_headers(landed))
    assert sorted(r.sprint for r in issues.collect()) == sorted(f"Sprint {r}" for r in range(5) for _ in widths)
    assert all(len(r.names) == HM.MAX_COLUMNS + 1 for r in HM.file_headers(landed).collect())


@pytest.mark.parametrize("widths,kept", [((4, 12, 4), {24}), ((4, 110), {24, 101})])
def test_stream_keeps_cells_that_rows_have(spark, widths, kept):
    d = J.new_dirs(spark, "t2-cells")
    d["src"] = folder_of(spark, widths)
    glob = d["src"].replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")
    J.run_to_completion(J.csv_ingest_stream(spark, glob, d["table"], d["dim"], d["ckpt"], max_files=1))
    assert J.read_epochs(spark, d["table"]).count() == 5 * len(widths)
    assert {r.n for r in J.read_epochs(spark, f"{d['table']}_raw").select(F.size("cells").alias("n")).distinct().collect()} == kept
    assert sorted(r.sprint for r in J.read_latest_epoch(spark, d["dim"]).collect()) == [f"Sprint {i}" for i in range(5)]


def test_tags_with_and_without_spaces(spark):
    rows = [("a;B|c,,", "É|b"), (" A ; b c |", "d"), ("", None), (None, ";,|"), ("ΑΣ|x\t", " ")]
    got = spark.createDataFrame(rows, "t string, u string").select(split_tags("t").alias("a"), split_tags("t", "u").alias("b"))
    assert [tuple(r) for r in got.collect()] == [
        (["a", "b", "c"], ["a", "b", "c", "é", "b"]), (["a", "b c"], ["a", "b c", "d"]), ([], []), ([], []), (["ας", "x\t"],) * 2]
