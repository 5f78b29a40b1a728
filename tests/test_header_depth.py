"""Header lines of several rows: years, spanning names and period labels."""

from __future__ import annotations

from tabloom.operators import tables as T

CELLS = "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string"


def facts(spark, *grids):
    rows = [("s", 1, n, i, j, h, c) for n, grid in enumerate(grids) for i, line in enumerate(grid[1:]) for j, (h, c) in enumerate(zip(grid[0], line))]
    out = T.to_facts(T.merge_header_rows(spark.createDataFrame(rows, CELLS))).where("value is not null").collect()
    return sorted((r.table_no, r.row_label, r.column_label, r.unit or "", r.year or 0, r.value) for r in out)


def test_year_line_under_a_spanning_name(spark):
    got = facts(spark, [["", "GHG", "", "Water", ""], ["", "2023", "2022", "2023", "2022"], ["Scope 1", "10", "20", "3", "4"]])
    assert got == sorted((0, "Scope 1", f"{n} {y}", "", y, v) for n, y, v in
                         (("GHG", 2023, 10.0), ("GHG", 2022, 20.0), ("Water", 2023, 3.0), ("Water", 2022, 4.0)))


def test_names_under_years_and_a_unit_column(spark):
    got = facts(spark, [[" ", " ", "2023", "", "2022", ""], ["", "", "Group  Total", "Full consolidated", "Group Total", "Full consolidated"],
                        ["Total direct", "(TJ)", "14334", "14092", "16665", "16041"], ["Renewable", "(%)", "9.76", "9.92", " ", " "]])
    assert got == sorted([
        (0, "Total direct", "2023 Group  Total", "TJ", 2023, 14334.0), (0, "Total direct", "2023 Full consolidated", "TJ", 2023, 14092.0),
        (0, "Total direct", "2022 Group Total", "TJ", 2022, 16665.0), (0, "Total direct", "2022 Full consolidated", "TJ", 2022, 16041.0),
        (0, "Renewable", "2023 Group  Total", "%", 2023, 9.76), (0, "Renewable", "2023 Full consolidated", "%", 2023, 9.92)])


def test_three_lines_and_a_period_label(spark):
    got = facts(spark, [["", "Energy", "", ""], ["", "Direct", "", "Indirect"], ["Fiscal year", "FY2023", "FY 2022", "2023"], ["Site", "1", "2", "3"]])
    assert [x[2] for x in got] == ["Energy Direct FY 2022", "Energy Direct FY2023", "Energy Indirect 2023"]


def test_rows_of_years_stay_data(spark):
    labelled = [["", "A", "B"], ["Founded", "1998", "2003"], ["Staff", "12", "15"]]
    only_years = [["", "A", "B"], ["", "1998", "2003"], ["", "2001", "2004"]]
    got = facts(spark, labelled, only_years)
    assert {(x[0], x[1], x[5]) for x in got} == {
        (0, "Founded", 1998.0), (0, "Founded", 2003.0), (0, "Staff", 12.0), (0, "Staff", 15.0),
        (1, "", 1998.0), (1, "", 2003.0), (1, "", 2001.0), (1, "", 2004.0)}


def test_single_header_and_repeated_tables_are_unchanged(spark):
    grid = [["name", "2023"], ["x", "1"], ["y", "2"]]
    got = facts(spark, grid, grid)
    assert got == [(n, r, "2023", "", 2023, v) for n in (0, 1) for r, v in (("x", 1.0), ("y", 2.0))]
