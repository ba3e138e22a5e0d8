"""The names of sheets are read once, and each text of a line once, for all stages of the matching."""

from larder.operators import ingredient_lines, sheets

DATA = "/root/testdata/sf0.001"


def test_names_are_read_once_for_all_stages(spark, monkeypatch):
    seen, read = [], ingredient_lines.ingredients
    monkeypatch.setattr(ingredient_lines, "ingredients", lambda lines, *a: (seen.append(lines), read(lines, *a))[1])
    plan = str(sheets.sheet_matches(spark, DATA)._jdf.queryExecution().sparkPlan())
    assert "lineitem" not in plan  # what the stages read is kept
    (lines,) = seen
    assert lines.count() == lines.select("text").distinct().count()
