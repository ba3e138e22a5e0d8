"""All queries by name, and the SQL each must agree with."""

from __future__ import annotations

from larder.operators import aliases, answers, columns, filters, household, ingredient_lines, labels, matching, prices, receipts, recipe_text, reconcile, relational, repairs, segments, sheets, steps, stock, writes
from larder.plans import menu, packs, shopping

MODULES = (matching, prices, stock, shopping, packs, relational, filters, household, labels, reconcile, writes, menu, receipts, sheets, ingredient_lines, answers, segments, recipe_text, repairs, aliases, steps, columns)


def _all(part: str) -> dict:
    out: dict = {}
    for m in MODULES:
        own = getattr(m, part)
        if twice := out.keys() & own.keys():
            raise ValueError(f"queries of one name: {sorted(twice)}")
        out |= own
    return out


QUERIES = _all("QUERIES")
SQL = _all("SQL")
