"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from loamix.plans import answering, cleaning, describing, fetched, further, reporting, searching, serving, structure

MODULES = (cleaning, describing, searching, serving, further, reporting, fetched, answering, structure)
QUERIES: dict = {name: f for module in MODULES for name, f in module.QUERIES.items()}
SQL: dict = {name: sql for module in MODULES for name, sql in module.SQL.items()}
