"""SQL text over named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.tables import Database


def statements(text: str) -> list[str]:
    """The ``;``-separated statements of a text; separators inside quotes and comments do not count."""
    out, here, i = [], "", 0
    while i < len(text):
        two = text[i : i + 2]
        if text[i] in "'\"`":
            end = text.find(text[i], i + 1)
            end = len(text) - 1 if end < 0 else end
        elif two == "--":
            end = text.find("\n", i)
            end = len(text) - 1 if end < 0 else end
        elif two == "/*":
            end = text.find("*/", i)
            end = len(text) - 1 if end < 0 else end + 1
        else:
            end = i
        if text[i] == ";":
            out.append(here)
            here = ""
        else:
            here += text[i : end + 1]
        i = end + 1
    return [s for s in (x.strip() for x in [*out, here]) if s]


def run_sql(db: Database, text: str) -> list[DataFrame]:
    """A DataFrame per statement. Tables are views of the database; grouping, ordering and limits all count."""
    db.register()
    return [db.spark.sql(s) for s in statements(text)]
