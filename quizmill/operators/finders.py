"""Element finders of the user's own: a function over a text becomes a table function, one text in, any number of elements out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

#: What a finder yields for an element: kind, the part that matters, the whole match, and where it begins.
Found = tuple[str, str | None, str, int]
SCHEMA = "kind string, content string, full_match string, start_pos long, end_pos long"


def finder(find: Callable[[str], Iterable[Found]]) -> UserDefinedTableFunction:
    """A table function from a finder. Texts reach it in Arrow batches; a null text has no elements; what it raises fails the
    query with its own message."""

    class Finder:
        def eval(self, text: str):  # noqa: ANN202 - rows of SCHEMA
            for kind, content, match, start in find(text) if text is not None else ():
                yield kind, content, match, start, start + len(match)

    return F.udtf(Finder, returnType=SCHEMA, useArrow=True)


def elements(rows: DataFrame, find: Callable[[str], Iterable[Found]], column: str = "text") -> DataFrame:
    """Every row once for each element that the finder finds in its text, with the element's columns; the text itself is not
    carried on. Rows without elements are left out. Nothing is shuffled."""
    keys = [c for c in rows.columns if c != column]
    return rows.lateralJoin(finder(find)(F.col(column).outer())).select(*keys, "kind", "content", "full_match", "start_pos", "end_pos")
