"""Gates: what must hold of a whole table before work goes on, and says all that is wrong at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .lineage import settled

#: Offenders that the error itself names; all of them are in the table.
NAMED = 5


class GateError(ValueError):
    """Rows that should not be there. ``count`` is their exact number; ``table`` is where all of them are, if it was asked for."""

    def __init__(self, what: str, count: int, named: list[str], table: str | None):
        more = f" and {count - len(named)} more" if count > len(named) else ""
        super().__init__(f"{count} {what}: {', '.join(named)}{more}" + (f" (all in {table})" if table else ""))
        self.count, self.table = count, table


def gate(offenders: DataFrame, what: str, table: str | None = None) -> None:
    """Fail with the exact number of distinct ``offenders`` (one column), the least of them by name, and all of them written to the
    Parquet folder ``table``. Nothing is wrong if there are none. The driver sees a number and NAMED rows."""
    column = offenders.columns[0]
    bad = settled(offenders.distinct())
    count = bad.count()
    if not count:
        return
    if table:
        bad.write.mode("overwrite").parquet(table)
    named = [str(r[0]) for r in bad.orderBy(column).limit(NAMED).collect()]
    raise GateError(what, count, named, table)

