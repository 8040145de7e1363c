"""Reading of identifiers that are not always written alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fillers that stand where no key is known.
FILLERS = ("n/a", "na", "-", "--", "tbd", "unknown", "none", "null", "nan", "?", "pending_owner_assignment", "pending", "unassigned", "not assigned", "todo")

BEHAVIORS = ("answer", "qualified_answer", "refuse")


def squeezed(column: Column) -> Column:
    """Lower case without outer blanks of any kind."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def key(column: Column) -> Column:
    """Comparable form of a key; null where null, blank or a filler names nothing."""
    value = squeezed(column)
    return F.when((value != "") & ~value.isin(*FILLERS), value)


def behavior(column: Column) -> Column:
    """One of the three behaviors however it is spelt, else null."""
    value = F.regexp_replace(squeezed(column), r"(?U)[\s\-]+", "_")
    return F.when(value.isin(*BEHAVIORS), value)
