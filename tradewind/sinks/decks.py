"""Imports of resolved decklists into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.sinks.shared import staged
from tradewind.sinks.versions import VersionedTable

#: Columns of the stored table; a deck's cards lie in one bucket.
COLUMNS, KEYS = "deck_id bigint, card_id string, quantity bigint", ["deck_id"]


def import_decks(table: VersionedTable, resolved: DataFrame, problems: DataFrame, number: int) -> bool:
    """Commits the decks that a dry run finds nothing wrong with, each whole: a deck that is there already is replaced.

    resolved(deck_id, entries) as resolve_decklists() gives it, problems(deck_id,
    problems) as import_problems() does.  An import that runs twice, or whose
    writer dies, leaves no deck in part.  The import's rows are computed once,
    and not at all if it has been committed.
    """
    if table.holds(number):
        return False
    sound = resolved.join(problems.where("problems = ''"), "deck_id", "left_semi")
    lines = F.transform(F.split("entries", "\n"), lambda x: F.split(x, " ", 2))
    rows = sound.where("entries <> ''").select("deck_id", F.explode(lines).alias("l")).select(F.col("deck_id").cast("bigint").alias("deck_id"), F.col("l")[1].alias("card_id"), F.col("l")[0].cast("bigint").alias("quantity"))
    rows = staged(rows, "import")
    return table.change(lambda stored: stored.join(rows.select("deck_id").distinct(), "deck_id", "left_anti").select(stored.columns).unionByName(rows), rows, number)
