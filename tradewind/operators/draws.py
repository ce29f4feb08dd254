"""Draws that were agreed rather than played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES = ("position", "position-only", "score-only", "score-or-position")
_ROUND = ["event_id", "round_number"]


def rounds(matches: DataFrame, window: int = 2) -> DataFrame:
    """(event_id, round_number, in_cut, cut_size, closing) of every round with a match that isn't a bye.

    The top cut is what halves to a single final: from the last round backwards
    1, 2, 4, 8, ... matches, up to the first round with a draw, another size, or
    an earlier neighbour of its own size.  cut_size is the number of players
    that entered it, 0 without a cut.  The last ``window`` other rounds close.
    """
    drawn = F.col("winner_id").isNull() & ~F.col("is_bye")
    sizes = matches.groupBy(*_ROUND).agg(F.count_if(~F.col("is_bye")).alias("n"), F.bool_or(drawn).alias("drawn")).where("n > 0")
    back = W.partitionBy("event_id").orderBy(F.desc("round_number"))
    so_far = back.rowsBetween(W.unboundedPreceding, W.currentRow)
    halves = (F.col("n") == F.pow(F.lit(2), F.row_number().over(back) - 1)) & ~F.col("drawn") & ~F.lead("n").over(back).eqNullSafe(F.col("n"))
    cut = sizes.withColumn("halves", halves).withColumn("in_cut", F.min("halves").over(so_far))
    return cut.select(
        *_ROUND,
        "in_cut",
        F.coalesce(2 * F.max(F.when(F.col("in_cut"), F.col("n"))).over(W.partitionBy("event_id")), F.lit(0)).alias("cut_size"),
        (~F.col("in_cut") & (F.count_if(~F.col("in_cut")).over(so_far) <= window)).alias("closing"),
    )


def entering(matches: DataFrame, swiss: DataFrame) -> DataFrame:
    """(event_id, round_number, player_id, before): points held going into each Swiss round; 3 a win or bye, 1 a draw of two players."""
    won = "CASE WHEN {bye} WHEN winner_id = {me} THEN 3 WHEN winner_id IS NULL AND player1_id IS NOT NULL AND player2_id IS NOT NULL THEN 1 ELSE 0 END"
    p1, p2 = won.format(bye="is_bye THEN 3", me="player1_id"), won.format(bye="is_bye THEN 0", me="player2_id")
    sides = matches.join(swiss, _ROUND, "left_semi").select(*_ROUND, F.expr(f"stack(2, player1_id, {p1}, player2_id, {p2}) AS (player_id, points)")).where("player_id IS NOT NULL")
    per = sides.groupBy(*_ROUND, "player_id").agg(F.sum("points").alias("points"))
    earlier = W.partitionBy("event_id", "player_id").orderBy("round_number").rowsBetween(W.unboundedPreceding, -1)
    return per.select(*_ROUND, "player_id", F.coalesce(F.sum("points").over(earlier), F.lit(0)).alias("before"))


def draw_tiers(matches: DataFrame, rule: str = "score-or-position", window: int = 2, ruled: DataFrame | None = None) -> DataFrame:
    """Every drawn match of matches(event_id, round_number, table_number, player1_id, player2_id, winner_id, games_won_p1, games_won_p2, is_bye) with its tier.

    A player contends who enters a round with at least the points of the player
    at the cut's last place then.  Draws of contenders in closing rounds are
    ID-strong where the round has more than one, else ID-likely; by score, draws
    without a finished game are ID-likely in any round.  Draws inside the cut are
    in-cut; closing draws without contention are unclear, all others real.
    ruled(event_id, round_number, table_number, intentional) overrides all of it;
    a null table is a table like any other, and intentional wins over its contrary.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    by_round = rounds(matches, window)
    held = entering(matches, by_round.where("NOT in_cut"))
    place = F.row_number().over(W.partitionBy(*_ROUND).orderBy(F.desc("before"), "player_id"))
    line = held.withColumn("place", place).join(by_round.select(*_ROUND, "cut_size"), _ROUND).where("place = cut_size").select(*_ROUND, F.col("before").alias("line"))
    found = matches.where("NOT is_bye AND winner_id IS NULL").join(by_round, _ROUND).join(line, _ROUND, "left")
    for seat in ("player1_id", "player2_id"):
        found = found.join(held.select(*_ROUND, F.col("player_id").alias(seat), F.col("before").alias(f"{seat}_before")), [*_ROUND, seat], "left")
    agreed = (F.coalesce("games_won_p1", F.lit(0)) == 0) & (F.coalesce("games_won_p2", F.lit(0)) == 0)
    contend = F.coalesce((F.col("player1_id_before") >= F.col("line")) & (F.col("player2_id_before") >= F.col("line")), F.lit(False))
    several = F.count_if(agreed if rule == "position" else F.lit(True)).over(W.partitionBy(*_ROUND)) > 1
    strong = F.when(several, "ID-strong").otherwise("ID-likely")
    tier = F.when(F.col("in_cut"), "in-cut")
    if rule == "score-only":
        tier = tier.when(agreed, "ID-likely").otherwise("real")
    else:
        if rule == "score-or-position":
            tier = tier.when(agreed, F.when(F.col("closing") & contend, strong).otherwise("ID-likely"))
        played = ~F.col("closing") | (~agreed if rule == "position" else F.lit(False))
        tier = tier.when(played, "real").when(contend, strong).otherwise("unclear")
    out = found.select(*_ROUND, "table_number", "player1_id", "player2_id", tier.alias("tier"))
    if ruled is not None:
        said = ruled.groupBy(*_ROUND, F.col("table_number").alias("ruled_table")).agg(F.bool_or("intentional").alias("intentional"))
        same = (out.event_id == said.event_id) & (out.round_number == said.round_number) & out.table_number.eqNullSafe(said.ruled_table)
        manual = F.when(F.col("intentional"), "ID-manual").when(~F.col("intentional"), "real-manual")
        out = out.join(said, same, "left").select(*(out[c] for c in out.columns[:-1]), F.coalesce(manual, "tier").alias("tier"))
    return out.withColumn("intentional", F.col("tier").startswith("ID"))
