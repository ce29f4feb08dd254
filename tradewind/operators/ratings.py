"""Views over given ratings: leaderboard, rounds, events, standings, seasons and rosters.

Tables: ratings (rating_id, match_id, player_id, opponent_id, score,
rating_before, rating_after, opponent_rating), matches (match_id, event_id,
round_number, table_number, player1_id, player2_id, games_won_p1, games_won_p2,
is_bye, is_intentional_draw), events, and players with merged_into_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.sinks.shared import shared_path


def share(part: str, whole: str) -> Column:
    """part of whole (whole numbers) in percent with one decimal, rounded half up; null without a whole."""
    return F.expr(f"CASE WHEN {whole} > 0 THEN CAST((2000 * {part} + {whole}) div (2 * {whole}) AS DOUBLE) / 10 END")


def roots(players: DataFrame) -> DataFrame:
    """(player_id, root_id): where the chain of merges ends, by doubling the pointers; a cycle ends at its smallest member.

    After k rounds pointers lead 2 ** k merges on, so chains of any length need
    no more rounds than the number of players has binary digits; rounds end
    sooner once no pointer moves.  Each round is written, which cuts lineage.
    """
    spark = players.sparkSession
    save = lambda rows: (path := shared_path(spark, "roots"), rows.write.parquet(path), spark.read.schema(rows.schema).parquet(path))[-1]
    kind = players.schema["player_id"].dataType
    start = players.select("player_id", F.coalesce(F.col("merged_into_id").cast(kind), F.col("player_id")).alias("to"))
    up = save(start.withColumn("least", F.least("player_id", "to")))
    for _ in range(up.count().bit_length() + 1):
        ahead = up.select(F.col("player_id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        moved = up.join(ahead, "to", "left").select("player_id", F.coalesce("to2", "to").alias("to"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.coalesce("to2", "to") != F.col("to")).alias("moved"))
        moved = save(moved)
        up = moved.drop("moved")
        if not moved.where("moved").head(1):
            break
    ends = players.where("merged_into_id IS NULL").select(F.col("player_id").alias("to"), F.lit(True).alias("ends"))
    return up.join(ends, "to", "left").select("player_id", F.when(F.col("ends"), F.col("to")).otherwise(F.col("least")).alias("root_id"))


def seats(matches: DataFrame, players: DataFrame, hops: int = 2) -> DataFrame:
    """The matches with c1 and c2, their players after one or two merges."""
    first = players.select("player_id", "merged_into_id")
    second = first.select(F.col("player_id").alias("merged_into_id"), F.col("merged_into_id").alias("again"))
    where = first.join(second, "merged_into_id", "left") if hops > 1 else first.withColumn("again", F.lit(None).cast("bigint"))
    out = matches
    for k in (1, 2):
        own = where.select(F.col("player_id").alias(f"player{k}_id"), F.coalesce("again", "merged_into_id").alias(f"m{k}"))
        out = out.join(own, f"player{k}_id", "left").withColumn(f"c{k}", F.coalesce(f"m{k}", f"player{k}_id")).drop(f"m{k}")
    return out


def _games(mine: str, theirs: str) -> tuple[str, str]:
    """SQL for the games won, and played, by the rated player."""
    won = f"CASE WHEN c1 = player_id THEN coalesce({mine}, 0) WHEN c2 = player_id THEN coalesce({theirs}, 0) ELSE 0 END"
    played = f"CASE WHEN c1 = player_id OR c2 = player_id THEN coalesce({mine}, 0) + coalesce({theirs}, 0) ELSE 0 END"
    return won, played


WON, PLAYED = _games("games_won_p1", "games_won_p2")


def record() -> list[Column]:
    """Wins, losses and draws of rated rows."""
    return [F.expr(f"count(*) FILTER (WHERE score = {s})").alias(n) for n, s in (("wins", 1.0), ("losses", 0.0), ("draws", 0.5))]


def global_rank(rows: DataFrame, by: str, width: float = 1.0) -> DataFrame:
    """The rows with rank by a column, largest first, without sorting the table in one task.

    Values are cut into bands of a width; a small table of bands gives how many
    rows lie above each, and ranks are counted within bands.
    """
    banded = rows.withColumn("band", F.floor(F.col(by) / width))
    above = banded.groupBy("band").agg(F.count("*").alias("n"))
    before = above.withColumn("above", F.coalesce(F.sum("n").over(W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.rank().over(W.partitionBy("band").orderBy(F.desc(by)))
    return banded.withColumn("r", inner).join(before, "band").withColumn("rank", F.col("above") + F.col("r")).drop("band", "r", "above")


def leaderboard(ratings: DataFrame, matches: DataFrame, events: DataFrame, players: DataFrame) -> DataFrame:
    """Every unmerged rated player: current and peak rating, record, shares of games and matches won, where the peak was, and rank.

    The newest rating is that of the last match by date, event, round, table and
    id.  Games count for the seat that the player holds after two merges; only
    matches with both scores have games.  All of it is one aggregate.
    """
    rows = ratings.join(seats(matches, players), "match_id").join(events.select("event_id", "event_date"), "event_id")
    both = "games_won_p1 IS NOT NULL AND games_won_p2 IS NOT NULL"
    found = rows.groupBy("player_id").agg(
        F.max_by("rating_after", F.struct("event_date", "event_id", "round_number", "table_number", "match_id")).alias("current_rating"),
        F.count("*").alias("n_matches"), F.max("rating_after").alias("peak_rating"), *record(),
        F.expr(f"sum({WON}) FILTER (WHERE {both})").alias("won"), F.expr(f"sum({PLAYED}) FILTER (WHERE {both})").alias("played"),
        F.max_by(F.struct("event_id", "round_number"), F.struct("rating_after", -F.col("rating_id"))).alias("peak"),
    )
    named = players.where("merged_into_id IS NULL").select("player_id", "display_name", "platform").join(found, "player_id")
    shown = named.select(
        "player_id", "display_name", "platform", "current_rating", "n_matches", "peak_rating", "wins", "losses", "draws", share("won", "played").alias("gw_pct"),
        share("(2 * wins + draws)", "(2 * (wins + losses + draws))").alias("mw_pct"), F.col("peak.event_id").alias("peak_event_id"), F.col("peak.round_number").alias("peak_round_number"),
    )
    return global_rank(shown, "current_rating")


def player_rounds(ratings: DataFrame, matches: DataFrame, events: DataFrame, players: DataFrame) -> DataFrame:
    """Every rated round of every player, and byes as rows without an opponent and a score."""
    held = events.select("event_id", F.col("name").alias("event_name"), "event_date")
    names = players.select(F.col("player_id").alias("opponent_id"), F.col("display_name").alias("opponent_name"))
    placed = seats(matches, players, hops=1)
    mine = F.expr("CASE WHEN c1 = player_id THEN games_won_p1 WHEN c2 = player_id THEN games_won_p2 END")
    theirs = F.expr("CASE WHEN c1 = player_id THEN games_won_p2 WHEN c2 = player_id THEN games_won_p1 END")
    rated = ratings.join(placed, "match_id").join(held, "event_id").join(names, "opponent_id", "left").select(
        "rating_id", "player_id", "event_id", "event_name", "event_date", "round_number", "table_number", "opponent_id", "opponent_name", "opponent_rating", mine.alias("my_games"), theirs.alias("opp_games"),
        "score", "rating_before", "rating_after", (F.col("rating_after") - F.col("rating_before")).alias("elo_delta"), F.lit(False).alias("is_bye"), F.coalesce("is_intentional_draw", F.lit(False)).alias("is_draw_agreed"),
    )
    byes = placed.where("is_bye").join(held, "event_id").select(F.col("c1").alias("player_id"), "event_id", "event_name", "event_date", "round_number", "table_number", F.lit(0.0).alias("elo_delta"), F.lit(True).alias("is_bye"), F.lit(False).alias("is_draw_agreed"))
    return rated.unionByName(byes, allowMissingColumns=True)


def player_events(ratings: DataFrame, matches: DataFrame, events: DataFrame, players: DataFrame) -> DataFrame:
    """Per player and event: record, games, and the rating at the start, at the end and at its peak.

    The start is the first round's (of equal rounds the lowest table, unnumbered
    ones last), the end the last one's (the highest table, unnumbered ones last).
    """
    rows = ratings.join(seats(matches, players, hops=1), "match_id")
    first = F.struct("round_number", F.isnull("table_number").alias("no_table"), "table_number", "rating_id")
    last = F.struct("round_number", F.isnotnull("table_number").alias("table"), "table_number", "rating_id")
    found = rows.groupBy("player_id", "event_id").agg(
        *record(), F.min_by("rating_before", first).alias("start_rating"), F.max_by("rating_after", last).alias("end_rating"), F.max("rating_after").alias("peak_rating"),
        F.expr(f"sum({WON})").alias("games_won"), F.expr(f"sum({PLAYED})").alias("total_games"), F.max_by("rating_after", "rating_id").alias("newest_rating"),
    )
    pct = share("(2 * wins + draws)", "(2 * (wins + losses + draws))").alias("mw_pct")
    return found.join(events.select("event_id", "store_id", "event_date", "season"), "event_id").select("*", pct)


def standings(by_event: DataFrame, official: DataFrame, players: DataFrame) -> DataFrame:
    """Per event and player: official values where there are any, else those out of the rated matches (rank by 3 points a win, 1 a draw, then wins)."""
    own = by_event.select("event_id", "player_id", "wins", "losses", "draws", "games_won", "total_games", "newest_rating")
    rank = F.rank().over(W.partitionBy("event_id").orderBy(F.expr("wins * 3 + draws").desc(), F.desc("wins")))
    ranked = own.withColumn("own_rank", rank).join(players.select("player_id", "display_name"), "player_id")
    given = official.select("event_id", "player_id", "place", "matches_won", "matches_lost", "match_points")
    both = ranked.join(given, ["event_id", "player_id"], "left").withColumns({"w": F.coalesce("matches_won", "wins"), "l": F.coalesce("matches_lost", "losses")})
    return both.select(
        "event_id", "player_id", "display_name", F.col("w").cast("bigint").alias("wins"), F.col("l").cast("bigint").alias("losses"), "draws",
        F.coalesce("match_points", F.expr("wins * 3 + draws")).cast("bigint").alias("points"), share("games_won", "total_games").alias("gw_pct"),
        share("(2 * w + draws)", "(2 * (w + l + draws))").alias("mw_pct"), F.col("newest_rating").alias("end_rating"), F.coalesce("place", "own_rank").cast("int").alias("event_rank"),
    )


def event_summary(events: DataFrame, by_event: DataFrame, placed: DataFrame) -> DataFrame:
    """Per event: rated players, mean and top rating at the start, and the champion (first by name of those placed first)."""
    starts = by_event.groupBy("event_id").agg(F.count("*").alias("rated_players"), F.sum("start_rating").alias("total"), F.max("start_rating").cast("int").alias("top_seed"))
    best = placed.where("event_rank = 1").groupBy("event_id").agg(F.min(F.struct("display_name", "player_id")).alias("c"))
    joined = events.join(starts, "event_id", "left").join(best, "event_id", "left")
    return joined.select(
        "event_id", "name", "store_id", "event_date", "season", "num_players", F.coalesce("rated_players", F.lit(0)).alias("rated_players"),
        F.floor(F.col("total") / F.col("rated_players") + 0.5).cast("int").alias("avg_start"), "top_seed", F.col("c.display_name").alias("champion_name"), F.col("c.player_id").alias("champion_id"),
    )


def season_players(by_event: DataFrame, official: DataFrame, board: DataFrame, players: DataFrame, season: str) -> DataFrame:
    """A season's table: record, shares, rating change, peak, and places counted from official standings; unmerged players only.

    Events entered are the distinct ones of rated matches and official standings together.
    """
    whole = players.where("merged_into_id IS NULL").select("player_id", "display_name")
    own = by_event.where(F.col("season") == season).join(whole.select("player_id"), "player_id", "left_semi")
    held = by_event.where(F.col("season") == season).select("event_id").distinct()
    given = official.join(held, "event_id", "left_semi").join(whole.select("player_id"), "player_id", "left_semi")
    total = own.groupBy("player_id").agg(*(F.sum(c).alias(a) for c, a in (("wins", "w"), ("losses", "l"), ("draws", "d"), ("games_won", "gw"), ("total_games", "tg"))), F.sum(F.col("end_rating") - F.col("start_rating")).alias("change"), F.max("peak_rating").alias("peak"))
    entered = own.select("player_id", "event_id").union(given.select("player_id", "event_id")).distinct().groupBy("player_id").agg(F.count("*").alias("events"))
    between = lambda a, b: F.sum(F.col("place").between(a, b).cast("int"))
    places = given.groupBy("player_id").agg(F.min("place").alias("best_place"), *(between(a, b).alias(n) for n, a, b in (("titles", 1, 1), ("finals", 2, 2), ("top4", 3, 4), ("top8", 5, 8))))
    joined = total.join(whole, "player_id").join(entered, "player_id", "left").join(board.select("player_id", "current_rating", "rank"), "player_id", "left").join(places, "player_id", "left")
    return joined.select(
        "player_id", "display_name", F.coalesce("events", F.lit(0)).alias("events"), "w", "l", "d", share("(2 * w + d)", "(2 * (w + l + d))").alias("mw_pct"), share("gw", "tg").alias("gw_pct"),
        F.round("change").cast("int").alias("elo_change"), F.round("peak").cast("int").alias("season_peak"), F.round("current_rating").cast("int").alias("current_rating"), F.col("rank").alias("current_rank"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("titles", "finals", "top4", "top8")), "best_place",
    )


def season_summary(by_event: DataFrame, matches: DataFrame, events: DataFrame, season: str) -> DataFrame:
    """One row of a season's totals: events, players, matches without byes, games, mean field, stores, dates and the largest event."""
    held = events.where(F.col("season") == season)
    a = held.agg(
        F.count("*").alias("events"), (F.sum("num_players") / F.count("num_players")).alias("avg_field"), F.countDistinct("store_id").alias("stores"), F.min("event_date").alias("date_from"), F.max("event_date").alias("date_to"),
        F.min_by("name", F.struct(-F.col("num_players"), "event_date")).alias("largest"),
    )
    b = by_event.where(F.col("season") == season).agg(F.countDistinct("player_id").alias("players"), F.coalesce(F.sum("total_games"), F.lit(0)).alias("total_games"))
    c = matches.where("NOT coalesce(is_bye, false)").join(held.select("event_id"), "event_id", "left_semi").agg(F.count("*").alias("matches"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def roster(names: DataFrame, players: DataFrame, board: DataFrame) -> DataFrame:
    """names(event_id, name) resolved to one account each: case is free; rated, exactly spelled and unmerged accounts come first, then the smallest id."""
    rated = board.select("player_id", "current_rating")
    accounts = players.join(rated, "player_id", "left").withColumn("low", F.lower("display_name"))
    wanted = names.select("event_id", "name", F.lower("name").alias("low")).distinct()
    met = wanted.join(accounts, "low", "left")
    order = F.struct(F.isnull("current_rating").alias("a"), (F.col("display_name") != F.col("name")).alias("b"), F.isnotnull("merged_into_id").alias("c"), "player_id", "current_rating")
    return met.groupBy("event_id", "name").agg(F.min(F.when(F.col("player_id").isNotNull(), order)).alias("best")).select("event_id", "name", "best.player_id", "best.current_rating")


def roster_strength(resolved: DataFrame) -> DataFrame:
    """Per event: entrants, rated ones, mean, median and top rating."""
    return resolved.groupBy("event_id").agg(
        F.count("*").alias("entrants"), F.count("current_rating").alias("rated"), (F.sum("current_rating") / F.count("current_rating")).alias("mean_rating"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY current_rating)").alias("median_rating"), F.max("current_rating").alias("top_rating"),
    )


def search_players(players: DataFrame, board: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """Unmerged players whose name holds the text (two characters or more), the best rated first; a report of ``limit`` rows."""
    if len(text.strip()) < 2:
        return players.where("false").select("player_id", "display_name").withColumn("current_rating", F.lit(None).cast("double"))
    hit = players.where("merged_into_id IS NULL").where(F.instr(F.lower("display_name"), text.strip().lower()) > 0).join(board.select("player_id", "current_rating"), "player_id", "left")
    return hit.orderBy(F.desc_nulls_last("current_rating"), "player_id").limit(limit).select("player_id", "display_name", "current_rating")


def swiss_record(matches: DataFrame) -> DataFrame:
    """Per event and player: wins, losses, draws and byes out of both seats of each match, without a join on either seat."""
    won1 = "coalesce(games_won_p1, 0) > coalesce(games_won_p2, 0)"
    won2 = "coalesce(games_won_p2, 0) > coalesce(games_won_p1, 0)"
    sides = matches.select(
        "event_id", F.expr(f"stack(2, player1_id, {won1}, {won2}, player2_id, {won2}, {won1}) AS (player_id, won, lost)"), "is_bye"
    ).where("player_id IS NOT NULL")
    n = lambda c: F.count_if(F.expr(c))
    return sides.groupBy("event_id", "player_id").agg(n("NOT is_bye AND won").alias("w"), n("NOT is_bye AND lost").alias("l"), n("NOT is_bye AND NOT won AND NOT lost").alias("d"), n("is_bye").alias("byes"))


def points_before(matches: DataFrame) -> DataFrame:
    """Match points of each seat before each round: 3 a win or bye, 1 a draw."""
    p1 = "CASE WHEN is_bye OR coalesce(games_won_p1, 0) > coalesce(games_won_p2, 0) THEN 3 WHEN coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) THEN 1 ELSE 0 END"
    p2 = "CASE WHEN coalesce(games_won_p2, 0) > coalesce(games_won_p1, 0) THEN 3 WHEN coalesce(games_won_p1, 0) = coalesce(games_won_p2, 0) THEN 1 ELSE 0 END"
    sides = matches.select("event_id", "round_number", "match_id", F.expr(f"stack(2, player1_id, {p1}, player2_id, {p2}) AS (player_id, points)")).where("player_id IS NOT NULL")
    before = W.partitionBy("event_id", "player_id").orderBy("round_number", "match_id").rowsBetween(W.unboundedPreceding, -1)
    return sides.withColumn("before", F.coalesce(F.sum("points").over(before), F.lit(0)))


def cut_line(points: DataFrame, cut: int = 8) -> DataFrame:
    """Per event the points of the player in place ``cut`` by total, null where fewer played."""
    total = points.groupBy("event_id", "player_id").agg(F.sum("points").alias("points"))
    place = F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("points"), "player_id"))
    return total.withColumn("place", place).groupBy("event_id").agg(F.count("*").alias("n_players"), F.max(F.when(F.col("place") == cut, F.col("points"))).alias("line"))


def renames(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Names that differ in the same slot (event, round, table) of two sources, with how often."""
    slot = ("event_id", "round_number", "t")
    side = lambda rows, a: rows.select("event_id", "round_number", F.coalesce("table_number", F.lit(-999)).alias("t"), *(F.col(f"name{k}").alias(f"{a}{k}") for k in (1, 2)))
    met = side(ours, "our").join(side(theirs, "their"), list(slot))
    pairs = met.select(F.expr("stack(2, our1, their1, our2, their2) AS (ours, theirs)")).where("ours IS NOT NULL AND theirs IS NOT NULL AND ours <> theirs")
    return pairs.groupBy("ours", "theirs").agg(F.count("*").alias("n"))


def deck_inks(decks: DataFrame, order: tuple[str, ...], today: str, since: str | None = None, least_events: int = 3, fallback_days: int = 90, kind: str = "core") -> DataFrame:
    """decks(deck_id, event_id, event_date, format, place_rank, inks) of one format by their combination of inks in a fixed order: decks, top fours and wins.

    Decks of events since a day count; where fewer than ``least_events`` were
    held since then, those of the last ``fallback_days``.
    """
    own = decks.where(F.col("format") == kind)
    first = F.date_sub(F.lit(today).cast("date"), fallback_days)
    if since is not None:
        n = own.where(F.col("event_date") >= F.lit(since).cast("date")).agg(F.countDistinct("event_id")).first()[0]
        first = F.lit(since).cast("date") if n >= least_events else first
    rank = F.create_map(*(x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))))
    inks = F.transform(F.array_sort(F.transform(F.array_distinct("inks"), lambda c: F.struct(rank[c].alias("i"), c.alias("c")))), lambda s: s["c"])
    keyed = own.where(F.col("event_date") >= first).withColumn("combination", F.array_join(inks, "/")).where("combination <> ''")
    return keyed.groupBy("combination").agg(F.count("*").alias("n_decks"), F.count_if(F.col("place_rank") <= 4).alias("top4"), F.count_if(F.col("place_rank") == 1).alias("won"))
