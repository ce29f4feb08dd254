"""Decklists, places, calendars, catalogues and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions.keys import with_local_time
from tradewind.functions.text import card_key, nfkd_fold
from tradewind.functions.titles import place_rank

#: A line of a decklist, and what its parts are.
LINE = r"(?i)^(\d{1,3})\s*[x×]?\s*(?:-\s*)?(.+?)\s*$"
CHASE = ("Enchanted", "Iconic", "Epic")
#: Words that half of all events have in their names.
CALENDAR_STOP = (
    "lorcana", "disney", "tcg", "the", "and", "at", "of", "a", "an", "in", "on",
    "ccq", "dlc", "challenge", "championship", "qualifier", "qualifiers", "set",
    "tournament", "event", "constructed", "core", "sealed", "open", "games",
    "game", "gaming", "cards", "card", "store", "official", "weekend", "2k",
    "10k", "2026", "2027", "play", "night", "day",
)


def candidates(cards: DataFrame, mainline: int = 150, last_number: int = 204) -> DataFrame:
    """(k, card_id, ink): for each name key the best card; mainline sets first, chase and overnumbered cards later, then the smaller id."""
    sized = cards.withColumn("main", F.count("*").over(W.partitionBy("set_id")) >= mainline)
    over = F.col("main") & (F.col("collector_number") > last_number)
    score = F.when(F.col("main"), 100).otherwise(0) - F.when(F.col("rarity").isin(*CHASE) | F.coalesce(over, F.lit(False)), 80).otherwise(0) - F.when(F.col("card_id").like("crd\\_custom%"), 60).otherwise(0)
    keyed = sized.withColumns({"k": card_key("name"), "rank": -score}).where("k <> ''")
    return keyed.groupBy("k").agg(F.min(F.struct("rank", "card_id", "ink")).alias("b")).select("k", "b.card_id", "b.ink")


def resolve_decklists(decks: DataFrame, cards: DataFrame, mainline: int = 150) -> DataFrame:
    """decks(deck_id, decklist) as entries, totals, lines that match no card, cards beyond four copies, and inks; all decks in one pass.

    Empty lines and those that begin with # or // are notes.
    """
    lines = decks.select("deck_id", F.posexplode(F.split(F.coalesce("decklist", F.lit("")), "\r?\n")).alias("ord", "raw")).withColumn("line", F.trim("raw"))
    parsed = lines.where("line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%'").withColumn("qty", F.when(F.col("line").rlike(LINE), F.regexp_extract("line", LINE, 1).cast("int")))
    keyed = parsed.withColumn("k", F.when(F.col("qty") > 0, card_key(F.regexp_extract("line", LINE, 2))))
    hit = keyed.join(candidates(cards, mainline), "k", "left")
    by_line = hit.groupBy("deck_id").agg(
        F.count("*").alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("card_id").isNull(), F.struct("ord", "line")))).alias("bad"),
        F.array_sort(F.collect_set("ink")).alias("inks"),
    )
    cards_of = hit.where("card_id IS NOT NULL").groupBy("deck_id", "card_id").agg(F.sum("qty").alias("qty"), F.min(F.struct("ord", "line")).alias("first"))
    entries = cards_of.groupBy("deck_id").agg(
        F.sum("qty").alias("total"),
        F.array_sort(F.collect_list(F.struct("first.ord", "card_id", "qty"))).alias("entries"),
        F.array_sort(F.collect_list(F.when(F.col("qty") > 4, F.struct("first.ord", "first.line", "qty")))).alias("over"),
    )
    joined = decks.select("deck_id").join(by_line, "deck_id", "left").join(entries, "deck_id", "left")
    text = lambda array, f: F.coalesce(F.array_join(F.transform(array, f), "\n"), F.lit(""))
    return joined.select(
        "deck_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("total", F.lit(0)).alias("total"),
        text("entries", lambda e: F.concat(e["qty"].cast("string"), F.lit(" "), e["card_id"])).alias("entries"), text("bad", lambda e: e["line"]).alias("unmatched"),
        text("over", lambda e: F.concat(e["line"], F.lit(" ("), e["qty"].cast("string"), F.lit(" in all)"))).alias("over_cap"), F.coalesce(F.array_join("inks", ","), F.lit("")).alias("inks"),
    )


def import_problems(decks: DataFrame, resolved: DataFrame) -> DataFrame:
    """(deck_id, place_rank, problems) of a dry run: unreadable places, unmatched lines and empty decklists, one a line."""
    joined = decks.select("deck_id", "place").join(resolved, "deck_id").withColumn("place_rank", place_rank("place"))
    found = F.array_compact(
        F.array(
            F.when(F.col("place_rank").isNull(), F.concat(F.lit("unreadable place "), F.coalesce(F.nullif(F.trim("place"), F.lit("")), F.lit("none")))),
            F.when(F.col("unmatched") != "", F.lit("unmatched lines")),
            F.when(F.col("total") == 0, F.lit("empty decklist")),
        )
    )
    return joined.select("deck_id", "place_rank", F.array_join(found, "; ").alias("problems"))


def miles(lat: float, lon: float, to_lat: str = "latitude", to_lon: str = "longitude", radius: float = 3958.8) -> Column:
    """Great-circle distance to a point."""
    half = f"power(sin(radians({to_lat} - {lat}D) / 2), 2) + cos(radians({lat}D)) * cos(radians({to_lat})) * power(sin(radians({to_lon} - {lon}D) / 2), 2)"
    return F.expr(f"{radius}D * 2 * asin(least(1.0D, sqrt({half})))")


def nearby_series(places: DataFrame, lat: float, lon: float, since: str, radius: float = 50.0, most: int = 24, series: int = 400) -> DataFrame:
    """Events around a point collapsed into series: one venue's slot of kind, format, local weekday and time, however titled.

    The box is filtered first and reaches the scan; the list of dates is capped,
    the count isn't; the nearest begins come first.
    """
    import math

    r = max(1.0, min(500.0, radius))
    d_lat, d_lon = r / 69.0, r / (69.0 * max(0.15, math.cos(math.radians(lat))))
    box = places.where(F.col("latitude").between(lat - d_lat, lat + d_lat) & F.col("longitude").between(lon - d_lon, lon + d_lon) & (F.col("start_datetime") >= F.lit(since).cast("timestamp")))
    near = with_local_time(box.withColumn("dist", miles(lat, lon)).where(F.col("dist") <= r), "start_datetime", "timezone")
    venue = F.coalesce(F.col("store_id").cast("string"), F.concat(F.lit("addr:"), F.coalesce("full_address", F.lit("")), F.lit("|"), F.coalesce("city", F.lit(""))))
    keyed = near.withColumns({"dow": F.dayofweek("local_ts") - 1, "local_time": F.date_format("local_ts", "HH:mm")})
    keyed = keyed.withColumn("series_key", F.concat_ws("|", venue, "kind", F.coalesce("gameplay_format", F.lit("-")), F.col("dow").cast("string"), "local_time"))
    first = F.struct("start_datetime", "event_id")
    grouped = keyed.groupBy("series_key").agg(
        *(F.min_by(c, first).alias(c) for c in ("kind", "name", "city")), F.first("dow").alias("dow"), F.first("local_time").alias("local_time"), F.min("dist").alias("dist"),
        F.count("*").cast("int").alias("n_occurrences"), F.min("start_datetime").alias("next_start"), F.array_sort(F.collect_list(first)).alias("all"),
    )
    capped = F.array_join(F.transform(F.slice("all", 1, max(1, most)), lambda e: e["event_id"].cast("string")), ",")
    shown = grouped.select("series_key", "kind", "name", "city", "dow", "local_time", F.round("dist", 3).alias("distance_mi"), "n_occurrences", "next_start", capped.alias("occurrences"))
    return shown.orderBy("next_start", "distance_mi", "series_key").limit(max(1, min(2000, series)))


def ranked_places(places: DataFrame, term: str, home: str = "", most: int = 8, apart: float = 15.0) -> DataFrame:
    """The ``most`` best towns of places(place_id, city, state, country, latitude, longitude) for a search, none within ``apart`` miles of a better one.

    Best is the town of that very name, then of the home country, then of the
    shortest name.  Rows of one town count as the one with the smallest id; rows
    without a name or a finite position don't count.  The towns stay distributed:
    each pass takes the best one left, a single row, and drops what is near it.
    """
    bare = lambda c: F.translate(nfkd_fold(c), "'‘’`´", "")
    spark = places.sparkSession
    want = spark.range(1).select(bare(F.lower(F.trim(F.lit(term)))).alias("want")).first().want
    town = places.where("trim(city) <> '' AND abs(latitude) < double('inf') AND abs(longitude) < double('inf')").select(
        "place_id", F.trim("city").alias("city"), bare(F.trim("city")).alias("norm"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("state", "country")), "latitude", "longitude"
    )
    left = towns = town.groupBy("norm", "state", "country").agg(*(F.min_by(c, "place_id").alias(c) for c in ("city", "latitude", "longitude"))).persist()
    abroad = F.col("country") != home.upper() if home else F.lit(False)
    order = F.struct((F.col("norm") != want).alias("other"), abroad.alias("abroad"), F.length("norm").alias("n"), "norm", "state", "country")
    found: list[tuple] = []
    while len(found) < most:
        best = left.agg(F.min_by(F.struct("city", "state", "country", "latitude", "longitude"), order).alias("p")).first().p
        if best is None:
            break
        found.append((len(found) + 1, *best))
        left = left.where(miles(best.latitude, best.longitude) >= apart)
    towns.unpersist()
    return spark.createDataFrame(found, "place int, city string, state string, country string, latitude double, longitude double")


def merged_rings(rings: list[DataFrame], key: str = "series_key") -> DataFrame:
    """Results of several radii by key; the last ring that has a key wins."""
    tagged = [r.withColumn("_ring", F.lit(i)) for i, r in enumerate(rings)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rings[0].columns), "_ring").alias("r")).select("r.*")


def merged_calendar(curated: DataFrame, derived: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Confirmed rows of the days ahead and derived ones that no curated row covers: same kind and title, and for sets the same subtitle."""
    a, b = F.lit(day).cast("date"), F.date_add(F.lit(day).cast("date"), days)
    held = curated.where(F.col("confirmed") & F.col("starts_on").between(a, b)).select("kind", "title", "subtitle", "starts_on")
    same = (F.col("d.kind") == F.col("c.kind")) & (F.col("d.title") == F.col("c.title")) & ((F.col("d.kind") != "set") | F.col("d.subtitle").eqNullSafe(F.col("c.subtitle")))
    new = derived.where(F.col("starts_on").between(a, b)).select("kind", "title", "subtitle", "starts_on").alias("d").join(held.alias("c"), same, "left_anti")
    return held.withColumn("source", F.lit("curated")).unionByName(new.withColumn("source", F.lit("derived")))


def new_reveals(cards: DataFrame, cutoff: str, end: str) -> DataFrame:
    """(set_id, label, first_seen) of names first added after cutoff and by end; a name known by the cutoff is a new printing."""
    a, b = F.lit(cutoff).cast("date"), F.lit(end).cast("date")
    seen = cards.groupBy("label").agg(F.max(F.col("added").isNull() | (F.col("added") <= a)).alias("old"), F.max(F.when((F.col("added") > a) & (F.col("added") <= b), F.struct("added", "set_id"))).alias("new"))
    return seen.where("NOT old AND new IS NOT NULL AND label <> ''").select("new.set_id", "label", F.col("new.added").alias("last_added"))


def linked_events(wanted: DataFrame, events: DataFrame, slack: int = 1, contain: int = 5, stop: tuple[str, ...] = CALENDAR_STOP) -> DataFrame:
    """wanted(wid, day, name) to events(eid, day, name) within ``slack`` days that share a word, or one word within the other.

    Words are folded, of four characters or of three with a digit, and not among
    those that half of all events have.  Within a day words are joined by their
    four-character parts, so only pairs with a word in common are compared, and
    each pair of names of two days once, however many rows share them; ids are
    one row each.
    """
    tokens = lambda c: F.filter(F.array_distinct(F.split(nfkd_fold(c), "[^a-z0-9]+")), lambda w: ~w.isin(*stop) & ((F.length(w) >= 4) | ((F.length(w) >= 3) & w.rlike("[0-9]") & ~w.rlike("^[0-9]+$"))))
    # a word that holds another holds its first four characters somewhere
    heads = lambda c: F.explode(F.array_distinct(F.transform(F.col(c), lambda w: F.substring(w, 1, 4))))
    parts = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.col(c), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 3, F.lit(1))), lambda i: F.substring(w, i, F.lit(4)))))))
    asked = wanted.select("day", "name").distinct().withColumn("w", tokens("name"))
    left = asked.select("day", "name", "w", F.explode(F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda i: F.date_add("day", i))).alias("on"))
    right = events.select(F.col("day").alias("on"), F.col("name").alias("event")).distinct().withColumn("h", tokens("event"))
    met = left.withColumn("key", heads("w")).join(right.withColumn("key", parts("h")), ["on", "key"]).unionByName(left.withColumn("key", parts("w")).join(right.withColumn("key", heads("h")), ["on", "key"]))
    shares = F.expr(f"filter(w, x -> array_contains(h, x) OR (length(x) >= {contain} AND exists(h, y -> contains(y, x) OR (length(y) >= {contain} AND contains(x, y)))))")
    found = met.select("day", "name", "on", "event", "w", "h").dropDuplicates(["day", "name", "on", "event"]).withColumn("evidence", shares).where(F.size("evidence") > 0)
    linked = found.select("day", "name", "on", "event", F.array_join(F.array_sort("evidence"), ",").alias("evidence"))
    repeated = lambda rows, i, many: rows.distinct().withColumn(many, F.count("*").over(W.partitionBy(i)) > 1)
    own = repeated(wanted.select("wid", "day", "name"), "wid", "_wanted")
    held = repeated(events.select("eid", F.col("day").alias("on"), F.col("name").alias("event")), "eid", "_held")
    pairs = own.join(linked, ["day", "name"]).join(held, ["on", "event"])
    # only an id with several names or days can be linked twice by the same words
    again = F.col("_wanted") | F.col("_held")
    return pairs.where(~again).select("wid", "eid", "evidence").unionByName(pairs.where(again).select("wid", "eid", "evidence").distinct())


def catalogue_findings(ours: DataFrame, theirs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(kind, key, is_new): what one catalogue(key, name) has and the other hasn't, and names that differ.

    is_new marks what the previous report(kind, key) didn't have; without one nothing is new.
    """
    side = lambda rows, a: rows.select("key", F.col("name").alias(a), F.lit(True).alias(f"in_{a}"))
    both = side(ours, "ours").join(side(theirs, "theirs"), "key", "full")
    kind = F.when(F.col("in_ours").isNull(), "missing").when(F.col("in_theirs").isNull(), "extra").when(~F.col("ours").eqNullSafe(F.col("theirs")), "renamed")
    found = both.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "key")
    if previous is None:
        return found.withColumn("is_new", F.lit(False))
    known = previous.select("kind", "key").distinct().withColumn("known", F.lit(True))
    return found.join(known, ["kind", "key"], "left").select("kind", "key", F.col("known").isNull().alias("is_new"))


def glossary(rows: DataFrame, ours: str, theirs: str, least: int = 2) -> DataFrame:
    """(term, translation, votes): words at the same places of two lists of one length, by vote; ties go to the smaller word."""
    pairs = rows.where(F.size(ours) == F.size(theirs)).select(F.explode(F.arrays_zip(F.col(ours).alias("a"), F.col(theirs).alias("b"))).alias("p")).where("p.a <> '' AND p.b <> ''")
    votes = pairs.groupBy(F.col("p.a").alias("term"), F.col("p.b").alias("translation")).agg(F.count("*").alias("votes"))
    first = votes.groupBy("term").agg(F.min(F.struct(-F.col("votes"), "translation")).alias("m"))
    return first.select("term", F.col("m.translation").alias("translation"), (-F.col("m.col1")).alias("votes")).where((F.col("votes") >= least) & (F.col("term") != F.col("translation")))


def coverage_match(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted(wid, words) to the held(hid, words) that holds the largest share of its words, with that share; 0 and null without any."""
    shared = wanted.select("wid", F.explode("words").alias("word")).join(held.select("hid", F.explode("words").alias("word")), "word").groupBy("wid", "hid").agg(F.count("*").alias("n"))
    top = shared.groupBy("wid").agg(F.min(F.struct((-F.col("n")).alias("n"), "hid")).alias("m"))
    return wanted.join(top, "wid", "left").select("wid", "m.hid", F.coalesce(-F.col("m.n") / F.size("words"), F.lit(0.0)).alias("coverage"))


def baseline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Per bucket of (bucket, item): items now and before, how many are new, and whether the bucket shrank under 0.7."""
    new = now.join(before, ["bucket", "item"], "left_anti").groupBy("bucket").agg(F.count("*").alias("n_new"))
    count = lambda rows, a: rows.groupBy("bucket").agg(F.count("*").alias(a))
    both = count(now, "n_now").join(count(before, "n_before"), "bucket", "full").join(new, "bucket", "left").na.fill(0, ["n_now", "n_before", "n_new"])
    return both.withColumn("shrank", F.col("n_now") < 0.7 * F.col("n_before"))


def folded_cards(printings: DataFrame) -> DataFrame:
    """Printings(name, set_no, card_id, text) as one row per name: printings in order of sets, and the newest set's text."""
    order = F.struct("set_no", "card_id")
    return printings.groupBy("name").agg(F.count("*").alias("n_printings"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda p: p["card_id"]), ",").alias("printings"), F.max_by("text", order).alias("text"))


def membership(rows: DataFrame, rules: dict[str, str], excluded: DataFrame, key: str) -> DataFrame:
    """Rows that any named rule (SQL) admits, with the names of those that do, less the excluded keys."""
    reason = F.concat_ws("+", *(F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()))
    return rows.withColumn("reason", reason).where("reason <> ''").join(excluded, key, "left_anti")


def unread(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """Per thread: notes newer than the reader's last visit (all where there was none) and the newest note's time."""
    joined = notes.join(seen, "thread", "left")
    return joined.groupBy("thread").agg(F.count_if(F.col("noted_at") > F.coalesce("seen_at", F.lit("1900-01-01").cast("timestamp"))).alias("n_unread"), F.max("noted_at").alias("last_at"))


def poll_shares(options: DataFrame, votes: DataFrame) -> DataFrame:
    """(poll, option, n, percent): every option of a poll, also without votes; percent of the poll's votes with one decimal."""
    counted = options.join(votes.groupBy("poll", "option").agg(F.count("*").alias("n")), ["poll", "option"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(W.partitionBy("poll"))
    return counted.withColumn("total", total).select("poll", "option", "n", F.expr("CASE WHEN total > 0 THEN CAST((2000 * n + total) div (2 * total) AS DOUBLE) / 10 END").alias("percent"))


def list_feed(lists: DataFrame, sort: str = "new", before: str | None = None, followed: DataFrame | None = None, limit: int = 24) -> DataFrame:
    """Public lists, newest or most liked first, a page of at most 100; keyset pages by updated_at, optionally of followed owners only."""
    kept = lists.where("is_public")
    if followed is not None:
        kept = kept.join(followed, "owner", "left_semi")
    if before is not None:
        kept = kept.where(F.col("updated_at") < F.lit(before).cast("timestamp"))
    order = [F.desc_nulls_last("likes")] if sort == "liked" else []
    return kept.orderBy(*order, F.desc_nulls_last("updated_at"), "list_id").limit(max(1, min(100, limit)))


def freshness(derived: DataFrame, source: DataFrame, day: str) -> DataFrame:
    """One row per name: newest dates of a derived table and of its source(name, day), the lag between them, and the source's age on a day."""
    newest = lambda rows, a: rows.groupBy("name").agg(F.max("day").alias(a))
    both = newest(source, "source_day").join(newest(derived, "derived_day"), "name", "left")
    return both.select("name", "source_day", "derived_day", F.datediff("source_day", "derived_day").alias("lag_days"), F.datediff(F.lit(day).cast("date"), "source_day").alias("age_days"))


def reattributed(rows: DataFrame) -> DataFrame:
    """(item_id, kind) of unmatched rows: the first rail that stops one, else what attributing it does."""
    kind = F.expr(
        "CASE WHEN card_id IS NOT NULL THEN 'skip:already-attributed' WHEN exclude_reason IS NOT NULL THEN 'skip:has-reason' WHEN reason IS NOT NULL THEN concat('reason:', reason) "
        "WHEN match_id IS NULL AND cn_conflict THEN 'reason:cn-conflict' WHEN match_id IS NULL THEN 'skip:still-unmatched' WHEN grade IS NULL THEN 'attributed:needs-grade' "
        "WHEN sale_price IS NULL THEN 'attributed:no-price' ELSE 'attributed' END"
    )
    return rows.select("item_id", kind.alias("kind"))
