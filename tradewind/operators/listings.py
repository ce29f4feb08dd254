"""Matching of listing titles to the cards of a catalogue.

A card's marks depend on the words that it shares with a title and on few
facts more, so titles don't meet cards but the best card of each key:

- a key is some of a card's words, with its number, its printed number's base
  or neither, and with its set or not; of the cards of a key only the best of
  each kind (chase rarity, language, fair) stays, as releases go by;
- a title asks for all sets of its words that cards may have, with its numbers
  and its hint.  A key of fewer facts than a card has gives it no better place
  than its own, so the best of all answers is the best of all cards.

Cards of over LONGEST words and titles of over MOST_KNOWN known ones would have
too many keys; they meet by pairs of rare words, by numbers and by a shared
word together with the hinted set, the named rarity, the named language or the
printed number of a regional card.

A card that shares nothing but words of less than half its name with a title is
no candidate.  The field is decided in tiers by one minimum of ordered keys a
title; equal titles of a day are matched once.  What a title must know of its
whole field are marks that the earliest releases of its keys give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions import listings as L
from tradewind.sinks.shared import staged

#: Days before a set's release from which its cards can be sold.
EARLY_DAYS = 14
#: Share of a card's words from which a title names it in full.
FULL = 0.85
#: Cards of more words and titles with more words of cards are compared one by one.
LONGEST, MOST_KNOWN = 6, 16


def catalogue_cards(cards: DataFrame) -> DataFrame:
    """cards(card_id, name, version, set_name, collector_number, rarity, released_at) as the matcher reads them."""
    number = L.card_number(F.col("collector_number").cast("string"))
    words = F.array_union(L.card_words(F.col("name")), L.card_words(F.col("version")))
    region = r"^(\d+)([A-Z]{2})$"
    released = F.col("released_at").cast("date")
    return cards.select(
        "card_id",
        words.alias("words"),
        F.coalesce("set_name", F.lit("")).alias("set_name"),
        number.alias("number"),
        F.coalesce("rarity", F.lit("")).alias("rarity"),
        released.alias("released"),
        F.nullif(F.regexp_extract(number, region, 1), F.lit("")).alias("base"),
        F.nullif(F.lower(F.regexp_extract(number, region, 2)), F.lit("")).alias("language"),
        # an earlier printing first; a promo's date says nothing, an unknown one comes last
        F.when(F.col("rarity") == "Promo", 0).when(released.isNull(), -1_000_000_000).otherwise(-(F.year(released) * 372 + F.month(released) * 31 + F.dayofmonth(released))).alias("age"),
    )


def read_titles(titles: DataFrame) -> DataFrame:
    """Distinct (title, sold_date) with all that the matcher reads out of a title; titles of several cards are left out."""
    t = F.col("title")
    # titles are short and take long to read, so their size doesn't say how many tasks they need
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = titles.where("title IS NOT NULL").select("title", "sold_date").repartition(tasks, "title", "sold_date").distinct().where(~L.not_single(t))
    return (
        single.withColumn("hint", L.set_hint(t))
        .select(
            "title", "sold_date",
            L.card_words(t).alias("words"), "hint", L.card_words(F.col("hint")).alias("hint_words"), L.likely_numbers(t).alias("numbers"), L.printed_numbers(t).alias("printed"), L.lettered_numbers(t).alias("lettered"),
            L.named_rarity(t).alias("rarity"), L.named_language(t).alias("language"), L.of_earlier_fair(t).alias("fair"),
        )
    )


def _key(kind: str, *parts: Column) -> Column:
    """A key of the join; null if a part is."""
    return F.concat(F.lit(f"{kind}|"), *[x for p in parts for x in (p, F.lit("|"))])


def _with_words(words: Column, kind: str, value: Column) -> Column:
    return F.transform(words, lambda w: _key(kind, value, w))


def _pairs(words: Column) -> Column:
    """A key for every two words, the smaller first."""
    return F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: _key("p", a, b))))


def _keys(words: Column, numbers: Column, single: Column, rare: Column, pairs: list[tuple[str, Column]]) -> Column:
    """All keys of a row."""
    some = [F.transform(numbers, lambda n: _key("n", n)), F.transform(single, lambda w: _key("w", w)), _pairs(rare)]
    some += [_with_words(words, kind, value) for kind, value in pairs]
    return F.filter(F.array_distinct(F.concat(*some)), lambda k: k.isNotNull())


def _rare_words(cards: DataFrame) -> DataFrame:
    """(card_id, rare): of each card's words in order of frequency those of which half of a name has two at least; all of names of one or two words."""
    held = cards.select("card_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    frequency = held.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("card_id").orderBy("df", "word"))
    kept = held.join(frequency, "word").withColumn("place", place).where((F.col("n") <= 2) | (F.col("place") <= F.col("n") - F.ceil(F.col("n") / 2) + 2))
    return kept.groupBy("card_id").agg(F.collect_list("word").alias("rare"))


def title_candidates(read: DataFrame, cards: DataFrame) -> DataFrame:
    """(title, sold_date, card_id), or (tid, card_id) of titles with a tid: the field of each title, from titles and cards as read above."""
    indexed = cards.join(_rare_words(cards), "card_id", "left").where(F.size("words") > 0)
    region = F.when(F.col("language").isNotNull(), F.col("base"))
    none = F.array().cast("array<string>")
    few = F.size("words") <= 2
    card_keys = _keys(F.col("words"), F.array("number"), F.when(few, F.col("words")).otherwise(none), F.when(few, none).otherwise(F.col("rare")), [("s", F.col("set_name")), ("r", F.col("rarity")), ("l", F.col("language")), ("b", region)])
    words = F.col("words")
    title_keys = F.concat(
        _keys(words, F.col("numbers"), words, words, [("s", F.col("hint")), ("r", F.col("rarity")), ("l", F.col("language"))]),
        F.flatten(F.transform("printed", lambda n: _with_words(words, "b", n))),
    )
    kept = ["tid"] if "tid" in read.columns else ["title", "sold_date"]
    asked = read.select(*kept, F.explode(title_keys).alias("key"))
    return asked.join(indexed.select("card_id", F.explode(card_keys).alias("key")), "key").select(*kept, "card_id").distinct()


def field_marks(read: DataFrame, cards: DataFrame) -> DataFrame:
    """read with known, met, bases, dated, any_exact and any_owner, each out of the earliest release of a key, so that no card of a title is looked at.

    known: the title's words that some card has; met and bases: its numbers and
    printed ones that are a card's number or its base.  dated: whether some card, by any word or number, was out at the sale, as
    only then dates are trusted.  any_exact and any_owner: whether one of the
    cards that were out has the lettered number, or owns the printed one.
    """
    released = F.coalesce("released", F.lit("0001-01-01").cast("date"))
    of_set = lambda kind, *parts: F.array(_key(kind, *parts), _key(kind, *parts, F.col("set_name")))
    card_keys = F.concat(F.transform("words", lambda w: _key("w", w)), of_set("n", F.col("number")), F.array(_key("b", F.col("base"))), F.flatten(F.transform("words", lambda w: of_set("b", F.col("base"), w))))
    earliest = cards.select(F.explode(F.filter(card_keys, lambda k: k.isNotNull())).alias("key"), released.alias("released")).groupBy("key").agg(F.min("released").alias("released"))
    hint = F.col("hint")
    by_set = lambda kind, *parts: F.when(hint.isNull(), _key(kind, *parts)).otherwise(_key(kind, *parts, hint))
    asks = lambda what, keys: F.transform(keys, lambda k: F.struct(F.lit(what).alias("what"), k.alias("key")))
    owners = F.concat(F.transform("printed", lambda n: by_set("n", n)), F.flatten(F.transform("printed", lambda n: F.transform("words", lambda w: by_set("b", n, w)))))
    asked = F.concat(
        asks("any", F.concat(F.transform("words", lambda w: _key("w", w)), F.transform("numbers", lambda n: _key("n", n)))),
        asks("exact", F.transform("lettered", lambda n: _key("n", n))), asks("owner", owners), asks("base", F.transform("printed", lambda n: _key("b", n))),
    )
    out = F.coalesce(F.col("released") <= F.date_add("sold_date", EARLY_DAYS), F.lit(True))
    is_ = lambda what: F.col("what") == what
    marks = [F.max(is_("any") & out).alias("dated")] + [F.max(is_(x) & y).alias(n) for x, y, n in (("exact", out, "exact_out"), ("exact", F.lit(True), "exact"), ("owner", out, "owner_out"), ("owner", F.lit(True), "owner"))]
    value = F.expr("substring(key, 3, length(key) - 3)")
    held = lambda what, kind: F.sort_array(F.collect_set(F.when(is_(what) & F.col("key").startswith(f"{kind}|"), value)))
    marks += [held("any", "w").alias("known"), held("any", "n").alias("met"), held("base", "b").alias("bases")]
    found = read.select("tid", "sold_date", F.inline(asked)).join(earliest, "key").groupBy("tid").agg(*marks)
    chosen = lambda n: F.coalesce(F.when(F.col("dated"), F.col(f"{n}_out")).otherwise(F.col(n)), F.lit(False)).alias(f"any_{n}")
    return read.join(found, "tid", "left").select(*read.columns, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("known", "met", "bases")), F.coalesce("dated", F.lit(False)).alias("dated"), chosen("exact"), chosen("owner"))


def _score(t: str, c: str) -> dict[str, Column]:
    """A candidate's marks, by the columns of its title (t) and card (c)."""
    title, card = (lambda n: F.col(f"{t}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    has = lambda array, value: F.array_contains(array, value)
    shared = F.size(F.array_intersect(title("words"), card("words")))
    hint_words = title("hint_words")
    hinted = title("hint").isNotNull()
    printed = F.size(title("printed")) > 0
    owns = printed & (has(title("printed"), card("number")) | F.coalesce(has(title("printed"), card("base")), F.lit(False))) & (~hinted | (card("set_name") == title("hint")))
    chase = card("rarity").isin(*L.CHASE)
    number_hit = has(title("numbers"), card("number"))
    own_rarity = card("rarity") == title("rarity")
    return {
        "shared": shared,
        "cover": shared / F.size(card("words")),
        "number_hit": number_hit,
        "set_hit": F.coalesce(card("set_name") == title("hint"), F.lit(False)),
        "hinted": hinted,
        "fair_hit": title("fair") & (card("set_name") == L.FAIR_SET) & card("number").isin(*L.FAIR_NUMBERS),
        "exact": has(title("lettered"), card("number")),
        "lettered": F.size(title("lettered")) > 0,
        "owns": owns,
        "printed": printed,
        "agrees": has(title("printed"), card("number")),
        "set_named": (F.size(hint_words) > 0) & (F.size(F.array_except(card("words"), hint_words)) == 0),
        # all that the title shares with the card is the set's own name
        "only_set": (F.size(hint_words) > 0) & (F.size(F.array_except(card("words"), hint_words)) > 0) & (F.size(F.array_except(F.array_intersect(title("words"), card("words")), hint_words)) == 0),
        "rarity_ok": F.when(title("rarity").isNotNull(), own_rarity).otherwise(number_hit | ~chase),
        "by_rarity": F.when(title("rarity").isNull(), F.when(number_hit | ~chase, 0.0).otherwise(-0.5)).when(own_rarity, 0.7).when(number_hit, 0.0).when(chase, -0.6).otherwise(-0.45),
        "by_language": F.when(card("language").isNull() | title("language").isNull(), 0.0).when(card("language") == title("language"), 0.5).otherwise(-0.6),
        "age": card("age"),
        "too_early": F.coalesce(card("released") > F.date_add(title("sold_date"), EARLY_DAYS), F.lit(False)),
    }


def _best(read: DataFrame, cards: DataFrame, field: DataFrame) -> DataFrame:
    """(tid, b): the best card of each title's field(tid, card_id), with its marks."""
    pairs = field.select("tid", "card_id").join(cards.select("card_id", F.struct("words", "set_name", "number", "rarity", "released", "base", "language", "age").alias("c")), "card_id")
    pairs = pairs.join(read.select("tid", "dated", "any_exact", "any_owner", F.struct("words", "hint", "hint_words", "numbers", "printed", "lettered", "rarity", "language", "fair", "sold_date").alias("t")), "tid")
    marked = pairs.select("tid", "card_id", "dated", "any_exact", "any_owner", *[x.alias(n) for n, x in _score("t", "c").items()])
    return _first(marked.where((~F.col("too_early") | ~F.col("dated")) & ~F.col("only_set")))


def _first(scored: DataFrame) -> DataFrame:
    """(tid, b): the first of each title's candidates by their marks."""
    points = lambda condition, value: F.when(condition, value).otherwise(0.0)
    terms = [F.col("cover"), points(F.col("number_hit"), 0.4), points(F.col("set_hit"), 0.4), points(F.col("fair_hit"), 0.6), F.col("by_rarity"), F.col("by_language")]
    terms += [F.when(F.col("any_exact"), F.when(F.col("exact"), 0.8).otherwise(-0.5)).otherwise(0.0), points(F.col("any_owner") & F.col("owns") & (F.col("shared") >= 1), 0.5)]
    total = reduce(lambda a, b: a + b, terms) - points(F.col("hinted") & ~F.col("set_hit") & (F.col("cover") < 0.9), 0.3)
    full = (F.col("cover") >= FULL) & (F.col("shared") >= 2) & (~F.col("any_owner") | F.col("owns") | ~F.col("set_named"))
    first = lambda c: F.when(full & F.col(c), 0).otherwise(1).alias(f"not_{c}")
    order = [F.when(full, 0).otherwise(1).alias("tier"), first("exact"), first("rarity_ok"), first("fair_hit"), first("number_hit"), first("set_hit"), (-F.when(full, F.col("cover")).otherwise(total)).alias("least"), (-F.col("age")).alias("age"), (-total).alias("rest"), F.col("card_id")]
    return scored.groupBy("tid").agg(F.min(F.struct(*order, total.alias("total"), "cover", "number_hit", "set_hit", "printed", "agrees")).alias("b"))


def _sets_of(words: Column, allowed: Column | None = None) -> Column:
    """All sets of at most LONGEST of the sorted words, the empty one too; every two words of a set are one of the allowed pairs, if these are given."""
    start = F.array(F.array().cast("array<string>"))
    fits = lambda s, w: (F.size(s) < LONGEST) & (F.lit(True) if allowed is None else F.forall(s, lambda x: F.array_contains(allowed, F.concat_ws("|", x, w))))
    return F.aggregate(words, start, lambda found, w: F.concat(found, F.transform(F.filter(found, lambda s: fits(s, w)), lambda s: F.concat(s, F.array(w)))))


def _joined(words: Column) -> Column:
    return F.array_join(words, "|")


def _index_key(named: Column, number: Column, set_name: Column, words: Column) -> Column:
    return F.concat_ws("\n", words, number, set_name, named)


def card_index(cards: DataFrame, hints: DataFrame) -> DataFrame:
    """(key, held): for each key the best cards of their kinds, each with the release from which it is the best.

    A card lies under all sets of its words; under the empty one only with its
    number.  Cards that have no words but those of a hint(hint, hint_words) lie
    under that hint too.
    """
    none = F.lit("")
    known = F.when(F.col("language").isin(*L.LANGUAGES), F.col("language")).otherwise(F.when(F.col("language").isNotNull(), "?"))
    facts = cards.select(
        "card_id", F.sort_array("words").alias("words"), "set_name", "number", "base", "released", "age", known.alias("language"),
        F.when(F.col("rarity").isin(*L.CHASE), F.col("rarity")).otherwise(none).alias("rarity"),
        ((F.col("set_name") == L.FAIR_SET) & F.col("number").isin(*L.FAIR_NUMBERS)).alias("of_fair"),
    )
    named = hints.select("hint", F.explode(_sets_of(F.sort_array("hint_words"))).alias("words")).where(F.size("words") > 0)
    facts = facts.withColumn("named", none).unionByName(facts.join(named, "words").select(*facts.columns, F.concat(F.lit("H"), F.col("hint")).alias("named")))
    numbers = F.filter(F.array(none, F.concat(F.lit("N"), "number"), F.concat(F.lit("B"), "base")), lambda x: x.isNotNull())
    lies = facts.withColumn("s", F.explode(_sets_of(F.col("words")))).withColumn("m", F.explode(numbers)).where((F.size("s") > 0) | F.col("m").startswith("N"))
    lies = lies.withColumn("of", F.explode(F.array(none, F.concat(F.lit("S"), "set_name"))))
    kind = ["key", "rarity", "language", "of_fair"]
    # without a word in common a name's length says nothing
    order = F.struct(F.when(F.size("s") > 0, F.size("words")).otherwise(1).alias("n"), (-F.col("age")).alias("age"), F.col("card_id"))
    best = lies.withColumn("key", _index_key(F.col("named"), F.col("m"), F.col("of"), _joined(F.col("s")))).groupBy(*kind, "released").agg(F.min(order).alias("best"))
    before = F.min("best").over(W.partitionBy(*kind).orderBy(F.asc_nulls_first("released")).rowsBetween(W.unboundedPreceding, -1))
    kept = best.withColumn("before", before).where(F.col("before").isNull() | (F.col("best") < F.col("before")))
    return kept.groupBy("key").agg(F.collect_list(F.struct("rarity", "language", "of_fair", "released", "best")).alias("held"))


def _word_sets(read: DataFrame, cards: DataFrame) -> DataFrame:
    """read with sets(s, shared): the sets of known words, of which every two are words of one card, and their numbers of words."""
    two = lambda words: F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat_ws("|", a, b))))
    of_cards = cards.select(F.explode(two(F.col("words"))).alias("pair")).distinct()
    alike = read.select("known").distinct()
    allowed = alike.select("known", F.explode(two(F.col("known"))).alias("pair")).join(of_cards, "pair").groupBy("known").agg(F.collect_list("pair").alias("pairs"))
    found = alike.join(allowed, "known", "left").select("known", F.transform(_sets_of(F.col("known"), F.coalesce("pairs", F.array().cast("array<string>"))), lambda s: F.struct(_joined(s).alias("s"), F.size(s).alias("shared"))).alias("sets"))
    return read.join(found, "known")


def _best_by_index(read: DataFrame, cards: DataFrame) -> DataFrame:
    """(tid, b): the best card of each title out of the cards' index."""
    index = card_index(cards, read.where(F.size("hint_words") > 0).select("hint", "hint_words").distinct())
    facts = ["tid", "any_exact", "any_owner", "rarity", "language", "fair"]
    # number, exact and agrees of what is asked for
    asks = lambda kind, m, exact, agrees: F.struct(F.concat(F.lit(kind), m).alias("m"), exact.alias("exact"), agrees.alias("agrees"))
    no = F.lit(False)
    by_number = F.transform("met", lambda n: asks("N", n, F.array_contains("lettered", n), F.array_contains("printed", n)))
    by_base = F.transform("bases", lambda n: asks("B", n, no, no))
    read = _word_sets(read, cards).select(
        *facts, "hint", "sets", F.col("hint").isNotNull().alias("hinted"), (F.size("printed") > 0).alias("prints"),
        F.when(F.col("dated"), F.date_add("sold_date", EARLY_DAYS)).alias("until"),  # null: all are out
        F.concat(F.array(asks("", F.lit(""), no, no)), by_number, by_base).alias("asks"),
        F.array_compact(F.array(F.lit(""), F.concat(F.lit("S"), "hint"))).alias("of"),
        # words of the hint alone name no card but one that has no others
        F.when(F.size("hint_words") > 0, F.transform(_sets_of(F.sort_array("hint_words")), _joined)).otherwise(F.array().cast("array<string>")).alias("of_hint"),
    )
    asked = read.select(*facts, "hinted", F.col("prints").alias("printed"), "until", "hint", "of", "of_hint", "asks", F.inline("sets"))
    asked = asked.withColumn("set_named", F.array_contains("of_hint", F.col("s"))).drop("of_hint")
    asked = asked.select(*(c for c in asked.columns if c != "asks"), F.inline("asks")).where((F.col("s") != "") | F.col("m").startswith("N"))
    asked = asked.withColumn("of", F.explode("of"))
    keyed = asked.withColumn("key", _index_key(F.when(F.col("set_named"), F.concat(F.lit("H"), "hint")).otherwise(""), F.col("m"), F.col("of"), F.col("s"))).drop("s", "hint")
    number_hit, base_hit, set_hit = F.col("m").startswith("N"), F.col("m").startswith("B"), F.col("of") != ""
    met = keyed.join(index, "key").withColumns({"number_hit": number_hit, "base_hit": base_hit, "set_hit": set_hit}).drop("key", "m", "of")
    c = lambda n: F.col(f"c.{n}")
    met = met.withColumn("c", F.explode("held")).where(c("released").isNull() | F.col("until").isNull() | (c("released") <= F.col("until")))
    own_rarity, chase, is_hit = c("rarity") == F.col("rarity"), c("rarity") != "", F.col("number_hit")
    by_language = F.when(c("language").isNull() | F.col("language").isNull(), 0.0).when(c("language") == F.col("language"), 0.5).otherwise(-0.6)
    cover = F.col("shared") / c("best.n")
    candidate = is_hit | (cover >= 0.5) | ((F.col("shared") > 0) & (F.col("set_hit") | F.coalesce(own_rarity, F.lit(False)) | (by_language > 0) | F.col("base_hit")))
    marked = met.where(candidate).select(
        "tid", "any_exact", "any_owner", "hinted", "printed", "exact", "agrees", "shared", "number_hit", "set_hit", "set_named", c("best.card_id").alias("card_id"), (-c("best.age")).alias("age"), cover.alias("cover"),
        (F.col("fair") & c("of_fair")).alias("fair_hit"), by_language.alias("by_language"),
        (F.col("printed") & (F.col("agrees") | F.col("base_hit")) & (~F.col("hinted") | F.col("set_hit"))).alias("owns"),
        F.when(F.col("rarity").isNotNull(), own_rarity).otherwise(is_hit | ~chase).alias("rarity_ok"),
        F.when(F.col("rarity").isNull(), F.when(is_hit | ~chase, 0.0).otherwise(-0.5)).when(own_rarity, 0.7).when(is_hit, 0.0).when(chase, -0.6).otherwise(-0.45).alias("by_rarity"),
    )
    return _first(marked)


def match_titles(sales: DataFrame, cards: DataFrame) -> DataFrame:
    """sales(item_id, title, sold_date) with card_id, confidence and cn_conflict.

    A title whose printed number disagrees with the best card's conflicts,
    unless its set agrees; then, and where nothing is sure enough, card_id is
    null.  Of cards that are equal in all keys of a tier the
    higher score decides, then the smaller card_id.
    """
    own = catalogue_cards(cards).where(F.size("words") > 0)
    # read and marked once: titles are asked for by keys and by what is left of them
    read = staged(read_titles(sales).withColumn("tid", F.monotonically_increasing_id()), "titles_read")
    read = staged(field_marks(read, own), "titles_marked")
    short, few = F.size("words") <= LONGEST, F.size("known") <= MOST_KNOWN
    best = _best_by_index(read.where(few), own.where(short))
    for titles, others in ((read.where(few), own.where(~short)), (read.where(~few), own)):
        if not titles.isEmpty() and not others.isEmpty():
            best = best.unionByName(_best(titles, others, title_candidates(titles, others)))
    found = read.select("tid", "title", "sold_date").join(best.groupBy("tid").agg(F.min("b").alias("b")), "tid")
    b = lambda n: F.col(f"b.{n}")
    sure = (b("number_hit") & b("set_hit")) | ((b("cover") >= 0.5) & (b("number_hit") | b("set_hit"))) | (b("number_hit") & (b("cover") >= 0.25)) | (b("cover") >= 0.85)
    conflict = sure & b("printed") & ~b("agrees") & ~b("set_hit")
    decided = found.select(
        F.col("title").alias("_title"), F.col("sold_date").alias("_sold"), conflict.alias("cn_conflict"),
        F.when(sure & ~conflict, b("card_id")).alias("card_id"), F.when(sure & ~conflict, F.round(b("total"), 3)).alias("confidence"),
    )
    joined = sales.join(decided, (F.col("title") == F.col("_title")) & F.col("sold_date").eqNullSafe(F.col("_sold")), "left")
    return joined.select("item_id", "card_id", "confidence", F.coalesce("cn_conflict", F.lit(False)).alias("cn_conflict"))
