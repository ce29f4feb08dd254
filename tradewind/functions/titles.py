"""What a listing's title says: kind, grade, printing and reasons to leave it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of listing titles, in the order in which they decide.
OTHER_GAME = r"(?i)\b(kingdom hearts|weiss schwarz|one piece|pok[eé]mon|yugioh|yu-gi-oh|magic the gathering|topps|panini)\b"
LOT = (
    r"(?i)\b(lot|lots|bundle|bundles|playset|joblot|job lot|wholesale|bulk|sequential|pair|duo|trio|"
    r"complete set|master set|full set|base set|set of \d|\d+[\s-]*card[\s-]*set|pick your|you pick|your pick|pick a|pick \d|you choose|choose your|"
    r"choose a|multi[- ]?buy|[2-9]\d*\s+cards\b|x\s?\d{2,}|\d{2,}\s?x)\b"
)
MULTIPLIER = r"(?i)\b([2-9]\s?x|x\s?[2-9])\b"
SWORD = r"(?i)sword"
CONNECTOR = r"(?i)(&|\sand\s|\splus\s| \+ )"
GRADED_TOKEN = r"(?i)(?:PSA|CGC|BGS|SGC|TAG|BECKETT)\s*\.?\s*(?:10|9\.5|9|8\.5|8|7\.5|7)"
SEALED = r"(?i)\b(booster box|booster pack|sleeved booster|trove|gift set|starter deck|sealed|prerelease|pre-release|booster bundle|display box|booster case)\b"
ACCESSORY = (
    r"(?i)\b(toploaders?|top loader|sleeves?|st[aä]nder|screw\s?down|magnetic (?:holder|case)|card saver|deck box|binder|playmat|"
    r"centering tool|slab case|graded card case|acrylic (?:case|stand|display)|(?:enamel|lapel)\s+pins?|pin\s+(?:set|pair|bundle)|pins(?=\s*:))\b"
)
RAW = r"(?i)\b(gradeable|ungraded|un-graded|raw card|not graded|no grade)\b"
GRADER = "PSA|CGC|BGS|SGC|TAG|BECKETT|CSG|HGA|ACE"
GRADE = r"10|9\.5|9|8\.5|8|7\.5|7|6\.5|6|5\.5|5|4\.5|4|3\.5|3|2\.5|2|1\.5|1"
GRADER_FIRST = rf"(?i)\b({GRADER})[\s.:#-]*(?:GRADE[\sD]*|GEM[\s-]*MINT\s*|GEM[\s-]*MT\s*|MINT\s*|PRISTINE\s*)?({GRADE})\b"
GRADE_FIRST = rf"(?i)({GRADE})\s*({GRADER})\b"
FOREIGN_WORD = r"(?i)\b(chinese|japanese|korean|china|japan|korea|german|germany|deutsch|deutsche|french|francais|française|francaise|italian|italiano|italien|italienne)\b"
FOREIGN_CODE = r"\b(ZH|JA|JP|JPN|JAP|KR|KOR|CN|CHN|GER|DEU|FR|FRA)\b"
GERMAN_LETTER = "[äöüÄÖÜß]"
GERMAN_TAG = r"\bDE\b"
DE_VIL = r"(?i)de\s+vil"
TROLL = r"(?i)contender|\b(would|will|could|should)\s+grade|gem\s*mint\s*(candidate|contender|worthy)|\b(psa|cgc|bgs)\s*10\s*(candidate|worthy|quality)\b"
AUTOGRAPH = r"(?i)\b(auto|signed|signature|jsa|sketch|witnessed|inscribed)\b|\bautograph|psa/?dna|hand.?drawn"
NON_FOIL = r"\b(?:non?|not|n/)[\s\-./]*foil"
PRIZE_WALL = r"\bprize\s*wall\b|\bside\s*event\b"
INFINITY_WEEKEND = r"\binfinity\s*weekend\b"
TOP_PRIZE = r"\btop\s*(?:prize|4|8|16|32|64)\b|\bcontinentals\b"
CHALLENGE = r"\bc[12]\b|/\s*c[12]\b|challenge|continentals|\bdlc\b"
#: Parts of product names and their kinds, the first that fits.
SEALED_KINDS = (
    ("Booster Box", ("booster box", "booster display", "display box")),
    ("Booster Pack", ("booster pack",)),
    ("Starter Deck", ("starter deck", "starter set", "starter blister")),
    ("Gift Set", ("gift set", "gift box")),
    ("Prerelease Pack", ("prerelease",)),
    ("Trove", ("trove",)),
    ("Quest", ("quest", "deep trouble")),
    ("Collector's Edition", ("collector's edition", "collectors edition", "curator's collection", "curators collection")),
    ("Bundle", ("bundle",)),
    ("Sealed", ("gateway", "d23 expo promo set", "d23 collection")),
)


def several_cards(title: str = "title") -> Column:
    """A copy count (unless it is about swords), or two graded tokens with a connector between."""
    t = F.col(title)
    return (t.rlike(MULTIPLIER) & ~t.rlike(SWORD)) | (t.rlike(CONNECTOR) & (F.size(F.regexp_extract_all(t, F.lit(GRADED_TOKEN), F.lit(0))) >= 2))


def title_kind(title: str = "title") -> Column:
    """EXCLUDE_... by the first pattern that fits, else GRADED or NEEDS_GRADE."""
    t = F.col(title)
    return (
        F.when(t.rlike(OTHER_GAME), "EXCLUDE_OTHER_TCG")
        .when(t.rlike(LOT) | several_cards(title), "EXCLUDE_LOT")
        .when(t.rlike(SEALED), "EXCLUDE_SEALED")
        .when(t.rlike(ACCESSORY), "EXCLUDE_ACCESSORY")
        .when(t.rlike(RAW), "EXCLUDE_RAW")
        .when(t.rlike(GRADER_FIRST) | t.rlike(GRADE_FIRST), "GRADED")
        .otherwise("NEEDS_GRADE")
    )


def grader(title: str = "title") -> Column:
    """The grader beside a grade, in either order; null without one."""
    t = F.col(title)
    found = F.upper(F.when(t.rlike(GRADER_FIRST), F.regexp_extract(t, GRADER_FIRST, 1)).when(t.rlike(GRADE_FIRST), F.regexp_extract(t, GRADE_FIRST, 2)))
    return F.when(found == "BECKETT", "BGS").otherwise(found)


def grade(title: str = "title") -> Column:
    """The grade beside a grader; null without one."""
    t = F.col(title)
    return F.when(t.rlike(GRADER_FIRST), F.regexp_extract(t, GRADER_FIRST, 2)).when(t.rlike(GRADE_FIRST), F.regexp_extract(t, GRADE_FIRST, 1))


def named_grader(title: str = "title") -> Column:
    """The first grader in the list's order that stands in a title as a word, with or without a grade."""
    t = F.upper(F.coalesce(title, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(rf"\b{g}\b"), "BGS" if g == "BECKETT" else g) for g in GRADER.split("|")))


def listing_grader(title: str = "title", given: str = "file_grader") -> Column:
    """The grader of a graded or ungraded listing: beside the grade, else named, else that of the listing's file; null for what is left out."""
    kind = title_kind(title)
    return F.when(kind == "GRADED", F.coalesce(grader(title), F.col(given))).when(kind == "NEEDS_GRADE", F.coalesce(named_grader(title), F.col(given)))


def printings(sales: DataFrame, variants: DataFrame, said: Column | None = None) -> DataFrame:
    """sales(card_id, title, ...) with printing: for cards in variants(card_id, variant, pattern) the variant or Normal, else the finish that the title says (``said`` where it has been read)."""
    named = variants.select(F.col("card_id").alias("_card"), "variant", "pattern")
    joined = sales.join(named, F.col("card_id") == F.col("_card"), "left")
    own = F.when(F.expr("coalesce(title, '') RLIKE concat('(?i)', pattern)"), F.col("variant")).otherwise("Normal")
    return joined.withColumn("printing", F.when(F.col("_card").isNotNull(), own).otherwise(finish() if said is None else said)).drop("_card", "variant", "pattern")


def read_once(rows: DataFrame, columns: dict[str, Column], title: str = "title") -> DataFrame:
    """rows with columns that are functions of their title alone, worked out once for each distinct title; null is a title too."""
    read = rows.select(F.col(title).alias("_title")).distinct().select("_title", F.col("_title").alias(title)).withColumns(columns).select("_title", *columns)
    return rows.join(read, F.col(title).eqNullSafe(F.col("_title"))).drop("_title")


def exclude_reason(title: str = "title") -> Column:
    """foreign, troll or auto by the first that fits; null for listings that count."""
    t = F.col(title)
    foreign = t.rlike(GERMAN_LETTER) | t.rlike(FOREIGN_WORD) | t.rlike(FOREIGN_CODE) | (t.rlike(GERMAN_TAG) & ~t.rlike(DE_VIL))
    return F.when(foreign, "foreign").when(t.rlike(TROLL), "troll").when(t.rlike(AUTOGRAPH), "auto")


def finish(title: str = "title") -> Column:
    """The printing that a title names, or that its prize implies: Non-Foil, Cold Foil or Foil; null where it says nothing."""
    t = F.lower(title)
    return (
        F.when(t.rlike(NON_FOIL), "Non-Foil")
        .when(t.contains("cold foil"), "Cold Foil")
        .when(t.contains("foil") | t.contains("holo"), "Foil")
        .when(t.rlike(PRIZE_WALL) | t.rlike(INFINITY_WEEKEND), "Non-Foil")
        .when(t.rlike(TOP_PRIZE) & t.rlike(CHALLENGE), "Foil")
    )


def sealed_kind(name: str = "name") -> Column:
    """The kind of a product by the first part of its name that fits; Promo Single where none does."""
    n, found = F.lower(F.coalesce(name, F.lit(""))), F.lit("Promo Single")
    for kind, parts in reversed(SEALED_KINDS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | n.contains(p)
        found = F.when(hit, kind).otherwise(found)
    return found


def place_rank(label: str = "place") -> Column:
    """1 for 1st, 8 for Top 8, 16 for T16, 5 for 5th; null where a label can't be read."""
    key = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", "")
    number = r"^(?:top|t)?(\d{1,4})(?:th|st|nd|rd)?$"
    return F.when(key.rlike(number), F.regexp_extract(key, number, 1).cast("int"))


def rarity_name(rarity: str = "rarity") -> Column:
    """Rarities in one spelling; unknown ones stay."""
    names = ("Super Rare", "Common", "Uncommon", "Rare", "Legendary", "Enchanted", "Epic", "Iconic", "Promo", "Quest")
    known = F.create_map(*(F.lit(x) for n in names for x in (n.lower().replace(" ", "_"), n)))
    return F.coalesce(F.try_element_at(known, F.lower(rarity)), F.col(rarity))
