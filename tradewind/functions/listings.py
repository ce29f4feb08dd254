"""What a listing's title says about the card that it sells: words, numbers, set, rarity and language."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a card.
STOP = tuple(
    """disney lorcana ravensburger the of a an and en card tcg trading game
psa cgc bgs sgc tag beckett gem mint mt graded grade foil nonfoil non holo holofoil
cold enchanted fabled iconic epic legendary rare super uncommon common promo first
edition ed new near english eng set chapter pristine card slab gemmt""".split()
)
#: Titles of several cards, packs and test prints.
NOT_SINGLE = (
    r"(?i)\bpromo\s+set\b|\bcomplete\s+set\b|\bcollection\s+set\b|\bset\s+of\s+\d|\blot\b|\bbundle\b|\bsealed\b|\bbooster\s+pack\b|\bwave\s*\d*\s*pack\b"
    r"|\b\d{1,2}\s+(?:promo\s+)?cards\b|\bdemo\b|\bomitted\b|\btest\s+print\b"
)
LOOSE_SET = r"(?i)\b(complete|sequential|full|master|entire)\b(?:\s+\S+){0,3}?\s+\bsets?\b"
SEVERAL = r"(?i)\bx\s?[2-9]\b"
#: The main sets by their number.
MAIN_SETS = (
    "The First Chapter", "Rise of the Floodborn", "Into the Inklands",
    "Ursula's Return", "Shimmering Skies", "Azurite Sea", "Archazia's Island",
    "Reign of Jafar", "Fabled", "Whispers in the Well",
    "Winterspell", "Wilds Unknown", "Attack of the Vine!",
)
#: Names by which titles call sets, the first that fits.
SET_NAMES = {
    "first chapter": "The First Chapter", "1st chapter": "The First Chapter",
    "floodborn": "Rise of the Floodborn",
    "inklands": "Into the Inklands", "ursulas return": "Ursula's Return",
    "shimmering skies": "Shimmering Skies", "azurite": "Azurite Sea",
    "archazia": "Archazia's Island", "reign of jafar": "Reign of Jafar",
    "fabled": "Fabled", "whispers in the well": "Whispers in the Well",
    "wilds unknown": "Wilds Unknown", "winterspell": "Winterspell",
    "epcot": "EPCOT Festival of the Arts",
    "attack of the vine": "Attack of the Vine!",
    "attack of vine": "Attack of the Vine!",
    "curator's collection": "Curator's Collection: Heroines",
    "curators collection": "Curator's Collection: Heroines",
    "heroines": "Curator's Collection: Heroines",
}
#: Rarities that are cards of their own, and languages of regional printings.
CHASE = ("Enchanted", "Iconic", "Epic")
LANGUAGES = {"ja": r"japan|jpn|tokyo\s*toy|\bja\b|/\s*ja|p1[-\s]?ja", "zh": r"chinese|\bzh\b|simplified|/\s*zh"}
#: The fair of one year, and what tells it from the fair of another.
FAIR, FAIR_LATER, FAIR_EARLIER, FAIR_LABEL = r"\bd23\b", r"collection|\b202[45]\b", r"collector|1st\s*ed|\b2022\b|\b2023\b", r"d23[-\s]+d23|d23 promos?\b|\b\d{1,2}\s*d23\b"
FAIR_SET, FAIR_NUMBERS = "Promo Set 1", ("1", "2", "3", "4", "5", "6", "7")


class Hint(NamedTuple):
    """A pattern over the lower-case title, and the set that it names; a mapping goes by the pattern's first group."""

    pattern: str
    names: str | dict[str, str]
    also: str | None = None
    unless: str | None = None


#: Hints of the set in the order in which they decide; SET_NAMES come after them.
HINTS = (
    Hint(r"\b\d{1,3}\s*/\s*p([123])\b", {"1": "Promo Set 1", "2": "Promo Set 2", "3": "Promo Set 3"}),
    Hint(FAIR, "D23 Collection", also=FAIR_LATER),
    Hint(FAIR, "D23 Collection", also=FAIR_LABEL, unless=FAIR_EARLIER),
    Hint(FAIR, FAIR_SET),
    Hint(r"\bp1\b|p1[-\s]promo|gencon|gamescom|disney\s?100|\bd100\b|tokyo\s*toy\s*show", "Promo Set 1"),
    Hint(r"\bp2\b|p2[-\s]promo", "Promo Set 2"),
    Hint(r"\bp3\b|p3[-\s]promo", "Promo Set 3"),
    Hint(r"\bc3\b|/\s*c3|\bccq\b", "Lorcana Challenge Promo (C3)"),
    Hint(r"\bc2\b|/\s*c2|year\s*3", "Lorcana Challenge Year 3"),
    Hint(r"\bc1\b|/\s*c1|top\s*prize|prize\s*wall|challenge", "Challenge Promo"),
    Hint(r"\ben[\s-]?(\d{1,2})\b", {str(i): name for i, name in enumerate(MAIN_SETS, 1)}),
)
#: A number with its set's total or a promo's letters, a number after "#", and what isn't a number of a card.
OF_TOTAL = r"(?<![\d./])(\d{1,3}[A-Za-z]?)\s*/\s*(\d{1,3}|[A-Za-z]{1,3}\d+)"
HASHED = r"#\s*(\d{1,3}[A-Za-z]?)\b"
GRADED_NUMBER = r"(?i)\b(?:PSA|CGC|BGS|SGC|TAG|BECKETT|CSG|HGA|ACE)\b[\s.:#-]*\d+(?:\.\d)?"
YEAR, ORDINAL, POPULATION = r"\b(?:19|20)\d{2}\b", r"(?i)\b\d+(?:st|nd|rd|th)\b", r"\bpop\s*\d+\b"
BARE = r"(?<![\d/#.])(\d{1,3})(?![\d/.])"


def card_words(text: Column) -> Column:
    """The distinct words of two or more letters and digits, without numbers and those of STOP."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$") & ~w.isin(*STOP)))


def card_number(number: Column) -> Column:
    """A collector number without leading zeros, its letters in capitals."""
    n = F.trim(F.coalesce(number, F.lit("")))
    return F.when(n.rlike(r"^\d+$"), F.regexp_replace(n, r"^0+(?=\d)", "")).otherwise(F.upper(n))


def not_single(title: Column) -> Column:
    """Whether a title sells several cards, a pack or a test print."""
    t = F.coalesce(title, F.lit(""))
    return t.rlike(NOT_SINGLE) | t.rlike(LOOSE_SET) | t.rlike(SEVERAL)


def set_hint(title: Column, hints: tuple[Hint, ...] = HINTS, names: dict[str, str] = SET_NAMES) -> Column:
    """The set that a title names by the first hint that fits; null where none does."""
    t, found = F.lower(title), []
    for h in hints:
        fits = t.rlike(h.pattern)
        fits = fits & t.rlike(h.also) if h.also else fits
        fits = fits & ~t.rlike(h.unless) if h.unless else fits
        if isinstance(h.names, dict):
            known = F.create_map(*(F.lit(x) for pair in h.names.items() for x in pair))
            found.append(F.when(fits, F.try_element_at(known, card_number(F.regexp_extract(t, h.pattern, 1)))))
        else:
            found.append(F.when(fits, h.names))
    return F.coalesce(*found, *(F.when(t.contains(part), name) for part, name in names.items()))


def of_earlier_fair(title: Column) -> Column:
    """Whether a title is about the earlier fair's cards."""
    t = F.lower(title)
    return t.rlike(FAIR) & ~(t.rlike(FAIR_LATER) | (t.rlike(FAIR_LABEL) & ~t.rlike(FAIR_EARLIER)))


def _totals(title: Column) -> Column:
    """Numbers in front of a set's total of 100 or more, or of a promo's letters."""
    found = F.regexp_extract_all(title, F.lit(OF_TOTAL), F.lit(0))
    below = lambda x: F.regexp_extract(x, r"/\s*(\w+)$", 1)
    counted = F.filter(found, lambda x: below(x).rlike("^[A-Za-z]") | (F.try_to_number(below(x), F.lit("999")) >= 100))
    return F.transform(counted, lambda x: F.regexp_extract(x, r"^(\d{1,3}[A-Za-z]?)", 1))


def printed_numbers(title: Column) -> Column:
    """Collector numbers that a title prints as such ("#207", "207/204", "11/P1"), with and without their letter."""
    found = F.concat(_totals(title), F.regexp_extract_all(title, F.lit(HASHED), F.lit(1)))
    plain = F.transform(found, lambda x: F.regexp_replace(x, "[A-Za-z]$", ""))
    return F.array_distinct(F.transform(F.concat(found, plain), card_number))


def lettered_numbers(title: Column) -> Column:
    """Those of them that carry a letter, which tells cards of one number apart."""
    found = F.concat(_totals(title), F.regexp_extract_all(title, F.lit(HASHED), F.lit(1)))
    return F.array_distinct(F.transform(F.filter(found, lambda x: x.rlike("[A-Za-z]$")), card_number))


def likely_numbers(title: Column) -> Column:
    """Printed numbers, and bare ones of 100 and more that are no grade, year, ordinal or population."""
    rest = title
    for pattern, by in ((GRADED_NUMBER, " "), (YEAR, " "), (ORDINAL, " "), (rf"(?i){POPULATION}", " ")):
        rest = F.regexp_replace(rest, pattern, by)
    bare = F.filter(F.regexp_extract_all(rest, F.lit(BARE), F.lit(1)), lambda x: x.cast("int") >= 100)
    return F.array_distinct(F.concat(printed_numbers(title), F.transform(bare, card_number)))


def named_rarity(title: Column) -> Column:
    """The chase rarity that a title names, else null."""
    t = F.lower(title)
    return F.coalesce(*(F.when(t.rlike(rf"\b{r.lower()}\b"), r) for r in CHASE))


def named_language(title: Column) -> Column:
    """The language of a regional printing that a title names, else null."""
    t = F.lower(title)
    return F.coalesce(*(F.when(t.rlike(pattern), name) for name, pattern in LANGUAGES.items()))
