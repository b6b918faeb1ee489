"""Similarity of product names, and the guards that keep different variants and sizes apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions.packs import quantity_conflict
from basketlens.functions.text import fold, let, to_greek, word_tokens

FLOOR = 0.5
BAND = 0.05
# Roots of words that name a variant; names of different families are different products.
VARIANTS = (
    ("lemon", "λεμον"), ("fraoul", "φραουλ", "strawberr"), ("sokolat", "chocolat", "cacao", "κακαο", "choco"), ("vanil", "βανιλ"),
    ("portokal", "orange", "πορτοκαλ"), ("rodakin", "peach", "ροδακιν"), ("verykok", "βερυκοκ", "apricot"), ("banan", "μπαναν"),
    ("kerasi", "κερασ", "cherry"), ("ananas", "ανανα", "pineappl"), ("mango", "μανγκ", "μαγκο"), ("karyd", "καρυδ", "coconut", "καρυδα"),
    ("mela", "μηλο", "apple", "μηλ"), ("menta", "μεντ", "mint", "δυοσμ"), ("kanel", "cinnamon", "κανελ"), ("karamel", "caramel", "καραμελ"),
    ("meli", "μελι", "honey"), ("amygdal", "αμυγδαλ", "almond"), ("lavand", "λεβαντ", "lavender"), ("aloe", "αλοη"),
    ("chamomil", "χαμομηλ", "χαμομιλ"), ("karpouz", "καρπουζ", "watermelon"), ("vatomour", "βατομουρ", "raspberr"),
    ("light", "λαιτ", "elafr", "ελαφρ", "imiapax", "ημιαπαχ", "apovoutyr", "αποβουτυρ"), ("plir", "πληρ", "full"), ("zero", "ζερο"), ("decaf", "ντεκαφ"),
)
UNITS = {
    "γρ": "g", "gr": "g", "g": "g", "κιλο": "kg", "kg": "kg", "ml": "ml", "μλ": "ml", "cl": "cl", "lt": "l", "λτ": "l", "l": "l",
    "λιτρα": "l", "λιτρο": "l", "τεμ": "τεμ", "tem": "τεμ", "τμχ": "τεμ", "μεζ": "μεζ", "mez": "μεζ",
}


def salient_tokens(name: Column) -> Column:
    """Distinct words that tell products apart: units in one spelling, Latin words in Greek letters, short words dropped."""
    n = F.regexp_replace(fold(name, final_sigma=True), r"([0-9])\s*[x×*]\s*(?=[0-9])", "$1 ")
    raw = F.filter(F.split(F.regexp_replace(n, "[^a-z0-9α-ω]+", " "), " "), lambda t: t != "")
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def canon(t: Column) -> Column:
        value, unit = F.regexp_extract(t, "^([0-9]+)([a-zα-ω]+)$", 1).try_cast("double"), units[F.regexp_extract(t, "^([0-9]+)([a-zα-ω]+)$", 2)]
        litres = (unit == "ml") & (value >= 1000)
        value, unit = F.when(litres, value / 1000).otherwise(value), F.when(litres, "l").otherwise(unit)
        written = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
        return F.when(unit.isNotNull(), F.concat(written, unit)).otherwise(t)

    kept = F.filter(F.transform(raw, canon), lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))
    return F.array_distinct(F.transform(kept, lambda t: F.when(t.rlike("^[a-z]+$"), to_greek(t)).otherwise(t)))


def name_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(salient_tokens(a).alias("a"), salient_tokens(b).alias("b")), lambda t: token_similarity(t["a"], t["b"]))


def token_similarity(ta: Column, tb: Column) -> Column:
    """Shared tokens over all tokens. Each token of a, in order, takes an unused equal token of b, else one of which either
    is a prefix of the other and neither has a digit. The state of the fold is b's unused tokens."""

    def take(acc: Column, t: Column) -> Column:
        free = acc["free"]
        prefix = F.filter(free, lambda u: ~t.rlike("[0-9]") & ~u.rlike("[0-9]") & (t.startswith(u) | u.startswith(t)))
        pick = F.when(F.array_contains(free, t), t).otherwise(F.get(prefix, F.lit(0)))
        rest = lambda p: F.when(p.isNotNull(), F.filter(free, lambda u: u != p)).otherwise(free)
        return let(pick, lambda p: F.struct(rest(p).alias("free"), (acc["n"] + p.isNotNull().cast("int")).alias("n")))

    shared = F.aggregate(ta, F.struct(tb.alias("free"), F.lit(0).alias("n")), take, lambda s: s["n"])
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(shared / (F.size(ta) + F.size(tb) - shared))


def variant_families(name: Column) -> Column:
    words = F.filter(word_tokens(name), lambda t: F.length(t) >= 3)
    begins = ["^(?:" + "|".join(roots) + ")" for roots in VARIANTS]
    has = lambda pattern: F.exists(words, lambda t: t.rlike(pattern))
    return F.array_compact(F.array(*(F.when(has(p), F.lit(i)) for i, p in enumerate(begins))))


def variant_conflict(a: Column, b: Column) -> Column:
    return variant_families(a) != variant_families(b)


def comparable(a: Column, b: Column) -> Column:
    return ~variant_conflict(a, b) & ~quantity_conflict(a, b) & (name_similarity(a, b) >= FLOOR)


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of a (of three letters or more) that b has; 0 without words."""
    words = lambda s: F.array_distinct(F.filter(word_tokens(s), lambda t: F.length(t) >= 3))
    return F.when(F.size(words(a)) > 0, F.size(F.array_intersect(words(a), words(b))) / F.size(words(a))).otherwise(0.0)
