"""Rule-based classification: ordered keyword rules, native labels, aisles and browse paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.text import contains_any, fold

OTHER = "Άλλο"
# Department names.
DEPARTMENTS = (
    "Φρούτα & Λαχανικά", "Κρέας & Ψάρι", "Γαλακτοκομικά & Είδη Ψυγείου", "Τυριά & Αλλαντικά", "Σαλάτες & Αλοιφές", "Κονσέρβες", "Αρτοποιία", "Κατεψυγμένα",
    "Είδη Παντοπωλείου", "Πρωινό & Ροφήματα", "Σνακ & Γλυκά", "Κάβα", "Προσωπική Φροντίδα", "Βρεφικά Είδη", "Είδη Καθαρισμού & Σπιτιού", "Είδη Κατοικιδίων", OTHER,
)
PERSONAL = DEPARTMENTS[12]
SUNCARE = ("spf", "nivea sun", "carroten", "noxzema", "ambre solaire", "sunscreen", "sun block", "sun lotion", "after sun", "αντηλιακ")


@dataclass(frozen=True)
class Rules:
    """Parameters of a classifier. Terms of a department are tried in the order of `keywords`; the first that hits decides.

    A term '=word' hits the whole word, a term of Latin letters and digits a whole word among Latin text, any other term
    any place. `aliases` maps folded native labels to departments, `chains` does so for one chain's labels; a null
    department there means that the label is known but mixed, so that only the name decides.
    """

    keywords: Sequence[tuple[str, Sequence[str]]]
    aliases: Mapping[str, str] = field(default_factory=dict)
    chains: Mapping[str, Mapping[str, str | None]] = field(default_factory=dict)
    departments: Sequence[str] = DEPARTMENTS
    overrides: Sequence[tuple[str, Sequence[str]]] = ((PERSONAL, SUNCARE),)
    other: str = OTHER


#: A small rule set; deployments pass their own.
DEFAULT = Rules(
    keywords=(
        ("Είδη Καθαρισμού & Σπιτιού", ("απορρυπαντικ", "μαλακτικο", "χαρτομαντηλ", "χλωριν", "lenor")),
        ("Προσωπική Φροντίδα", ("σαμπουαν", "αφρολουτρο", "οδοντοκρεμα", "=λακ", "nivea")),
        ("Βρεφικά Είδη", ("βρεφικ", "πανες", "pampers")),
        ("Είδη Κατοικιδίων", ("γατας", "σκυλ")),
        ("Κατεψυγμένα", ("κατεψυγμεν", "παγωτ")),
        ("Σνακ & Γλυκά", ("σοκολατ", "μπισκοτ", "πατατακια")),
        ("Πρωινό & Ροφήματα", ("καφε", "τσαι", "χυμο", "δημητριακ", "=μελι")),
        ("Κάβα", ("μπυρ", "κρασι", "ουζο", "νερο", "αναψυκ", "cola")),
        ("Τυριά & Αλλαντικά", ("τυρι", "φετα", "ζαμπον", "γραβιερα")),
        ("Γαλακτοκομικά & Είδη Ψυγείου", ("γαλα", "γιαουρτ", "βουτυρο", "αυγα")),
        ("Κρέας & Ψάρι", ("κοτοπουλο", "χοιριν", "κιμα", "ψαρι")),
        ("Φρούτα & Λαχανικά", ("μηλα", "ντοματ", "πατατες", "λαχανικ")),
        ("Αρτοποιία", ("ψωμι", "φρυγανι", "τορτιγι")),
        ("Κονσέρβες", ("κονσερβ", "τονος")),
        ("Είδη Παντοπωλείου", ("ζυμαρικ", "μακαρον", "ρυζι", "ελαιολαδο", "αλευρι", "ζαχαρη")),
    )
)


def term_hits(term: str, text: Column) -> Column:
    word = term.strip()
    if word.startswith("="):
        return text.rlike(f"(^|[^a-z0-9α-ω]){word[1:]}([^a-z0-9α-ω]|$)")
    if word.isascii() and word.isalnum() and word == word.lower():
        return text.rlike(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)")
    return text.contains(term)


def first_rule(text: Column, rules: Rules) -> Column:
    """struct(dept, term) of the first keyword that hits; null if none does."""
    hits = [F.when(term_hits(t, text), F.struct(F.lit(dept).alias("dept"), F.lit(t).alias("term"))) for dept, terms in rules.keywords for t in terms]
    return F.coalesce(*hits)


def classify(chain: Column, name: Column, native: Column, rules: Rules = DEFAULT) -> Column:
    """struct(dept, via, term, mapped): name overrides, the chain's label map, a real department, an alias, keywords of the
    label, keywords of the name, in this order."""
    label, text = fold(native), fold(name)
    known = native.isNotNull() & (native != "") & (native != rules.other)
    out = lambda dept, via, term=None, mapped=False: F.struct(dept.alias("dept"), F.lit(via).alias("via"), (F.lit(None).cast("string") if term is None else term).alias("term"), F.lit(mapped).alias("mapped"))
    by_name, by_label = first_rule(text, rules), first_rule(label, rules)
    steps = [F.when(contains_any(text, terms), out(F.lit(dept), "override", mapped=True)) for dept, terms in rules.overrides]
    for c, labels in rules.chains.items():
        for native_label, dept in labels.items():
            here = (chain == c) & (label == fold(F.lit(native_label)))
            steps.append(F.when(here, out(F.lit(dept), "chain", mapped=True) if dept else out(F.coalesce(by_name["dept"], F.lit(rules.other)), "chain-mixed", by_name["term"], True)))
    steps.append(F.when(known & native.isin(*rules.departments), out(native, "native-dept")))
    steps += [F.when(known & (label == fold(F.lit(a))), out(F.lit(d), "native-alias", native)) for a, d in rules.aliases.items()]
    steps.append(F.when(known & by_label.isNotNull(), out(by_label["dept"], "native-kw", by_label["term"])))
    steps.append(F.when(by_name.isNotNull(), out(by_name["dept"], "name", by_name["term"])))
    return F.coalesce(*steps, out(F.lit(rules.other), "none"))


def leaks(traced: DataFrame, name: str) -> DataFrame:
    """Rows of a classifier's trace (via, term) that a Latin keyword decided by the name though it only stands inside other words there."""
    text, term = fold(F.col(name)), F.trim("term")
    quoted = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    whole = F.regexp_like(text, F.concat(F.lit("(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)")))
    return traced.where((F.col("via") == "name") & term.rlike("^[a-z0-9 ]+$") & text.contains(term) & ~whole)


# Patterns of drinks and breakfast goods over folded names; a Latin word that must end is followed by no ASCII word character.
_END = r"(?!\w)"
_WATER = "νερο|water|εμφιαλωμεν|μεταλλικο|επιτραπεζιο"
_SOFT = "αναψυκ|cola|coca|pepsi|fanta|sprite|σοδα|soda|tonic|λεμοναδ|πορτοκαλαδ|γκαζοζ|energy drink|red bull|monster|powerade|schweppes"
_COFFEE = "καφε|coffee|nescafe|espresso|nespresso|καπουτσιν|φραπε"
_JUICE = "χυμο|νεκταρ|φρουτοποτο"
_TEA = f"τσαι|tea{_END}|κακαο|cacao|ροφημα"
_ALCOHOL = f"μπυρ|μπιρ|κρασι|οινο|wine|ουζο|τσιπουρ|βοτκ|vodka|ουισκ|whisk|τζιν|gin{_END}|ρουμι|rum{_END}|λικερ|σαμπαν|prosecco|ρετσιν|μηλιτ|somersby"
_BEER = f"μπυρ|μπιρ|beer|lager|pils|weiss|ale{_END}|stout|μηλιτ|cider|somersby"
_WINE = "κρασι|οινο|wine|σαμπαν|prosecco|αφρωδ|ρετσιν|ροζε"
_SPIRITS = f"ουζο|τσιπουρ|βοτκ|vodka|ουισκ|whisk|τζιν|gin{_END}|ρουμι|rum{_END}|λικερ|tequila|aperitif|brandy|κονιακ"
_GROUPS = {
    PERSONAL: ("personal", (("hair", f"μαλλ|σαμπουαν|conditioner|hair|λακ{_END}|βαφ"), ("oral", "στομα|οδοντ|tooth|mouth"), ("feminine", "σερβιετ|ταμπον|γυναικ|intim"), ("shaving", "ξυρ|after shave|ανδρ|shav"), ("face", "προσωπ|μακιγιαζ|makeup|μασκα|serum"), ("body", f"σωμα|αφρολουτρ|σαπουν|αποσμητ|κρεμα|αντηλιακ|sun{_END}")), "personal-other"),
    "Είδη Καθαρισμού & Σπιτιού": ("home", (("laundry", "ρουχ|πλυντηρ|μαλακτικ|σιδερ|laundry"), ("kitchen", "πιατ|κουζιν|λιποκαθαρ|σφουγγαρ|dish"), ("paper", "χαρτ|χαρτο|ρολο|paper|αλουμινοχαρτ|μεμβραν"), ("bathroom", f"μπανιο|τουαλετ|wc{_END}"), ("insect", "εντομ|κουνουπ|κατσαριδ|σκοροκτον"), ("cleaning", "καθαρισ|χλωριν|πατωμ|τζαμι|σκον|clean")), "home-other"),
    "Βρεφικά Είδη": ("baby", (("baby-food", "τροφη|κρεμα|γαλα|γευμα|μπισκοτ|food"), ("diapers", "πανε|diaper|pants|pampers|babylino"), ("wipes", "μωρομαντ|μαντηλ|wipe")), "baby-care"),
    "Είδη Κατοικιδίων": ("pets", (("dogs", "σκυλ|dog|canin"), ("cats", "γατ|cat|feline")), "pets-other"),
}
_COFFEE_KINDS = (("espresso", "espresso|nespresso|καψουλ"), ("greek", "ελληνικ"), ("instant", "στιγμιαι|nescafe|φραπε"), ("filter", "φιλτρ|filter"))


def aisle_key(category: Column, name: Column) -> Column:
    """The shelf of an offer: drinks and breakfast goods are split by name, other departments stay."""
    c, n = F.coalesce(category, F.lit(OTHER)), fold(name)
    drinks = F.when(n.rlike(_ALCOHOL), "alcohol").when(n.rlike(_WATER), "water").when(n.rlike(_SOFT), "soft-drinks").otherwise("drinks-other")
    breakfast = F.when(n.rlike(_COFFEE), "coffee").when(n.rlike(_JUICE), "juice").when(n.rlike(_TEA), "tea").otherwise("breakfast")
    return F.when(c == "Κάβα", drinks).when(c == "Πρωινό & Ροφήματα", breakfast).when(c.isin(*DEPARTMENTS), c).otherwise(OTHER)


def browse_path(category: Column, subcategory: Column, name: Column) -> Column:
    """struct(top, grp, leaf) of a three-level menu."""
    c, n = F.coalesce(category, F.lit(OTHER)), fold(name)
    text = F.concat(fold(subcategory), F.lit(" "), n)
    path = lambda top, grp, leaf=None: F.struct((F.lit(top) if isinstance(top, str) else top).alias("top"), (F.lit(grp) if isinstance(grp, str) else grp).alias("grp"), (F.lit(None).cast("string") if leaf is None else F.lit(leaf) if isinstance(leaf, str) else leaf).alias("leaf"))
    coffee = F.lit("coffee-other")
    for leaf, pattern in reversed(_COFFEE_KINDS):
        coffee = F.when(n.rlike(pattern), leaf).otherwise(coffee)
    drinks = F.when(n.rlike(_BEER), path("drinks", "alcohol", "beer")).when(n.rlike(_WINE), path("drinks", "alcohol", "wine")).when(n.rlike(_SPIRITS), path("drinks", "alcohol", "spirits"))
    drinks = drinks.when(n.rlike(_WATER), path("drinks", "water")).when(n.rlike(_SOFT), path("drinks", "soft-drinks")).otherwise(path("drinks", "drinks-other"))
    breakfast = F.when(n.rlike(_COFFEE), path("drinks", "coffee", coffee)).when(n.rlike(_JUICE), path("drinks", "juice")).when(n.rlike(_TEA), path("drinks", "tea")).otherwise(path("food", "breakfast"))
    out = F.when(c == "Κάβα", drinks).when(c == "Πρωινό & Ροφήματα", breakfast)
    for department, (top, groups, rest) in _GROUPS.items():
        grp = F.lit(rest)
        for key, pattern in reversed(groups):
            grp = F.when(text.rlike(pattern), key).otherwise(grp)
        out = out.when(c == department, path(top, grp))
    foods = [d for d in DEPARTMENTS if d not in (*_GROUPS, "Κάβα", "Πρωινό & Ροφήματα", OTHER)]
    return out.when(c.isin(*foods), path("food", c)).otherwise(path("other", "other"))


def brands_agree(raw: Column, candidate: Column) -> Column:
    """First words agree as written or across alphabets; a missing first word agrees with any."""
    from basketlens.functions.text import to_greek

    first = lambda s: F.regexp_replace(F.split(F.trim(fold(s, final_sigma=True)), r"\s+")[0], "[^a-zα-ω0-9]", "")
    a, b = first(raw), first(candidate)
    latin = lambda s: s.rlike("^[a-z0-9]+$")
    across = F.when(latin(a) & ~latin(b), to_greek(a) == b).when(~latin(a) & latin(b), a == to_greek(b)).otherwise(F.lit(False))
    return (a == "") | (b == "") | (a == b) | across
