"""What a dish is on a menu: a counted dish, or a dessert, condiment or staple beside it.

The rules are a chain of expressions over the folded section and name, evaluated in order; the first that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import stored

from .text import fold_text

# Names of sections, and words of dishes, written without accents.
DESSERT_SECTIONS = r"\bdesserts?\b|\bsweets\b|\bpuddings?\b|\bdolci\b|\bnagerecht|\bpostres?\b|\bpatisserie\b|\bsomething sweet\b|\bsweet treats?\b|^to finish$|^afters$"
CONDIMENT_SECTIONS = r"^(house\s+|extra\s+)?(sauces?|dips?|condiments?)$|^(create|build|make)\s+your\s+own$|^toppings?$|^add[-\s]?ons?$"
NIBBLE_SECTIONS = r"^(nibbles?|snacks?|bites?|bar\s+(snacks?|bites?)|para\s+picar|pinxtos?|pintxos?|aperitivos?)(\s*[&+/]\s*\w+)?$"
DESSERTS = ["cheesecake", "ice cream", "sorbet", "gelato", "panna cotta", "tiramisu", "baklawa", "baklava", "gulab jamun", "kulfi", "posset", "brownie", "affogato", "creme brulee", "cannolo", "cannoli", "semifreddo", "pavlova", "parfait", "sticky toffee", "kheer", "malabi", "profiterole", "macaron"]
CONDIMENTS = ["mayo", "mayonnaise", "aioli", "ketchup", "bearnaise", "chimichurri", "chilli oil", "chili oil", "gravy", "chutney", "raita", "vinaigrette", "zhug", "amba", "harissa", "pesto dip"]
STAPLES = ["white rice", "basmati rice", "steamed rice", "plain rice", "pulao rice", "house rice", "boiled rice", "naan", "roti", "paratha", "parantha", "chapati", "papadum", "poppadom", "bread & butter", "bread and butter", "bread + butter", "bread basket", "breadbasket", "sourdough", "focaccia", "foccacia", "crackers", "extra pita", "fried pita bites", "pita bites", "olives", "almond", "chips", "fries"]
BARE_STAPLE = r"^(rice|bread|pita|naan|chips|fries|olives)$"
BARE_POTATO = r"^(potatoes?|mash|mashed potatoes?)$"
POTATO_TAIL = r"\b(potato|potatoes|mash|fries|chips)$"
TANDOOR_TAIL = r"\b(naans?|nan|rotis?|parathas?|paranthas?|chapatis?|papadums?|poppadoms?)$"
BREAD_TAIL = r"\b(breads?|flatbreads?|sourdough|focaccias?|foccacia|toast)$"
BREAD_AND_BUTTER = r"\b(breads?|sourdough|focaccias?|foccacia|toast)\b[^,]*(?:and|&|\+|with)[^,]*\bbutter\b"
SEASONING = r"\b(butter|mayo|mayonnaise|aioli|oils?|sauces?|creams?|gravy|dressing|vinaigrette|salt|herbs?|rosemary|thyme|truffle|garlic|parsley|chives?|skins?)\b"
ADD_ON = r"^(\+|(?:extra|side of|add|add[-\s]?on|additional|topping)\b)"  # a leading + counts whatever follows it


def _parts(text: Column) -> Column:
    """What commas, signs, `and` and `with` join."""
    return F.filter(F.transform(F.split(text, r"[,&+/]|\bwith\b|\band\b"), F.trim), lambda p: p != "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def _first_of(text: Column, words: list[str]) -> Column:
    """The first word of the list that the text contains."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def _verdict(role: str, rule: Column | str | None, ambiguous: bool = False) -> Column:
    rule = rule if isinstance(rule, Column) else F.lit(rule).cast("string")
    return F.struct(F.lit(role).alias("role"), rule.alias("rule"), F.lit(ambiguous).alias("ambiguous"))


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once and can be named any number of times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dish_role(section: Column, name: Column) -> Column:
    """struct<role, rule, ambiguous>; an ambiguous verdict is left to the price.

    What several rules look at is bound step by step, so it stands once in the plan and is worked out once, in filters too.
    """
    texts = F.struct(fold_text(section).alias("section"), fold_text(name).alias("name"))
    return _let(texts, lambda t: _let(_cut(t), lambda x: _let(_ends(x), lambda y: _decide(t, x, y))))


def _cut(t: Column) -> Column:
    """What stands before the first `with` or `in`, in parts; what follows it; and the parts of the whole name."""
    pieces = F.split(t["name"], r"\bwith\b|\bin\b")

    def parted(p: Column) -> Column:
        lead = F.trim(F.element_at(p, 1))
        rest = F.trim(F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), " "))
        return F.struct(_parts(F.when(lead == "", t["name"]).otherwise(lead)).alias("parts"), F.when(F.size(p) > 1, rest).otherwise("").alias("beside"), _parts(t["name"]).alias("whole"))

    return _let(pieces, parted)


def _ends(x: Column) -> Column:
    """The first and last part of the lead, and the head of the whole name."""
    end = lambda i: F.coalesce(F.try_element_at(x["parts"], F.lit(i)), F.lit(""))
    return F.struct(end(1).alias("first"), end(-1).alias("last"), F.try_element_at(x["whole"], F.lit(1)).alias("head"))


def _decide(t: Column, x: Column, y: Column) -> Column:
    """The chain of rules. t: section, name; x: parts, beside, whole; y: first, last, head."""
    section, name, parts, beside, last = t["section"], t["name"], x["parts"], x["beside"], y["last"]
    head = F.coalesce(y["head"], name)
    potato = lambda p: (_words(p) >= 2) & (_words(p) <= 4) & p.rlike(POTATO_TAIL)
    place = F.when(potato(y["first"]), 0).when(potato(last), F.size(parts) - 1).otherwise(-1)
    others = lambda at: F.forall(F.transform(parts, lambda p, i: (i == at) | p.rlike(SEASONING)), lambda ok: ok)
    only_potato = _let(place, lambda at: (at >= 0) & ((beside == "") | beside.rlike(SEASONING)) & others(at))
    named = lambda text, word: F.concat(F.lit(text + ' "'), word, F.lit('"'))
    found = lambda text, words, role, told: _let(_first_of(text, words), lambda w: F.when(w.isNotNull(), _verdict(role, named(told, w))))
    counted, long = _verdict("counted", None), _words(last) >= 2
    rules = [
        F.when(name == "", counted),
        F.when(section.rlike(DESSERT_SECTIONS), _verdict("dessert", "dessert section")),
        F.when(section.rlike(CONDIMENT_SECTIONS), _verdict("condiment", "sauce/dip section")),
        F.when(name.rlike(BARE_POTATO) | only_potato, _verdict("staple", "potatoes on their own")),
        F.when(long & last.rlike(TANDOOR_TAIL), _verdict("staple", 'named "… naan/roti"')),
        F.when(name.rlike(BREAD_AND_BUTTER), _verdict("staple", "bread & butter")),
        F.when(long & last.rlike(BREAD_TAIL), _verdict("staple", 'named "… bread"', True)),
        F.when((F.size(x["whole"]) > 3) | (_words(name) > 5), counted),
        found(name, DESSERTS, "dessert", "dish name:"),
        F.when(name.rlike(ADD_ON), _verdict("condiment", 'add-on ("extra…"/"side of…")')),
        found(head, CONDIMENTS, "condiment", "named"),
        F.when(name.rlike(r"\bsauces?$") & (_words(name) <= 4), _verdict("condiment", 'named "… sauce"', True)),
        F.when(head.rlike(BARE_STAPLE), _verdict("staple", named("bare", head))),
        found(head, STAPLES, "staple", "named"),
        F.when(section.rlike(NIBBLE_SECTIONS), _verdict("counted", None, True)),
    ]
    return F.coalesce(*rules, counted)


#: Bytes of distinct verdicts up to which they go to every task.
SENT = 64 << 20


def with_dish_role(df: DataFrame, section: str, name: str, into: str = "verdict") -> DataFrame:
    """df with the role of each dish. Menus repeat their words, so each distinct (section, name) is judged once and written.

    Verdicts of up to SENT bytes go to every task, so df's rows stay where they are; more meet the rows in a join, which can be
    split where many dishes share a name.
    """
    said = df.select(F.col(section).alias("_section"), F.col(name).alias("_name")).distinct()
    told = stored(said.withColumn(into, dish_role(F.col("_section"), F.col("_name"))), "roles")
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    small = (told.agg(F.sum(size("_section") + size("_name") + 128)).first()[0] or 0) <= SENT
    same = F.col(section).eqNullSafe(F.col("_section")) & F.col(name).eqNullSafe(F.col("_name"))
    return df.drop(into).join(F.broadcast(told) if small else told, same, "left").drop("_section", "_name")
