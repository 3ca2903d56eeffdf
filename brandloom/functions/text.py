"""Name and composition normalisers as Column expressions, without any UDF.

Patterns carry `(?U)`, so that white space and digits are Unicode's; the
control characters 0x1C to 0x1F count as white space too.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandloom.functions.vocabulary import DEFAULT, Vocabulary

WS = r"[\s\x1C-\x1F]"
_PARENS = r"(?d)\(.*?\)"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{WS}+|{WS}+$", "")


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, rf"(?U){WS}+", " "))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(_squeezed(x), " "), lambda t: t != "")


def _without_tail(tokens: Column, drops, least: int = 0) -> Column:
    """tokens up to the last one that `drops(token, index, tokens)` doesn't drop."""

    def cut(all_: Column) -> Column:
        kept = F.array_max(F.concat(F.array(F.lit(least)), F.transform(all_, lambda t, i: F.when(drops(t, i, all_), F.lit(0)).otherwise(i + 1))))
        return F.slice(all_, F.lit(1), F.least(kept, F.size(all_)))

    return _let(tokens, cut)


def _or_whole(text: Column, drops) -> Column:
    """text without its tail, or all of it where nothing would be left."""

    def choose(s: Column) -> Column:
        return _let(F.array_join(_without_tail(_tokens(s), drops), " "), lambda root: F.when(root == "", s).otherwise(root))

    return _let(text, choose)


def normalise_molecule(raw: Column, keep_salts: bool = False, v: Vocabulary = DEFAULT) -> Column:
    """Lower-case name without trailing salt words, in its international spelling.

    A protected inorganic keeps its salt; at least one word is always kept.
    Null gives an empty string.
    """
    spelling = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in sorted(v.spellings.items())))

    def base(plain: Column) -> Column:
        if keep_salts:
            return plain
        kept = F.array_join(_without_tail(F.split(plain, " "), lambda t, i, _: t.isin(v.salts), 1), " ")
        return F.when(plain.isin(v.protected), plain).otherwise(kept)

    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[^a-z0-9\-/+]+", " "))
    return _let(_let(plain, base), lambda name: F.coalesce(F.try_element_at(spelling, name), name))


def normalise_strength(raw: Column) -> Column:
    """Lower case without white space; null gives an empty string."""
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), rf"(?U){WS}+", "")


def parse_composition(cell: Column, keep_salts: bool = False, v: Vocabulary = DEFAULT) -> Column:
    """struct(molecule, strength) of "Name (qualifier) (strength)", or null.

    The last parenthesis is the strength if it reads like one; all of them
    leave the name. Blank cells and empty names are null.
    """
    last = F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all(cell, F.lit(r"\(([^)]*)\)"), F.lit(1)), F.lit(-1)), F.lit("")), rf"(?U){WS}+", "")
    strength = _let(last, lambda x: F.when(x.rlike(f"(?U)(?i){v.strength}"), F.lower(x)).otherwise(F.lit("")))
    molecule = normalise_molecule(F.regexp_replace(cell, r"\([^)]*\)", " "), keep_salts, v)
    both = _let(F.struct(molecule.alias("molecule"), strength.alias("strength")), lambda p: F.when(p["molecule"] != "", p))
    return F.when(_strip(F.coalesce(cell, F.lit(""))) != "", both)


def brand_root(name: Column, v: Vocabulary = DEFAULT) -> Column:
    """The name without its tail of dosage forms and strengths; null gives ""."""
    s = _strip(F.lower(F.coalesce(name, F.lit(""))))
    s = F.replace(F.replace(s, F.lit("sugar free"), F.lit(" ")), F.lit("sugarfree"), F.lit(" "))
    s = F.regexp_replace(F.regexp_replace(s, _PARENS, " "), r"(?U)[^a-z0-9\s\x1C-\x1F\-/+.]", " ")
    return _or_whole(s, lambda t, i, _: t.isin(v.forms) | t.rlike(f"(?U)(?i){v.strength}"))


def clean_root(name: Column, v: Vocabulary = DEFAULT) -> Column:
    """The stricter root for blocking: digits, variants and cut-off forms go too.

    A token at the tail is dropped if it is a form, a modifier or a strength;
    if it has a digit and is not the first; or if it has one or two letters
    and the token before it would be dropped by the first two rules.
    """
    s = F.regexp_replace(_strip(F.lower(F.coalesce(name, F.lit("")))), _PARENS, " ")
    s = F.regexp_replace(F.regexp_replace(s, f"(?U){v.glue}", "$1$2"), f"(?U){v.chain}", " ")
    s = F.regexp_replace(s, r"(?U)[^a-z0-9\s\x1C-\x1F\-/+.]", " ")
    words = sorted({*v.forms, *v.more_forms, *v.modifiers})

    def soft(t: Column) -> Column:
        return t.isin(words) | t.rlike(f"(?U)(?i){v.cleaner_strength}")

    def drops(t: Column, i: Column, tokens: Column) -> Column:
        before = F.coalesce(F.get(tokens, i - 1), F.lit(""))
        return soft(t) | ((i > 0) & (t.rlike("[0-9]") | (t.rlike("^[a-z]{1,2}$") & (soft(before) | before.rlike("[0-9]")))))

    return _or_whole(s, drops)


def letters_only(root: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(root, F.lit(""))), "[^a-z]", "")


def molecule_signature(molecules: Column) -> Column:
    """Sorted molecules, repeats kept, joined by " + "."""
    return F.array_join(F.array_sort(molecules), " + ")


def full_signature(parts: Column) -> Column:
    """Sorted molecule@strength of an array of structs, joined by " + "."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(p["molecule"], F.lit("@"), p["strength"])), " + ")


def ordered_unique(pairs: Column, key: str) -> Column:
    """Structs whose `key` comes first in the array, in order."""
    keys = F.transform(pairs, lambda p: p[key])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p[key]) == i + 1)
