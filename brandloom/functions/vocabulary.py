"""The word lists and grammars of the normalisers; every one can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

# Salt and hydrate words of molecule names.
SALTS = """
aceponate acetate aluminium anhydrous base besylate bicarbonate bitartrate bromide calcium carbonate chloride citrate
dihydrate dihydrogen dipropionate fumarate furoate gluconate hcl hemihydrate hydrate hydrobromide hydrochloride iodide
lactate magnesium maleate mesylate monohydrate nitrate oxalate palmitate phosphate pivalate potassium propionate sodium
sodiumsalt stearate succinate sulfate sulphate tartrate trihydrate valerate xinafoate zinc
""".split()

# Spellings and the international names they stand for.
SPELLINGS = {
    "acetaminophen": "paracetamol",
    "amoxycillin": "amoxicillin",
    "beclomethasone": "beclometasone",
    "cefixime": "cefixime",
    "cephalexin": "cefalexin",
    "cephradine": "cefradine",
    "chlorpheniramine": "chlorphenamine",
    "dicyclomine": "dicycloverine",
    "frusemide": "furosemide",
    "indomethacin": "indometacin",
    "levosalbutamol": "levosalbutamol",
    "lignocaine": "lidocaine",
    "oestradiol": "estradiol",
    "oestrogen": "estrogen",
    "pcm": "paracetamol",
    "salbutamol": "salbutamol",
    "sulphamethoxazole": "sulfamethoxazole",
    "sulphasalazine": "sulfasalazine",
    "thyroxine": "levothyroxine",
}

# Inorganic names whose salt is the drug.
PROTECTED = [
    "aluminium hydroxide",
    "ammonium chloride",
    "calcium carbonate",
    "calcium chloride",
    "calcium gluconate",
    "calcium lactate",
    "calcium phosphate",
    "disodium hydrogen phosphate",
    "ferrous gluconate",
    "ferrous sulfate",
    "ferrous sulphate",
    "magnesium chloride",
    "magnesium hydroxide",
    "magnesium sulfate",
    "magnesium sulphate",
    "potassium chloride",
    "potassium citrate",
    "sodium acetate",
    "sodium bicarbonate",
    "sodium chloride",
    "sodium citrate",
    "sodium lactate",
    "sodium phosphate",
    "zinc sulfate",
    "zinc sulphate",
]

# Dosage forms at the end of product names.
FORMS = """
ampoule bottle cap caps capsule capsules cream drop drops ear elixir emulsion eye film foam gargle gel granules infusion
inhaler inj injection kit liquid lotion mouthwash nasal ointment oral pack paste patch pessary powder respules rotacaps
sachet sf shampoo soap solution spray strip suppository suspension syrup tab tablet tablets tabs tube vial
""".split()

# Further forms, cut-off forms and fillers that the blocking cleaner drops.
MORE_FORMS = """
cd disin disintegrating dry dusting for gelatin hm inhale injecti injectio new orally orange prolong prolonged soft
softgel spores tangy vagin vaginal wash xt
""".split()

# Release and variant marks that the blocking cleaner drops.
MODIFIERS = "active cr dp dr dry ds dt er fort forte lb ls md mr od plus pr sr total xl xr".split()

# Units of strengths, as regular expressions, before and after the slash.
UNITS = (["mg", "g", "mcg", "ml", "l", "iu", "%", "w/w", "w/v", "meq"], ["mg", "g", "mcg", "ml", "l", "iu", "%"])
CLEANER_UNITS = (["mg", "gm", "g", "mcg", "ml", "l", "iu", "au", "miu", "%", "w/w", "w/v", "meq", "lb"], ["mg", "gm", "g", "mcg", "ml", "l", "iu", "au", "miu", "%", "lb"])
GLUED_UNITS = ["mg", "gm", "mcg", "g", "ml", "l", "iu", "au", "miu", "%", "lb"]


def strength_pattern(units: tuple[list[str], list[str]]) -> str:
    """Number, unit, slash, number, unit; all but the first number may be missing."""
    before, after = ("|".join(u) for u in units)
    amount = r"\d+(\.\d+)?\s*"
    return rf"^{amount}({before})?/?({amount}({after})?)?$"


def chain_pattern(units: list[str]) -> str:
    """Strengths joined by slashes, as in 5mg/500mg/30mg."""
    amount = rf"\d[\d.]*\s*(?:{'|'.join(units)})?"
    return rf"\b{amount}(?:\s*/\s*{amount})+\b"


@dataclass(frozen=True)
class Vocabulary:
    salts: list[str] = field(default_factory=lambda: list(SALTS))
    spellings: dict[str, str] = field(default_factory=lambda: dict(SPELLINGS))
    protected: list[str] = field(default_factory=lambda: list(PROTECTED))
    forms: list[str] = field(default_factory=lambda: list(FORMS))
    more_forms: list[str] = field(default_factory=lambda: list(MORE_FORMS))
    modifiers: list[str] = field(default_factory=lambda: list(MODIFIERS))
    strength: str = strength_pattern(UNITS)
    cleaner_strength: str = strength_pattern(CLEANER_UNITS)
    glue: str = rf"(\d[\d.]*)\s*({'|'.join(GLUED_UNITS)})"
    chain: str = chain_pattern(GLUED_UNITS)


DEFAULT = Vocabulary()
