"""Small tables and plain models for the corpus operators' tests."""

import random

WORDS = {
    "en": "the of and to in is that with from shore under bright river stone market".split(),
    "de": "der die und nicht mit von über straße schön wasser zeit haus grün jahr weg".split(),
    "fr": "le la des et une pour avec être déjà maison fenêtre garçon école rivière jour".split(),
    "es": "el los que de para con niño señal ciudad corazón mañana tierra camino luz año".split(),
}


def prose(r: random.Random, lang: str, n: int) -> str:
    out = []
    while len(out) < n:
        k = r.randint(4, 12)
        out += [r.choice(WORDS[lang]) for _ in range(k)]
        out[-1] += "."
    return " ".join(out[:n])


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def row(i, text, lang=None):
    return (i, text, lang, "src", None if text is None else len(text))


ODD = [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "123 !!! 456"), row(5, "é"), row(6, "word " * 30_000), row(7, "same text here twice over."), row(7, "same text here twice over."), row(None, "no id at all, but a text.")]
