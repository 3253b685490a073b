"""Russian stems as column expressions, after the published Snowball description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
VOWELS = "аеиоуыэюя"
GERUND_AFTER_A = "в вши вшись"
GERUND = "ив ивши ившись ыв ывши ывшись"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_AFTER_A = "ем нн вш ющ щ"
PARTICIPLE = "ивш ывш ующ"
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _any(words: str, after_a: str = "") -> str:
    """Pattern of these endings, or of ``after_a`` where a letter of that kind stands before."""
    free = words.replace(" ", "|")
    return f"(?:{free}|(?<=[ая])(?:{after_a.replace(' ', '|')}))" if after_a else f"(?:{free})"


_GERUND = _any(GERUND, GERUND_AFTER_A) + "$"
_ADJECTIVE = _any(PARTICIPLE, PARTICIPLE_AFTER_A) + "?" + _any(ADJECTIVE) + "$"
_VERB = _any(VERB, VERB_AFTER_A) + "$"
_NOUN = _any(NOUN) + "$"
_QUALITY = f"^([{VOWELS}]*[^{VOWELS}].*[{VOWELS}][^{VOWELS}].*)ость?$"


def _cut(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def _first_cut(text: Column, *patterns: str) -> Column:
    """The text without the ending of the first pattern that finds one."""
    out = text
    for p in reversed(patterns):
        out = F.when(text.rlike(p), _cut(text, p)).otherwise(out)
    return out


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words; words without a Cyrillic letter stay, null stays null.

    Endings are looked for behind the first vowel only. Each step is a pass over the array, so that
    no step is evaluated more than once a word; arrays without Cyrillic letters take none.
    """
    head = f"^[^{VOWELS}]*[{VOWELS}]"

    def step(of: Column, change) -> Column:
        return F.transform(of, lambda w: F.struct(w["head"].alias("head"), change(w["tail"]).alias("tail")))

    russian = F.transform(words, lambda w: F.translate(w, "ё", "е"))
    split = F.transform(russian, lambda w: F.struct(F.regexp_extract(w, head, 0).alias("head"), F.when(w.rlike(head), _cut(w, head)).otherwise(F.lit("")).alias("tail"), w.alias("word")))
    out = F.transform(split, lambda w: F.struct(F.when(w["head"] == "", w["word"]).otherwise(w["head"]).alias("head"), w["tail"].alias("tail")))
    out = step(out, lambda t: F.when(t.rlike(_GERUND), F.concat(_cut(t, _GERUND), F.lit("\x00"))).otherwise(_cut(t, "(?:ся|сь)$")))
    out = step(out, lambda t: F.when(t.endswith("\x00"), _cut(t, "\x00$")).otherwise(_first_cut(t, _ADJECTIVE, _VERB, _NOUN)))
    out = step(out, lambda t: _cut(_cut(t, "и$"), _QUALITY, "$1"))
    out = step(out, lambda t: F.when(t.endswith("ь"), _cut(t, "ь$")).otherwise(_cut(_cut(t, "ейше?$"), "нн$", "н")))
    stemmed = F.transform(out, lambda w: F.concat(w["head"], w["tail"]))
    return F.when(F.exists(words, lambda w: w.rlike("[а-яё]")), stemmed).otherwise(words)
