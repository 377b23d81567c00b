"""Language analysis of texts: stop words out, endings off, per language; for search and for queries alike.

A text's words are written with a space on each side, so that an ending is what stands before a space; each rule then is one
replacement over the whole text, and native. Rules take the longest ending that leaves the stem its least length.
Languages without rules, and null, are ``simple``: the words as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fts_config, sub, tokens

STOP = {
    "english": "a an and are as at be been but by for from had has have he her his i if in into is it its my no not of on or our she so that the their them then there these they this to was we were what when which who will with would you your",
    "german": "aber als am an auch auf aus bei bin bis bist da das dem den der des die du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja mit nach nicht noch nur ob oder ohne sich sie sind so um und uns von vor war wenn wie wir wird zu zum zur über",
    "french": "à au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui ma mais me mes moi ne nos notre nous on ou par pas plus pour qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y",
    "spanish": "a al ante como con de del donde el ella en entre era es esta este fue ha hay la las le les lo los más me mi muy no nos o otra para pero por que se si sin sobre su sus también tan te tu un una uno unos y ya yo",
}
FOLD = {"german": ("äöü", "aou"), "french": ("àâäçéèêëîïôöûùü", "aaaceeeeiioouuu"), "spanish": ("áéíóúü", "aeiouu")}
#: (ending with what stands before it, by what it is replaced), in order.
ENDINGS = {
    "english": (
        (r"([^ ]{2,})sses ", "$1ss "),
        (r"([^ ]{2,})ies ", "$1y "),
        (r"([^ ]{2,}[^su ])s ", "$1 "),
        (r"([^ ]*[aeiouy][^ ]+?)(?:ingly|edly|ing|ed) ", "$1 "),
        ("bb ", "b "), ("dd ", "d "), ("gg ", "g "), ("mm ", "m "), ("nn ", "n "), ("pp ", "p "), ("rr ", "r "), ("tt ", "t "),
        (r"([^ ]{2,}[st])ion(?:al)? ", "$1 "),
        (r"([^ ]{3,}?)(?:fulness|ness|ments|ment|fully|ful|ly) ", "$1 "),
        (r"([^ ]{3,})e ", "$1 "),
        (r"([^ ]{2,})y ", "$1i "),
    ),
    "german": (
        ("ß", "ss"),
        (r"([^ ]{4,}?)(?:ungen|ung|heiten|heit|keiten|keit|lichen|lich) ", "$1 "),
        (r"([^ ]{3,}?)(?:ern|em|er|en|es|e|n) ", "$1 "),
        (r"([^ ]{2,}[bdfghklmnrt])s ", "$1 "),
    ),
    "french": (
        (r"([^ ]{2,})aux ", "$1al "),
        (r"([^ ]{3,}?)(?:issements|issement|ements|ement|ations|ation|ites|ite|euses|euse|eux|ives|ive) ", "$1 "),
        (r"([^ ]{3,}?)(?:eraient|erait|aient|erons|erez|ait|ants|ant|er|ez|ees|ee|es|e|s|x) ", "$1 "),
    ),
    "spanish": (
        (r"([^ ]{3,}?)(?:amientos|amiento|aciones|acion|idades|idad|mente) ", "$1 "),
        (r"([^ ]{3,}?)(?:iendo|ieron|ando|aron|aban|aba|ados|adas|ado|ada|idos|idas|ido|ida|ar|er|ir|os|as|es|o|a|e|s) ", "$1 "),
    ),
}


def stems(words: Column, config: str) -> Column:
    """The words of a language without its stop words, each without its endings; repeats and order stay."""
    if config not in ENDINGS:
        return words
    text = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    text = sub(text, f" (?:{'|'.join(STOP[config].split())}) ", "")
    if config in FOLD:
        text = F.translate(text, *FOLD[config])
    for ending, by in ENDINGS[config]:
        text = sub(text, ending, by) if "(" in ending else F.replace(text, F.lit(ending), F.lit(by))
    return F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))


def terms(text: Column, config: Column) -> Column:
    """Search terms of a text under a configuration such as ``english``; those of languages with rules carry its name."""
    words = tokens(F.coalesce(text, F.lit("")))
    out = words
    for name in ENDINGS:
        named = lambda xs, n=name: F.transform(xs, lambda x: F.concat(F.lit(f"{n}:"), x))
        out = F.when(config == name, named(stems(words, name))).otherwise(out)
    return out


@dataclass(frozen=True)
class ByWord:
    """An analysis in two steps: the words of a text that count, and the one term that each of them has, whatever stands beside it."""

    lang: str = "lang"

    def __call__(self, text: Column) -> Column:
        return terms(text, self.config())

    def config(self) -> Column:
        return fts_config(F.col(self.lang))

    def words(self, text: Column, config: Column) -> Column:
        """The words of a text without its stop words: as many as it has terms."""
        found = tokens(F.coalesce(text, F.lit("")))
        out = found
        for name in ENDINGS:
            stop = STOP[name].split()
            out = F.when(config == name, F.filter(found, lambda x: ~x.isin(stop))).otherwise(out)
        return out

    def term(self, word: Column, config: Column) -> Column:
        """The term of such a word."""
        out = word
        for name in ENDINGS:
            out = F.when(config == name, F.concat(F.lit(f"{name}:"), F.get(stems(F.array(word), name), 0))).otherwise(out)
        return out


def analyser(lang: str = "lang") -> Callable[[Column], Column]:
    """For ``retrieval``: analyses each row by the language code in a column."""
    return ByWord(lang)


def sql(words: str, config: str) -> str:
    """``stems`` as DuckDB SQL over a list of words."""
    text = f"' ' || array_to_string({words}, '  ') || ' '"
    text = f"regexp_replace({text}, ' (?:{'|'.join(STOP[config].split())}) ', '', 'g')"
    if config in FOLD:
        text = f"translate({text}, '{FOLD[config][0]}', '{FOLD[config][1]}')"
    for ending, by in ENDINGS[config]:
        text = f"regexp_replace({text}, '{ending}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return f"regexp_extract_all({text}, '[^ ]+')"
