"""English stems (the Snowball "English" rules) and stop words, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a text search leaves out.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now",
]

# The stemmer's exceptions and endings. Of the endings that fit, the longest counts.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STARTS = ["gener", "commun", "arsen"]
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "logi": "log",
}
LI_AFTER = "cdeghkmnrt"
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]

#: A run of letters and digits, or a number with points.
WORD = r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"
REGION = r"^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_END = r"[^aeiouy][aeiouy][^aeiouwxyY]$|^[aeiouy][^aeiouy]$"
DOUBLE = r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(w: Column, ending: str, put: str = "") -> Column:
    return F.concat(F.left(w, F.length(w) - len(ending)), F.lit(put))


def _longest(endings: list[str]) -> list[str]:
    return sorted(endings, key=lambda e: (-len(e), e))


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Letters other than aeiouy count as consonants; null stays null."""

    def first_letters(w: Column) -> Column:
        """A y at the start or after a vowel is a consonant and is written Y until the end."""
        return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y")

    def plural(w: Column) -> Column:
        short = F.length(w) <= 4
        return (
            F.when(w.endswith("sses"), _cut(w, "es")).when(w.rlike("ie[ds]$"), F.when(short, F.left(w, F.length(w) - 1)).otherwise(F.left(w, F.length(w) - 2)))
            .when(w.rlike("(us|ss)$"), w).when(w.rlike("[aeiouy].+s$"), _cut(w, "s")).otherwise(w)
        )

    def region(w: Column) -> Column:
        own = F.length(F.regexp_extract(w, "^(" + "|".join(STARTS) + ")", 1))
        return F.when(own > 0, own).otherwise(_region_after(w, F.lit(0)))

    def _region_after(w: Column, at: Column) -> Column:
        found = F.length(F.regexp_extract(F.substr(w, at + 1), REGION, 0))
        return F.when(found > 0, at + found).otherwise(F.length(w))

    def past(w: Column, r1: Column) -> Column:
        eed = F.regexp_extract(w, "(eed|eedly)$", 1)
        plain = F.regexp_extract(w, "[aeiouy].*?(ingly|edly|ing|ed)$", 1)

        def mended(x: Column) -> Column:
            short = x.rlike(SHORT_END) & (F.length(x) <= r1)
            return F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(DOUBLE), F.left(x, F.length(x) - 1)).when(short, F.concat(x, F.lit("e"))).otherwise(x)

        held = F.when(F.length(w) - F.length(eed) >= r1, F.concat(F.left(w, F.length(w) - F.length(eed)), F.lit("ee"))).otherwise(w)
        bare = F.left(w, F.length(w) - F.length(plain))
        return F.when(eed != "", held).when((plain != ""), F.when(F.length(plain) > 0, _let(bare, mended))).otherwise(w)

    def last_y(w: Column) -> Column:
        return F.regexp_replace(w, "(?<=.[^aeiouy])[yY]$", "i")

    def second(w: Column, r1: Column) -> Column:
        out, inside = F.when(F.lit(False), w), lambda e: F.length(w) - len(e) >= r1
        for e in _longest([*SECOND, "li"]):
            if e == "li":
                out = out.when(w.endswith("li"), F.when(inside("li") & w.rlike(f"[{LI_AFTER}]li$"), _cut(w, "li")).otherwise(w))
            elif e == "logi":  # the ending is ogi, after an l
                out = out.when(w.endswith(e), F.when(inside("ogi"), _cut(w, "ogi", "og")).otherwise(w))
            else:
                out = out.when(w.endswith(e), F.when(inside(e), _cut(w, e, SECOND[e])).otherwise(w))
        return out.otherwise(w)

    def third(w: Column, r1: Column, r2: Column) -> Column:
        out = F.when(F.lit(False), w)
        for e in _longest([*THIRD, "ative"]):
            inside = F.length(w) - len(e) >= (r2 if e == "ative" else r1)
            out = out.when(w.endswith(e), F.when(inside, _cut(w, e, THIRD.get(e, ""))).otherwise(w))
        return out.otherwise(w)

    def fourth(w: Column, r2: Column) -> Column:
        out = F.when(F.lit(False), w)
        for e in _longest([*FOURTH, "ion"]):
            inside = F.length(w) - len(e) >= r2
            out = out.when(w.endswith(e), F.when(inside & (w.rlike("[st]ion$") if e == "ion" else F.lit(True)), _cut(w, e)).otherwise(w))
        return out.otherwise(w)

    def fifth(w: Column, r1: Column, r2: Column) -> Column:
        at = F.length(w) - 1
        short = F.left(w, at).rlike(SHORT_END)
        return F.when(w.endswith("e") & ((at >= r2) | ((at >= r1) & ~short)), F.left(w, at)).when(w.endswith("ll") & (at >= r2), F.left(w, at)).otherwise(w)

    def stemmed(y: Column) -> Column:
        r1 = region(y)
        return _let(r1, lambda a: _let(_region_after(y, a), lambda b: _let(plural(y), lambda p: F.when(p.isin(UNCHANGED), p).otherwise(
            _let(_let(past(p, a), last_y), lambda q: _let(second(q, a), lambda r: _let(third(r, a, b), lambda s: _let(fourth(s, b), lambda t: fifth(t, a, b)))))
        ))))

    whole = F.when(F.lit(False), word)
    for k, v in WHOLE_WORDS.items():
        whole = whole.when(word == k, F.lit(v))
    return whole.when(F.length(word) <= 2, word).otherwise(F.regexp_replace(_let(first_letters(word), stemmed), "Y", "y"))


def words_of(text: Column) -> Column:
    """Lower-case words and numbers of a text in order; their places from 1 are the positions of a text search."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)
