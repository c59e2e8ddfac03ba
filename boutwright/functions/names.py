"""Person names: normalised and canonical keys, and matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Letters that carry no separable accent, and what they fold to.
SPECIAL = {"ß": "ss", "æ": "ae", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "œ": "oe", "þ": "th", "ı": "i", "ħ": "h"}
#: Generation suffixes that a canonical name leaves out.
SUFFIXES = ("jr", "sr", "junior", "senior", "ii", "iii", "iv", "v", "2nd", "3rd")
#: Short first names and the long form that stands for both.
NICKNAMES = {
    "joe": "joseph", "joey": "joseph", "mike": "michael", "mikey": "michael", "alex": "alexander", "dan": "daniel", "danny": "daniel", "matt": "matthew", "rob": "robert", "bob": "robert", "bobby": "robert", "will": "william",
    "bill": "william", "billy": "william", "nick": "nicholas", "tony": "anthony", "chris": "christopher", "ed": "edward", "eddie": "edward", "ben": "benjamin", "benny": "benjamin", "greg": "gregory", "tom": "thomas", "tommy": "thomas",
    "tim": "timothy", "timmy": "timothy", "dave": "david", "jim": "james", "jimmy": "james", "pat": "patrick", "paddy": "patrick", "sam": "samuel", "sammy": "samuel", "jake": "jacob", "charlie": "charles", "chuck": "charles",
    "dick": "richard", "rick": "richard", "ricky": "richard", "steve": "steven", "stevie": "steven", "nate": "nathaniel", "vince": "vincent", "vinny": "vincent", "len": "leonard", "lenny": "leonard", "andy": "andrew", "drew": "andrew",
    "jack": "john", "johnny": "john", "jon": "john", "kenny": "kenneth", "larry": "lawrence", "marty": "martin", "ray": "raymond", "ronnie": "ronald", "ted": "theodore", "wes": "wesley", "zach": "zachary", "zack": "zachary",
}


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents, and their base letters, by Unicode's own decomposition."""
    pairs = []
    for c in (chr(x) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for x in block):
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def normalise(name: Column) -> Column:
    """Lower case, no accents, words of letters, digits and underscores, single spaces."""

    def folded(x: Column) -> Column:
        s = F.lower(F.translate(F.regexp_replace(x, r"\p{M}+", ""), ACCENTED, PLAIN))
        single = {k: v for k, v in SPECIAL.items() if len(v) == 1}
        s = F.translate(s, "".join(single), "".join(single.values()))
        for k, v in SPECIAL.items():
            s = F.replace(s, F.lit(k), F.lit(v)) if len(v) > 1 else s
        return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", " "))

    # plain letters need none of the folding
    return _let(name, lambda x: F.when(F.length(x) == F.octet_length(x), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9_]+", " "))).otherwise(folded(x)))


@F.pandas_udf(StringType())
def normalise_exact(names: pd.Series) -> pd.Series:
    """As normalise, by full compatibility decomposition and case folding."""
    table = str.maketrans(SPECIAL)

    def one(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        s = s.lower().translate(table).casefold()
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in s).split())

    return names.map(one, na_action="ignore")


def canonical(name: Column, tokens: dict[str, str] | None = None, names: dict[str, str] | None = None) -> Column:
    """Normalised name without generation suffixes, with the long form of the first name, then other spellings of tokens and of whole names."""
    out = _long_form(name)
    if tokens:
        out = F.array_join(F.transform(F.split(out, " "), lambda t: _looked_up(t, tokens)), " ")
    return _looked_up(out, names) if names else out


def _looked_up(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), x)


def _long_form(name: Column) -> Column:
    return long_form(normalise(name))


def long_form(normalised: Column) -> Column:
    """The canonical name of a normalised one."""

    def joined(tokens: Column) -> Column:
        long = _looked_up(F.get(tokens, 0), NICKNAMES)
        return F.when(F.size(tokens) > 0, F.array_join(F.concat(F.array(long), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))), " "))

    return _let(F.filter(F.split(normalised, " "), lambda t: ~t.isin(*SUFFIXES)), joined)


def same_person(a: Column, b: Column) -> Column:
    """Equal or wholly reversed tokens, plain or canonical."""

    def match(x: Column, y: Column) -> Column:
        return (x == y) | (x == F.array_join(F.reverse(F.split(y, " ")), " "))

    return match(normalise(a), normalise(b)) | match(canonical(a), canonical(b))


def appears_in(name: Column, text: Column) -> Column:
    """Whether the name's tokens stand as a run in the text's."""
    return F.concat(F.lit(" "), normalise(text), F.lit(" ")).contains(F.concat(F.lit(" "), normalise(name), F.lit(" "))) & (F.length(normalise(name)) > 0)


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalise(name), " ")), " ")


@F.pandas_udf(BooleanType())
def fuzzy_same(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of 0.92 or more, with both outer tokens alike."""
    from difflib import SequenceMatcher

    ratio = lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio()

    def one(x, y):
        if not x or not y or len(x) < 8 or len(y) < 8 or " " not in x or " " not in y or ratio(x, y) < 0.92:
            return False
        p, q = x.split(), y.split()
        f, s = ratio(p[0], q[0]), ratio(p[-1], q[-1])
        return f == 1 and s >= 0.80 or s == 1 and f >= 0.80 or min(f, s) >= 0.88

    return pd.Series([one(x, y) for x, y in zip(a, b)])
