"""Parsing and comparing of names typed by people."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Titles and suffixes that belong to no name, and words that make a name an organisation.
TITLES = frozenset("dr mr mrs ms miss prof sir dame".split())
SUFFIXES = frozenset("cfa cpa phd md mba jr sr ii iii iv esq frm caia".split())
ORGANISATION = {
    "research": "research", "rsch": "research", "res": "research", "group": "group", "grp": "group", "capital": "capital", "cap": "capital", "cptl": "capital", "partners": "partners", "ptnrs": "partners", "prtnrs": "partners",
    "securities": "securities", "secs": "securities", "sec": "securities", "advisory": "advisory", "advisors": "advisors", "advs": "advisors", "adv": "advisory", "advisers": "advisors", "bank": "bank", "bk": "bank", "markets": "markets", "mkts": "markets",
    "equity": "equity", "eqty": "equity", "eq": "equity", "institutional": "institutional", "instl": "institutional", "inst": "institutional", "holdings": "holdings", "hldgs": "holdings", "hldg": "holdings", "company": "company", "co": "company",
    "corporation": "corporation", "corp": "corporation", "incorporated": "incorporated", "inc": "incorporated", "limited": "limited", "ltd": "limited", "llc": "llc", "llp": "llp", "plc": "plc", "associates": "associates", "assoc": "associates", "assocs": "associates",
    "management": "management", "mgmt": "management", "mgt": "management", "asset": "asset", "assets": "asset", "investments": "investments", "invs": "investments", "invts": "investments", "investment": "investments", "international": "international", "intl": "international",
    "financial": "financial", "fin": "financial", "fincl": "financial", "services": "services", "svcs": "services", "svc": "services", "street": "street", "trust": "trust", "tr": "trust", "fund": "fund", "funds": "fund", "analytics": "analytics", "strategies": "strategies",
    "and": "and", "the": "the", "of": "of", "for": "for", "systems": "systems", "sys": "systems", "industries": "industries", "inds": "industries", "ind": "industries", "brothers": "brothers", "bros": "brothers", "national": "national", "natl": "national", "first": "first",
    "global": "global", "glbl": "global", "technologies": "technologies", "tech": "technologies", "department": "department", "dept": "department", "association": "association", "assn": "association",
    "investor": "investor", "inv": "investor", "relations": "relations", "rels": "relations", "rel": "relations", "equities": "equities", "ventures": "ventures", "wealth": "wealth", "insurance": "insurance", "ins": "insurance", "communications": "communications", "comms": "communications",
}
_STRONG = frozenset(
    "research group capital partners securities advisory advisors bank markets equity institutional holdings company corporation incorporated limited llc llp plc associates management investments international financial services trust fund strategies systems industries technologies analytics department association relations equities ventures wealth insurance communications".split()
)
_LONG_STRONG = frozenset(w for w in _STRONG if len(w) > 6)
# Words that an organisation's name may have or lack.
LOOSE_WORDS = frozenset("the llc llp limited incorporated plc corporation company".split())

# Given names and their short forms.
NICKNAMES = {
    "alexandra": "alex lexi sandra sasha", "alexander": "alex xander sasha", "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate cat", "charlotte": "charlie lottie char lotte", "christopher": "chris topher kit", "christine": "chris tina",
    "daniel": "dan danny", "deborah": "deb debbie debby debra", "edward": "ed eddie ted ned", "elizabeth": "liz beth eliza betty lizzie libby betsy bess ellie", "frederick": "fred freddie freddy fritz rick", "gabriel": "gabe", "gregory": "greg", "henrietta": "hattie hettie hetty etta hen henri", "henry": "harry hank",
    "isabella": "bella belle izzy isa isabel", "jacob": "jake", "james": "jim jimmy jamie", "javier": "javi", "jennifer": "jen jenny jenn jennie", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon john jonny nathan", "joseph": "joe joey jo", "joshua": "josh",
    "katherine": "kate kathy katie kat kay kit kitty", "kenneth": "ken kenny", "lawrence": "larry laurie lance", "leonard": "len leo lenny", "margaret": "maggie meg peg peggy marge margie madge greta", "matthew": "matt matty", "mateo": "teo", "michael": "mike mick mickey", "nathaniel": "nate nat nathan natty",
    "nicholas": "nick nicky nico", "oliver": "ollie olly", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "quentin": "quin quent", "rajesh": "raj", "rebecca": "becky becca beck", "richard": "rich rick dick richie ricky",
    "robert": "rob bob bobby robbie", "ronald": "ron", "samantha": "sam sammy", "samuel": "sam sammy", "stephen": "steve", "steven": "steve", "susannah": "sue susie suzie suzy sanna anna susan", "susan": "sue susie", "theodore": "ted theo", "thomas": "tom tommy", "timothy": "tim timmy",
    "victoria": "vicky tori vic vicki", "vincent": "vince", "walter": "walt wally", "william": "will bill billy willie liam", "xiomara": "xio mara", "yolanda": "yoli yo", "zachary": "zach zack zac", "ingrid": "inge", "priya": "pri", "dominic": "dom", "andrew": "andy drew", "valentina": "val tina", "gregor": "greg",
}
FULL = {}
for _full, _short in NICKNAMES.items():
    FULL.setdefault(_full, set()).add(_full)
    for _s in _short.split():
        FULL.setdefault(_s, set()).add(_full)


class Name(NamedTuple):
    """given: full given name or ''; initials: of the given names; surname; firm: the words of an organisation."""

    given: str
    initials: str
    surname: str
    firm: tuple[str, ...] = ()


def plain(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _organisation_word(w: str) -> str | None:
    """The full form of a word that makes a name an organisation, also with one mistaken letter in a long one."""
    full = ORGANISATION.get(w)
    if full in _STRONG:
        return full
    if len(w) > 5 and full is None:
        return next((x for x in _LONG_STRONG if abs(len(x) - len(w)) < 2 and distance(x, w, 1) <= 1), None)
    return None


@lru_cache(maxsize=100_000)
def parse(text: str) -> Name | None:
    """A typed name's parts; None where it has no letters. Affiliations, titles, degrees and case are left out,
    "Last, First" is turned round, and words of organisations are written in full."""
    body = text.strip()
    cut = re.match(r"^(.*?\S)\s*(?:\(.*|\s[-–—]{1,2}\s.*)$", body)
    if cut:
        body = cut[1]
    words = re.findall(r"[^\W\d_][\w'’]*\.?|,", body)
    low = [plain(w.strip(".")) for w in words]
    while low and low[0] in TITLES:
        words, low = words[1:], low[1:]
    while low and (low[-1] in SUFFIXES or low[-1] == ","):
        words, low = words[:-1], low[:-1]
    if not low:
        return None
    # "IR" behind a name is short for two words.
    if len(low) > 1 and "ir" in low[1:]:
        low = [x for w in low for x in (("investor", "relations") if w == "ir" else (w,))]
    if len(low) > 1 and any(_organisation_word(w) for w in (low if "," in low else low[1:])):
        full = tuple(_organisation_word(w) or ORGANISATION.get(w, w) for w in low if w != ",")
        return Name("", "", "", tuple(w for w in full if w not in LOOSE_WORDS) or full)
    if "," in low:
        k = low.index(",")
        low, words = low[k + 1 :] + low[:k], words[k + 1 :] + words[:k]
        low, words = [w for w in low if w != ","], [w for w in words if w != ","]
        if not low:
            return None
        turned = True
    else:
        turned = False
    # A single run such as "AlexandraDicharthorri" is two names without their space.
    if len(words) == 1 and (m := re.match(r"^([A-ZÀ-Þ][a-zß-ÿ]+)([A-ZÀ-Þ][a-zß-ÿ']+)$", words[0])) and plain(m[1]) not in ("mc", "mac", "de", "di", "la", "le", "van", "von"):
        low = [plain(m[1]), plain(m[2])]
    if len(low) == 1:
        return Name("", "", low[0])
    short = lambda w: len(w) == 1
    if not turned and all(short(w) for w in low[1:]) and not short(low[0]):
        low = low[1:] + low[:1]  # "Last F." and "Last F M"
    surname = low[-1]
    given = next((w for w in low[:-1] if not short(w)), "")
    return Name(given, "".join(w[0] for w in low[:-1]), surname)


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, a swap of neighbours being one; most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if before2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def allowed(n: int) -> int:
    """Edits that a name part of n letters may have."""
    return 0 if n < 4 else 1 if n < 9 else 2


def slip(a: str, b: str) -> bool:
    """Whether a short name part is another with a letter added, dropped or swapped with its neighbour, which is all that
    may happen to it; another letter makes it another name."""
    return 1 < min(len(a), len(b)) < 4 and distance(a, b, 1) == 1 and (len(a) != len(b) or sorted(a) == sorted(b))


def given_cost(a: Name, b: Name) -> float:
    """How far two persons' given names are apart: 0 the same, 9 certainly different."""
    if not a.initials or not b.initials:
        return 0.6
    if not a.given or not b.given:
        one, two = (a, b) if not a.given else (b, a)
        if not two.given:
            n = min(len(a.initials), len(b.initials))
            return 0.3 if a.initials[:n] == b.initials[:n] else 9.0
        if one.initials[0] != two.given[0] and all(one.initials[0] != f[0] for f in FULL.get(two.given, ())):
            return 9.0
        # All initials that both have must agree.
        n = min(len(one.initials), len(two.initials))
        return 9.0 if one.initials[1:n] != two.initials[1:n] else 0.2 if n > 1 else 0.3
    if a.given == b.given:
        return 0.0
    if FULL.get(a.given, {a.given}) & FULL.get(b.given, {b.given}):
        return 0.1
    k = 1 if max(len(a.given), len(b.given)) > 3 else 0
    return 0.5 if k and distance(a.given, b.given, k) <= k else 9.0


def _firm_cost(a: list[str], b: list[str]) -> float:
    if a == b:
        return 0.0
    if len(a) != len(b):
        return 9.0
    left = [w for w in a if w not in b]
    right = [w for w in b if w not in a]
    return 0.5 if len(left) == len(right) == 1 and min(len(left[0]), len(right[0])) > 3 and distance(left[0], right[0], 1) <= 1 else 9.0


@lru_cache(maxsize=100_000)
def cost(a: Name, b: Name) -> float:
    """How far two names are apart; from 5 on they are different persons."""
    if a.firm and b.firm:
        return _firm_cost(sorted(a.firm), sorted(b.firm))
    if a.firm or b.firm:
        # A lone word may be the organisation's own name.
        firm, other = (a.firm, b) if a.firm else (b.firm, a)
        own = [w for w in firm if w not in ORGANISATION]
        return 0.6 if not other.initials and any(distance(w, other.surname, 1) <= (len(w) > 3) for w in own) else 9.0
    best = 9.0
    for x, y in ((a, b), (a, Name(b.surname, b.surname[:1], b.given)) if b.given else (a, b), (Name(a.surname, a.surname[:1], a.given), b) if a.given else (a, b)):
        k = allowed(min(len(x.surname), len(y.surname)))
        d = distance(x.surname, y.surname, k)
        if d <= k:
            best = min(best, given_cost(x, y) + 0.5 * d)
        elif x.given and x.given == y.given and slip(x.surname, y.surname):
            best = min(best, 1.0)
    return best


@lru_cache(maxsize=20_000)
def soundex(word: str) -> str:
    """The phonetic block of a word: its first letter and three digits for its consonants."""
    codes = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
    out, last = word[:1], codes.get(word[:1], "")
    for c in word[1:]:
        d = codes.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


def assign(costs: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least total cost (Kuhn-Munkres with potentials); rows <= columns."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
