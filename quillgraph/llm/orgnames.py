"""What a typed organisation name says: its own words, the kind of organisation, legal form and given name."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

# Words that say what kind of organisation it is, with their usual abbreviations.
KINDS = {
    "council": "cncl cl coun", "city": "", "county": "cnty", "borough": "boro", "district": "dist", "parish": "", "town": "", "nhs": "", "foundation": "fdn found",
    "trust": "tr trst", "integrated": "integ", "care": "", "board": "bd", "housing": "hsg hous", "association": "assoc assn ass", "college": "coll", "further": "furth",
    "education": "educ edu", "fire": "", "rescue": "resc", "authority": "auth", "primary": "prim", "school": "sch", "combined": "comb", "academy": "acad",
    "university": "univ uni", "hospital": "hosp", "police": "", "service": "", "environmental": "env environ", "consulting": "cons consult", "training": "trng train",
    "development": "dev devt", "electrical": "elec elect", "installations": "inst install", "facilities": "facs", "management": "mgmt mgt", "building": "bldg",
    "contractors": "contrs contr", "highways": "hways hwys", "maintenance": "maint mtce", "catering": "cater", "services": "svcs serv servs svc", "transport": "transp trans",
    "architecture": "arch archit", "studio": "st stud", "security": "sec secur", "software": "sw", "systems": "sys syst", "medical": "med", "supplies": "supp suppl",
    "legal": "leg", "partners": "ptnrs prtnrs ptrs", "recruitment": "recruit recruitmt recr", "engineering": "eng engrg engr", "furniture": "furn furnit",
}
ACRONYMS = {
    "ft": "foundation trust", "icb": "integrated care board", "ha": "housing association", "fe": "further education", "fra": "fire rescue authority", "bc": "borough council",
    "dc": "district council", "cc": "county council", "fm": "facilities management", "ca": "combined authority",
}
LEGAL = {"ltd": "ltd", "limited": "ltd", "plc": "plc", "llp": "llp", "cic": "cic"}
LONG_LEGAL = {"public limited company": "plc", "limited liability partnership": "llp", "community interest company": "cic"}
ASIDE = ["commercial dept", "commercial department", "procurement team", "corporate procurement", "procurement dept", "sole trader", "finance dept", "accounts payable", "head office"]
CONNECT = set("the of and for at in".split())
TITLES = set("mr mrs ms miss mx dr sir prof".split())
GIVEN = {
    "william": "will bill billy willy wm", "richard": "rich rick dick richie", "edward": "ed eddie ted ned", "robert": "rob bob bobby robbie", "margaret": "maggie meg peggy marge",
    "anthony": "tony ant", "katherine": "kate kath kathy katie kit", "jennifer": "jen jenny jenn", "elizabeth": "liz lizzie beth betty eliza", "susan": "sue susie suzie",
    "james": "jim jimmy jamie", "john": "jack johnny", "thomas": "tom tommy", "michael": "mike mick", "david": "dave", "charles": "charlie chas", "patricia": "pat trish",
    "christopher": "chris kit", "andrew": "andy drew", "joseph": "joe joey", "samuel": "sam", "rebecca": "becky", "victoria": "vicky", "alexander": "alex", "deborah": "debbie deb",
}

_KIND = {w: k for k, a in KINDS.items() for w in [k, *a.split()]}
_NICK: dict[str, str] = {}
for _g, _a in GIVEN.items():
    for _w in [_g, *_a.split()]:
        _NICK.setdefault(_w, _g)
_LONG = {w: k for w, k in _KIND.items() if len(w) >= 5} | {"limited": "limited"}
#: Letters from which one word may be two run together.
JOINED = 12
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])|(?<=[a-zà-ÿ]0)(?=[A-ZÀ-Ý])|(?<=[A-Za-zÀ-ÿ]{3}\.)(?=[A-Za-zÀ-Ý]{3})")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?|\b[a-z](?: [a-z])+\b")
_ASIDES = re.compile(r"\b(?:" + "|".join(ASIDE) + r")\b")
_LEGALS = re.compile(r"\b(" + "|".join(LONG_LEGAL) + r")\b")


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words (letter added, left out, changed, or neighbours swapped); most + 1 for more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@lru_cache(200_000)
def kind_like(w: str) -> str | None:
    """The kind word of which `w` is a misspelling."""
    if len(w) < 4:
        return None
    d, _, k = min(((distance(w, k, 3), _LONG[k] != k, k) for k in _LONG if abs(len(k) - len(w)) < 4), default=(9, True, ""))
    return _LONG[k] if d <= (3 if len(k) > 8 else 2 if len(k) > 5 else 1) else None


@dataclass
class Name:
    core: list[str] = field(default_factory=list)  # its own words, in alphabetic order
    cut: list[str] = field(default_factory=list)  # those of them that are cut off by a full stop
    kind: str = ""
    legal: str = ""
    given: str = ""


def plain(text: str) -> str:
    """Lower case without accents; digits that stand for letters are letters."""
    s = unicodedata.normalize("NFKD", _CAMEL.sub(" ", text))
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    return re.sub(r"(?<=[a-z])[01](?=[a-z01]|\b)|\b[01](?=[a-z])", lambda m: "o" if m.group() == "0" else "l", s)


def parse(text: str | None) -> Name:
    """The parts of a name. A blank one has no core. Nothing is looked up in the data."""
    out = Name()
    if not text or not text.strip():
        return out
    s = plain(text).replace("&", " and ").replace("+", " and ").replace("h'way", "hway").replace("s/w", "sw")
    s = _DOTTED.sub(lambda m: m.group().replace(".", "").replace(" ", "") + " ", s)
    s = re.sub(r"[^a-z0-9.]+", " ", s)
    s = _ASIDES.sub(" ", s)
    found = _LEGALS.search(s)
    if found:
        out.legal, s = LONG_LEGAL[found.group(1)], _LEGALS.sub(" ", s)
    kinds: set[str] = set()
    core: list[tuple[str, bool]] = []
    given: list[str] = []
    for raw in s.split():
        w = raw.strip(".").replace(".", "")
        if not w or w in CONNECT or w in TITLES:
            continue
        if w in LEGAL:
            out.legal = LEGAL[w]
        elif w in ACRONYMS:
            kinds.update(ACRONYMS[w].split())
        elif w in _KIND:
            kinds.add(_KIND[w])
        elif w in _NICK or len(w) == 1:
            given.append(_NICK.get(w, w))
        else:
            core.append((w, raw.endswith(".")))
    # Beyond the two own words (which may stand as one), the word most like a kind word is one.
    while len(core) > 2 or (len(core) == 2 and max(len(w) for w, _ in core) >= JOINED):
        like = [(distance(w, k, 6), i, k) for i, (w, _) in enumerate(core) if len(w) < JOINED + 4 and (k := kind_like(w))]
        if not like:
            break
        _, i, k = min(like)
        if k == "limited":
            out.legal = "ltd"
        else:
            kinds.add(k)
        del core[i]
    if not core and given:
        core, given = [(g, False) for g in given], []
    out.kind = " ".join(sorted(kinds))
    out.given = given[0] if given else ""
    core.sort()
    out.core, out.cut = [w for w, _ in core], [w for w, c in core if c]
    return out


def same_given(a: str, b: str) -> bool:
    """Whether two given names or initials can be one person's; a missing one fits any."""
    return not a or not b or a == b or (min(len(a), len(b)) == 1 and a[0] == b[0])
