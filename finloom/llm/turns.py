"""Spoken transcripts into clean speaker turns.

Labels are found at the starts of lines, stripped of time marks and notes, and read as names. The roster of a transcript
holds its people in the spelling that is most frequent for them over all transcripts of the ticker, looked up by phonetic
block. Within a row the labels are assigned to the roster's people, and to each other where the roster has nobody, at
least total cost within their phonetic blocks, the fuller names first; labels of one person are one speaker, and the
speakers are numbered in the order of their turns. Lines that begin with a time mark are put in the order of the marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm.names import Name, assign, cost, parse, plain, soundex
from finloom.llm.lines import repeated_lines
from finloom.plans.runtime import stored

# What transcribers note between brackets; hesitation and listening noises; roles that speak.
NOTES = (
    r"inaudible|indiscernible|unintelligible|cross[ -]?talk|overlapping[ \w]*|multiple speakers|(?:long )?pause|laughter|laugh(?:s|ing)?|chuckl\w+|applause|music[ \w]*|noise|(?:back)?ground noise|background \w+|"
    r"phone(?:tic)?(?: ringing)?|ph|sp|sic|technical difficult(?:y|ies)|technical \w+|cough\w*|sneez\w*|sigh\w*|silence|clears throat|break|audio \w+|no audio|no response|static|beep|foreign language|operator instructions|call \w+|line \w+"
)
_TIME = re.compile(
    r"[\[({<]\s*(?:\d{1,2}:)?\d{1,3}:\d{2}(?:[.,]\d+)?\s*[\])}>]|(?<![\w:.,])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])"
)
_SPAN = re.compile(r"(?<![\w:.,])(?:\d+h)?\d+m\d{1,2}s(?!\w)")
_RANGE = re.compile(r"^\s*\d{1,2}:\d{2}(?::\d{2})?[.,]?\d*\s*-+>\s*\d{1,2}:\d{2}(?::\d{2})?[.,]?\d*.*$")
_ROUND = re.compile(rf"\(\(.*?\)\)|\(\s*(?:{NOTES})\s*\)", re.I)
_OTHER = re.compile(r"\[[^\[\]]{1,60}\]|\{[^{}]{1,60}\}|<[^<>]{1,60}>|(?<!\*)\*[^*\s][^*]{0,40}\*(?!\*)")
_TERM = re.compile(r"gaap|ifrs|currenc|audited|adjust|\btax\b|pro forma|basis|dilut|organic|\bnet\b|reported|year|quarter|\d")
_NOISE = re.compile(r"(?:u+h*m+|u+h+|e+r+m*|e+h+|a+h+|o+h+m+|h+m+|m+h+m*|m+|mm+-?h+m+|u+h+-?h+u+h+|m+-?h+m+)$")
_P = r"(?:[^\W\d_][\w'’.]*(?:-[^\W\d_][\w'’]*)?)"
_ROLE = r"(?:(?:conference|call)\s+)?(?:operator|moderator|coordinator)"
_WHO = rf"(?:(?i:{_ROLE})|{_P}(?:,?[ ]+{_P}){{0,4}})"
_LABEL = re.compile(
    rf"^\s*(?:>+\s*)?(?:[QA]\s*[-–—:]\s*)?(?:<\s*(?P<a>{_WHO})\s*>:?|\[\s*(?P<b>{_WHO})\s*\]\s*:?|(?P<c>{_WHO})\s*(?:\([^()]{{1,60}}\)\s*|\s[-–—]{{1,2}}\s*[^:]{{1,60}}?)?:(?!\d)|(?P<d>(?i:{_ROLE}))\s+[-–—]{{1,2}}\s)\s*"
)
_ONE_NOTE = re.compile(rf"^(?:{NOTES})$", re.I)
_IS_ROLE = re.compile(rf"^{_ROLE}$", re.I)
_HAS = re.compile(r"[^\W_]")
_OPENS = tuple("[({<0123456789")
_BREAK = re.compile("[\r\x85\u2028\u2029]+")


class Counted(dict):
    """Whether a white-space-separated piece counts as a word."""

    def __missing__(self, piece: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        ok = False
        if _HAS.search(piece):
            core = re.sub(r"^[^\w]+|[^\w]+$", "", piece)
            low = core.lower()
            ok = True
            if _NOISE.match(low):
                # "ER visits", "the UH contract" are abbreviations; "UM," and "Uh..." are noises.
                ok = core.isupper() and len(core) > 1 and piece == core and low not in ("um", "hmm", "mm", "mhm", "uhm", "erm")
        self[piece] = ok
        return ok


_COUNTED = Counted()


def _note(m: re.Match) -> str:
    inner = m[0][1:-1].strip()
    return m[0] if _TERM.search(inner.lower()) and not _ONE_NOTE.match(inner) else " "


# Words that stand before a colon without being anybody's name.
_NO_NAMES = frozenset("date note notes source sources question answer subject re tags related peers page title time location disclaimer contact company ticker speaker participants transcript summary".split())


def _looks_like_name(who: str) -> bool:
    """Every part begins with a capital letter (or all are lower case roles)."""
    parts = re.findall(r"[^\W\d_][\w'’.-]*", who)
    return bool(parts) and all(p[0].isupper() for p in parts) and parts[0].lower() not in _NO_NAMES


def label(line: str) -> tuple[str | None, str]:
    """The label at the line's start and the rest; None where it has none."""
    m = _LABEL.match(line)
    if not m:
        return None, line
    who = next(x for x in m.groups() if x is not None).strip()
    if _IS_ROLE.match(who):
        return "operator", line[m.end() :]
    if _ONE_NOTE.match(who) or not _looks_like_name(who):
        return None, line
    return who, line[m.end() :]


def said(text: str) -> str:
    return _OTHER.sub(_note, _ROUND.sub(" ", text)) if any(c in text for c in "[({<*") else text


class Person:
    __slots__ = ("names", "blocks", "no", "operator")

    def __init__(self, name: Name | None, operator: bool = False):
        self.names, self.blocks, self.no, self.operator = [], set(), 0, operator
        if name:
            self.add(name)

    def add(self, name: Name) -> None:
        if name not in self.names:
            self.names.append(name)
            self.blocks |= blocks(name)


@lru_cache(maxsize=20_000)
def blocks(name: Name) -> frozenset[str]:
    """The phonetic blocks of a name's parts."""
    return frozenset(soundex(x) for x in (name.surname, name.given, *name.firm) if x)


def _same(a: Person, name: Name) -> float:
    return min((cost(x, name) for x in a.names), default=9.0)


def _vague(n: Name) -> int:
    return 0 if n.given or n.firm else 1 if n.initials else 2


FAR = 5.0


def _assigned(names: list[Name], people: list[Person], alone: bool = False) -> list[tuple[Name, Person]]:
    """Names and the people they mean: one to one, at least total cost; a name meets the people of its phonetic blocks,
    or all where those hold nobody near. With ``alone`` a name with two nearest people goes to neither."""
    if len(people) == 1:
        # A column of its own needs no more than its least cost.
        n = min(names, key=lambda n: _same(people[0], n))
        return [(n, people[0])] if _same(people[0], n) < FAR else []
    costs = []
    for n in names:
        near = [_same(p, n) if p.blocks & blocks(n) else FAR for p in people]
        if min(near) >= FAR:
            near = [min(_same(p, n), FAR) for p in people]
        least = min(near)
        if len(names) == 1:
            return [] if least >= FAR or alone and near.count(least) > 1 else [(n, people[near.index(least)])]
        costs.append([FAR] * len(near) if alone and near.count(least) > 1 else [min(c, FAR) for c in near])
    got = assign([row + [FAR] * len(names) for row in costs])
    return [(n, people[j]) for n, row, j in zip(names, costs, got, strict=True) if j < len(people) and row[j] < FAR]


def people_of(names: list[str]) -> list[str]:
    """One name for each person: those that are not near one before them."""
    out: list[tuple[str, Name]] = []
    for x in names:
        n = parse(x)
        if n and all(cost(n, m) >= FAR for _, m in out):
            out.append((x, n))
    return [x for x, _ in out]


def place(names: list[Name], roster: list[str]) -> dict[Name, Person]:
    """Whom each name means, among the roster's people and those whom it does not know."""
    spelt = {n: Person(n) for n in map(parse, roster) if n}
    known = list(spelt.values())
    out: dict[Name, Person] = {}
    here: dict[Person, None] = {}

    def join(n: Name, p: Person) -> None:
        out[n] = p
        p.add(n)
        here[p] = None

    for k in range(3):
        left = [n for n in dict.fromkeys(names) if _vague(n) == k]
        if k == 0:
            for n in left:
                if n in spelt:
                    join(n, spelt[n])
        while left := [n for n in left if n not in out]:
            # Several labels may mean one person: each round assigns one to one, until nobody is near any more.
            got = _assigned(left, list(here)) if here else []
            if not got and (others := [p for p in known if p not in here]):
                got = _assigned(left, others, alone=k > 0)
            for n, p in got or [(left[0], Person(None))]:
                join(n, p)
    return out


class Speakers:
    """The speakers of one row: the people that its labels and its own speaker mean."""

    def __init__(self, first: str | None, labels: list[str], roster: list[str]):
        self.operator = Person(None, True)
        name = parse(first) if first else None
        seen = {x: n for x in dict.fromkeys(labels) if x != "operator" and (n := parse(x))}
        whom = place(([name] if name else []) + list(seen.values()), roster)
        self.by_label = {x: whom[n] for x, n in seen.items()}
        self.first = self.operator if first and _IS_ROLE.match(first.strip()) else whom[name] if name else Person(None)

    def of(self, who: str) -> Person:
        return self.operator if who == "operator" else self.by_label.get(who) or self.by_label.setdefault(who, Person(None))


def _seconds(mark: str) -> tuple[int, bool]:
    """The time of a mark and whether it has hours."""
    got = mark.strip("[](){}<> \t").replace(",", ".").partition(".")[0].split(":") if ":" in mark else re.findall(r"\d+", mark)
    return sum(int(x) * 60**k for k, x in enumerate(reversed(got))), len(got) > 2


def in_time(parts: list[tuple[str | None, str | None, str]]) -> list[tuple[str | None, str]]:
    """(label, rest) of (time mark, label, rest), in the order of the marks; what has none goes with what it follows. A
    mark without hours that falls back by more than half an hour begins the next hour."""
    if not any(m for m, _, _ in parts):
        return [x[1:] for x in parts]
    told, at, hours, last = [], -1, 0, -1
    for mark, *rest in parts:
        if mark:
            at, whole = _seconds(mark)
            if not whole:
                if at + hours < last - 1800:
                    hours += 3600
                at += hours
            last = at
        told.append((at, tuple(rest)))
    return [x for _, x in sorted(told, key=itemgetter(0))]


def turns(text: str | None, speaker: str | None, gone: frozenset[int] | set[int] = frozenset(), roster: list[str] | None = None) -> list[tuple[Person, str, int]]:
    """(person, clean text, words) of every turn; speakers are numbered in ``Person.no``. Labels of one person of the
    ``roster`` are one speaker."""
    if not text:
        return []
    parts: list[tuple[str | None, str | None, str]] = []
    raw, mark, spans = text.split("\n"), None, _SPAN.search(text) is not None
    for i, line in enumerate(raw, 1):
        if i in gone:
            continue
        line = line.strip("\r \t\x0b\x0c\x85 ")
        if not line:
            continue
        if _RANGE.match(line):
            mark = line.split("-")[0]
            continue
        if line.isdigit() and i < len(raw) and _RANGE.match(raw[i]):
            continue
        for piece in _BREAK.split(line) if "\r" in line or not line.isascii() else (line,):
            if piece[:1] in _OPENS and (m := _TIME.match(piece) or _SPAN.match(piece)):
                mark = m[0]
            if ":" in piece:
                piece = _TIME.sub(" ", piece)
            parts.append((mark, *label(_SPAN.sub(" ", piece) if spans else piece)))
            mark = None
    told = in_time(parts)
    people = Speakers(speaker, [w for w, _ in told if w], roster or [])
    now, out, n_people = people.first, [], 0
    for who, rest in told:
        pieces = said(rest).split()
        n = sum(map(_COUNTED.__getitem__, pieces))
        if not n:
            continue
        if who is not None:
            now = people.of(who)
        if not now.no:
            n_people += 1
            now.no = n_people
        words = " ".join(pieces if n == len(pieces) else [p for p in pieces if _COUNTED[p] or not _HAS.search(p)])
        if out and out[-1][0] is now:
            out[-1] = (now, out[-1][1] + " " + words, out[-1][2] + n)
        else:
            out.append((now, words, n))
    return out


def display(name: Name) -> str:
    if name.firm:
        return " ".join(name.firm).title()
    first = name.given or ". ".join(name.initials) + ("." if name.initials else "")
    return f"{first} {name.surname}".strip().title()


def clean_names(people: list[Person], roster: list[str]) -> dict[int, str]:
    """Speaker number to the roster's spelling, assigned one to one at least cost; without one, the fullest own name.

    Who bears a roster's name to the letter costs nothing and has it; the assignment is over the others and the rest of
    the roster in their phonetic blocks."""
    people = [p for p in dict.fromkeys(people) if p.names]
    own = {p.no: display(min(p.names, key=lambda n: (not (n.given or n.firm), len(n.surname)))) for p in people}
    refs = dict.fromkeys(n for n in map(parse, roster) if n)
    exact = {(r.given, r.surname, r.firm): r for r in refs}
    rest = []
    for p in people:
        r = next((exact[k] for n in p.names if (k := (n.given, n.surname, n.firm)) in exact), None)
        if r is None:
            rest.append(p)
        else:
            own[p.no] = display(r)
            refs.pop(r, None)
    if rest and refs:
        blocks = {soundex(x) for p in rest for n in p.names for x in (n.surname, n.given)}
        free = [r for r in refs if r.firm or soundex(r.surname) in blocks]
        costs = [[min(_same(p, r), 5.0) for r in free] + [5.0] * len(rest) for p in rest]
        for p, row, j in zip(rest, costs, assign(costs) if free else [0] * len(rest), strict=True):
            if free and j < len(free) and row[j] < 5:
                own[p.no] = display(free[j])
    return own


def speaker_turns(chunks: DataFrame, lines: DataFrame | None = None, row: str = "chunk_key") -> DataFrame:
    """The clean turns of every ``qa_exchange`` row, in order: ``row``, ``turn_no``, ``speaker_no``, ``n_words``,
    ``speaker``, ``speaker_role``, ``phase``, ``text``.

    ``lines``: the repeated lines (row, line_no) to leave out, by default those of ``repeated_lines``. Null, empty and
    noise-only texts have no turns; where ``speaker`` is null, words before the first label are an unnamed speaker's.
    ``speaker_role`` and ``phase`` are the row's, in one spelling (the role only for the row's own speaker, "operator"
    for the operator). Repeated rows each have their turns; further columns are ignored. A row is turned by one task,
    whatever its length.
    """
    qa = chunks.filter(F.col("chunk_type") == "qa_exchange")
    if lines is None:
        lines = repeated_lines(chunks, row=row)
    gone = lines.groupBy(row).agg(F.collect_set("line_no").alias("_gone"))
    # The narrow columns meet first, so that the texts move once and are not sorted.
    info = qa.select(row, "doc_id").join(roster(chunks), "doc_id", "left").join(gone, row, "left").drop("doc_id")
    rows = qa.select(row, "text", "speaker", "speaker_role", "phase").join(info.hint("shuffle_hash"), row)
    kind = f"{row} {chunks.schema[row].dataType.simpleString()}, turn_no int, speaker_no int, n_words int, speaker string, speaker_role string, phase string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for key, text, who, role, phase, gone_, known in zip(*(b.column(c).to_pylist() for c in (row, "text", "speaker", "speaker_role", "phase", "_gone", "_roster")), strict=True):
                got = turns(text, who, frozenset(gone_ or ()), known)
                clean = clean_names([p for p, _, _ in got], known or [])
                first = parse(who) if who else None
                for k, (p, t, n) in enumerate(got, 1):
                    mine = first is not None and _same(p, first) < 5
                    values = (key, k, p.no, n, "Operator" if p.operator else clean.get(p.no), "operator" if p.operator else _role(role) if mine else None, _phase(phase), t)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(row).type, *[pa.int32()] * 3, *[pa.string()] * 4], strict=True)], names=[c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(run, kind)


# The spellings of roles and phases.
_ROLES = {"ceo": "CEO", "chief executive officer": "CEO", "cfo": "CFO", "chief financial officer": "CFO", "coo": "COO", "chief operating officer": "COO", "cto": "CTO", "president": "President", "chairman": "Chairman", "analyst": "analyst", "operator": "operator", "executive": "executive"}
_PHASES = {"qa": "qa", "q&a": "qa", "prepared_remarks": "prepared_remarks", "prepared remarks": "prepared_remarks"}


def _role(x: str | None) -> str:
    return _ROLES.get(plain(x or "").strip(), "unknown")


def _phase(x: str | None) -> str | None:
    return _PHASES.get(plain(x or "").strip())


def roster(chunks: DataFrame) -> DataFrame:
    """(doc_id, _roster): the people of a transcript in the spelling that is most frequent for them over all transcripts
    of the ticker, the most frequent first.

    Full names meet those of their phonetic block (surname's sound, first initial) and take the most frequent one near
    them; different people of a block all stay. Initials stand for the one person of their block, or for nobody. Only
    narrow columns move; counts are exact; no group is collected but a transcript's own people."""

    @F.pandas_udf("block string, full string")
    def read(typed: pd.Series) -> pd.DataFrame:
        got = [parse(x) if x else None for x in typed]
        return pd.DataFrame([(f"{soundex(n.surname)}{n.initials[:1]}", display(n) if n.given else None) if n and not n.firm else (None, None) for n in got], columns=["block", "full"])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cost(parse(x), parse(y)) < FAR for x, y in zip(a, b, strict=True)], dtype="bool")

    @F.pandas_udf("array<string>")
    def each(names: pd.Series) -> pd.Series:
        return names.map(people_of)

    typed = chunks.filter("speaker is not null and doc_id is not null").select(F.coalesce("ticker", F.lit("")).alias("ticker"), "doc_id", "speaker").groupBy("ticker", "doc_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    named = stored(typed.withColumn("r", read("speaker")).select("ticker", "doc_id", "n", "r.block", "r.full").filter("block is not null"), "named")
    fulls = named.filter("full is not null").groupBy("ticker", "block", "full").agg(F.sum("n").alias("n"))
    met = fulls.join(fulls.select("ticker", "block", F.col("full").alias("other"), F.col("n").alias("m")), ["ticker", "block"]).filter("other = full or m > n or (m = n and other < full)").filter(alike("full", "other"))
    heads = stored(met.groupBy("ticker", "block", "full").agg(F.max(F.struct("m", "other")).alias("h")).select("ticker", "block", "full", F.col("h.other").alias("head"), F.col("h.m").alias("often")), "heads")
    one = heads.groupBy("ticker", "block").agg(F.min("head").alias("head"), F.max("head").alias("last"), F.max("often").alias("often")).filter("head = last").drop("last")
    people = named.filter("full is not null").join(heads, ["ticker", "block", "full"]).select("doc_id", "head", "often")
    people = people.unionByName(named.filter("full is null").join(one, ["ticker", "block"]).select("doc_id", "head", "often"))
    own = F.transform(F.sort_array(F.collect_set(F.struct((-F.col("often")).alias("often"), F.col("head").alias("name")))), lambda x: x["name"])
    return people.groupBy("doc_id").agg(own.alias("_names")).select("doc_id", each("_names").alias("_roster"))
