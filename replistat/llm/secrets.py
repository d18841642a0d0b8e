"""Secret scan by lexing assignments: names, literals, propagated constants, scores by target name."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import table

# Fixed by the result contract: the three base kinds, letters of the names in either case.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RANK = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}

# The lexer. Each token is matched where the last one ended; what opens a literal and never closes is looked for once.
TOKEN = re.compile(r"""([A-Za-z_$][A-Za-z0-9_$.\-]*+)|(\"\"\"|'''|["'`])|(:=|=>|[=!<>]=++|::++|[=:])|([(\[\]),])|\\.""")
CLOSED = {'"': re.compile(r'"((?:[^"\\\n]|\\.)*+)"', re.S), "'": re.compile(r"'((?:[^'\\\n]|\\.)*+)'", re.S), "`": re.compile(r"`((?:[^`\\]|\\.)*+)`", re.S),
          '"""': re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*+)"""', re.S), "'''": re.compile(r"'''((?:[^'\\]|\\.|'(?!''))*+)'''", re.S)}
BARE = re.compile(r"[A-Za-z0-9+/_.=\-$@!%^&*~]++")
GAP = re.compile(r"(?:[ \t]++|/\*[^*\n]*+\*/|\\\r?\n)*+")
TYPE = re.compile(r"[ \t]*+&?(?:const )?[A-Za-z_][\w.\[\]<>*?,| \t]*+=(?![=>])[ \t]*+")
FOLDED = re.compile(r"[|>][+\-]?[ \t]*+\r?\n[ \t]++([^\s][^\n]*+)")
SCHEME = re.compile(r"(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]++")
JOIN = re.compile(r"[ \t]*+(?:(?:\+|\.\.?|&)[ \t\r\n]*+|\\\r?\n[ \t]*+)?")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)[^<>]*+>([^<>\n]*+)</")
LOGIN = re.compile(r"""://[^\s/:@"'<>]*+:([^\s/@"'<>]++)@""")
KEY_BEGIN, KEY_END = re.compile(r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]*?PRIVATE KEY-----")
#: First words of calls that hand a value over, and names of attributes that hold name and value of an entry.
SETTERS = frozenset("set with use add put update login authenticate authorize connect".split())
ENTRY_NAMES, ENTRY_VALUES = frozenset("name key".split()), frozenset("value content".split())
#: Parts of names that make their literal a secret, with weights.
NAME_PARTS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "auth": 2, "authorization": 2, "bearer": 2,
              "private": 2, "signing": 2, "encryption": 2, "key": 1, "access": 1, "salt": 1}
LIKELY = 4
#: A text without any of these has no sensitive name, no login and no key block.
SENSITIVE = re.compile("(?i)" + "|".join(sorted({*NAME_PARTS, "://", "-----BEGIN", "api.?key"})))


def name_score(name: str) -> int:
    """Sum of the weights of a name's different parts, split at case changes, digits and punctuation."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return sum(NAME_PARTS.get(p, 0) for p in {*parts, *joined})


def literal_score(length: int, chars: frozenset[str]) -> int:
    """How much a literal looks random: length, mixed classes, many distinct characters; negative for plain words and placeholders."""
    seen = "".join(sorted(chars))
    if length < 8 or re.search(r"\s", seen):
        return -9
    classes = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    distinct = len(chars)
    if distinct <= 3 or re.fullmatch(r"[A-Za-z_.\-]+", seen) and distinct < 14:
        return -1
    return (classes >= 2) + (classes >= 3) + (distinct >= 10) + (length >= 16)


def runs_of_hex(text: str) -> Iterator[re.Match]:
    """HEX.finditer; a run of 32 shows as four hex digits in a row in every eighth character, so most texts need no full pass."""
    if re.search("[0-9a-f]{4}", text[7::8]) is None:
        return iter(())
    return HEX.finditer(text)


@dataclass
class Pair:
    """A name and the parts of its right-hand side: start, end, and whether it is a bare word."""

    name: str
    parts: list[tuple[int, int, bool]]
    constant: bool = True


class _Lexer:
    """Name-literal pairs of source and configuration text, in one pass."""

    def __init__(self, text: str) -> None:
        self.text, self.pairs = text, []
        self.dead = dict.fromkeys(CLOSED, 0)  # no literal of this quote closes before here

    def quoted(self, at: int) -> re.Match | None:
        """The closed literal whose quote stands at ``at``."""
        for q in (self.text[at:at + 3], self.text[at:at + 1]):
            if q in CLOSED and at >= self.dead[q]:
                m = CLOSED[q].match(self.text, at)
                if m:
                    return m
                end = self.text.find("\n", at) if q in ("'", '"') else -1
                self.dead[q] = end if end >= 0 else len(self.text)
        return None

    def value(self, at: int) -> tuple[list[tuple[int, int, bool]], int]:
        """The parts of the expression at ``at``, joined by operators or side by side, and where it ends."""
        parts: list[tuple[int, int, bool]] = []
        end = at
        while True:
            m = self.quoted(at)
            if m:
                parts.append((m.start(1), m.end(1), False))
            else:
                m = BARE.match(self.text, at)
                if not m:
                    return parts, end
                parts.append((m.start(), m.end(), True))
            end = m.end()
            j = JOIN.match(self.text, end)
            at = j.end()
            if not j.group().strip() and (parts[-1][2] or self.text[at:at + 1] not in ('"', "'") or at == end):
                return parts, end

    def run(self) -> list[Pair]:
        text, at = self.text, 0
        key = call = entry = None  # the last name or literal, the call that is open, the entry that an attribute names
        first = None  # the literal that opened the arguments
        while m := TOKEN.search(text, at):
            at = m.end()
            name, quote, op, mark = m.groups()
            if name:
                key, first = name, None
            elif quote:
                if quote == "'" and m.start() and text[m.start() - 1].isalnum():
                    continue  # an apostrophe
                lit = self.quoted(m.start())
                if not lit:
                    at = m.start() + 1
                    continue
                at, span = lit.end(), (lit.start(1), lit.end(1), False)
                if call is not None:
                    parts, at = self.value(m.start())
                    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", call.rpartition(".")[2])
                    if words and words[0].lower() in SETTERS:
                        self.pairs.append(Pair(call, parts, False))
                    first, call = lit.group(1), None
                elif first is not None and text[m.start() - 1] in ", \t":
                    self.pairs.append(Pair(first, [span], False))
                    first = None
                key = lit.group(1) if lit.end() - lit.start() < 200 else None
            elif op in ("=", ":", ":=", "=>") and key is not None:
                start = GAP.match(text, at).end()
                typed = TYPE.match(text, at) if op == ":" else None
                folded = FOLDED.match(text, start) if op == ":" else None
                if typed:
                    start = typed.end()
                scheme = SCHEME.match(text, start)
                if scheme:
                    start = scheme.end()
                if folded:
                    parts, at = [(folded.start(1), folded.end(1), False)], folded.end()
                else:
                    parts, at = self.value(start)
                if parts:
                    self.pairs.append(Pair(key, parts))
                    s, e, bare = parts[0]
                    if not bare and key.lower() in ENTRY_NAMES:
                        entry = text[s:e]
                    elif entry is not None and key.lower() in ENTRY_VALUES:
                        self.pairs.append(Pair(entry, parts, False))
                        entry = None
                at = max(at, m.end())
                key = first = call = None
            elif mark == "(":
                call, first = key if text[m.start() - 1:m.start()] not in (" ", "\n", "") else None, None
                key = None
            elif mark not in ("]", "[", ","):
                key = call = first = None
        self.pairs += [Pair(m.group(1), [(m.start(2), m.end(2), False)], False) for m in ELEMENT.finditer(text)]
        return self.pairs


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose target name is sensitive, directly or through constants that it is set from.

    Read as pairs: assignments with or without a type, entries of mappings, attributes and elements,
    arguments of setting calls; also logins in addresses and private key blocks. A bare word on the
    right-hand side that is itself an assigned name stands for that name's value, through any number of steps;
    the latest assignment before the use counts, else the first one after it; a circle stands for the word
    itself. Joined parts are judged as one value and reported each.
    """
    pairs = _Lexer(text).run()
    places: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        if p.constant:
            places.setdefault(p.name, []).append(i)

    def target(i: int, s: int, e: int, bare: bool) -> int | None:
        options = places.get(text[s:e]) if bare else None
        if not options:
            return None
        k = bisect_left(options, i)
        return options[k - 1] if k else options[0]

    needs = [[target(i, *part) for part in p.parts] for i, p in enumerate(pairs)]
    worth: list[tuple[int, frozenset[str]] | None] = [None] * len(pairs)  # length and characters of the value
    open_ = [False] * len(pairs)
    for top in range(len(pairs)):
        stack = [top]
        while stack:
            i = stack[-1]
            todo = [t for t in needs[i] if t is not None and worth[t] is None and not open_[t] and t != i]
            if worth[i] is None and todo:
                open_[i] = True
                stack += todo
                continue
            stack.pop()
            if worth[i] is None:
                length, chars = 0, frozenset()
                for (s, e, _), t in zip(pairs[i].parts, needs[i]):
                    own = worth[t] if t is not None and t != i else None
                    raw = text[s:e] if own is None else ""
                    own = own or (len(raw), frozenset(re.sub(r"\\(.)", r"\1", raw, flags=re.S) if "\\" in raw else raw))
                    length, chars = length + own[0], chars | own[1]
                worth[i] = (length, chars)
            open_[i] = False
    found, seen = set(), set()
    stack = [i for i, p in enumerate(pairs) if (w := name_score(p.name)) and w + literal_score(*worth[i]) >= LIKELY]
    while stack:
        i = stack.pop()
        if i in seen:
            continue
        seen.add(i)
        several = len(pairs[i].parts) > 1
        for (s, e, bare), t in zip(pairs[i].parts, needs[i]):
            if t is not None and t != i:
                stack.append(t)
            elif s < e and not (several and bare):
                found.add((s, e))
    found |= {m.span(1) for m in LOGIN.finditer(text) if literal_score(m.end(1) - m.start(1), frozenset(m.group(1))) + NAME_PARTS["password"] >= LIKELY}
    done = 0
    for m in KEY_BEGIN.finditer(text):
        end = KEY_END.search(text, m.end()) if m.start() >= done else None
        if end:
            found.add((m.start(), end.end()))
        done = max(done, end.end()) if end else done if m.start() < done else len(text)
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start, then kind; null counts as empty.

    Base spans always stay; a lexed span that lies within a base span adds nothing and is left out.
    """
    text = text or ""
    base = []
    if ":" in text or "=" in text:
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in runs_of_hex(text)]
    more = []
    if SENSITIVE.search(text):
        base.sort(key=lambda x: x[1])
        starts, reach = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
        for s, e in lexed(text):
            k = bisect_right(starts, s)
            if not k or reach[k - 1] < e:
                more.append(("lexed", s, e))
    return sorted(base + more, key=lambda x: (x[1], RANK[x[0]], x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of kind, start, end) for every row; offsets in code points, end exclusive.

    Null and empty texts have no spans; null and repeated ids are rows of their own. Rows are
    independent, so there is no shuffle.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE: dict[str, str] = {}
