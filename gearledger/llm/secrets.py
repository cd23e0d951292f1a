"""Secret scans with one combined deterministic automaton.

The rules' expressions are compiled together: a small parser makes a nondeterministic
automaton, subset construction a deterministic one, Moore's refinement the minimal one, stored
as one flat transition array. The combined search automaton reads every byte of a text once
and tells which rules may have a match and where the first of them fires; exact spans of such
a rule come from its own anchored automaton, leftmost first, longest, without overlap.

Scale: documents are scanned where they lie, in one pass, without a shuffle; the automata are
compiled once from the fixed rules and broadcast (some hundred KB, whatever the data).

Defined results: null is the empty text and has no secrets; spans count code points and end
exclusively; matches that miss their rule's length are dropped after matching, as a scanner
that consumes them would; repeated rows repeat; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

VALUE = r"[A-Za-z0-9+/_.=-]"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind, its expression as (head, repeated tail), and the least repeats that count.

    ``whole``: the least length is that of the whole match rather than of the tail.
    """

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = False


KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
# The base rules first, in the order in which spans of one start are listed,
# then published formats of access tokens and keys.
RULES = (
    Rule("assign", rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?", VALUE, 12),
    Rule("access", "AKIA", "[A-Z0-9]", 18, whole=True),
    Rule("hex", "", "[0-9a-f]", 16),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-][A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-][A-Za-z0-9_-]*\.", "[A-Za-z0-9_-]", 16),
    Rule("private_key", "-----BEGIN ([A-Z][A-Z0-9]* )*PRIVATE KEY-", "[-]", 4),
)

Node = tuple


def parse(expression: str) -> Node:
    """Syntax tree of a byte expression: literals, classes, groups, ``|``, ``?``, ``*`` and ``+``."""
    text, at = expression, 0

    def byte() -> int:
        nonlocal at
        if text[at] == "\\":
            if text[at + 1] == "x":
                at += 4
                return int(text[at - 2 : at], 16)
            at += 1
        at += 1
        return ord(text[at - 1])

    def atom() -> Node:
        nonlocal at
        if text[at] == "(":
            at += 1
            inner = choice()
            at += 1
            return inner
        if text[at] != "[":
            return ("set", frozenset([byte()]))
        at += 1
        members: set[int] = set()
        while text[at] != "]":
            low = byte()
            if text[at] == "-" and text[at + 1] != "]":
                at += 1
                members.update(range(low, byte() + 1))
            else:
                members.add(low)
        at += 1
        return ("set", frozenset(members))

    def row() -> Node:
        nonlocal at
        parts = []
        while at < len(text) and text[at] not in "|)":
            node = atom()
            while at < len(text) and text[at] in "?*+":
                node = (text[at], node)
                at += 1
            parts.append(node)
        return ("row", parts)

    def choice() -> Node:
        nonlocal at
        parts = [row()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(row())
        return ("or", parts)

    return choice()


class Nfa:
    """States with byte-set moves and empty moves; ``accept`` maps a state to its rule."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: Node, start: int) -> int:
        """Append the node after ``start``; the state where it ends."""
        kind, body = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((body, end))
            return end
        if kind == "row":
            for part in body:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for part in body:
                self.empty[self.add(part, start)].append(end)
            return end
        loop = self.state()
        self.empty[start].append(loop)
        last = self.add(body, loop)
        self.empty[last].append(end)
        if kind in "?*":
            self.empty[loop].append(end)
        if kind in "*+":
            self.empty[last].append(loop)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.empty[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)


@dataclass
class Dfa:
    """Transition array (state * 256 + byte), and per state the bit set of accepted rules."""

    table: list[int]
    accepts: list[int]
    # States from here on accept something.
    first_accepting: int
    # The state that nothing leaves, or -1.
    dead: int


def determine(nfa: Nfa, start: int, search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction; with ``search`` a match may begin at every byte. State 0 is the start."""
    root = nfa.closed({start})
    names, order, rows = {root: 0}, [root], []
    for states in order:
        targets: list[set[int]] = [set() for _ in range(256)]
        for state in states:
            for members, after in nfa.moves[state]:
                for b in members:
                    targets[b].add(after)
        made: dict[frozenset[int], frozenset[int]] = {}
        row = []
        for group in targets:
            raw = frozenset(group)
            if raw not in made:
                made[raw] = nfa.closed(group) | (root if search else frozenset())
            closed = made[raw]
            if closed not in names:
                names[closed] = len(order)
                order.append(closed)
            row.append(names[closed])
        rows.append(row)
    accepts = [sum(1 << r for r in {nfa.accept[s] for s in states if s in nfa.accept}) for states in order]
    return np.array(rows), np.array(accepts)


def minimise(moves: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Moore's refinement; the start becomes state 0 or, if it accepts, the first accepting one."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        signature = np.column_stack([block, block[moves]])
        _, refined = np.unique(signature, axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    _, first = np.unique(block, return_index=True)
    # Accepting states last, so that one comparison tells them.
    rank = np.empty(len(first), dtype=int)
    rank[np.lexsort((first, accepts[first] > 0))] = np.arange(len(first))
    chosen = np.empty(len(first), dtype=int)
    chosen[rank] = first
    table = rank[block[moves[chosen]]] * 256
    kept = accepts[chosen]
    own = np.arange(len(chosen))[:, None] * 256
    dead = np.flatnonzero((table == own).all(axis=1) & (kept == 0)) * 256
    return Dfa(table.ravel().tolist(), kept.tolist(), int((kept == 0).sum()) * 256, int(dead[0]) if len(dead) else -1)


def anchor(expression: str) -> Dfa:
    """The minimal automaton of matches that begin at the first byte."""
    nfa = Nfa()
    start = nfa.state()
    nfa.accept[nfa.add(parse(expression), start)] = 0
    return minimise(*determine(nfa, start, search=False))


def mirrored(node: Node) -> Node:
    """The tree of the same matches read from right to left."""
    kind, body = node
    if kind == "set":
        return node
    if kind == "row":
        return (kind, [mirrored(part) for part in reversed(body)])
    if kind == "or":
        return (kind, [mirrored(part) for part in body])
    return (kind, mirrored(body))


def backward(expression: str) -> Dfa:
    """Read from right to left, it accepts at every byte where a match begins."""
    nfa = Nfa()
    start = nfa.state()
    nfa.accept[nfa.add(mirrored(parse(expression)), start)] = 0
    return minimise(*determine(nfa, start, search=True))


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Dfa, list[tuple[Dfa, Dfa, Dfa | None]]]:
    """The combined search automaton, and per rule those of its starts, its whole match and its head."""
    nfa = Nfa()
    start = nfa.state()
    for number, rule in enumerate(rules):
        # A short tail is enough to raise the rule; a rule of nothing but its tail needs all.
        repeats = min(rule.least, 4) if rule.head else rule.least
        nfa.accept[nfa.add(parse(rule.head + rule.tail * repeats), start)] = number
    combined = minimise(*determine(nfa, start, search=True))
    anchored = [
        (backward(f"{r.head}{r.tail}+"), anchor(f"{r.head}{r.tail}+"), anchor(r.head) if r.head else None) for r in rules
    ]
    return combined, anchored


def fires(data: bytes, dfa: Dfa) -> int:
    """Bit set of the rules that may have a match: one pass over the bytes."""
    table, limit, accepts = dfa.table, dfa.first_accepting, dfa.accepts
    state = found = 0
    for b in data:
        state = table[state + b]
        if state >= limit:
            found |= accepts[state >> 8]
    return found


def longest(data: bytes, at: int, dfa: Dfa) -> int:
    """End of the longest match that begins at a place, or -1."""
    table, limit = dfa.table, dfa.first_accepting
    state, end = 0, -1
    for here in range(at, len(data)):
        state = table[state + data[here]]
        if state == dfa.dead:
            break
        if state >= limit:
            end = here + 1
    return end


def starts_of(data: bytes, back: Dfa) -> list[int]:
    """Places where a match begins, from the last to the first: one pass from right to left."""
    table, limit = back.table, back.first_accepting
    state, found = 0, []
    for at in range(len(data) - 1, -1, -1):
        state = table[state + data[at]]
        if state >= limit:
            found.append(at)
    return found


def spans_of(data: bytes, rule: Rule, back: Dfa, dfa: Dfa, head: Dfa | None) -> Iterator[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of one rule, in bytes; short ones consume too.

    Only real starts are followed, so a text of many false ones takes no longer than another.
    """
    at = 0
    for start in reversed(starts_of(data, back)):
        if start < at:
            continue
        at = longest(data, start, dfa)
        counted = start if rule.whole or head is None else longest(data, start, head)
        if at - counted >= rule.least:
            yield start, at


def scan(
    text: str | None, rules: tuple[Rule, ...], automata: tuple[Dfa, list[tuple[Dfa, Dfa, Dfa | None]]]
) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of every secret of a text, in code points, in listing order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    combined, anchored = automata
    raised = fires(data, combined)
    found = []
    for number, rule in enumerate(rules):
        if raised >> number & 1:
            found += [(start, number, end) for start, end in spans_of(data, rule, *anchored[number])]
    found.sort()
    if found and not data.isascii():
        # Code points before a byte: those that begin before it.
        begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        point = lambda i: int(begins[i - 1]) if i else 0
        found = [(point(start), number, point(end)) for start, number, end in found]
    return found


RESULT = T.StructType([
    T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("base", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """The documents with ``_secrets``: counts per rule, base spans and all spans as text."""

    automata = docs.sparkSession.sparkContext.broadcast(compile_rules(rules))

    @F.pandas_udf(RESULT)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = scan(text, rules, automata.value)
            named = [(number, f"{rules[number].kind}:{start}:{end}") for start, number, end in found]
            counts = [0] * len(rules)
            for number, _ in named:
                counts[number] += 1
            rows.append((counts, ",".join(s for n, s in named if n < base), ",".join(s for _, s in named)))
        return pd.DataFrame(rows, columns=["counts", "base", "spans"])

    return docs.withColumn("_secrets", find(whole_text()))


def secrets_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, and all spans."""
    counts = F.col("_secrets.counts")
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        counts[0].alias("n_assign"),
        counts[1].alias("n_access"),
        counts[2].alias("n_hex"),
        F.sha2("_secrets.base", 256).alias("base_sha256"),
        F.col("_secrets.spans").alias("spans"),
    )
