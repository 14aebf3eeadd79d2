"""License scans by matching template markup.

Templates are license wordings with regions marked

    <<beginOptional>> ... <<endOptional>>                    may be left out
    <<var;name="x";original="y";match="regex";max="n">>      1 to n words, each wholly matching the regex

Each compiles into an automaton over words.  A text has a license where some
run of its words takes the automaton from start to end: all wording outside the
marked regions must be there, word for word.  Case, punctuation between words
and white space don't matter.  A run that a word of DENIED precedes ("not
released under ...") doesn't count.

Spark lets through only texts that hold the words, up to three, which a template
can't do without, which loses nothing; the automata then read those texts to the end.
"""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word: letters and digits, with single dots, hyphens or apostrophes inside.
WORD = re.compile(r"[^\W_]+(?:[.'’+-][^\W_]+)*")
_TAG = re.compile(r"<<(beginOptional|endOptional|var)([^>]*(?:>(?!>)[^>]*)*)>>")
_PART = re.compile(r';\s*(\w+)\s*=\s*"([^"]*)"')

#: Markup by license: the files beside this module.  Names with -text or -notice are whole wordings, the others one-line notices.
TEMPLATES: dict[str, str] = {p.stem: p.read_text() for p in sorted((pathlib.Path(__file__).parent / "license_templates").glob("*.txt"))}
#: Words right before a wording that turn it into its opposite.
DENIED = frozenset("not never no nor isn't wasn't aren't weren't isn’t wasn’t aren’t weren’t cannot can't".split())


def _nodes(markup: str) -> list:
    """("word", w), ("var", name, regex, most) and ("optional", nodes), in order."""
    stack: list[list] = [[]]
    at = 0
    for tag in _TAG.finditer(markup):
        stack[-1] += [("word", w.lower()) for w in WORD.findall(markup[at : tag.start()])]
        at = tag.end()
        if tag[1] == "beginOptional":
            stack.append([])
        elif tag[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            part = dict(_PART.findall(tag[2]))
            stack[-1].append(("var", part.get("name", "var"), re.compile(part.get("match", ".+"), re.I), int(part.get("max", 1))))
    stack[-1] += [("word", w.lower()) for w in WORD.findall(markup[at:])]
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """State 0 is the start, `accept` the end.  `edges[s]` are (word or regex, variable or None, next state); `skips[s]` need no word."""

    def __init__(self, markup: str):
        nodes = _nodes(markup)
        self.needed = sorted({n[1] for n in nodes if n[0] == "word"}, key=lambda w: (-len(w), w))
        if not self.needed:
            raise ValueError("a template needs a word outside its marked regions")
        self.edges: list[list] = [[]]
        self.skips: list[list[int]] = [[]]
        self.accept = self._chain(nodes, 0)
        self.closed = [self._closure(s) for s in range(len(self.edges))]
        first = [e[0] for s in self.closed[0] for e in self.edges[s]]
        self.first_words = {w for w in first if isinstance(w, str)}
        self.first_regex = [w for w in first if not isinstance(w, str)]

    def _new(self) -> int:
        self.edges.append([]), self.skips.append([])
        return len(self.edges) - 1

    def _chain(self, nodes: list, at: int) -> int:
        for node in nodes:
            if node[0] == "word":
                to = self._new()
                self.edges[at].append((node[1], None, to))
            elif node[0] == "var":
                end, here = self._new(), at
                for _ in range(node[3]):
                    nxt = self._new()
                    self.edges[here].append((node[2], node[1], nxt))
                    self.skips[nxt].append(end)
                    here = nxt
                to = end
            else:
                to = self._chain(node[1], at_inner := self._new())
                self.skips[at].append(at_inner)
                end = self._new()
                self.skips[to].append(end), self.skips[at].append(end)
                to = end
            at = to
        return at

    def _closure(self, s: int) -> tuple[int, ...]:
        seen, todo = [s], [s]
        while todo:
            for n in self.skips[todo.pop()]:
                if n not in seen:
                    seen.append(n), todo.append(n)
        return tuple(seen)

    def begins(self, word: str) -> bool:
        return word in self.first_words or any(r.fullmatch(word) for r in self.first_regex)

    def run(self, words: list[str], at: int) -> tuple[int, dict[str, str]] | None:
        """End of the longest match that begins at word `at`, and what its variables stood for; None without one."""
        live: dict[int, tuple] = dict.fromkeys(self.closed[0], ())
        best = None
        while True:
            if self.accept in live:
                best = (at, live[self.accept])
            if at >= len(words):
                break
            nxt: dict[int, tuple] = {}
            for s, said in live.items():
                for want, name, to in self.edges[s]:
                    if want == words[at] if isinstance(want, str) else want.fullmatch(words[at]):
                        for e in self.closed[to]:
                            nxt.setdefault(e, said if name is None else (*said, (name, words[at])))
            if not nxt:
                break
            live, at = nxt, at + 1
        if best is None:
            return None
        found: dict[str, str] = {}
        for name, word in best[1]:
            found[name] = f"{found[name]} {word}" if name in found else word
        return best[0], found


class Scanner:
    """Several automata over one pass of a text's words."""

    def __init__(self, automata: dict[str, Automaton]):
        self.automata = automata
        self.begins: dict[str, tuple[str, ...]] = {}

    def _may(self, word: str) -> tuple[str, ...]:
        """The licenses whose wording can begin with the word; remembered for a million words."""
        found = self.begins.get(word)
        if found is None:
            if len(self.begins) >= 1_000_000:
                self.begins.clear()
            found = self.begins[word] = tuple(n for n, a in self.automata.items() if a.begins(word))
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, dict[str, str]]]:
        """(license, first character, end, variables) of all matches; a license's own matches don't overlap, the first and longest counts."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        out, free = [], dict.fromkeys(self.automata, 0)
        for at, word in enumerate(words):
            for name in self._may(word):
                if at < free[name] or at and words[at - 1] in DENIED:
                    continue
                hit = self.automata[name].run(words, at)
                if hit and hit[0] > at:
                    out.append((name, spans[at][0], spans[hit[0] - 1][1], hit[1]))
                    free[name] = hit[0]
        return sorted(out, key=lambda m: (m[0], m[1]))


def scan(text: str, automata: dict[str, Automaton]) -> list[tuple[str, int, int, dict[str, str]]]:
    """All matches of one text, as `Scanner.scan` gives them."""
    return Scanner(automata).scan(text)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, variables): every place of `docs` where a template's wording is.

    start and end count characters of the text from 0.  Whole texts are read.
    A text may have several licenses, or one several times.  Null and empty
    texts have none.  Each row is scanned by itself: repeated rows are reported
    repeatedly, and a null doc_id as null.  An empty table, or no templates,
    gives no rows; extra columns are ignored.
    """
    automata = {k: Automaton(v) for k, v in sorted((TEMPLATES if templates is None else templates).items())}
    schema = "doc_id long, license string, start int, end int, variables map<string,string>"
    if not automata:
        return docs.sparkSession.createDataFrame([], schema)
    low = F.lower(F.col("text"))
    plain = {tuple([w for w in a.needed if w.isascii()][:3]) for a in automata.values()}
    may = F.lit(False)
    for words in sorted(plain):
        may |= reduce(lambda x, y: x & y, (low.contains(w) for w in words), F.lit(True))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automata)
        for batch in batches:
            got = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for m in scanner.scan(t)]
            i, lic, a, b, v = zip(*got) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(lic, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([list(x.items()) for x in v], pa.map_(pa.string(), pa.string()))], ["doc_id", "license", "start", "end", "variables"])

    return rows.mapInArrow(run, schema)
