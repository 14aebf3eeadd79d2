"""Documents to section trees: markdown by its headings, source code by its declarations.

Both are grammars with state, so they run in Python over Arrow batches, whole
documents at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 250
SECTIONS = "doc_id string, section_id string, parent_id string, branch array<string>, level int, start int, end int, title string, content string"
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def blocks(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, heading level or 0, title) of headings, fenced code and paragraphs."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    i = 0
    while i < len(lines):
        start, line = lines[i]
        bare = line.rstrip("\r\n")
        if not bare.strip():
            i += 1
        elif m := _FENCE.match(bare):
            j = i + 1
            while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j][1]):
                j += 1
            end = min(j, len(lines) - 1)
            yield start, lines[end][0] + len(lines[end][1]), 0, ""
            i = end + 1
        elif m := _ATX.match(bare):
            yield start, start + len(line), len(m[1]), (m[2] or "").strip()
            i += 1
        else:
            j = i + 1
            level = 0
            while j < len(lines):
                nxt = lines[j][1].rstrip("\r\n")
                if m := _SETEXT.match(nxt):
                    level = 1 if m[1][0] == "=" else 2
                    j += 1
                    break
                if not nxt.strip() or _ATX.match(nxt) or _FENCE.match(nxt):
                    break
                j += 1
            end = lines[j - 1][0] + len(lines[j - 1][1])
            yield start, end, level, bare.strip() if level else ""
            i = j


def section_tree(text: str, max_words: int = MAX_WORDS) -> list[dict]:
    """Sections in order: the root of level 0, headings under the closest shallower one, and a new section where one has `max_words` words or more.

    Sections whose range is their parent's are left out, their children lifted.
    """
    root = {"level": 0, "start": 0, "end": len(text), "title": "", "parent": None, "words": 0, "forced": False}
    out, stack = [root], [root]

    def opened(level: int, start: int, title: str, forced: bool) -> dict:
        while stack[-1]["level"] >= level:
            stack.pop()["end"] = start
        node = {"level": level, "start": start, "end": len(text), "title": title, "parent": stack[-1], "words": 0, "forced": forced}
        out.append(node), stack.append(node)
        return node

    for start, end, level, title in blocks(text):
        words = len(text[start:end].split())
        if level:
            opened(level, start, title, False)
        elif stack[-1]["words"] >= max_words:
            now = stack[-1]
            opened(now["level"] if now["forced"] else now["level"] + 1, start, now["title"] if now["forced"] else "", True)
        stack[-1]["words"] += words
    same = [n for n in out if n["parent"] is not None and (n["start"], n["end"]) == (n["parent"]["start"], n["parent"]["end"])]
    for n in same:
        for child in out:
            if child["parent"] is n:
                child["parent"] = n["parent"]
        n["parent"]["title"] = n["parent"]["title"] or n["title"]
        out.remove(n)
    return out


_OPEN = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:public|private|protected|static|abstract|async|final|[ \t])*"
DECLARATIONS = {
    "go": re.compile(r"^(?:func|type|var|const)\b[ \t]*(?:\([^)]*\)[ \t]*)?(\w+)?", re.M),
    "js": re.compile(_OPEN + r"(?:function\*?|class|interface|enum|type|const|let)[ \t]+(\w+)", re.M),
    "php": re.compile(_OPEN + r"(?:function|class|interface|trait|enum)[ \t]+(\w+)", re.M),
    "json": re.compile(r'^ {0,2}"(\w+)"\s*:', re.M),
    "yaml": re.compile(r"^([\w-]+):", re.M),
}
EXTENSIONS = {".go": "go", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".py": "py", ".pyi": "py", ".php": "php", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
_COMMENT = re.compile(r"[ \t]*(?://|#|\*|/\*|\*/)")


def declarations(filename: str, text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of declarations with the comments right above them, inner ones after outer ones."""
    kind = EXTENSIONS.get("." + filename.rsplit(".", 1)[-1].lower() if "." in filename else "")
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = text.splitlines()

    def glued(no: int) -> int:
        while no > 0 and _COMMENT.match(lines[no - 1]):
            no -= 1
        return starts[no]

    if kind == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        return sorted(((glued(min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1), starts[n.end_lineno], n.name) for n in found), key=lambda x: (x[0], -x[1]))
    if kind is None:
        return []
    out = []
    hits = list(DECLARATIONS[kind].finditer(text))
    for i, m in enumerate(hits):
        no = text.count("\n", 0, m.start())
        end = starts[-1] if i + 1 == len(hits) else glued(text.count("\n", 0, hits[i + 1].start()))
        if kind in ("go", "js", "php") and (brace := text.find("{", m.end())) >= 0 and "\n\n" not in text[m.end() : brace]:
            depth = 0
            for at in range(brace, len(text)):
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                if not depth:
                    end = next((s for s in starts if s > at), len(text))
                    break
        out.append((glued(no), end, m[1] or ""))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def code_tree(filename: str, text: str, max_words: int = MAX_WORDS) -> list[dict]:
    """The file and its declarations, nested by range; leaves of more than `max_words` words are cut at line ends."""
    root = {"level": 0, "start": 0, "end": len(text), "title": filename, "parent": None}
    out, stack = [root], [root]
    for start, end, name in declarations(filename, text):
        while start >= stack[-1]["end"] or end > stack[-1]["end"]:
            if len(stack) == 1:
                break
            stack.pop()
        node = {"level": len(stack), "start": start, "end": end, "title": name, "parent": stack[-1]}
        out.append(node), stack.append(node)
    for leaf in [n for n in out if not any(c["parent"] is n for c in out)]:
        at, cuts, words = leaf["start"], [leaf["start"]], 0
        for line in text[leaf["start"] : leaf["end"]].splitlines(keepends=True):
            words += len(line.split())
            at += len(line)
            if words >= max_words and at < leaf["end"]:
                cuts.append(at)
                words = 0
        if len(cuts) > 1:
            out += [{"level": leaf["level"] + 1, "start": a, "end": b, "title": "", "parent": leaf} for a, b in zip(cuts, [*cuts[1:], leaf["end"]])]
    return sorted(out, key=lambda n: (n["start"], -n["end"], n["level"]))


def rows(doc_id: str, text: str, tree: list[dict]) -> list[dict]:
    number = {id(n): f"{doc_id}#{i}" for i, n in enumerate(tree)}
    out = []
    for n in tree:
        branch, p = [], n
        while p is not None:
            branch.append(number[id(p)])
            p = p["parent"]
        out.append({"doc_id": doc_id, "section_id": branch[0], "parent_id": branch[1] if len(branch) > 1 else None, "branch": branch[::-1], "level": n["level"], "start": n["start"], "end": n["end"], "title": n["title"], "content": text[n["start"] : n["end"]]})
    return out


def sections(docs: DataFrame, filename: str | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """The section tree of every (doc_id, text); with the name of a column of file names, source code is parsed as such.  A null text is an empty document of one section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, name in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "name"))):
                text = text or ""
                code = name and "." + name.rsplit(".", 1)[-1].lower() in EXTENSIONS
                tree = code_tree(name, text, max_words) if code else section_tree(text, max_words)
                yield pa.RecordBatch.from_pylist(rows(doc, text, tree), schema=_ARROW)

    name = F.col(filename) if filename else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), name.alias("name")).where("doc_id is not null").mapInArrow(run, SECTIONS)


_ARROW = pa.schema([("doc_id", pa.string()), ("section_id", pa.string()), ("parent_id", pa.string()), ("branch", pa.list_(pa.string())), ("level", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("title", pa.string()), ("content", pa.string())])


def image_references(docs: DataFrame, most: int = 32) -> DataFrame:
    """(doc_id, destination): the first distinct image destinations of each markdown text."""
    found = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1)))
    return docs.select("doc_id", F.explode(F.slice(found, 1, most)).alias("destination"))
