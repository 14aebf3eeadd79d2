"""URL allow and block lists as one trie over reversed host labels and path segments.

Spark splits each URL into steps, `.org .example .www /en /page`; the trie of
all entries is broadcast and walked along them, and the deepest entry met
decides.  Lists of more than `broadcast_entries` entries aren't broadcast: then
each distinct URL's prefixes are joined with the entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where `url` has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")


def steps(url: Column) -> Column:
    """Reversed host labels, each after a dot, then path segments, each after a slash; query and fragment don't count."""
    name = host(url)
    labels = F.when(name == "", F.array().cast("array<string>")).when(name.startswith("["), F.array(name)).otherwise(F.reverse(F.split(name, r"\.")))
    segments = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")
    return F.concat(F.transform(labels, lambda x: F.concat(F.lit("."), x)), F.transform(segments, lambda x: F.concat(F.lit("/"), x)))


def entry_steps(entry: str) -> list[str]:
    """Steps of an entry, `host` or `host/path`, with or without a scheme; a leading `*.` or `.` of the host is ignored."""
    m = re.match(_URL, entry if "://" in entry else "http://" + entry)
    name = m[1].lower().rstrip(".").removeprefix("*").lstrip(".") if m else ""
    if not name:
        raise ValueError(f"no host in entry {entry!r}")
    labels = [name] if name.startswith("[") else name.split(".")[::-1]
    return ["." + x for x in labels] + ["/" + x for x in m[2].split("/") if x]


def _decided(allow: Iterable[str], block: Iterable[str]) -> dict[tuple[str, ...], tuple[str, str]]:
    """Steps to (action, entry); an entry in both lists is blocked, of two spellings of one entry the lesser counts."""
    out = {}
    for action, entries in (("allow", allow), ("block", block)):
        out |= {tuple(entry_steps(e)): (action, e) for e in sorted(set(entries), reverse=True)}
    return out


def build(allow: Iterable[str], block: Iterable[str]) -> dict:
    """The trie: a node maps a step to a node, and None to (action, entry) where an entry ends."""
    root: dict = {}
    for path, decision in _decided(allow, block).items():
        node = root
        for step in path:
            node = node.setdefault(step, {})
        node[None] = decision
    return root


def walk(root: dict, path: Iterable[str]) -> tuple[str, str | None]:
    """Action and entry of the deepest node along `path` that has one; ("none", None) without any."""
    node, found = root, root.get(None)
    for step in path:
        node = node.get(step)
        if node is None:
            break
        found = node.get(None, found)
    return found or ("none", None)


def filtered(pages: DataFrame, allow: Iterable[str], block: Iterable[str], broadcast_entries: int = 1_000_000, key: str = "page_id") -> DataFrame:
    """(page_id, url, host, action, entry) for every row of `pages`.

    An entry `host` matches that host and all below it; `host/path` matches
    that very host where the path begins with these whole segments.  Of all
    that match, the one with most steps decides; the same entry in both lists
    blocks.  action is allow, block or none.  Host case, a port, user names,
    empty segments, query and fragment don't matter; percent signs aren't
    decoded, and names in Unicode and their xn-- forms are different hosts.

    A null, empty or malformed URL has host '' (null for a null one) and action
    none.  Each row stands for itself, so null and repeated page_ids pass
    through.  Without entries every action is none.  An empty table gives no
    rows; extra columns are ignored.
    """
    allow, block = list(allow), list(block)
    rows = pages.select(F.col(key).alias(key), F.col("url").cast("string").alias("url"))
    if len(allow) + len(block) > broadcast_entries:
        return _joined(rows, allow, block, key)
    trie = rows.sparkSession.sparkContext.broadcast(build(allow, block))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            got = [walk(root, path or ()) for path in batch.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "url", "host")), pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [key, "url", "host", "action", "entry"])

    wide = rows.select(key, "url", host(F.col("url")).alias("host"), steps(F.col("url")).alias("steps"))
    return wide.mapInArrow(decide, f"{key} {dict(rows.dtypes)[key]}, url string, host string, action string, entry string")


def _joined(rows: DataFrame, allow: list[str], block: list[str], key: str) -> DataFrame:
    """The same by a shuffled join of every distinct URL's prefixes with the entries."""
    table = [("".join(path), len(path), action, entry) for path, (action, entry) in _decided(allow, block).items()]
    entries = rows.sparkSession.createDataFrame(table, "prefix string, depth int, action string, entry string")
    urls = rows.where("url is not null").select("url").distinct().withColumn("steps", steps(F.col("url")))
    prefixes = urls.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda n: F.array_join(F.slice("steps", 1, n), ""))).alias("prefix")).where("prefix != ''")
    best = prefixes.join(entries, "prefix").groupBy(F.col("url").alias("found_url")).agg(F.max_by(F.struct("action", "entry"), "depth").alias("best"))
    out = rows.join(best, F.col("url") == F.col("found_url"), "left")
    return out.select(key, "url", host(F.col("url")).alias("host"), F.coalesce("best.action", F.lit("none")).alias("action"), F.col("best.entry").alias("entry"))


def oracle(allow: Iterable[str], block: Iterable[str]) -> str:
    """DuckDB SQL for `filtered` over pages."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(''.join(p))}, {len(p)}, {quote(a)}, {quote(e)}, {str(any(s[0] == '/' for s in p)).lower()})" for p, (a, e) in _decided(allow, block).items())
    url = quote(_URL)
    return f"""
WITH entries(prefix, depth, action, entry, has_path) AS (VALUES {values}),
p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, {url}, 1)), '\\.+$', '') AS host,
             list_filter(string_split(regexp_extract(url, {url}, 2), '/'), lambda s: s <> '') AS segments FROM pages),
k AS (SELECT page_id, url, host,
             CASE WHEN host = '' THEN '' WHEN starts_with(host, '[') THEN '.' || host ELSE '.' || array_to_string(list_reverse(string_split(host, '.')), '.') END
             || CASE WHEN len(segments) = 0 THEN '' ELSE '/' || array_to_string(segments, '/') END AS path FROM p),
m AS (SELECT k.page_id, k.url, k.host, e.action, e.entry, row_number() OVER (PARTITION BY k.page_id ORDER BY e.depth DESC NULLS LAST) AS r
      FROM k LEFT JOIN entries e ON k.path = e.prefix OR starts_with(k.path, e.prefix || '/') OR (NOT e.has_path AND starts_with(k.path, e.prefix || '.')))
SELECT page_id, url, host, coalesce(action, 'none') AS action, entry FROM m WHERE r = 1"""
