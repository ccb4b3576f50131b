"""URL rules in a bit-parallel wildcard automaton.

All rules are packed into one extended Shift-And automaton: a bit for each literal or
one-character wildcard, spread over as many 64-bit words as needed. A character moves all
rules' states at once: shift, and with the character's mask; a wildcard run is a state
that keeps itself alive. A batch of URLs steps through its characters together.

In a rule `?` is one character, `*` any run without `/`, and `**` any run. Rules match a
whole canonical URL: a dot, the host, the path, and the query, with A-Z in lower case.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Host and path rules of the query, and what they decide.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: URLs that no rule fits are blocked if one of these does.
BLOCKED = (
    ".",  # no host at all
    "**bets**",
    "**pills**",
    "**casino**",
    "**/login**",
    "**/admin/**",
    "**.exe",
    "**.zip",
    "**/tag/?*/**",
    "**[?]sessionid=**",
    "**&sessionid=**",
)


class Automaton:
    """Matches strings against all patterns at once. `[x]` stands for the character x."""

    def __init__(self, patterns: list[str]):
        items: list[tuple[int, str]] = []  # per bit: (pattern, what it reads)
        loops: list[tuple[int, str]] = []  # per run: (bit it stands behind, -1 at a start, kind)
        self.accept: list[list[int]] = []  # bits that end each pattern
        self.empty = np.zeros(len(patterns), bool)
        begins = []
        for p, pattern in enumerate(patterns):
            parts = re.findall(r"\[.\]|\*\*|.", pattern, re.S)
            begins.append(len(items))
            items.append((p, "start"))  # set before the first character only
            for x in parts:
                if x in ("*", "**"):
                    loops.append((len(items) - 1, x))
                else:
                    items.append((p, "any" if x == "?" else x[1] if len(x) == 3 else x))
            self.accept.append([len(items) - 1])
        self.words = max(1, -(-len(items) // 64))
        self.start = self._bits(begins)
        self.last = [a[0] for a in self.accept]
        self.loop_any = self._bits([b for b, x in loops if x == "**"])
        self.loop_part = self._bits([b for b, x in loops if x == "*"])
        others = self._bits([i for i, (_, x) in enumerate(items) if x == "any"])
        kinds = sorted({x for _, x in items if x not in ("start", "any")})
        self.code = {x: i + 1 for i, x in enumerate(kinds)}
        self.masks = np.zeros((len(kinds) + 1, self.words), np.uint64)
        self.masks[:] = others
        for x, i in self.code.items():
            self.masks[i] |= self._bits([k for k, (_, y) in enumerate(items) if y == x])
        self.slash = self.code.get("/", -1)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in places:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each pattern."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        table = np.zeros(0x110000, np.uint16)
        for x, i in self.code.items():
            table[ord(x)] = i
        flat = table[np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        state = np.tile(self.start, (len(order), 1))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than step
            c = flat[starts[:live] + step]
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            stay = s & (self.loop_any | np.where((c == self.slash)[:, None], np.uint64(0), self.loop_part))
            state[:live] = (moved & self.masks[c]) | stay
        out = np.zeros((len(texts), len(self.last)), bool)
        for p, bit in enumerate(self.last):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


_parts = re.compile(r"^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
_lower = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lowered), path and query of a URL; all empty if it has no `://`."""
    found = _parts.match(url or "")
    return (found[1].translate(_lower), found[2], found[3] or "") if found else ("", "", "")


def rule_glob(rule: str) -> str:
    """A host/path rule as a pattern: the host and its subdomains, paths that begin so."""
    plain = re.sub(r"[\[*?]", lambda m: f"[{m[0]}]", rule)
    return f"*.{plain}**"


def judge_urls(pages: DataFrame, rules: tuple = RULES, blocked: tuple = BLOCKED, key: str = "page_id") -> DataFrame:
    """The key, host, path, rule and verdict of every row; one pass without a shuffle.

    Of the rules that fit, the longest decides; without one, a URL that a `blocked` pattern
    fits is blocked and any other allowed. A null or empty url, or one without `://`, has
    empty host and path, no rule, and the verdict block. Rules compare the path as it is;
    `blocked` patterns see path and query in lower case. Repeated rows each give a row; an
    empty table gives none.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    made: list[Automaton] = []

    def run(batches):
        if not made:
            made.extend((Automaton([rule_glob(r) for r, _ in ranked]), Automaton(list(blocked))))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                parts = [split_url(u) for u in some.column("url").to_pylist()]
                fits = made[0].match([f".{h}{p}" for h, p, _ in parts])
                hits = made[1].match([f".{h}{p}{q}".translate(_lower) for h, p, q in parts])
                first = np.where(fits.any(1), fits.argmax(1), -1)
                rule = [ranked[i][0] if i >= 0 else None for i in first.tolist()]
                bad = hits.any(1).tolist()
                verdict = [ranked[i][1] if i >= 0 else "block" if b else "allow" for i, b in zip(first.tolist(), bad, strict=True)]
                out = {
                    key: some.column(key),
                    "host": pa.array([h for h, _, _ in parts], pa.string()),
                    "path": pa.array([p for _, p, _ in parts], pa.string()),
                    "rule": pa.array(rule, pa.string()),
                    "verdict": pa.array(verdict, pa.string()),
                    "n_patterns": pa.array(hits.sum(1), pa.int32()),
                }
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "url").mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string, n_patterns int")


def query(spark: SparkSession, path: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{path}/pages.parquet"))


SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*([?][^#]*)', 1) ELSE '' END AS search
  FROM pages),
named AS (
  SELECT page_id, path, search,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parts),
ruled AS (
  SELECT page_id, host, path,
         translate('.' || host || path || search, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole,
         CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM named),
fits AS (
  SELECT *, (CASE WHEN whole = '.' THEN 1 ELSE 0 END
    + CASE WHEN whole LIKE '%bets%' THEN 1 ELSE 0 END + CASE WHEN whole LIKE '%pills%' THEN 1 ELSE 0 END
    + CASE WHEN whole LIKE '%casino%' THEN 1 ELSE 0 END + CASE WHEN whole LIKE '%/login%' THEN 1 ELSE 0 END
    + CASE WHEN whole LIKE '%/admin/%' THEN 1 ELSE 0 END + CASE WHEN whole LIKE '%.exe' THEN 1 ELSE 0 END
    + CASE WHEN whole LIKE '%.zip' THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(whole, '/tag/[^/][^/]*/|/tag//[^/]*/') THEN 1 ELSE 0 END
    + CASE WHEN whole LIKE '%?sessionid=%' THEN 1 ELSE 0 END + CASE WHEN whole LIKE '%&sessionid=%' THEN 1 ELSE 0 END) AS n_patterns
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_patterns > 0 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_patterns AS INTEGER) AS n_patterns
FROM fits
"""
