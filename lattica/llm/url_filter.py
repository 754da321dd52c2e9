"""URL filter: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what separates tokens in host + path
BREAK = r"[^0-9A-Za-z]+"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host + path, the tokens that each match must hold, and what follows.

    tokens: literal strings that stand as whole tokens in every URL that the pattern matches; a rule
    without any is tried on every URL. Of the rules that match, the highest rank decides; ties go to
    the smaller name.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host with all its subdomains and every path that starts with the given one."""
    inner = re.split(BREAK, path)[:-1]  # the last part may go on in the URL, so it is no whole token
    tokens = tuple(t for t in [*re.split(BREAK, host), *inner] if t)
    return UrlRule(host + path, rf"(?:[^/]*\.)?{re.escape(host + path)}", verdict, tokens, len(host + path))


#: The rules that the registered query judges by.
DEFAULT_RULES = (
    host_path_rule("com", "/en/", "block"),
    host_path_rule("example.com", "/en/7", "allow"),
    host_path_rule("net", "/de/", "allow"),
    host_path_rule("example.net", "/de/8", "block"),
    host_path_rule("org", "/es/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// with A-Z lower-cased, path up to ? or #."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens stands, over all rows; one result row per token."""
    words = F.explode(F.array_distinct(F.split(F.lower(F.col("url")), BREAK))).alias("t")
    wanted = sorted({t.lower() for t in tokens})
    counts = pages.select(words).where(F.col("t").isin(wanted)).groupBy("t").count()
    return dict(counts.collect())


def build_index(rules: Iterable[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list[UrlRule]], list[UrlRule]]:
    """Rules by their rarest token, and those without tokens."""
    index: dict[str, list[UrlRule]] = {}
    rest = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t.lower(), 0), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def judge_urls(pages: DataFrame, rules: Iterable[UrlRule] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row of pages.

    The URL's tokens fetch the rules filed under them, and only those run their regular expressions.
    Rules are a bounded driver-side list that travels with the tasks; rows are never shuffled.

    Defined cases: a null url, or one without ://, has empty host and path and matches no rule; rows
    where no rule matches have rule null and the default verdict; repeated rows are judged one by one;
    an empty table gives no rows; other columns are ignored.
    """
    rules = list(rules)
    index, rest = build_index(rules, token_counts(pages, [t for r in rules for t in r.tokens]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name + r.pattern: re.compile(r.pattern, re.DOTALL) for r in rules}
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                where = host + path
                found = {r for t in set(re.split(BREAK, where)) for r in index.get(t, ())}
                hits = [r for r in (*found, *rest) if where and compiled[r.name + r.pattern].match(where)]
                best = min(hits, key=lambda r: (-r.rank, r.name), default=None)
                out.append((host, path, best and best.name, best.verdict if best else default))
            cols = [pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, host string, path string, rule string, verdict string"
    return pages.select("page_id", "url").mapInArrow(run, schema)
