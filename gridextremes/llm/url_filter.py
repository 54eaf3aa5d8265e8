"""Allow and block lists of hosts and path prefixes, looked up in a trie."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

MAX_RULES = 1_000_000
SCHEMA = "rule string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z in lower case; empty without ``://`` or url."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[tuple[str, str]]) -> dict:
    """Trie over reversed host labels, with a trie over path segments at each host.

    ``rules`` are (verdict, ``host/path``). A node is a dict: children by label or
    segment, ``None`` for what lies in it. The last piece of a path may end inside
    a segment, so it is kept at its parent as a list of beginnings, longest first.
    Of two verdicts for the same rule, block holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast and takes {MAX_RULES} at most")
    root: dict = {}
    for verdict, rule in sorted(rules, key=lambda r: r[0] == "block"):
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict}")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *segments, tail = (slash + path).split("/")
        node = node.setdefault(None, {})
        for segment in segments:
            node = node.setdefault(segment, {})
        node.setdefault(None, {})[tail] = (len(rule), rule, verdict)
    _sort_tails(root)
    return root


def _sort_tails(root: dict) -> None:
    stack = [(root, False)]
    while stack:
        node, in_path = stack.pop()
        for key, child in list(node.items()):
            if key is None and in_path:
                node[None] = sorted(child.items(), key=lambda t: -len(t[0]))
            else:
                stack.append((child, in_path or key is None))


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest rule that fits, or None."""
    best = None
    node = trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        paths = node.get(None)
        if paths is not None:
            for segment in segments:
                for tail, found in paths.get(None, ()):
                    if segment.startswith(tail):
                        best = max(best, found) if best else found
                        break
                paths = paths.get(segment)
                if paths is None:
                    break
    return best[1:] if best else None


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
                otherwise: str = "allow") -> DataFrame:
    """``row`` (all columns), ``host``, ``path``, ``rule``, ``verdict`` of every row.

    A rule ``host/path`` fits its host and all subdomains when the url's path
    starts with the rule's; the longest rule wins, at the same length the one
    later by code point. Without one, ``rule`` is null and the verdict is
    ``otherwise``. The trie is sent to the tasks: it holds ``MAX_RULES`` rules at
    most, or building it raises.

    A null url, or one without ``://``, has an empty host and path and so no rule
    unless one is given for the empty host. Repeated rows are judged alike, an
    empty table gives an empty result, extra columns of any name stay in ``row``.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from gridextremes.llm.url_filter import longest_match

        for hosts, paths in batches:
            found = [longest_match(trie.value, h, p) or (None, otherwise) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    url = F.col(f"row.`{url_col}`")
    return (
        pages.select(packed(pages))
        .select("row", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("judged", judge("host", "path"))
        .select("row", "host", "path", "judged.rule", "judged.verdict")
    )
