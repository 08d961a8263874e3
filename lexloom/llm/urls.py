"""URL filters: a trie over reversed host labels and path segments, longest match first.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
the end; null or no ``://``: both empty. A rule (host, path) fits its host and all subdomains when the path
starts with the rule's. Of the fitting rules the longest (host and path together) wins, a block before
an allow of the same length. Without one the verdict is ``default``.

The trie is broadcast. Its rules come from the driver's configuration, not from the data, and
``MAX_RULES`` bounds them; a longer list is refused (split it into several passes by top-level label).
Edge cases: null urls and urls without a host fit no rule; repeated rows and extra columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.session import prepare

MAX_RULES = 1_000_000
Rule = tuple[str, str, str]  # verdict, host, path


class Trie:
    """Edges are host labels from the right, then whole path segments; a node's ``tails`` are rules that end within its next segment."""

    def __init__(self, rules: Sequence[Rule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules are above the bound of {MAX_RULES}")
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("", ""))[0] != "block":
                tails[tail] = (verdict, host + path)
            node["longest"] = max(node.get("longest", 0), len(tail))  # prefixes beyond it end no rule

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """verdict and text of the longest rule that fits."""
        best: tuple[tuple[int, bool], tuple[str, str]] | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            inner = node
            for segment in segments:
                tails = inner.get("tails")
                if tails:
                    for length in range(min(len(segment), inner["longest"]) + 1):
                        got = tails.get(segment[:length])
                        if got and (best is None or (len(got[1]), got[0] == "block") > best[0]):
                            best = ((len(got[1]), got[0] == "block"), got)
                inner = inner.get(("path", segment))
                if inner is None:
                    break
        return best and best[1]


_FOLD = {i: i + 32 for i in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (null without one), verdict for every row of ``pages`` (columns ``key`` and url are read)."""
    spark = prepare(pages.sparkSession)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            found = [find(*x) if x[0] else None for x in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([f and f[1] for f in found], pa.string()),
                    pa.array([f[0] if f else default for f in found], pa.string()),
                ],
                [key, "host", "path", "rule", "verdict"],
            )

    return pages.select(key, "url").mapInArrow(judge, f"{key} {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string")
