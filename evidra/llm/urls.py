"""URL filters: rules indexed by their rarest literal token.

How often each token of a rule stands in the URLs is counted over all of them; each rule is filed under its
rarest. The tokens of a URL fetch the rules filed under them, and only those are matched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import common as _common  # noqa: F401

_TOKEN = re.compile("[a-z0-9]+")
_ASCII = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A rule for a host with its subdomains and a beginning of the path; or, with ``pattern``, for host and path together.

    ``literal`` lists whole tokens that stand in every URL that the pattern matches; the pattern decides where and
    how they must stand. Patterns see host, a line end and path, with A-Z lowered. Host rules decide before patterns.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literal: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Tokens whole in every URL that the rule fits; the path's last one may go on there unless something ends it."""
        if self.pattern:
            return sorted(set(self.literal))
        found = _TOKEN.findall(self.path.translate(_ASCII))
        if found and re.search("[A-Za-z0-9]$", self.path):
            found.pop()
        return sorted({*found, *_TOKEN.findall(self.host.translate(_ASCII))})


# Rules of host and path.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]
# Words that mark a host by one of its labels, a path by the beginning of a segment, or either in pairs.
HOST_WORDS = ["adult", "casino", "escort", "gambling", "porn", "warez", "xxx"]
PATH_WORDS = ["casino", "escort", "gambling", "keygen", "malware", "phishing", "poker", "porn", "torrent", "viagra", "warez", "xxx"]
PAIRS = [("cheap", "pills"), ("click", "bait"), ("online", "lottery"), ("spam", "farm"), ("sports", "bet")]
PATTERNS = [
    *[Rule("block", pattern=rf"\A(?:[^\n]*[.-])?{w}(?:[.-][^\n]*)?\n", literal=(w,)) for w in HOST_WORDS],
    *[Rule("block", pattern=rf"\n(?:[^\n]*/)?{w}(?:[._-][^/\n]*)?(?:/|\Z)", literal=(w,)) for w in PATH_WORDS],
    *[Rule("block", pattern=rf"(?:\A|[^a-z0-9]){v}[^a-z0-9]{w}(?:[^a-z0-9]|\Z)", literal=(v, w)) for v, w in PAIRS],
]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ://, up to / ? # or end, A-Z lowered; then up to ? # or end."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search("[/?#]", rest)
    end = end.start() if end else len(rest)
    return rest[:end].translate(_ASCII), re.split("[?#]", rest[end:], maxsplit=1)[0]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES, patterns: list[Rule] = PATTERNS) -> DataFrame:
    """(id, host, path, rule, verdict, patterns) for every row of ``pages``.

    Of the host rules that fit, the longest (host and path together, then the longer host) decides and is named
    in ``rule``; without one, ``rule`` is null and the verdict is block if a pattern matches, else allow.
    ``patterns`` lists those that match. A null url, or one without ://, has empty host and path, no rule and is
    allowed. Repeated rows each keep their row; an empty table gives no rows. The rule list is a parameter and
    travels with the code; the counts that reach the driver are as many as the rules have tokens.
    """
    every = [*rules, *patterns]
    vocabulary = {t for r in every for t in r.tokens()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in vocabulary.intersection(_TOKEN.findall("\n".join(split_url(url)).translate(_ASCII))):
                    seen[t] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    urls = F.col(url_col).cast("string")
    seen = {r["token"]: r["n"] for r in pages.select(urls).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    index: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(every):
        index[min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default="")].append(k)
    index = dict(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = [re.compile(r.pattern) if r.pattern else None for r in every]
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                both = "\n".join((host, path)).translate(_ASCII)
                best, marks = None, []
                for t in {"", *_TOKEN.findall(both)}:
                    for k in index.get(t, ()):
                        r = every[k]
                        if r.pattern:
                            if fits[k].search(both):
                                marks.append(r.pattern)
                        elif (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or (len(r.name), len(r.host)) > (len(best.name), len(best.host))):
                            best = r
                out.append((host, path, best.name if best else None, best.verdict if best else "block" if marks else "allow", sorted(marks)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.list_(pa.string()))], names=["id", "host", "path", "rule", "verdict", "patterns"])

    rows = pages.select(F.col(id_col).alias("id"), urls.alias("url"))
    return rows.mapInArrow(judge, f"id {dict(rows.dtypes)['id']}, host string, path string, rule string, verdict string, patterns array<string>").withColumnRenamed("id", id_col)
