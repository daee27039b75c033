"""URL filters with redirect equivalence: pages that redirect to one another, or name one
canonical address, are aliases, and a decision on one of them holds for all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parecer.llm.components import connected_components
from parecer.llm.storage import written

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, with its subdomains, and the paths that begin so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: What is not markup of the page itself.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TO = r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """An address without scheme and fragment, as a number; null without a host."""
    address = F.concat(host_of(url), path_of(url), F.regexp_extract(url, _PARTS, 3))
    return F.when(host_of(url) != "", F.xxhash64(address))


def matching(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of rules of one length the
    first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _absolute(link: Column, url: Column) -> Column:
    """The address a page's link means."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    base = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "(?s)^(.*/)", 1)
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """``url`` and ``target`` of every canonical link and refresh in the pages' markup."""
    some = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    shown = pages.where(some).select("url", F.regexp_replace("html", _HIDDEN, " ").alias("h"))

    def links(pattern: str, target: Callable[[Column], Column]) -> Column:
        return F.transform(F.regexp_extract_all("h", F.lit(pattern), F.lit(0)), target)

    href = links(
        _CANONICAL, lambda tag: F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)])
    )
    refresh = links(_REFRESH, lambda tag: F.regexp_extract(tag, _TO, 1))
    return shown.select("url", F.explode(F.concat(href, refresh)).alias("link")).select(
        "url", _absolute(F.col("link"), F.col("url")).alias("target")
    ).where("target is not null")


def judged(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, component.

    A rule that fits decides. Any other page is decided by its aliases, the pages and
    addresses in its connected component over canonical links, refreshes and ``redirects``
    (``url``, ``target``): allowed if a rule allows one of them, else blocked if a rule blocks
    one, else allowed. Null addresses and those without ``://`` have an empty host and path,
    fit no rule, and have no aliases; null markup has no links. Pages of one address are one
    node, so repeated rows are judged alike. ``component`` is null for a page without aliases.
    Other columns are not read. An empty table gives none.
    """
    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    sides = {
        side: matching(host_of(F.col(side)), path_of(F.col(side)), rules)[1]
        for side in ("url", "target")
    }
    edges = written(
        links.select(
            node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"),
            sides["url"].alias("verdict_a"), sides["target"].alias("verdict_b"),
        ).where("a is not null and b is not null"),
        "links",
    )
    components = connected_components(edges)
    # Each end of a link says what the rules say of it; combined before the shuffle.
    said = reduce(
        DataFrame.union,
        (edges.select(F.col(n).alias("id"), F.col(f"verdict_{n}").alias("said")) for n in "ab"),
    ).where("said is not null").distinct()
    decided = (
        said.join(components, "id")
        .groupBy("component")
        .agg(F.min("said").alias("decision"))  # allow comes before block
    )
    aliases = components.join(decided, "component", "left")
    host, path, node = host_of(F.col("url")), path_of(F.col("url")), node_of(F.col("url"))
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("id"))
        .join(aliases, "id", "left")
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, "decision", F.lit(ALLOW)).alias("verdict"), "component",
        )
    )
