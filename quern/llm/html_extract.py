"""HTML extraction: pages are differenced against the page of the nearest URL on their host."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import whole_row, written

#: Pages that a path range of a large host holds on average; ranges, not hosts, are sorted in one task. No result depends on it.
NEIGHBOURS = 5000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav header footer aside form dialog menu head button select object audio video".split())
_CHROME_ROLES = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|alert|alertdialog|dialog|menu|menubar)\b")
_CHROME_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri(?:be|ption)|"
    r"sidebar|side-?nav|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|respond|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"pagination|pager|login|signup|search-?(?:box|form)|widget|toolbar|skip-?link)(?![a-z])"
)
_ATTRIBUTE = re.compile(r"([a-z][a-z-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

#: Where a line stands by its markup: inside the article, in the page's furniture, or neither.
MAIN, CHROME, OPEN = 0, 1, 2


def _marked(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element starts furniture, and whether it starts the article."""
    if not attributes.strip():
        return name in _CHROME, name in ("article", "main")
    found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    names = " ".join((found.get("class", ""), found.get("id", ""))).lower()
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))
    article = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    if article and name not in _CHROME and not hidden:
        return bool(re.search(r"(?<![a-z])comments?(?![a-z])", names)), True
    return name in _CHROME or hidden or bool(_CHROME_ROLES.search(found.get("role", ""))) or bool(_CHROME_NAMES.search(names)), False


def text_lines(page: str) -> tuple[list[str], list[int]]:
    """The page's blocks of text in order, white space in each turned into one space, and where each stands: MAIN, CHROME or OPEN."""
    lines: list[str] = []
    places: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    chrome = main = linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            furniture = chrome or (not main and linked > 0.6 * len(text))
            lines.append(text)
            places.append(CHROME if furniture else MAIN if main else OPEN)
        held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal chrome, main, in_link
        if any(x[0] in _BLOCKS or x[1] or x[2] for x in stack[to:]):
            flush()
        for name, furniture, article in stack[to:]:
            chrome -= furniture
            main -= article
            in_link -= name == "a"
        del stack[to:]

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            held.append(page[at : token.start()])
            linked += (token.start() - at) * bool(in_link)
        at = token.end()
        closing, name, attributes = token[2], token[3], token[4]
        if name is None:
            continue
        name = name.lower()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                if name in _BLOCKS:
                    flush()
            continue
        if name in _BLOCKS:  # a block ends an open paragraph, and an item the item before it
            ends = ("p", name) if name in ("li", "dt", "dd", "tr") else ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in _BLOCKS:
                    break
            flush()
        elif name in ("br", "td", "th", "option"):
            held.append(" ")
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        furniture, article = _marked(name, attributes)
        if (furniture or article) and held:
            flush()
        stack.append((name, furniture, article))
        chrome += furniture
        main += article
        in_link += name == "a"
    held.append(page[at:])
    flush()
    return lines, places


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[bool]:
    """Which lines of a belong to a longest common subsequence with b (bit-parallel: a row of the table is one integer)."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    shared, j = [False] * len(a), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if above >> j & 1:  # the step of the table in this column comes from line i
            shared[i] = True
            j -= 1
    return shared


def main_lines(lines: Sequence[str], places: Sequence[int], shared: Sequence[bool]) -> tuple[list[str], int, int, int]:
    """The lines that are the page's main text, given which of them its neighbour shares; how many lines went as shared; how
    many by their markup; and how many of the first would have stayed but for the neighbour.

    Shared lines go, but for those of a marked article, which stays whole: articles quote each other, and furniture inside
    one is marked as such. Of the lines that are left, the markup judges what the neighbour cannot show: furniture of this
    page alone goes, and so do lines outside the article where one is marked.
    """
    marked = MAIN in places
    gone = [x and p != MAIN for x, p in zip(shared, places, strict=True)]
    stays = [p == MAIN or (p != CHROME and not marked) for p in places]
    kept = [x and not g for x, g in zip(stays, gone, strict=True)]
    return [x for x, k in zip(lines, kept, strict=True) if k], sum(gone), len(lines) - sum(gone) - sum(kept), sum(x and g for x, g in zip(stays, gone, strict=True))


def path_ranges(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of about NEIGHBOURS pages of the hosts of (host, key) that have more: host, firsts; and host, range, first, last.

    firsts are the sorted keys at which the ranges after the first begin, every so many of a sample by hash; first and
    last are the keys at a range's ends.
    """
    step = max(1, NEIGHBOURS // 16)
    every = NEIGHBOURS // step
    counts = keyed.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > NEIGHBOURS).select("host")
    sample = keyed.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).join(counts, "host", "left_semi")
    place = F.row_number().over(Window.partitionBy("host").orderBy("key"))
    firsts = sample.withColumn("place", place).where(F.col("place") % every == 0).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("firsts"))
    firsts = written(firsts, "ranges")
    ends = keyed.join(firsts, "host").withColumn("range", _range("key", "firsts")).groupBy("host", "range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    return firsts, written(ends, "ends")


def _range(key: str, firsts: str) -> Column:
    """How many of the sorted firsts are not above the key, by halving; none if they are null."""
    steps = F.array(*[F.lit(1 << x) for x in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, x: F.when(F.get(firsts, at + x - 1) <= F.col(key), at + x).otherwise(at))


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Struct `row` (pages' columns but `page`), main_text, n_shared, n_furniture and n_differenced of every row.

    Each page is paired with the page of its host (in lower case, with its port) whose path is nearest: the neighbour in
    path order that shares the longer start of its path, the one before on a tie. Pages of one path stand in the order of
    hashes of URL and row. The text lines of both are aligned by a longest common subsequence, and shared lines go
    (n_shared), but for those inside a marked article; n_differenced of them the markup would have kept. What differencing cannot see, the markup judges (n_furniture): furniture
    that differs from page to page (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element,
    role, class or id, and blocks that are mostly links), and, where there is a marked article with text, lines outside
    it. The lines left are joined by \\n.

    Null and empty pages have an empty text. Null URLs have no host and no pair, nor has a host's only page; then the
    markup alone decides. Repeated rows are each other's neighbours: in them only a marked article stays. Hosts of over
    NEIGHBOURS pages are sorted by path ranges, whose first and last pages go to the adjoining ranges as well, so that
    every page meets its neighbours; rows without a host are dealt out one by one.
    """
    @F.pandas_udf("lines array<string>, places array<int>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_lines(x) if x else ([], []) for x in batch]
            yield pd.DataFrame({"lines": [x[0] for x in found], "places": [x[1] for x in found]})

    @F.pandas_udf("text string, n_shared int, n_furniture int, n_differenced int")
    def differ(lines: pd.Series, places: pd.Series, path: pd.Series, own: pd.Series, path1: pd.Series, near1: pd.Series, path2: pd.Series, near2: pd.Series) -> pd.DataFrame:
        found = []
        for text, place, here, mine, there1, one, there2, two in zip(lines, places, path, own, path1, near1, path2, near2, strict=True):
            start = lambda other: -1 if other is None else len(os.path.commonprefix([here, other]))
            pair = one if start(there1) >= start(there2) else two
            shared = common_lines(list(mine), list(pair)) if pair is not None else [False] * len(text)
            found.append(main_lines(text, place, shared))
        return pd.DataFrame({"text": ["\n".join(x[0]) for x in found], "n_shared": [x[1] for x in found], "n_furniture": [x[2] for x in found], "n_differenced": [x[3] for x in found]})

    site = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host, path = F.lower(F.regexp_extract("url", site + "([^/?#]*)", 1)), F.regexp_extract("url", site + "[^/?#]*([^#]*)", 1)
    deal = F.xxhash64(F.to_json("row"))  # of the whole row, so that a URL that many rows share is dealt out too
    rows = pages.select(whole_row(pages.drop(page)).alias("row"), F.col(url).alias("url"), F.col(page).alias("page"))
    rows = rows.withColumns({"host": host, "key": F.struct(path.alias("path"), F.xxhash64("url").alias("code"), deal.alias("deal"))})
    none = F.col("host").isNull() | (F.col("host") == "")
    firsts, ends = path_ranges(rows.where(~none).select("host", "key"))  # about one row or key per NEIGHBOURS pages
    rows = rows.select("row", "host", "key", cut("page").alias("cut")).select("row", "host", "key", "cut.lines", "cut.places")
    rows = rows.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    rows = rows.join(firsts, "host", "left").withColumn("range", _range("key", "firsts")).drop("firsts").join(ends, ["host", "range"], "left")
    # A range's first and last pages are guests of the ranges beside it.
    at = F.col("range").cast("long")
    groups = F.array(at, F.when(F.col("key") == F.col("first"), at - 1), F.when(F.col("key") == F.col("last"), at + 1))
    rows = rows.withColumn("group", F.explode(F.when(none, F.array("key.deal")).otherwise(F.array_compact(groups))))
    rows = rows.select("row", "host", "group", "lines", "places", "hashes", "key.path", "key.code", "key.deal", (~none & (F.col("group") != at)).alias("guest"))
    near = Window.partitionBy("host", "group").orderBy("path", "code", "deal")
    beside = {f"{c}{i}": F.when(~none, way(c).over(near)) for c in ("path", "hashes") for i, way in ((1, F.lag), (2, F.lead))}
    rows = rows.withColumns(beside).where("guest IS NOT TRUE")
    rows = rows.select("row", differ("lines", "places", "path", "hashes", "path1", "hashes1", "path2", "hashes2").alias("found"))
    return rows.select("row", F.col("found.text").alias("main_text"), "found.n_shared", "found.n_furniture", "found.n_differenced")
