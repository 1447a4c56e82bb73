"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of element styles (tags with class names, digits folded).  A style's
presentation importance is the entropy of its child layouts over the host's pages, its content importance one minus the
mean entropy of its text blocks over these pages: a block that returns on every page carries nothing.  Copies of a page
count as one page.  Branches of low composite importance are taken out of each page, but inside a declared article only
if each of their blocks returns in another article.  Entropy can't tell a menu whose entries differ on every page from an
article, so a prior joins it: the part a tag, role or class name declares (navigation, advert, comment ...), the share of
text inside links, and whether a declared article lies elsewhere.  A tag or role decides; a form or a class word, which
wrappers of whole pages have as well, is a factor: what is marked so goes only if enough other text remains.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.llm.arrow_text import bounded, slices
from placerank.llm.common import attach, materialise, small

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD, DIGITS = re.compile(r"[a-z]+"), re.compile(r"\d+")
#: HTML fixed sets: elements without content, elements whose content is not markup, and elements that end a text block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same set closes if one is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Declared parts that are no main text: by element, by ARIA role, by a word of a class or id.
PART_TAGS = set("nav aside footer button select menu dialog head svg canvas object search".split())
PART_ROLES = set("navigation banner contentinfo search complementary alert dialog alertdialog menu menubar toolbar form".split())
PART_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus respond replies share "
    "sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager masthead topbar".split()
)
#: Words that stay decisive, and words of a class that say what a wrapper has or does, not what it is ("has-sidebar").
FIRM_WORDS = set("comment comments disqus respond replies".split())
STATE_WORDS = set("has with without no is open opened closed enabled disabled".split())
#: How much a mark says: nothing, a factor of the importance (form, class word), or that the part is no main text.
CLEAR, WORDED, FIRM = 0, 1, 2
FACTOR = 0.25
#: Composite importance below which a style is noise, and inside a declared article.
LEAST, LEAST_INSIDE = 0.3, 0.05
#: A pair of pages is one observation of what they share; every style counts as important in so many pairs before any.
PRIOR_PAIRS = 3.0
GAMMA = 0.2
#: Rows up to which the table of repeated contents is broadcast (a hash and a count each).
COPIES = 1_000_000


@dataclass
class Block:
    path: str
    text: str
    linked: int
    part: int
    inside: bool
    wrapped: bool


def named(name: str) -> set[str]:
    """Words of one class name or id; none if it says what the element has or does."""
    words = set(WORD.findall(name))
    return set() if words & STATE_WORDS else words


def declared(tag: str, attrs: str, inside: bool) -> tuple[str, int]:
    """Style name of an element, and how much it declares itself a part other than the main text."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = {w for name in names.split() for w in named(name)}
    style = DIGITS.sub("0", names).split()
    if tag in ("body", "html"):
        part = CLEAR
    elif tag in ("article", "main"):
        part = FIRM if words & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo"} else CLEAR
    elif (
        tag in PART_TAGS or found.get("role", "").lower() in PART_ROLES or words & FIRM_WORDS or "hidden" in found or (tag == "header" and not inside)
        or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    ):
        part = FIRM
    else:
        part = WORDED if tag == "form" or words & PART_WORDS or ("header" in words and not inside) else CLEAR
    return tag + "".join("." + s for s in sorted(style)), part


def blocks(page: str) -> tuple[list[Block], dict[str, str]]:
    """Text blocks of a page in order with the style path they stand in, and the child layout of every path."""
    out: list[Block] = []
    layout: dict[str, list[str]] = {}
    stack: list[tuple[str, str, int, bool, bool]] = [("", "", CLEAR, False, False)]  # tag, path, part, inside a declared article, that in a worded wrapper
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            _, path, part, inside, wrapped = stack[-1]
            out.append(Block(path, said, min(linked, len(said)), part, inside, wrapped))
        text.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        if any(t in BLOCK for t, *_ in stack[at:]):
            flush()
        links -= sum(t == "a" for t, *_ in stack[at:])
        del stack[at:]

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k:
                close(k)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                done = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = done.end() if done else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if k and not any(t in ("table", "td", "button") for t, *_ in stack[k:]):
                close(k)
            shut = CLOSES.get(tag, ())
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in shut or stack[i][0] in ("ul", "ol", "dl", "table", "select")), 0)
            if k and stack[k][0] in shut:
                close(k)
            flush()
        if tag == "a":
            links += 1
        _, path, part, inside, wrapped = stack[-1]
        style, own = declared(tag, m[3], inside)
        if tag in BLOCK or own:
            layout.setdefault(path, []).append(style)
            path = f"{path}>{style}"
        if tag in ("article", "main") and not own:
            wrapped, inside = wrapped or part == WORDED, True
            part = CLEAR if part == WORDED else part
        stack.append((tag, path, max(part, own), inside, wrapped))
    flush()
    return out, {k: " ".join(dict.fromkeys(v)) for k, v in layout.items()}


def occurrences(page: str) -> Iterator[tuple[str, str, int, int, int, int | None]]:
    """(path, kind, feature, characters, linked characters, article) of a page, each feature once: what the style tree counts.

    Kind p: the page has the path; l: its child layout; t: a text block in it, with the hash of the article it stands in."""
    found, layout = blocks(page)
    per: dict[str, list[int]] = {}
    seen = set()
    for b in found:
        sums = per.setdefault(b.path, [0, 0])
        sums[0] += len(b.text)
        sums[1] += b.linked
        seen.add((b.path, hash_of(b.text), b.inside))
    article = hash_of("\n\n".join(b.text for b in main_blocks(found) if b.inside))
    for path, (chars, linked) in per.items():
        yield path, "p", 0, chars, linked, None
    for path in per:
        yield path, "l", hash_of(layout.get(path.rpartition(">")[0], "")), 0, 0, None
    for path, feature, inside in seen:
        yield path, "t", feature, 0, 0, article if inside else None


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(df: DataFrame) -> DataFrame:
    return df.withColumn("_host", F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1)), F.lit("")))


def with_copies(pages: DataFrame) -> DataFrame:
    """_host, html and how many rows of the host have this html."""
    rows = host_of(pages).select("_host", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("_page", F.xxhash64("_host", "html"))
    many = materialise(rows.groupBy("_page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    return rows.join(small(many, COPIES), "_page", "left").select("_host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def style_tree(pages: DataFrame) -> DataFrame:
    """_host, path, importance and `shared` of every style of every host, from the distinct pages.

    Shared: each block of the style stands in different articles.  Each of n copies of a page adds 1 / n to the counts,
    which are summed before and after one shuffle by feature, then by style; a host may hold any share of the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                cols = [part.column(i).to_pylist() for i in range(3)]
                rows = [(h, f, k, x, 1 / n, c / n, a / n, t, t) for h, p, n in zip(*cols, strict=True) for f, k, x, c, a, t in occurrences(p or "")]
                got = pd.DataFrame(rows, columns=["_host", "path", "kind", "feature", "pages", "chars", "linked", "low", "high"])
                got = got.astype({"feature": "int64", "pages": "float64", "chars": "float64", "linked": "float64", "low": "Int64", "high": "Int64"})
                got = got.groupby(["_host", "path", "kind", "feature"], as_index=False).agg({"pages": "sum", "chars": "sum", "linked": "sum", "low": "min", "high": "max"})
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    raw = bounded(with_copies(pages)).mapInArrow(run, "_host string, path string, kind string, feature long, pages double, chars double, linked double, low long, high long")
    per = raw.groupBy("_host", "path", "kind", "feature").agg(
        *[F.round(F.sum(c)).cast("long").alias(c) for c in ("pages", "chars", "linked")], (F.min("low") != F.max("high")).alias("shared")
    )
    kind, k = F.col("kind"), F.col("pages")
    per = per.groupBy("_host", "path").agg(
        F.sum(F.when(kind == "p", k)).alias("m"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.avg(F.when(kind == "t", F.log(k.cast("double")))).alias("block_entropy"),
        F.sum(F.when(kind == "l", k * F.log(k.cast("double")))).alias("layout_sum"), F.coalesce(F.min("shared"), F.lit(False)).alias("shared"),
    )
    seen = F.col("m").cast("double")
    base = F.log(seen)
    pairs = seen * (seen - 1) / 2
    shrunk = lambda found: F.when(seen > 1, (pairs * found + PRIOR_PAIRS) / (pairs + PRIOR_PAIRS)).otherwise(1.0)
    content = shrunk(1 - F.col("block_entropy") / base)
    layout = shrunk(1 - F.col("layout_sum") / F.col("m") / base)
    share = F.col("linked") / F.greatest(F.col("chars"), F.lit(1))
    composite = (GAMMA * F.least(layout, content) + (1 - GAMMA) * content) * F.when(share > 0.6, 0.0).otherwise(1.0)
    return per.select("_host", "path", composite.alias("importance"), "shared")


def main_blocks(found: list[Block]) -> list[Block]:
    """Blocks of a page that the declared parts leave, in order.

    Articles outside worded wrappers come first; text in worded marks joins what remains where a FACTOR of it outweighs that."""

    def size(some: list[Block]) -> int:
        return sum(len(b.text) for b in some)

    found = [b for b in found if b.part < FIRM]
    clear = [b for b in found if b.part == CLEAR]
    stated = size([b for b in clear if b.inside and not b.wrapped])
    within = size([b for b in clear if b.wrapped])
    if stated:
        both = FACTOR * within > stated
        found = [b for b in found if b.inside and (both or not b.wrapped)]
    elif within:
        both = size([b for b in clear if not b.inside]) > within
        found = [b for b in found if both or b.inside]
    kept = [b for b in found if b.part == CLEAR]
    return found if FACTOR * (size(found) - size(kept)) > size(kept) else kept


def main_text(page: str, noise: set[str], inner_noise: set[str]) -> str:
    """Main blocks of a page that are not noise, joined by blank lines."""
    found = main_blocks(blocks(page)[0])
    kept = [b for b in found if b.path not in (inner_noise if b.inside else noise)]
    return "\n\n".join(b.text for b in kept or found)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null or empty html gives an empty text, a null url counts as a host of its own; repeated pages stay repeated.  If all
    of a page would be noise by entropy (a host of copies of one page), only the prior decides."""
    tree = materialise(style_tree(pages).where(F.col("importance") < LEAST))
    noisy = tree.groupBy("_host").agg(  # a host's noisy styles: as many as its templates have
        F.collect_list("path").alias("noise"), F.collect_list(F.when((F.col("importance") < LEAST_INSIDE) & F.col("shared"), F.col("path"))).alias("inner_noise")
    )
    rows = host_of(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")))
    named = attach(rows, small(noisy, 5_000), ["_host"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                cols = [part.column(i) for i in range(part.num_columns)]
                texts = [
                    main_text(h or "", set(a or ()), set(b or ()))
                    for h, a, b in zip(cols[2].to_pylist(), cols[3].to_pylist(), cols[4].to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    named = named.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "noise", "inner_noise")
    return bounded(named).mapInArrow(run, "page_id long, url string, text string, n_chars long")
