"""Main-text extraction by a site style tree.

The DOMs of a host's pages are merged by path: a node of the tree is a path of
element labels (tag, first class, id) of any length. For every node the host's pages vote
with how they lay it out (the labels of its children) and with what it says (a
hash of its text). A node's importance is the larger of the two entropies,
each relative to the most that so many pages can have: a branch that looks and
reads alike on all pages is a template and is cut from each page.

Entropy alone can't see that a menu with entries of its own on every page is a
menu, and can't judge a host of few pages, so what an element says of itself
(its tag, role, and class and id names that mean nothing but page furniture)
takes its importance away first. Names that also have another meaning, and
names that mean nothing, are judged by the tree: by the share of links in the
text, by paragraphs, by repeated entries, by what follows. Inside an article only elements with a class
or id of their own are judged by entropy, so that copies of a page on one host
don't lose their text.

Pages are read in one pass without recursion, in time linear in their length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

from .common import settle, slices

# Elements and words that mark what is not main text.
RAW = frozenset("script style noscript template textarea title iframe svg object xmp".split())
APART = RAW | frozenset("head nav header footer aside form button select menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar comment comments commentlist respond disqus "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related recommended popup modal login search pagination pager toolbar copyright "
    "crumb crumbs adsbygoogle reply replies".split()
)
#: Of these, the ones that mean furniture whatever else a name says: google-ad does.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsored breadcrumb breadcrumbs crumbs navbar commentlist disqus replies".split())
#: Of these, the ones that articles are about too; they go unless they hold paragraphs of an article.
ALSO_WORDS = frozenset("social share sharing related recommended".split())
#: Names of readers' comments, if a list or repeated entries that nothing follows have them.
TALK_WORDS = frozenset("responses response discussion discussions reactions feedback thread threads conversation".split())
_HIDDEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements in which an inline element is part of a sentence.
_SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption pre caption".split())
#: Links that a named block in an article has at least, and the share of its text in them, to be a menu.
MENU_LINKS, MENU_SHARE = 3, 0.9
#: Parts of a name that leave the meaning of the words above as it is.
PLAIN_WORDS = frozenset(
    "area articles bar block body box buttons col column container content entry form global group holder icons inner item items left link links list main module news outer overlay page panel posts primary reader right row secondary section site slot stories sub thread top bottom unit user widget widgets wrap wrapper".split()
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The next attribute of any name with its value, or the end of the tag. An open quote runs to the end of the page.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*))?)?)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Pages of a host that must have a node before its entropy counts, and the importance below which it goes.
LEAST_PAGES, LEAST_IMPORTANCE = 4, 0.2
#: Characters of a path that is spelled out; no path so written begins with a space, as hashed ones do.
LONGEST_PATH = 400
#: Texts are hashed modulo this prime, of which (p - 1) / 2 is prime too.
_PRIME = 3955046125492947383
#: Broadcast the cut paths of all hosts up to this many bytes.
BROADCAST_BYTES = 8 << 20


@dataclass
class Element:
    tag: str
    label: str
    apart: bool
    main: bool
    parent: Element | None
    blocks: list = field(default_factory=list)  # text runs and child elements, in page order
    also: bool = False  # apart by a name that has another meaning too
    talk: bool = False  # named like readers' comments
    said: int = 0  # letters of its own text, and of those in links; links
    linked: int = 0
    links: int = 0


def _parts(name: str) -> set[str]:
    """The words of a class or id name, without numbers and single letters."""
    return {p.lower() for p in _PART.findall(name) if len(p) > 1}


def furniture(name: str) -> bool:
    """Whether a class or id name means what is not main text: ad-slot, google-ad and cookie-law-notice do, share-price does not."""
    parts = _parts(name)
    found = parts & APART_WORDS
    return bool(found) and (parts <= APART_WORDS | PLAIN_WORDS or len(found) > 1 or bool(found & SURE_WORDS))


def _attributes(source: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """(name, value) of a tag's attributes from ``at`` on, and where the tag ends; -1 if it doesn't."""
    found = []
    while m := _ATTRIBUTE.match(source, at):
        at = m.end()
        if m[1]:
            return found, at
        found.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
    return found, -1


def parse(source: str) -> Element:
    """The page's tree of block elements; inline elements leave their text to the block around.

    What follows an unfinished tag or comment is part of it.
    """
    root = Element("", "", False, False, None)
    top, at, text = root, 0, []
    opened: Counter = Counter()
    in_link, of_link = False, []  # whether each piece of the open text is in a link

    def say(piece: str) -> None:
        text.append(piece)
        of_link.append(in_link)

    def flush() -> None:
        if text:
            run = " ".join(html_lib.unescape("".join(text)).split())
            if run:
                top.blocks.append(run)
                top.said += len(run)
                top.linked += min(len(run), sum(len(t.strip()) for t, link in zip(text, of_link, strict=True) if link))
            text.clear()
            of_link.clear()

    def leave(to: Element) -> None:
        """Close elements up to, not including, ``to``."""
        nonlocal top
        while top is not to:
            opened[top.tag] -= 1
            top = top.parent

    end = len(source)
    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        say(source[at:begin])
        at = begin + 1
        m = _NAME.match(source, at)
        if not m:
            if source.startswith("!--", at):
                stop = source.find("-->", at + 1)
                at = end if stop < 0 else stop + 3
            elif source[at : at + 1] in ("!", "?", "/") and at < end:
                stop = source.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                say("<")
            continue
        name = m[0].lower()
        attributes, at = _attributes(source, m.end())
        if at < 0:
            break
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                in_link = False
            if opened[name] < 1:
                if name in ("p", "br"):
                    flush()
                continue
            flush()
            node = top
            while node.tag != name:
                node = node.parent
            leave(node.parent)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        label, apart, named, talk = name, name in APART, [], False
        for key, value in attributes:
            if key in ("class", "id"):
                names = value.split()
                label += ("." if key == "class" else "#") + (names[0].lower() if names else "")
                if name not in ("html", "body", "main"):
                    named += filter(furniture, names)
                    talk |= any(_parts(n) & TALK_WORDS and _parts(n) <= TALK_WORDS | APART_WORDS | PLAIN_WORDS for n in names)
            elif key == "role":
                apart |= value.strip().lower() in APART_ROLES
            elif key in ("hidden", "aria-hidden"):
                apart |= value.strip().lower() != "false"
            elif key == "style":
                apart |= _HIDDEN.search(value) is not None
        also = bool(named) and not apart and all((_parts(n) & APART_WORDS) <= ALSO_WORDS for n in named)
        if named and not (name in INLINE and any(opened[t] for t in _SENTENCES)):  # a word of a sentence isn't furniture
            apart = True
        if name == "a":
            in_link = True
            top.links += 1
        if name in INLINE and not apart and not opened[name]:  # within one that is set apart, they are told apart
            continue
        flush()
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s>/])", re.I).search(source, at)
            if not close:
                break
            at = _attributes(source, close.end())[1]
            if at < 0:
                break
            continue
        if name in _CLOSES:
            while top.tag in _CLOSES[name]:
                leave(top.parent)
        elif name in _ENDS_P and top.tag == "p":
            leave(top.parent)
        child = Element(name, label, apart, name in ("article", "main"), top, also=also, talk=talk)
        top.blocks.append(child)
        opened[name] += 1
        top = child
    flush()
    _judge(root)
    return root


def _judge(root: Element) -> None:
    """Set apart, or bring back, what names alone can't tell: one pass down for order and articles, one up for sums."""
    order: list[tuple[Element, bool, bool]] = []  # element, within an article, within what may be apart there
    stack = [(root, False, False)]
    while stack:
        element, inside, doubted = stack.pop()
        order.append((element, inside, doubted))
        inside, doubted = inside or element.main, not element.main and (doubted or element.apart or element.talk)
        stack += [(b, inside, doubted) for b in reversed(element.blocks) if not isinstance(b, str)]
    said, linked, links, paragraphs = ({id(e): n for (e, *_), n in zip(order, own, strict=True)} for own in ([e.said for e, *_ in order], [e.linked for e, *_ in order], [e.links for e, *_ in order], [int(e.tag == "p" and e.said > e.linked) for e, *_ in order]))
    for element, *_ in reversed(order[1:]):
        for sums in (said, linked, links, paragraphs):
            sums[id(element.parent)] += sums[id(element)]
    followed = False  # whether text of the article stands behind
    for element, inside, doubted in reversed(order):
        key = id(element)
        if inside and not element.main:
            share = linked[key] / max(1, said[key])
            if element.also:
                element.apart = not (paragraphs[key] and share < 0.5)
            elif element.talk and not element.apart:
                entries = Counter(b.label for b in element.blocks if not isinstance(b, str) and b.tag in ("li", "div", "article", "section"))
                element.apart = element.tag in ("ol", "ul") or (not followed and max(entries.values(), default=0) > 1)
            elif element.label != element.tag and element.tag in ("div", "section", "ul", "ol", "table") and links[key] >= MENU_LINKS and share >= MENU_SHARE and not paragraphs[key]:
                element.apart = True
        elif element.main:
            followed = False  # another article begins behind
        if inside and not element.apart and not doubted and element.said:
            followed = True


def _below(path: str, label: str) -> str:
    """The path of a child; a long one is told by its hash, so that paths stay short at any depth."""
    own = f"{path}/{label}"
    return own if len(own) <= LONGEST_PATH else f" {xxh3_128_hexdigest(own.encode('utf8', 'surrogatepass'))}"


def nodes(root: Element) -> Iterator[tuple[str, str, int]]:
    """(path, layout, hash of the text) of every node worth a vote; branches set apart by themselves have none."""
    # A node's text is a stretch of the page's, so sums and powers up to every run give its hash at any depth.
    sums, powers = [0], [1]
    found: dict[str, tuple[list, list]] = {}
    stack: list[tuple[str, Element, Iterator, int, list]] = [("", root, iter(root.blocks), 0, [])]
    while stack:
        path, element, blocks, begin, kinds = stack[-1]
        for b in blocks:
            if isinstance(b, str):
                run = b" " + b.encode("utf8", "surrogatepass")
                power = pow(256, len(run), _PRIME)
                sums.append((sums[-1] * power + int.from_bytes(run)) % _PRIME)
                powers.append(powers[-1] * power % _PRIME)
            elif not b.apart:
                kinds.append(b.label)
                own = _below(path, b.label)
                found.setdefault(own, ([], []))  # in page order
                stack.append((own, b, iter(b.blocks), len(sums) - 1, []))
                break
        else:
            stack.pop()
            if element is not root:
                layouts, stretches = found[path]
                layouts.append(" ".join(dict.fromkeys(kinds)))
                stretches.append((begin, len(sums) - 1))
    for path, (layouts, stretches) in found.items():
        text = 0
        for a, e in stretches:
            power = powers[e] * pow(powers[a], -1, _PRIME) % _PRIME
            text = (text * power + sums[e] - sums[a] * power) % _PRIME
        yield path, " | ".join(dict.fromkeys(layouts)), text


def main_text(root: Element, cut: frozenset[str] = frozenset()) -> str:
    """The text of what is left: of articles where there are any, else of the whole page."""
    only, rest = False, [root]
    while rest and not only:
        below = [b for b in rest.pop().blocks if not isinstance(b, str) and not b.apart]
        only = any(b.main for b in below)
        rest += below
    out: list[str] = []
    stack = [("", not only, iter(root.blocks))]
    while stack:
        path, inside, blocks = stack[-1]
        for b in blocks:
            if isinstance(b, str):
                if inside:
                    out.append(b)
                continue
            own = _below(path, b.label)
            inner = inside or b.main
            named = b.label != b.tag
            if b.apart or (own in cut and b.tag not in ("html", "body") and not b.main and (named or not (only and inner))):
                continue
            stack.append((own, inner, iter(b.blocks)))
            break
        else:
            stack.pop()
    return " ".join(out)


def host_of(url: str | Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    column = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, pages, layout_importance, content_importance of all hosts' merged trees."""
    source = pages.select(host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            votes: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, layout, text in nodes(parse(page)):
                    votes[host, path, 0, xxh3_64_intdigest(layout.encode()) >> 1] += 1
                    votes[host, path, 1, text] += 1
            keys = list(votes)
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.string()), "kind": pa.array([k[2] for k in keys], pa.int32()), "value": pa.array([k[3] for k in keys], pa.int64()), "n": pa.array(list(votes.values()), pa.int64())})

    votes = source.mapInArrow(vote, "host string, path string, kind int, value long, n long")
    # By value first: a host with a third of all pages is summed in many tasks.
    each = votes.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    kinds = each.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.when(F.sum("n") > 1, entropy / F.log(F.sum("n"))).otherwise(1.0).alias("importance"))
    return kinds.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == 0, F.col("importance"))).alias("layout_importance"), F.max(F.when(F.col("kind") == 1, F.col("importance"))).alias("content_importance"))


def extract_main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, in whatever order.

    Character references are decoded, white space in a block becomes one
    space, and blocks are joined by one. Null or empty html, and pages whose
    every branch goes, give an empty text. Pages without a readable host are
    one host. Repeated rows and ids are pages of their own; null ids and urls
    stay null. Very long pages are read whole. An empty table gives no rows;
    further columns are ignored.
    """
    tree = style_tree(pages, url=url, html=html)
    low = tree.where((F.col("pages") >= LEAST_PAGES) & (F.greatest("layout_importance", "content_importance") < LEAST_IMPORTANCE))
    cuts = settle(low.groupBy("host").agg(F.collect_list("path").alias("cut")))
    weight = cuts.agg(F.sum(F.length(F.concat_ws("", "cut")) + F.length("host"))).first()[0] or 0
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(url).alias("host"))
    joined = source.join(F.broadcast(cuts) if weight <= BROADCAST_BYTES else cuts, "host", "left").select("page_id", "url", "html", "cut")
    id_type = joined.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(parse(page), frozenset(cut or ())) for page, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long")
