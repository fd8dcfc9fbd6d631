"""Main text of web pages by two-pass block rules (operator 3).

A page is cut into blocks at block-level tags. Elements that never hold the article (menus, footers, forms,
scripts, ...; by tag, or hidden) are left out. Class names, ids and roles are hints: what they enclose is left out too, but never
an article that is marked, nor most of the page's text. Pass one classifies each block by its length, its
density of stop words and the share of its text inside links: good, bad, or ambiguous. Pass two gives each
ambiguous block the label of its nearest decided neighbours. On a page that marks its article
(``article``, ``main``), blocks outside are bad; inside, links and calls to share or subscribe count against a block, and the
mark stands for a good neighbour: an ambiguous block goes only right between two bad ones.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: share of link text above which a block is bad; characters below which a block is ambiguous, and from which fewer
#: stop words will do; shares of stop words that make a block good from either length on (below the second: bad)
LINKS, SHORT, LONG, RICH, POOR = 0.4, 70, 140, 0.25, 0.12

#: Frequent function words of European languages.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i if in is it its my not of on or our "
          "she so that the their them there they this to was we were which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die du durch ein eine einem einen einer er es "
          "für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was "
          "wenn wie wir zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui mais ne nous on ou où "
          "par pas pour qu que qui sa se ses son sont sur un une vous",
    "es": "a al así como con de del el ella en es esta este fue ha la las le lo los más me mi no o para pero por que se "
          "ser si sin sobre su sus también un una y ya",
    "it": "a al che chi con da dal de dei del della di e è gli ha i il in la le lo ma nel non per più si sono su un una",
    "pt": "a ao as com da das de do dos e em é era foi mais mas na não nas no nos o os ou para pela pelo por que se sua um uma",
    "nl": "aan als bij dat de der deze die dit door een en er het hij ik in is maar met naar niet nog om ook op te tot "
          "uit van voor was wat we werd wordt ze zich zijn",
}
_LISTS = [frozenset(ws.split()) for ws in STOP_WORDS.values()]
_STOP = frozenset().union(*_LISTS)

#: Elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object applet canvas "
                "audio video".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog head button select fieldset dir".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class names, ids and roles of elements that aren't the article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs "
                  "comment comments commentlist consent contentinfo cookie cookies copyright disclaimer disqus donate footer gdpr "
                  "hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
                  "overlay pagination paywall popup promo promoted promotion recommended related replies reply respond "
                  "search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
                  "tagcloud teaser toolbar topbar widget widgets".split())
#: Words that say of a hint that it isn't there, and those that ids of page furniture have beside a hint
#: (other ids with a hint in them are anchors made from headings).
NEGATIONS = frozenset("has no not with without hide".split())
FURNITURE = frozenset("area articles bar block body bottom box button buttons column container content div form group header icons "
                      "inner item items left links list main module modules outer pane panel post posts primary region right row "
                      "secondary section site slot title top unit wrap wrapper".split())
#: First words and other words of calls to share, to follow or to subscribe.
CALLS = frozenset("advertisement follow join share sign sponsored subscribe tweet".split())
CALL_WORDS = CALLS | frozenset("article email facebook friends inbox instagram linkedin media more newsletter now page post reddit "
                               "social story today twitter up updates us whatsapp youtube".split())
#: hints nested deeper belong to those around them
NESTED = 8
_COMMENT_HINTS = frozenset("comment comments commentlist disqus replies reply respond".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class _Block:
    __slots__ = ("text", "linked", "inside", "heading", "regions")

    def __init__(self, text: str, linked: int, inside: bool, heading: bool, regions: tuple = ()):
        self.text, self.linked, self.inside, self.heading, self.regions = text, linked, inside, heading, regions


class _Region:
    """An open element whose names hint at something else than the article."""
    __slots__ = ("name", "depth", "comments", "article")

    def __init__(self, name: str, comments: bool):
        self.name, self.depth, self.comments, self.article = name, 1, comments, False


def _hinted(key: str, value: str, inside: bool) -> str:
    """"comments", "other" or "" of a class, id or role."""
    found = ""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        hints = {x for at, x in enumerate(parts) if not (at and parts[at - 1] in NEGATIONS)
                 and (x in HINTS or x == "header" and not inside)}
        if key == "id" and not all(x in HINTS or x in FURNITURE for x in parts):
            continue
        if hints & _COMMENT_HINTS:
            return "comments"
        found = "other" if hints else found
    return found


def _unwanted(name: str, attributes: str, inside: bool) -> str:
    """Why an element is left out: "" (it isn't), "never" (by tag or hidden), or what its names hint at: "comments", "other"."""
    if name in LEFT_OUT or name == "header" and not inside:
        return "never"
    if not attributes.strip() or name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return ""
    why = ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        # names in camel case are cut like others
        value = (re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value) if key in ("class", "id") else value).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "never"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "never"
        if key in ("class", "id", "role"):
            hint = _hinted(key, value, inside)
            why = hint if hint == "comments" or not why else why
    return why


def _without_regions(blocks: list[_Block]) -> list[_Block]:
    """Blocks outside the hinted regions that go: those without the marked article and with half of the page's text at most.

    Comments go as well if they hold more, as long as a good block stands outside them.
    """
    size = [len(b.text) - b.linked for b in blocks]
    held: dict[_Region, int] = {}
    for b, n in zip(blocks, size):
        for r in b.regions:
            held[r] = held.get(r, 0) + n
    gone = set()
    for r, n in held.items():
        most = 2 * n > sum(size)
        if most and r.comments and not r.article:
            most = not any(first_pass(b, False) == "good" for b in blocks if r not in b.regions)
        if not r.article and not most:
            gone.add(r)
    return [b for b in blocks if gone.isdisjoint(b.regions)]


def blocks_of(page: str) -> tuple[list[_Block], bool]:
    """The page's blocks outside left-out elements and regions, in order, and whether it marks its article."""
    blocks: list[_Block] = []
    buffer: list[str] = []
    linked = 0
    links = 0  # open a elements
    inside = 0  # open article and main elements
    marked = False
    heading = False
    dropped: list | None = None  # [element name, depth of that name]
    regions: list[_Region] = []  # open elements with a hint

    def flush():
        nonlocal linked, buffer
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                blocks.append(_Block(text, linked, inside > 0, heading, tuple(regions)))
        buffer, linked = [], 0

    def add(piece: str):
        nonlocal linked
        if piece and dropped is None:
            buffer.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))

    at = 0
    while True:
        found = _NEXT.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        tag = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not tag:
            end = page.find(">", at) if page.startswith("</", at) else -1
            if end < 0:
                add(page[at])
                at += 1
            else:
                at = end + 1
            continue
        at = tag.end()
        closing, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else (at if name == "title" else len(page))
            continue
        if dropped is not None:
            if not closing and name in ("article", "main") and not inside and name != dropped[0]:
                dropped = None  # an element left open before the article
            else:
                if name == dropped[0]:
                    dropped[1] += -1 if closing else 1
                    if not dropped[1]:
                        dropped = None
                elif closing and name in ("body", "html"):
                    dropped = None
                continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            links = 0 if name not in ("li", "td", "th", "div") else links
        # comments are often articles of their own
        marks = name == "main" or name == "article" and not any(r.comments for r in regions)
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in ("article", "main") and marks:
                inside = max(0, inside - 1)
            if regions:
                flush()
                for k, r in enumerate(regions):
                    r.depth -= name == r.name
                    if not r.depth or name in ("body", "html"):
                        del regions[k:]
                        break
            continue
        why = _unwanted(name, attributes, inside > 0)
        open_ = name not in VOID and not attributes.rstrip().endswith("/")
        if why and open_:
            flush()
            if why == "never":
                dropped = [name, 1]
                continue
        for r in regions:
            r.depth += name == r.name and open_
            r.article = r.article or marks and not inside and name in ("article", "main") and name != r.name
        if why and open_ and len(regions) < NESTED:
            regions.append(_Region(name, why == "comments"))
        if name == "a":
            links = 1
        elif name in ("article", "main") and marks:
            inside += 1
            marked = True
    flush()
    return _without_regions(blocks), marked


def listed(blocks: list[_Block]) -> bool:
    """Whether a list of stop words fits the page: its longer blocks that aren't links, or a rich one of them."""
    found = [_WORD.findall(b.text.lower()) for b in blocks if len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    if any(sum(w in ws for w in words) >= RICH * max(len(words), 1) for words in found for ws in _LISTS):
        return True
    words = [w for ws in found for w in ws]
    return max(sum(w in ws for w in words) for ws in _LISTS) >= POOR * len(words)


def calls(words: list[str]) -> bool:
    """Whether a short block calls to share, to follow or to subscribe: by its first word, and half of those that aren't stop words."""
    own = [w for w in words if w not in _LISTS[0]]
    return bool(words) and words[0] in CALLS and 2 * sum(w in CALL_WORDS for w in own) >= len(own)


def first_pass(block: _Block, marked: bool, known: bool = True) -> str:
    """good, bad, or ambiguous ("?"). In a language without a list (not ``known``) length and links decide."""
    size = len(block.text)
    if block.linked > LINKS * size:
        return "bad"
    if marked and not block.inside:
        return "bad"
    words = _WORD.findall(block.text.lower())
    if size < SHORT and not block.heading and calls(words):
        return "bad"
    if not known:
        return "bad" if "©" in block.text else "good" if size >= SHORT else "?"
    share = sum(w in _STOP for w in words) / max(len(words), 1)
    if share >= RICH and size >= SHORT or share >= POOR and size >= LONG:
        return "good"
    if marked:
        return "?"
    if "©" in block.text or size >= SHORT and share < POOR:
        return "bad"
    return "?"


def second_pass(labels: list[str], unknown: bool, marked: bool = False) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block; at equal distance good wins.

    ``unknown``: whether all are kept if none is decided. ``marked``: in a marked article a good neighbour is never further than
    two blocks away, so only the label of bad blocks right before and after passes on.
    """
    if marked:
        at = ["good", *labels, "good"]
        return [v == "good" or v == "?" and not at[i] == at[i + 2] == "bad" for i, v in enumerate(labels)]
    n = len(labels)
    before, after = [(-1, "?")] * n, [(-1, "?")] * n
    last = None
    for i in range(n):
        if labels[i] != "?":
            last = (i, labels[i])
        before[i] = last
    last = None
    for i in reversed(range(n)):
        if labels[i] != "?":
            last = (i, labels[i])
        after[i] = last
    out = []
    for i in range(n):
        b, a = before[i], after[i]
        if labels[i] != "?":
            out.append(labels[i] == "good")
        elif b is None and a is None:
            out.append(unknown)
        elif b is None or a is None:
            out.append((b or a)[1] == "good")
        else:
            d = (i - b[0]) - (a[0] - i)
            out.append((b[1] if d < 0 else a[1] if d > 0 else "good" if "good" in (a[1], b[1]) else "bad") == "good")
    return out


def main_blocks(page: str | None) -> list[str]:
    """The article's blocks, in page order. A null or empty page has none."""
    blocks, marked = blocks_of(page or "")
    if marked:
        # an article that holds nothing but links or nothing at all isn't the page's text
        inside = [b for b in blocks if b.inside]
        if not any(b.linked <= LINKS * len(b.text) for b in inside):
            marked = False
    if marked:
        blocks = [b for b in blocks if b.inside]
    known = marked or listed(blocks)
    labels = [first_pass(b, marked, known) for b in blocks]
    keep = second_pass(labels, "bad" not in labels, marked)
    return [b.text for b, k in zip(blocks, keep) if k]


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("n_blocks", T.LongType())]))
def _extract(pages: pa.Array) -> pa.Array:
    found = [main_blocks(p) for p in pages.to_pylist()]
    texts = ["\n".join(b) for b in found]
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())],
        names=["text", "n_chars", "n_blocks"])


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` but with text, n_chars (code points) and n_blocks of the article.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one
    line feed. A null or empty page has an empty text. Columns of those names are replaced; the others stay.
    No shuffle: a page is worked on alone.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars", "n_blocks")]
    r = pages.select(F.struct(*kept).alias("row"), _extract(F.col(html_col)).alias("main"))
    return r.select("row.*", "main.text", "main.n_chars", "main.n_blocks")
