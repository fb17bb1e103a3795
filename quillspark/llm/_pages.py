"""Leaf blocks of HTML pages, and made-up pages with labelled blocks to learn from."""

from __future__ import annotations

import html
import random
import re

#: Of more elements, one within the other, a path has so many from either end. It describes a block; no text hangs on it.
ENDS = 200
#: Elements that do not end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source svg path".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style template noscript title head iframe object svg canvas math datalist audio video".split())
#: Elements whose content is drawn by rules of its own, in which a tag may close itself;
FOREIGN = frozenset("svg math".split())
#: their parts that hold HTML again,
_HTML_AGAIN = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
#: and elements whose start ends them elsewhere.
_LEAVES = frozenset(
    "article aside b big blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var".split()
)
#: Elements that may stand in the head; any other ends it.
_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: What the start of one element closes: itself and its kin, up to the holder.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")
_RAW = {n: re.compile(rf"</{n}\s*(?:>|\Z)", re.I) for n in ("script", "style", "title", "template", "noscript", "iframe", "xmp", "textarea")}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each leaf block in page order. A path has the names of the open elements and of their classes, ids and roles."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = hidden = depth_a = foreign = at = 0

    def close_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = stack if len(stack) <= 2 * ENDS else stack[:ENDS] + stack[-ENDS:]
                out.append((tuple(x for _, names in path for x in names), text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop_to(n: int) -> None:
        nonlocal hidden, depth_a, foreign
        for name, _ in stack[n:]:
            hidden -= name in HIDDEN
            depth_a -= name == "a"
            foreign -= name in FOREIGN
        del stack[n:]

    def put(text: str) -> None:
        nonlocal links
        if stack and stack[-1][0] == "head" and text.strip():
            pop_to(len(stack) - 1)
        if text and not hidden:
            parts.append(text)
            if depth_a:
                links += len(text)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if block:
            close_block()
        elif name in ("br", "wbr", "img"):
            put(" " if name == "br" else "")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if not block and name != "svg" and stack[k][0] not in INLINE:
                    break
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            pop_to(len(stack) - 1)
        if foreign and name in _LEAVES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _HTML_AGAIN:
                    break
                if stack[k][0] in FOREIGN:
                    pop_to(k)
        if name in VOID or m[3].endswith("/") and (foreign or name in FOREIGN or name == "path"):
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _CLOSES:
            kin, holders = _CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in kin:
                    pop_to(k)
        elif block:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        names = [name]
        for a in _NAMES.finditer(m[3]):
            names += [f"{a[1][0].lower()}.{p.lower()}" for p in _PART.findall(a[2] or a[3] or a[4] or "")]
        stack.append((name, tuple(names)))
        hidden += name in HIDDEN
        depth_a += name == "a"
        foreign += name in FOREIGN
    close_block()
    return out


_HOLDERS = ["article", "main", "article.post", "div.content", "div.post", "div.entry-content", "div.article-body", "div#main", "section.story", "div.text", "div#content", "div", "main.page", "td.body"]
#: What may stand inside an article and is none of it: words, holders, whether a list.
_INSIDE = [
    ("comment", ["section.comments", "div.comments", "div#comments", "ol.comment-list", "div.responses", "aside.comments", "div.discussion"], False),
    ("side", ["aside.related", "aside", "div.related", "nav.toc", "div.tags", "div.more", "aside.sidebar", "section.recommended", "nav"], True),
    ("side", ["aside.related", "aside", "div.teaser", "aside.infobox", "div.related"], False),
    ("notice", ["div.notice", "div.cookie", "aside.newsletter", "div.subscribe", "div.paywall", "div.alert", "section.newsletter"], False),
    ("form", ["form", "form.newsletter", "div.login", "form.comment-form"], False),
    ("share", ["div.share", "ul.social", "div.share-buttons", "nav.share"], True),
    ("ad", ["div.ad", "div.advert", "aside.promo", "div.banner", "div.sponsored"], False),
    ("footer", ["footer", "footer.meta", "div.post-footer"], False),
]
_WORDS = {
    "nav": "home news about contact login search menu sport world start suche kontakt accueil recherche inicio buscar more next previous categories archive",
    "footer": "copyright © all rights reserved privacy terms imprint impressum datenschutz mentions légales aviso legal sitemap powered ·",
    "ad": "advertisement sponsored buy now offer sale free shipping click here save today anzeige publicité anuncio",
    "notice": "cookies we use accept settings consent subscribe newsletter sign up javascript enable alert warning",
    "form": "name email password submit send comment your message search login register",
    "comment": "reply says like posted ago minutes hours report share thanks agree great comment antworten répondre responder",
    "side": "related popular recent posts tags trending most read recommended follow us archive",
    "share": "share tweet facebook email print whatsapp link copy teilen partager compartir",
    "header": "welcome site blog magazine daily online edition subscribe",
}


def made_page(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of a made-up page in order, and of each with text whether it is main text (1), not (0), or has no text of its own (-1)."""
    letters = "aeioubcdfghklmnprstvwzéèñüöäß"
    stock = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300)]
    out: list[tuple[str, int]] = []
    tag = lambda s: out.append((s, -1))

    def words(kind: str | None, lo: int, hi: int) -> str:
        own = _WORDS[kind].split() if kind else []
        got = [rng.choice(own) if own and rng.random() < 0.4 else rng.choice(stock) for _ in range(rng.randint(lo, hi))]
        if rng.random() < (0.75 if kind is None else 0.5):
            got[0] = got[0].capitalize()
            got = [w + "." if rng.random() < 0.1 else w + "," if rng.random() < 0.08 else w + rng.choice(["***", "%", "###"]) if rng.random() < 0.02 else w for w in got]
            got[-1] += "."
        r = rng.random()
        if r < 0.05:
            got = [got[0]] * len(got)
        return html.escape((" | " if 0.05 < r < 0.15 else " ").join(got))

    def opened(spec: str, bare: float = 0.12) -> str:
        name, _, c = spec.partition(".")
        name, _, i = name.partition("#")
        if rng.random() < bare:
            c = i = ""
        tag(f"<{name}" + (f' class="{c}{rng.choice(["", " x", "-1"])}"' if c else "") + (f' id="{i}"' if i else "") + ">")
        return name

    def listed(kind: str, holder: list[str], lo: int, hi: int) -> None:
        name = opened(rng.choice(holder))
        if rng.random() < 0.3:
            out.append((f"<h3>{words(kind, 1, 3)}</h3>", 0))
        tag("<ul>")
        for _ in range(rng.randint(lo, hi)):
            out.append((f'<li><a href="/x">{words(kind, 1, 4)}</a></li>', 0))
        tag("</ul>")
        tag(f"</{name}>")

    def box(kind: str | None, holder: list[str], n: int, lo: int, hi: int, bare: float = 0.12) -> None:
        name = opened(rng.choice(holder), bare)
        for _ in range(rng.randint(1, n)):
            text = words(kind, lo, hi)
            out.append((rng.choice([text + " <br>", f"<p>{text}</p>", f"<div>{text}</div>", f"<p>{text}", f"<span>{text}</span><hr>", f'<p><a href="/y">{text}</a></p>']), 0))
        tag(f"</{name}>")

    def inside(kinds: list = _INSIDE) -> None:
        kind, holders, in_list = rng.choice(kinds)
        if in_list:
            listed(kind, holders, 1, 6)
        elif rng.random() < 0.4:
            # in words like those of the article: only where it stands tells it apart
            box(None, holders, 4, 3, 60, 0.04)
        else:
            box(kind, holders, 5 if kind == "comment" else 3, 1 if kind == "form" else 3, 50, 0.04)

    def article(holder: str | None) -> None:
        name = opened(holder, 0.05) if holder else ""
        depth = rng.randint(0, 1) if holder else 0
        for _ in range(depth):
            tag("<div>")
        if rng.random() < 0.8:
            out.append((f"<h1>{words(None, 1, 12)}</h1>", 1))
        odds = rng.choice([0, 0, 0.05, 0.15, 0.3])
        for _ in range(rng.choice([1, 2, 4, 8, 12, 25])):
            text = words(None, *rng.choice([(1, 4), (5, 30), (20, 120)]))
            r = rng.random()
            if r < 0.6:
                out.append((f"<p>{text}</p>", 1))
            elif r < 0.75:
                out.append((f"<p><b>{text}<br>", 1))
            elif r < 0.8:
                out.append((f"<h2>{text}</h2>", 1))
            elif r < 0.85:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            elif r < 0.9:
                out.append((f"<ul><li>{text}</li></ul>", 1))
            elif r < 0.95:
                out.append((f"<p>{text} <a href='/z'>{words(None, 1, 5)}</a> {words(None, 1, 9)}", 1))
            else:
                out.append((f"<div>{text}</div>", 1))
            if rng.random() < odds:
                inside()
        if rng.random() < 0.25:
            inside(_INSIDE[:1] if rng.random() < 0.6 else _INSIDE)
        for _ in range(depth):
            tag("</div>")
        if holder:
            tag(f"</{name}>")

    def cells(make, spec: str) -> None:
        opened(spec, 0.3)
        make()
        tag("</td>")

    tag("<html><body>")
    if rng.random() < 0.15:
        # a layout by tables: what is around the text stands in cells of its own
        tag("<table>")
        if rng.random() < 0.6:
            tag("<tr>")
            cells(lambda: box("header", ["div", "div#top", "b"], 2, 1, 10), "td.top")
            tag("</tr>")
        tag("<tr>")
        if rng.random() < 0.8:
            cells(lambda: listed("nav", ["div", "div.menu", "font", "div#nav"], 1, 9), rng.choice(["td.menu", "td.left", "td.nav"]))
        cells(lambda: article(rng.choice([None, None, "div", "div.text", "font"])), rng.choice(["td.main", "td.body", "td.content", "td", "td"]))
        if rng.random() < 0.4:
            cells(lambda: listed("side", ["div", "div.box", "font"], 1, 6), rng.choice(["td.right", "td.side"]))
        tag("</tr>")
        if rng.random() < 0.7:
            tag("<tr>")
            cells(lambda: box("footer", ["div", "small", "div.footer"], 2, 2, 20), "td.bottom")
            tag("</tr>")
        tag("</table></body></html>")
        return out
    own = None if rng.random() < 0.1 else rng.choice(_HOLDERS)
    for part in (
        (0.5, lambda: box("header", ["header", "div.header", "div#top", "div.masthead"], 2, 1, 12)),
        (0.8, lambda: listed("nav", ["nav", "div.menu", "div#nav", "nav.main-menu", "div.breadcrumb"], 1, 9)),
        (0.2, lambda: box("notice", ["div.notice", "div.cookie-banner", "div.alert", "section.newsletter"], 2, 3, 40)),
        (0.5, lambda: box("ad", ["div.ad", "div.ads", "div.advert", "div.banner", "aside.sponsored"], 1, 2, 30)),
        (0.3, lambda: listed("side", ["aside", "div.sidebar", "div#sidebar", "div.related"], 1, 7)),
        (1.0, lambda: article(own)),
        (0.3, lambda: box("comment", ["section.comments", "div.comment-list", "div#comments", "ol.comments"], 6, 3, 60)),
        (0.3, lambda: listed("side", ["aside", "div.sidebar", "div.related", "section.popular"], 1, 7)),
        (0.25, lambda: box("form", ["form", "form.search", "div.login"], 3, 1, 8)),
        (0.85, lambda: box("footer", ["footer", "div.footer", "div#footer", "footer.site"], 3, 2, 30)),
    ):
        if rng.random() < part[0]:
            part[1]()
    tag("</body></html>")
    return out


def labelled(seed: int, n: int) -> list[tuple[list, list[int]]]:
    """Blocks and labels of made-up pages. A block's label is found again by a mark in its text."""
    rng, found = random.Random(seed), []
    for _ in range(n):
        pieces = made_page(rng)
        marked = "".join(s if y < 0 else re.sub(r">(?=[^<\s])|^(?=[^<\s])", lambda m, y=y: m[0] + f"\x02{y}", s) for s, y in pieces)
        own = blocks(marked)
        found.append(([(p, re.sub("\x02[01]", "", t), min(a, len(t))) for p, t, a in own], [int("\x021" in t) for _, t, _ in own]))
    return found
