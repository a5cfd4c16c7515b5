"""A small lenient DOM with the CSS and XPath that extraction programs use. Pure Python, for use inside Arrow batches."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements whose start ends the search for an open element that is closed by implication.
WALLS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
# What is stripped from a page before its content is looked for.
STRIP_TAGS = ["script", "noscript", "style", "iframe", "embed", "object", "svg", "canvas"]
STRIP_SELECTORS = [
    "nav", 'header[role="banner"]', "footer", '[role="contentinfo"]', '[role="navigation"]', '[id*="cookie"]', '[class*="cookie"]', '[id*="banner"]', '[class*="banner"]',
    '[id*="newsletter"]', '[class*="newsletter"]', '[aria-label*="advert"]', '[id*="ad-"]', '[class*="ad-"]', '[class*="ads-"]', ".advertisement",
]


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def elements(self):
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self):
        """All elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(x.elements()[::-1])

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(x.kids[::-1])
        return "".join(out)

    def drop(self) -> None:
        if self.parent:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None

    def markup(self) -> str:
        if self.tag == "#root":
            return "".join(k.markup() if isinstance(k, Node) else html.escape(k, quote=False) for k in self.kids)
        attrs = "".join(f' {k}="{html.escape(v or "")}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        raw = self.tag in ("script", "style")
        inner = "".join(k.markup() if isinstance(k, Node) else k if raw else html.escape(k, quote=False) for k in self.kids)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._imply({"p"}, BLOCK - {"p"} | {"td", "th", "li", "button"})
        if tag in CLOSES:
            self._imply(CLOSES[tag], WALLS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply(self, tags, walls):
        x = self.at
        while x.tag != "#root" and x.tag not in walls:
            if x.tag in tags:
                self.at = x.parent
                return
            x = x.parent

    def handle_endtag(self, tag):
        x = self.at
        while x.tag != "#root":
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse_html(text: str | None) -> Node:
    """The tree of a page, however broken; null is an empty one."""
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


def text_of(node: Node) -> str:
    return " ".join(node.text().split())


# --- CSS ---------------------------------------------------------------------------------------------------------------

_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>(?:[\w-]|\\.)+)|\.(?P<cls>(?:[\w-]|\\.)+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:not\(\s*(?P<no>[^()]+)\s*\)|:nth-child\(\s*(?P<nth>\d+|odd|even|\d*n(?:\s*\+\s*\d+)?)\s*\)|:(?P<pseudo>first-child|last-child|only-child|first-of-type|last-of-type|empty)"
)


def _attribute(op, want):
    return {
        None: lambda v: True, "=": lambda v: v == want, "*=": lambda v: want != "" and want in v, "^=": lambda v: want != "" and v.startswith(want),
        "$=": lambda v: want != "" and v.endswith(want), "~=": lambda v: want in v.split(), "|=": lambda v: v == want or v.startswith(want + "-"),
    }[op]


def _compound(text: str):
    """A test of one element for a compound selector."""
    at, tests = 0, []
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"bad selector {text!r}")
        at = m.end()
        if (tag := m["tag"]) and tag != "*":
            tests.append(lambda n, t=tag.lower(): n.tag == t)
        elif m["id"]:
            tests.append(lambda n, x=m["id"].replace("\\", ""): n.attrs.get("id") == x)
        elif m["cls"]:
            tests.append(lambda n, x=m["cls"].replace("\\", ""): x in n.attrs.get("class", "").split())
        elif m["attr"]:
            check = _attribute(m["op"], m["val"][1:-1] if m["val"] and m["val"][0] in "\"'" else m["val"])
            tests.append(lambda n, a=m["attr"].lower(), c=check: a in n.attrs and c(n.attrs[a]))
        elif m["no"]:
            tests.append(lambda n, c=_compound(m["no"].strip()): not c(n))
        elif m["nth"]:
            tests.append(_nth(m["nth"].replace(" ", "")))
        elif m["pseudo"]:
            tests.append(_pseudo(m["pseudo"]))
    return lambda n: all(t(n) for t in tests)


def _place(n: Node, same: bool = False) -> tuple[int, int]:
    kids = [k for k in n.parent.elements() if not same or k.tag == n.tag] if n.parent else [n]
    return next(i for i, k in enumerate(kids, 1) if k is n), len(kids)


def _nth(x: str):
    if x.isdigit():
        return lambda n: _place(n)[0] == int(x)
    a, b = {"odd": (2, 1), "even": (2, 0)}.get(x) or (int(x.split("n")[0] or 1), int(x.split("+")[1]) if "+" in x else 0)
    return lambda n: (i := _place(n)[0]) >= b and (i - b) % max(1, a) == 0


def _pseudo(x: str):
    return {
        "first-child": lambda n: _place(n)[0] == 1, "last-child": lambda n: (p := _place(n))[0] == p[1], "only-child": lambda n: _place(n)[1] == 1,
        "first-of-type": lambda n: _place(n, True)[0] == 1, "last-of-type": lambda n: (p := _place(n, True))[0] == p[1], "empty": lambda n: not n.kids,
    }[x]


def compile_css(selector: str):
    """(root) -> matching elements in document order."""
    groups = []
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        parts = re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+", one.strip())
        if not parts or parts[0].strip() in (">", "+", "~"):
            raise ValueError(f"bad selector {selector!r}")
        groups.append([p.strip() or " " for p in parts])
    compiled = [[p if p in (" ", ">", "+", "~") else _compound(p) for p in g] for g in groups]

    def fits(n: Node, chain: list, root: Node) -> bool:
        if not chain[-1](n):
            return False
        if len(chain) == 1:
            return True
        how, rest = chain[-2], chain[:-2]
        if how in (">", " "):
            x = n.parent
            while x is not None and x.tag != "#root":
                if fits(x, rest, root):
                    return True
                if how == ">":
                    return False
                x = x.parent
            return False
        before = []
        for k in n.parent.elements() if n.parent else []:
            if k is n:
                break
            before.append(k)
        return any(fits(k, rest, root) for k in (before[-1:] if how == "+" else before))

    return lambda root: [n for n in root.walk() if any(fits(n, c, root) for c in compiled)]


# --- XPath -------------------------------------------------------------------------------------------------------------

_STEP = re.compile(r"(//?)((?:following-sibling|parent|self|descendant)::)?(\*|@?[\w-]+|text\(\)|\.\.?)((?:\[[^\]]*\])*)")
_TEST = re.compile(
    r"^(?:(?P<n>\d+)|(?P<last>last\(\))|(?:(?P<a>@[\w-]+|text\(\)|\.|normalize-space\((?:text\(\)|\.)?\))\s*(?P<eq>!?=)\s*(?P<v>\"[^\"]*\"|'[^']*'))"
    r"|(?P<f>contains|starts-with)\(\s*(?P<fa>@[\w-]+|text\(\)|\.|normalize-space\((?:text\(\)|\.)?\))\s*,\s*(?P<fv>\"[^\"]*\"|'[^']*')\s*\)|(?P<has>@[\w-]+))$"
)


def _value(n: Node, what: str) -> str | None:
    if what.startswith("@"):
        return n.attrs.get(what[1:].lower())
    if what == "text()":
        return next((k for k in n.kids if isinstance(k, str) and k.strip()), "")
    return " ".join(n.text().split()) if what.startswith("normalize") else n.text()


def _predicate(text: str):
    tests = []
    for part in re.split(r"\s+and\s+", text.strip()):
        m = _TEST.match(part.strip())
        if not m:
            raise ValueError(f"bad predicate [{text}]")
        if m["n"]:
            tests.append(lambda n, i, size, k=int(m["n"]): i == k)
        elif m["last"]:
            tests.append(lambda n, i, size: i == size)
        elif m["a"]:
            tests.append(lambda n, i, size, a=m["a"], v=m["v"][1:-1], no=m["eq"] == "!=": (_value(n, a) == v) != no)
        elif m["f"]:
            starts = m["f"] == "starts-with"
            tests.append(lambda n, i, size, a=m["fa"], v=m["fv"][1:-1], s=starts: (x := _value(n, a)) is not None and (x.startswith(v) if s else v in x))
        else:
            tests.append(lambda n, i, size, a=m["has"][1:].lower(): a in n.attrs)
    return lambda n, i, size: all(t(n, i, size) for t in tests)


def compile_xpath(path: str):
    """(root) -> matching elements in document order. An absolute path begins at the page, whatever the root."""
    path = path.strip().removeprefix("xpath:")
    if m := re.fullmatch(r"\((.+)\)\[(\d+)\]", path):
        inner, k = compile_xpath(m[1]), int(m[2])
        return lambda root: inner(root)[k - 1 : k]
    relative = path.startswith(".")
    path = path[1:] if relative else path
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m[3].startswith("@") and m.end() < len(path):
            raise ValueError(f"bad path {path!r}")
        steps.append((m[1], (m[2] or "").removesuffix("::"), m[3], [_predicate(p) for p in re.findall(r"\[([^\]]*)\]", m[4])]))
        at = m.end()
    if not steps:
        raise ValueError(f"bad path {path!r}")

    def run(root: Node) -> list[Node]:
        start = root
        while not relative and start.parent is not None:
            start = start.parent
        now = [start]
        for slash, axis, name, tests in steps:
            if name in ("text()",) or name.startswith("@"):
                now = [n for n in now if name == "text()" or name[1:].lower() in n.attrs]
                continue
            after, seen = [], set()
            for n in now:
                if name == ".." or axis == "parent":
                    found = [n.parent] if n.parent and n.parent.tag != "#root" else []
                elif name == ".":
                    found = [n]
                elif axis == "following-sibling":
                    kids = n.parent.elements() if n.parent else []
                    found = kids[next(i for i, k in enumerate(kids) if k is n) + 1 :] if kids else []
                else:
                    found = n.elements() if slash == "/" else list(n.walk())
                found = [k for k in found if name in ("*", "..", ".") or k.tag == name.lower()]
                for test in tests:
                    if slash == "//":  # a place is counted among the children of one parent
                        by: dict[int, list[Node]] = {}
                        for k in found:
                            by.setdefault(id(k.parent), []).append(k)
                        places = {id(k): (i, len(v)) for v in by.values() for i, k in enumerate(v, 1)}
                    else:
                        places = {id(k): (i, len(found)) for i, k in enumerate(found, 1)}
                    found = [k for k in found if test(k, *places[id(k)])]
                after += [k for k in found if id(k) not in seen and not seen.add(id(k))]
            now = after
        return now

    return run


def is_xpath(locator: str) -> bool:
    return locator.lstrip().startswith(("/", "(/", "./", "xpath:"))


def compile_locator(locator: str):
    """(root) -> elements; a locator that is not well formed finds nothing."""
    try:
        return compile_xpath(locator) if is_xpath(locator) else compile_css(locator)
    except (ValueError, AttributeError, IndexError):
        return lambda root: []


# --- pages -------------------------------------------------------------------------------------------------------------


def strip_boilerplate(root: Node, tags=STRIP_TAGS, selectors=STRIP_SELECTORS) -> Node:
    for n in [n for n in root.walk() if n.tag in tags]:
        n.drop()
    for s in selectors:
        for n in compile_css(s)(root):
            n.drop()
    return root


def content_of(root: Node) -> Node:
    """The part of a page that holds its text: the densest block, by letters outside links, of the usual kinds."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    best, most = body, 0.0
    for n in body.walk():
        if n.tag in ("article", "main", "section", "div", "td"):
            letters = len(text_of(n))
            linked = sum(len(text_of(a)) for a in n.walk() if a.tag == "a")
            paragraphs = sum(k.tag in ("p", "li", "pre", "table", "blockquote", "h2", "h3") for k in n.walk())
            score = (letters - 2 * linked) * (1 + min(paragraphs, 20) / 10) * {"article": 1.3, "main": 1.2}.get(n.tag, 1.0)
            if score > most:
                best, most = n, score
    return best if 2 * len(text_of(best)) >= len(text_of(body)) else body


def clean_page(page: str | None) -> dict:
    """html, text, readable, title, lang of a page without boilerplate."""
    root = parse_html(page)
    lang = next((n.attrs.get("lang") for n in root.walk() if n.tag == "html"), None)
    title = next((text_of(n) for n in root.walk() if n.tag == "title"), None) or next((text_of(n) for n in root.walk() if n.tag == "h1"), None)
    strip_boilerplate(root)
    main = content_of(root)
    return {"html": main.markup(), "text": text_of(main), "readable": main.tag not in ("#root", "body"), "title": title, "lang": lang}


def fingerprint(n: Node) -> str:
    """Shape of an element: tag, its classes and its children's tags, sorted."""
    classes = ".".join(sorted(n.attrs.get("class", "").split()))
    return f"{n.tag}.{classes}|{','.join(sorted(k.tag for k in n.elements()))}"


def regions(page: str | None) -> list[tuple[int, str, str]]:
    """(place, shape, markup) of the top elements of a page's body."""
    root = parse_html(page)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    top = body.elements()
    while len(top) == 1 and top[0].elements():
        top = top[0].elements()
    return [(i, fingerprint(n), n.markup()) for i, n in enumerate(top)]


def resolve_url(href: str, base: str) -> str | None:
    """Absolute http(s) URL of a link without its fragment, percent-encoded; None where it is none."""
    try:
        u = urlsplit(urljoin(base, href.strip()))
        if u.scheme not in ("http", "https") or not u.hostname:
            return None
        port = f":{u.port}" if u.port and u.port != {"http": 80, "https": 443}[u.scheme] else ""
    except ValueError:
        return None
    path = quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._")
    query = "?" + quote(u.query, safe="/%:@!$&'()*+,;=~-._?") if u.query else ""
    return f"{u.scheme}://{u.hostname.encode('idna').decode() if not u.hostname.isascii() else u.hostname}{port}{path}{query}"


def links(page: str | None, base: str) -> list[tuple[int, str, str, str]]:
    """(place, url, text, region) of the links of a page; region is nav, header, footer or body."""
    out = []
    for n in parse_html(page).walk():
        if n.tag == "a" and n.attrs.get("href"):
            url = resolve_url(n.attrs["href"], base or "")
            if url:
                x, region = n.parent, "body"
                rank = {"nav": 0, "header": 1, "footer": 2, "body": 3}
                while x is not None:
                    if x.tag in rank and rank[x.tag] < rank[region]:
                        region = x.tag
                    x = x.parent
                out.append((len(out), url, text_of(n), region))
    return out


def markdown(page: str | None) -> str:
    """Markdown of a page: ATX headings, fenced code, ``-`` bullets, ``_`` emphasis; images are left out."""
    out: list[str] = []

    def inline(n) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        inner = "".join(map(inline, n.kids))
        if n.tag in ("strong", "b"):
            return f"**{inner.strip()}**" if inner.strip() else ""
        if n.tag in ("em", "i"):
            return f"_{inner.strip()}_" if inner.strip() else ""
        if n.tag == "code":
            return f"`{n.text()}`"
        if n.tag == "a" and n.attrs.get("href"):
            return f"[{inner.strip()}]({n.attrs['href']})"
        return {"br": "  \n", "img": "", "script": "", "style": ""}.get(n.tag, inner)

    def block(n: Node, depth: int = 0) -> None:
        pending: list[str] = []

        def flush() -> None:
            text = "".join(pending).strip()
            pending.clear()
            if text:
                out.append(text)

        for k in n.kids:
            if isinstance(k, str) or k.tag not in BLOCK | {"html", "head", "body", "li", "tr", "td", "th", "tbody", "thead", "title"}:
                pending.append(inline(k))
                continue
            flush()
            if re.fullmatch("h[1-6]", k.tag):
                out.append("#" * int(k.tag[1]) + " " + inline(k).strip())
            elif k.tag == "pre":
                code = next((c for c in k.elements() if c.tag == "code"), k)
                lang = next((c.removeprefix("language-") for c in code.attrs.get("class", "").split() if c.startswith("language-")), "")
                out.append(f"```{lang}\n{k.text().rstrip()}\n```")
            elif k.tag in ("ul", "ol"):
                items = [x for x in k.elements() if x.tag == "li"]
                out.append("\n".join(("  " * depth + ("- " if k.tag == "ul" else f"{i}. ") + inline(x).strip()) for i, x in enumerate(items, 1)))
            elif k.tag == "blockquote":
                out.append("\n".join("> " + x for x in inline(k).strip().split("\n")))
            elif k.tag == "hr":
                out.append("---")
            elif k.tag == "table":
                rows = [[inline(c).strip().replace("|", "\\|") for c in r.elements()] for r in k.walk() if r.tag == "tr"]
                if rows:
                    out.append("\n".join([f"| {' | '.join(rows[0])} |", "|" + " --- |" * len(rows[0])] + [f"| {' | '.join(r)} |" for r in rows[1:]]))
            elif k.tag not in ("head", "title"):
                block(k, depth)
        flush()

    block(parse_html(page))
    return "\n\n".join(x for x in out if x.strip())
