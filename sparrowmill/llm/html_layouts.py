"""Labelled pages for fitting the main-text weights: pages of many layouts, with content between ``[[`` and ``]]``.

Pages are put together from parts.  A layout (``LAYOUTS``) says how the parts are framed: by elements of HTML5, by class names, by opaque
class names, by tables, by a form around everything, or not at all.  Words are made up, as no weight depends on which word it is.
Everything follows from a seed."""

from __future__ import annotations

import random

#: Names that page authors give to parts, by what the part is.
CONTENT_NAMES = ("content", "main-content", "post", "entry", "entry-content", "post-content", "article", "article-body", "story", "story-body", "text", "body", "page-content", "main", "prose", "markdown-body")
SECTION_NAMES = ("introduction", "background", "methods", "results", "discussion", "related-work", "references", "notes", "history", "summary", "conclusion", "appendix")
PART_NAMES = {
    "menu": ("nav", "navbar", "navigation", "menu", "main-menu", "main-nav", "site-nav", "top-nav", "topbar", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager", "skip-link"),
    "head": ("header", "site-header", "page-header", "masthead", "banner", "logo", "branding"),
    "foot": ("footer", "site-footer", "page-footer", "bottom", "copyright", "contentinfo", "disclaimer", "footer-links", "legal"),
    "side": ("sidebar", "side", "aside", "widget", "widgets", "rail", "right-rail", "sidebar-left", "sidebar-right", "complementary"),
    "advert": ("ad", "ads", "ad-box", "ad-banner", "ad-slot", "ad-container", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"),
    "notice": ("cookie", "cookies", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "paywall"),
    "form": ("newsletter", "subscribe", "subscription", "signup", "login", "search", "search-form", "contact-form", "register"),
    "share": ("share", "sharing", "social", "share-buttons", "social-links", "tags", "related", "related-posts", "recommended", "recommendations", "read-more", "toc"),
    "comments": ("comments", "comment", "comment-list", "respond", "replies", "reply", "disqus", "comments-area", "user-comments"),
}
ROLES = {"menu": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "notice": "dialog", "form": "search"}
TAGS = {"menu": ("nav", "nav", "menu"), "head": ("header",), "foot": ("footer",), "side": ("aside",), "form": ("form",), "notice": ("dialog",)}

#: How a layout frames its parts: elements of HTML5, class names, both, or opaque names; and how it frames the content.
LAYOUTS = ("html5", "main", "both", "classes", "opaque", "tables", "form", "bare", "sections", "nested")


class _Page:
    def __init__(self, rng: random.Random, layout: str) -> None:
        self.rng, self.layout = rng, layout
        self.pool = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(60)]
        self.semantic = layout in ("html5", "main", "both", "nested") or (layout == "sections" and rng.random() < 0.5)
        self.named = layout in ("both", "classes", "form") or (layout in ("tables", "nested", "sections", "html5", "main") and rng.random() < 0.6)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join(r.choices(self.pool, k=r.randint(low, high))).capitalize() + r.choice(".. ?!,")

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.words(low, high)}</a>'

    def opaque(self) -> str:
        return f' class="x{self.rng.randrange(1 << 20):x}"' if self.rng.random() < 0.6 else ""

    # ---------------------------------------------------------- content

    def inline(self) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(1, 5)):
            out.append(self.words(4, 24))
            if r.random() < 0.25:
                out.append(self.link())
            elif r.random() < 0.2:
                t = r.choice(("b", "em", "strong", "i", "code", "span", "q", "sup"))
                out.append(f"<{t}>{self.words(1, 4)}</{t}>")
            elif r.random() < 0.08:
                out.append(r.choice(("<br>", "<br/>", '<img src="a.png" alt="">')))
        return "[[" + " ".join(out) + "]]"

    def block(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            return f"<p{self.opaque() if r.random() < 0.2 else ''}>{self.inline()}" + "</p>" * (r.random() < 0.85)
        if kind < 0.72:
            t = r.choice(("ul", "ol"))
            items = "".join(f"<li>[[{self.words(3, 16)}]]" + "</li>" * r.randint(0, 1) for _ in range(r.randint(2, 7)))
            return f"<{t}>{items}</{t}>"
        if kind < 0.78:
            return f"<blockquote>{self.inline()}</blockquote>"
        if kind < 0.82:
            return f"<pre>[[{self.words(3, 20)}]]</pre>"
        if kind < 0.87:
            return "<figure><img src=b.jpg><figcaption>[[" + self.words(4, 14) + "]]</figcaption></figure>"
        if kind < 0.92:
            cells = "".join("<tr>" + "".join(f"<td>[[{self.words(1, 4)}]]</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5)))
            return f"<table>{cells}</table>"
        if kind < 0.95:
            return f"<dl><dt>[[{self.words(1, 3)}]]</dt><dd>[[{self.words(4, 14)}]]</dd></dl>"
        return f"<div{self.opaque()}>{self.inline()}</div>"

    def content(self) -> str:
        r = self.rng
        out = [f"<h1>[[{self.words(3, 9)}]]</h1>"] if r.random() < 0.85 else []
        if out and self.semantic and r.random() < 0.3:
            out = [f"<header>{out[0]}<p>[[{self.words(4, 12)}]]</p></header>"]
        for _ in range(r.choice((1, 1, 2, 3, 4))):
            blocks = "".join(self.block() for _ in range(r.randint(1, 7)))
            if r.random() < 0.5:
                level = r.randint(2, 4)
                blocks = f"<h{level}>[[{self.words(2, 7)}]]</h{level}>" + blocks
            if self.layout == "sections" or r.random() < 0.3:
                name = r.choice(SECTION_NAMES)
                blocks = f'<section{r.choice(("", f" id={name}", chr(32) + f"id={chr(34)}{name}{chr(34)}"))}>{blocks}</section>'
            out.append(blocks)
            if r.random() < 0.35:
                out.append(self.part(r.choice(("advert", "advert", "share", "side", "form", "notice"))))
        return "".join(out)

    # ---------------------------------------------------------- everything else

    def inside(self, kind: str) -> str:
        r = self.rng
        if kind in ("menu", "share") or (kind in ("foot", "side", "head") and r.random() < 0.4):
            if r.random() < 0.3:
                return r.choice((" ", " | ", " &middot; ")).join(self.link() for _ in range(r.randint(2, 9)))
            return f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(r.randint(2, 10)))}</ul>"
        if kind == "form":
            return f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + f"<p>{self.words(4, 12)}</p>" * r.randint(0, 1)
        if kind == "comments":
            names, t = PART_NAMES["comments"], r.choice(("div", "div", "li", "article", "p"))
            each = lambda: f'<{t} class="{r.choice(names)}"><b>{self.words(1, 2)}</b> {self.words(5, 50)}</{t}>'
            return f"<h3>{self.words(1, 3)}</h3>" + "".join(each() for _ in range(r.randint(1, 8)))
        if kind == "head":
            return f"<div>{self.link(1, 3)}</div>" + f"<p>{self.words(2, 8)}</p>" * r.randint(0, 1)
        if kind == "foot":
            return f"<p>&copy; {self.words(2, 12)}</p>" + f"<p>{self.link()} {self.link()}</p>" * r.randint(0, 1)
        if kind == "side":
            return f"<h4>{self.words(1, 3)}</h4><p>{self.words(4, 25)} {self.link()}</p>"
        return f"<p>{self.words(3, 18)}</p>" if r.random() < 0.5 else self.words(3, 14) + self.link()

    def part(self, kind: str) -> str:
        r, body = self.rng, self.inside(kind)
        if self.layout == "nested" and r.random() < 0.4:
            body = f"<div><div>{body}</div></div>"
        tag, attrs = "div", ""
        if self.semantic and kind in TAGS and r.random() < 0.85 or kind == "form" and r.random() < 0.8:
            tag = r.choice(TAGS[kind])
        named = self.named or kind in ("advert", "notice", "comments")
        if named and (tag == "div" or r.random() < 0.5):
            which = r.random()
            name = r.choice(PART_NAMES[kind])
            if which < 0.6:
                more = f" {r.choice(PART_NAMES[kind])}" * (r.random() < 0.2) + f" x{r.randrange(999)}" * (r.random() < 0.2)
                attrs = f' class="{name}{more}"'
            elif which < 0.85:
                attrs = f' id="{name}"'
            elif kind in ROLES:
                attrs = f' role="{ROLES[kind]}"'
            else:
                attrs = f" class={name}"
            if tag == "div" and r.random() < 0.25:
                tag = r.choice(("section", "ul" if "<li>" in body and "<div" not in body and "<ul" not in body else "div", "p" if "<" not in body else "div"))
        elif tag == "div":
            attrs = self.opaque()
        if kind == "notice" and r.random() < 0.2:
            attrs += r.choice((" hidden", ' style="display:none"', ' aria-hidden="true"'))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def page(self) -> str:
        r, layout = self.rng, self.layout
        content = self.content()
        before = [self.part(k) for k in ("notice", "head", "menu", "menu", "advert", "share") if r.random() < 0.55]
        after = [self.part(k) for k in ("share", "comments", "side", "form", "advert", "menu", "foot") if r.random() < 0.5]
        side = self.part("side") if r.random() < 0.4 else ""
        name = r.choice(CONTENT_NAMES)
        if layout in ("html5", "nested"):
            content = f"<article>{content}{self.part('foot') if r.random() < 0.15 else ''}</article>"
            if r.random() < 0.4:
                content = f"<main>{side}{content}</main>" if r.random() < 0.5 else f"<main>{content}{self.part('share')}</main>"
                side = ""
        elif layout == "main":
            content = f"<main{r.choice(('', ' id=main', ' role=main'))}>{content}</main>"
        elif layout in ("both", "classes", "form") or (layout == "sections" and self.named):
            content = f'<{"article" if layout == "both" and r.random() < 0.5 else "div"} {r.choice(("class", "id"))}="{name}">{content}</div>'
            content = content[:-6] + ("</article>" if content.startswith("<article") else "</div>")
        elif layout == "opaque":
            content = f"<div{self.opaque()}>{content}</div>"
        if layout == "tables":
            cells = "".join(f"<tr><td>{x}</td></tr>" for x in before)
            body = f"<table>{cells}<tr><td>{side}</td><td>{content}</td></tr>{''.join(f'<tr><td>{x}</td></tr>' for x in after)}</table>"
        else:
            middle = side + content if r.random() < 0.5 else content + side
            body = "".join(before) + middle + "".join(after)
        if layout == "form":
            body = f'<form id="aspnetForm" method="post">{body}</form>'
        elif layout == "nested":
            body = f"<div><div>{body}</div></div>"
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a = '<p>';</script></head>" if r.random() < 0.8 else ""
        return f"<html>{head}<body>{body}" + "</body></html>" * (r.random() < 0.9)


def labelled_pages(pages: int, seed: int, layouts: tuple = LAYOUTS) -> list[str]:
    """``pages`` labelled pages, the layouts in turn."""
    rng = random.Random(seed)
    return [_Page(rng, layouts[k % len(layouts)]).page() for k in range(pages)]
