"""Made-up pages with known labels, to learn from where no page is labelled.

``data-keep`` marks what belongs to the article (1) and what does not (0); it holds
for all below. Features do not see it.
"""

from __future__ import annotations

import random

SYLLABLES = "an er the on in ra lo mi sé tu ka ber gen".split()


class Layout:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        found = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 5))) for _ in range(n)]
        for i in range(self.r.randint(3, 14), n, self.r.randint(5, 16)):
            found[i] += self.r.choice([".", ",", "."])
        return " ".join(found).capitalize() + self.r.choice([".", ".", ""])

    def attr(self, names: str, chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return self.r.choice(["", "", ' class="x%d"' % self.r.randint(1, 99)])
        name = self.r.choice(names.split())
        more = self.r.choice(["", "", " c%d" % self.r.randint(1, 9), "-box", "-inner"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}{more}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice([" ", " | ", ""]).join(items)

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div"])
        return f'<{tag} data-keep="0"{self.attr("nav menu navbar navigation breadcrumb", 0.9 if tag == "div" else 0.3)}>{self.links(2, 10)}</{tag}>'

    def header(self) -> str:
        tag = self.r.choice(["header", "div"])
        title = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 10)}</p>", f"<h2>{self.words(1, 5)}</h2>"])
        inner = title + (self.nav() if self.r.random() < 0.5 else "")
        return f'<{tag} data-keep="0"{self.attr("header masthead topbar banner", 0.9 if tag == "div" else 0.3)}>{inner}</{tag}>'

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = self.r.choice(["&copy; ", "", "&middot; "]) + self.words(2, 25)
        if self.r.random() < 0.4:
            inner = f"<p>{inner}</p>" + self.links(1, 6)
        return f'<{tag} data-keep="0"{self.attr("footer bottom copyright", 0.9 if tag == "div" else 0.3)}>{inner}</{tag}>'

    def advert(self) -> str:
        tag = self.r.choice(["div", "div", "aside", "section"])
        inner = self.words(3, 40)
        inner = self.r.choice([inner, f"<p>{inner}</p>", f'<a href="#">{inner}</a>'])
        return f'<{tag} data-keep="0"{self.attr("ad ads advert advertisement promo sponsored banner", 0.95)}>{inner}</{tag}>'

    def notice(self) -> str:
        inner = f"<p>{self.words(4, 45)}</p>" + self.r.choice(["", "<button>Ok</button>"])
        return f'<div data-keep="0"{self.attr("cookie-notice notice consent alert popup newsletter", 0.95)}>{inner}</div>'

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q>" + self.r.choice(["", f"<p>{self.words(3, 25)}</p>"])
        form = f'<form action="/s" data-keep="0">{inner}<button>{self.words(1, 2)}</button></form>'
        return self.r.choice([form, f'<div data-keep="0"{self.attr("search login subscribe signup")}>{form}</div>'])

    def sidebar(self) -> str:
        tag = self.r.choice(["aside", "aside", "div", "section"])
        parts = []
        for _ in range(self.r.randint(1, 4)):
            parts.append(self.r.choice([f"<h3>{self.words(1, 4)}</h3>", ""]) + self.r.choice([self.links(2, 8), f"<p>{self.words(5, 60)}</p>"]))
        return f'<{tag} data-keep="0"{self.attr("sidebar side widget related recommended", 0.95 if tag != "aside" else 0.5)}>{"".join(parts)}</{tag}>'

    def comments(self) -> str:
        said = []
        for _ in range(self.r.randint(1, 8)):
            text = "".join(f"<p>{self.words(3, 80)}</p>" for _ in range(self.r.randint(1, 2)))
            tag = self.r.choice(["div", "li", "article"])
            said.append(f'<{tag}{self.attr("comment reply", 0.9)}><b>{self.words(1, 2)}</b>{text}</{tag}>')
        tag = self.r.choice(["section", "div"])
        head = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>"])
        return f'<{tag} data-keep="0"{self.attr("comments discussion replies respond", 0.97)}>{head}{"".join(said)}</{tag}>'

    def share(self) -> str:
        return f'<div data-keep="0"{self.attr("share social tags pagination", 0.95)}>{self.links(2, 6)}</div>'

    def paragraph(self) -> str:
        size = self.r.choice([(1, 2), (1, 12), (10, 60), (30, 160)])
        text = self.words(*size)
        if self.r.random() < 0.15:
            text += f' <a href="/w">{self.words(1, 4)}</a> {self.words(1, 9)}'
        kind = self.r.random()
        if kind < 0.08:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        return f"<p>{text}</p>"

    def part(self) -> str:
        kind = self.r.random()
        if kind < 0.74:
            return self.paragraph()
        if kind < 0.82:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 9)}</h{n}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(self.r.randint(2, 7))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{self.words(5, 50)}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=a><figcaption>{self.words(2, 15)}</figcaption></figure>"
        return f"<div>{self.paragraph()}{self.paragraph()}</div>"

    def article(self) -> str:
        parts = [f"<h1>{self.words(1, 12)}</h1>"] if self.r.random() < 0.8 else []
        parts += [self.part() for _ in range(self.r.choice([1, 2, self.r.randint(2, 8), self.r.randint(5, 40)]))]
        for make in (self.advert, self.share, self.form, self.notice, self.sidebar):
            if self.r.random() < 0.12:
                parts.insert(self.r.randint(0, len(parts)), make())
        if self.r.random() < 0.12:
            parts.append(self.comments())
        tag = self.r.choice(["article"] * 5 + ["main", "main", "div", "div", "section"])
        named = 0.3 if tag in ("article", "main") else 0.95
        return f'<{tag} data-keep="1"{self.attr("content article main post entry story body text", named)}>{"".join(parts)}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [make() for make, chance in ((self.header, 0.5), (self.nav, 0.8), (self.notice, 0.2), (self.advert, 0.5), (self.form, 0.2)) if r.random() < chance]
        after = [make() for make, chance in ((self.share, 0.2), (self.comments, 0.35), (self.sidebar, 0.35), (self.advert, 0.3)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.3 and after:
            before.append(after.pop())
        middle = self.article()
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = f'<{r.choice(["div", "div", "main", "section"])}{self.attr("wrapper container row page content", 0.6)}>{middle}</div>'
        inner = "".join([*before, middle, *after])
        if r.random() < 0.3:
            inner = f'<div{self.attr("wrapper container page", 0.7)}>{inner}</div>'
        end = self.footer() if r.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{inner}{end}</body></html>"
        return page if r.random() < 0.95 else page[: int(len(page) * r.uniform(0.4, 1))]
