"""Labelled pages for the field of ``html_text``: invented pages of varied build, each block marked as main text or not.

A page is drawn from a seeded generator: a frame (where header, menus, sidebar, notices, adverts, forms, comments and
footer stand, and how they are named), and an article of headings, paragraphs, lists, quotes, tables and figures, with
or without elements of its own name around it. In the generated html every stretch of text starts with an invisible
mark that says whether it is main text; ``labelled_pages`` parses the page, reads the marks as labels and removes them.
"""

from __future__ import annotations

import random

from brainweave.llm.html_text import Block, blocks

MAIN, REST = "\ue000", "\ue001"
SYLLABLES = "ka lo mi ren tas vo shu ber lin dor ea gra ni pol us ter qua fen ói çe hü st an er on".split()


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        end = self.r.choice((".", ".", ".", ".", "?", "!", ""))
        text = self.words(low, high)
        if self.r.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        style = self.r.random()
        if style < 0.04:
            text = text.upper()
        elif style < 0.08:
            text = " ".join(w + self.r.choice(("***", "!!", " |", "&amp;&amp;", "%%%")) for w in text.split(" "))
        return text[:1].upper() + text[1:] + end

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 9))))

    def say(self, mark: str, text: str) -> str:
        return mark + text

    def link(self, mark: str, text: str) -> str:
        return f'<a href="/{self.word()}">{mark}{text}</a>'

    def named(self, *names: str) -> str:
        name = self.r.choice(names)
        name = self.r.choice((name, f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}"))
        return self.r.choice((f' class="{name}"', f' id="{name}"', f' class="{name}"'))

    # ---- what isn't main text

    def menu(self) -> str:
        items = [self.link(REST, self.words(1, 2)) for _ in range(self.r.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)
        if self.r.random() < 0.6:
            return f"<nav{self.named('nav', 'main-menu', 'links') if self.r.random() < 0.4 else ''}>{inner}</nav>"
        return f"<div{self.named('nav', 'menu', 'navbar', 'breadcrumbs', 'navigation')}>{inner}</div>"

    def header(self) -> str:
        title = self.r.choice(("h1", "h2", "div", "p", "span"))
        inner = f"<{title}>{REST}{self.words(1, 4)}</{title}>" + (f"<p>{REST}{self.sentence(2, 6)}</p>" if self.r.random() < 0.4 else "") + (self.menu() if self.r.random() < 0.4 else "")
        return f"<header>{inner}</header>" if self.r.random() < 0.6 else f"<div{self.named('header', 'masthead', 'top-bar', 'banner')}>{inner}</div>"

    def footer(self) -> str:
        inner = self.r.choice((f"{REST}&copy; {self.word()}.example &middot; {self.sentence(2, 12)}", f"<p>{REST}&copy; 2{self.r.randint(100, 999)} {self.words(1, 3)}. {self.sentence()}</p>", f"<p>{REST}{self.sentence()}</p>" + self.menu(), f"<div>{REST}{self.words(2, 9)}</div>"))
        return f"<footer>{inner}</footer>" if self.r.random() < 0.7 else f"<div{self.named('footer', 'site-footer', 'copyright', 'legal')}>{inner}</div>"

    def advert(self) -> str:
        text = self.r.choice((self.sentence(2, 20), self.words(2, 6)))
        text = self.link(REST, text) if self.r.random() < 0.4 else REST + text
        tag = self.r.choice(("div", "div", "div", "aside", "section", "p"))
        return f"<{tag}{self.named('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'advertisement')}>{text}</{tag}>"

    def notice(self) -> str:
        inner = f"<p>{REST}{self.sentence(4, 25)}</p>" + (f"<button>{REST}{self.words(1, 2)}</button>" if self.r.random() < 0.6 else "")
        if self.r.random() < 0.3:
            inner = REST + self.sentence(4, 25)
        return f"<div{self.named('cookie', 'notice', 'consent', 'alert', 'popup', 'newsletter', 'gdpr', 'modal')}>{inner}</div>"

    def sidebar(self) -> str:
        inner = f"<h3>{REST}{self.words(1, 4)}</h3>" + "".join(self.r.choice((f"<p>{REST}{self.sentence()}</p>", self.advert(), self.menu(), f"<ul><li>{self.link(REST, self.words(2, 9))}</li></ul>")) for _ in range(self.r.randint(1, 3)))
        return f"<aside>{inner}</aside>" if self.r.random() < 0.5 else f"<div{self.named('sidebar', 'side', 'related', 'widget', 'rail', 'recommended', 'more')}>{inner}</div>"

    def form(self) -> str:
        return f'<form action="/{self.word()}"><label>{REST}{self.words(1, 5)}</label> <input name="q"><button>{REST}{self.words(1, 2)}</button></form>' + (f"<form><p>{REST}{self.sentence()}</p><select><option>{REST}{self.word()}<option>{REST}{self.word()}</select></form>" if self.r.random() < 0.3 else "")

    def comments(self) -> str:
        one = lambda: f"<{t}{self.named('comment', 'reply') if self.r.random() < 0.6 else ''}><p>{REST}{self.prose()}</p></{t}>" if (t := self.r.choice(("div", "li", "article"))) else ""
        inner = (f"<h3>{REST}{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(("div", "section", "ol", "ul"))
        return f"<{tag}{self.named('comments', 'comment-list', 'discussion', 'replies', 'respond', 'disqus')}>{inner}</{tag}>"

    def share(self) -> str:
        items = "".join(f"<li>{self.link(REST, self.word())}</li>" for _ in range(self.r.randint(2, 4)))
        return f"<ul{self.named('share', 'social', 'follow', 'tags')}>{items}</ul>"

    # ---- what is

    def paragraph(self) -> str:
        text = self.prose()
        shape = self.r.random()
        if shape < 0.1:
            text = f"<b>{MAIN}{text}<br>"
            return f"<p>{text}" if self.r.random() < 0.5 else f"<p>{text}</b></p>"
        if shape < 0.2:
            text = text.replace(" ", " " + self.link("", self.words(1, 3)) + " ", 1)
        elif shape < 0.3:
            text = text.replace(" ", f" <em>{self.word()}</em> ", 1)
        return f"<p>{MAIN}{text}</p>" if self.r.random() < 0.85 else f"<div>{MAIN}{text}</div>"

    def part(self) -> str:
        kind = self.r.random()
        if kind < 0.7:
            return self.paragraph()
        if kind < 0.78:
            tag = self.r.choice(("h2", "h3", "h2", "h4"))
            return f"<{tag}>{MAIN}{self.words(1, 7)}</{tag}>"
        if kind < 0.86:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{MAIN}{self.sentence()}{self.r.choice(('', '</li>'))}" for _ in range(self.r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.9:
            return f"<blockquote><p>{MAIN}{self.prose()}</p></blockquote>"
        if kind < 0.94:
            row = lambda: "<tr>" + "".join(f"<td>{MAIN}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>"
            return "<table>" + "".join(row() for _ in range(self.r.randint(1, 4))) + "</table>"
        if kind < 0.97:
            return f'<figure><img src="/{self.word()}.png"><figcaption>{MAIN}{self.sentence()}</figcaption></figure>'
        return f"<pre>{MAIN}{self.words(2, 12)}</pre>"

    def article(self) -> str:
        parts = [self.part() for _ in range(self.r.choice((1, 2, 4, 6, 10, 20)))]
        if self.r.random() < 0.9:
            head = f"<h1>{MAIN}{self.words(1, 10)}</h1>"
            parts.insert(0, f"<header>{head}</header>" if self.r.random() < 0.08 else head)
        for extra in (self.advert, self.share, self.sidebar, self.notice, self.form):
            if self.r.random() < 0.08:
                parts.insert(self.r.randint(1, len(parts)), extra())
        if self.r.random() < 0.08:
            parts.append(self.comments())
        inner = "".join(parts)
        shape = self.r.random()
        if shape < 0.6:
            return f"<article{self.named('post', 'entry', 'story') if self.r.random() < 0.3 else ''}>{inner}</article>"
        if shape < 0.75:
            return f"<main>{inner}</main>"
        if shape < 0.97:
            return f"<div{self.named('content', 'article', 'post', 'entry', 'main', 'story', 'text')}>{inner}</div>"
        return f"<div>{inner}</div>"

    def html(self) -> str:
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        top = some(0.5, self.header) + some(0.2, self.notice) + some(0.75, self.menu) + some(0.6, self.advert) + some(0.15, self.form)
        middle = some(0.1, self.sidebar) + self.article() + some(0.3, self.sidebar) + some(0.2, self.advert) + some(0.35, self.comments) + some(0.15, self.form) + some(0.15, self.share)
        if r.random() < 0.25:
            middle = f"<main>{middle}</main>" if r.random() < 0.6 else f'<div class="wrapper">{middle}</div>'
        bottom = some(0.2, self.notice) + some(0.1, self.menu) + some(0.8, self.footer)
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f'<!DOCTYPE html><html lang="en">{head}<body>{top}{middle}{bottom}' + r.choice(("</body></html>", ""))


def labelled(html: str) -> tuple[list[Block], list[bool]]:
    """Blocks without their marks, and their labels."""
    found = [b for b in blocks(html) if MAIN in b.text or REST in b.text]
    labels = [MAIN in b.text for b in found]
    for b in found:
        b.text = b.text.replace(MAIN, "").replace(REST, "").strip()
    keep = [i for i, b in enumerate(found) if b.text]
    return [found[i] for i in keep], [labels[i] for i in keep]


def labelled_pages(n: int = 800, seed: int = 0) -> list[tuple[list[Block], list[bool]]]:
    pages = [labelled(Page(seed * 1_000_003 + k).html()) for k in range(n)]
    return [p for p in pages if p[0]]
