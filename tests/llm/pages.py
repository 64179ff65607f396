"""Labelled pages: made up from templates of many kinds of sites; which blocks are main text is known by construction."""

import random


class Maker:
    def __init__(self, seed):
        self.rnd, self.main = random.Random(seed), []

    def words(self, low, high):
        return " ".join("".join(self.rnd.choice("abcdefghijklmnoprstuvw") for _ in range(self.rnd.randrange(2, 9))) for _ in range(self.rnd.randrange(low, high)))

    def sentence(self, low=4, high=30):
        return self.words(low, high).capitalize() + self.rnd.choice([".", ".", ".", "!", "?"])

    def keep(self, text):
        self.main.append(text)
        return text

    def title(self):
        return self.keep(self.words(2, 9).capitalize())

    def para(self):
        return self.keep(" ".join(self.sentence() for _ in range(self.rnd.choice([1, 1, 2, 3, 6]))))

    def short(self):
        return self.keep(self.sentence(1, 5))

    def linked(self):
        """Links that an article has itself: a list of sources, a linked sentence, links in a paragraph."""
        kind = self.rnd.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f'<li><a href="/s{i}">{self.keep(self.words(2, 9).capitalize())}</a></li>' for i in range(self.rnd.randrange(1, 5))) + "</ul>"
        if kind == 1:
            return f'<p><a href="/r">{self.short() if self.rnd.random() < 0.3 else self.para()}</a></p>'
        a, b, c = self.words(3, 20).capitalize(), self.words(2, 8), self.sentence(3, 20)
        self.main.append(f"{a} {b} {c}")
        return f'<p>{a} <a href="/x">{b}</a> {c}</p>'

    def body(self, wrap="p", low=1, high=7, links=False):
        out = []
        for _ in range(self.rnd.randrange(low, high)):
            kind = self.rnd.random()
            if links and self.rnd.random() < 0.2:
                out.append(self.linked())
            elif kind < 0.1:
                out.append(f"<h2>{self.title()}</h2>")
            elif kind < 0.2:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.words(1, 8).capitalize())}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.22:
                out.append(f"<p>{self.keep('* * *')}</p>")
            elif kind < 0.27:
                out.append(f"<blockquote>{self.para()}</blockquote>")
            elif kind < 0.4:
                out.append(f"<{wrap}>{self.short()}</{wrap}>")
            else:
                out.append(f"<{wrap}>{self.para()}</{wrap}>")
        return "".join(out) or f"<{wrap}>{self.para()}</{wrap}>"

    def links(self, n=5, tag="li"):
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 4)}</a></{tag}>' for i in range(n))

    def nav(self):
        return self.rnd.choice(["<nav><ul>{}</ul></nav>", '<div class="main-nav"><ul>{}</ul></div>', '<ul id="menu">{}</ul>', '<div class="topbar">{}</div>', "<div><ul>{}</ul></div>", "<div>|</div><div>{}</div><div>&raquo;</div>"]).format(self.links(self.rnd.randrange(3, 9)))

    def notice(self):
        return self.rnd.choice(['<div class="cookie-notice"><p>{}</p></div>', '<div id="gdpr-consent">{}</div>', '<div class="alert banner"><span>{}</span></div>', '<div role="alertdialog"><p>{}</p><button>ok</button></div>', '<div class="newsletter-signup"><p>{}</p></div>', '<dialog><p>{}</p></dialog>']).format(self.sentence(5, 30))

    def ad(self):
        return self.rnd.choice(['<div class="ad">{}</div>', '<div class="ads-slot"><p>{}</p></div>', '<aside class="sponsored">{}</aside>', '<div id="promo-box">{}</div>', '<div class="werbung"><p>{}</p></div>']).format(self.sentence(4, 25))

    def side(self):
        inner = self.rnd.choice([f"<ul>{self.links()}</ul>", f"<h3>{self.words(1, 4)}</h3><p>{self.sentence(5, 30)}</p>", "".join(f'<article class="teaser"><h4><a href="#">{self.words(2, 6)}</a></h4><p>{self.sentence(4, 12)}</p></article>' for _ in range(2))])
        return self.rnd.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related-posts">{}</div>', '<div class="col widget-area">{}</div>']).format(inner)

    def comments(self):
        n = self.rnd.randrange(1, 9)
        each = self.rnd.choice(["<div><b>{}</b><p>{}</p></div>", '<article class="comment"><header>{}</header><p>{}</p></article>', "<li><p>{}: {}</p></li>"])
        inner = "".join(each.format(self.words(1, 3), self.sentence(4, 40)) for _ in range(n))
        return self.rnd.choice(['<section id="comments"><h3>Comments</h3>{}</section>', '<ol class="comment-list">{}</ol>', '<div id="disqus_thread">{}</div>', '<div class="user-comments">{}</div>']).format(inner)

    def form(self):
        return self.rnd.choice(["<form><label>{0}</label><input><button>{1}</button></form>", '<form class="search"><p>{0}</p><button>{1}</button></form>', "<form><fieldset><legend>{0}</legend><p>{1}</p></fieldset></form>"]).format(self.words(1, 6), self.words(1, 2))

    def footer(self):
        return self.rnd.choice(["<footer>{}</footer>", '<div id="footer"><p>{}</p></div>', '<div class="footer-copyright">{}</div>', "<footer><ul>" + self.links(4) + "</ul><p>{}</p></footer>"]).format("&copy; 2024 " + self.words(2, 12))

    def masthead(self):
        return self.rnd.choice(["<header><h1>{}</h1></header>", '<div class="masthead"><h2>{}</h2></div>', '<div id="header"><p>{}</p></div>']).format(self.words(1, 5))

    def page(self, kind):
        wrap = {
            "article": lambda: f"<article><h1>{self.title()}</h1>{self.body(links=True)}</article>",
            "own header": lambda: f"<article><header><h1>{self.title()}</h1></header>{self.body(links=True)}<footer>{self.words(1, 4)}</footer></article>",
            "main": lambda: f"<main><h1>{self.title()}</h1>{self.body(links=True)}</main>",
            "main and ads": lambda: f'<main id="content"><h1>{self.title()}</h1>{self.body()}{self.ad()}{self.body()}</main>',
            "divs": lambda: f'<div id="content"><h1>{self.title()}</h1>{self.body("div", links=True)}</div>',
            "post": lambda: f'<div class="post-entry"><h2>{self.title()}</h2>{self.body(links=True)}</div>',
            "plain": lambda: f"<div>{self.body()}</div>",
            "bare": lambda: f"<div><p>{self.short()}</p></div>",
            "state words": lambda: f'<article class="post share-enabled has-comments"><h1>{self.title()}</h1>{self.body()}</article>',
            "table": lambda: f'<table><tr><td class="story"><h1>{self.title()}</h1>{self.body()}</td></tr></table>',
            "sections": lambda: f'<section class="article-body"><h1>{self.title()}</h1>{self.body()}</section><section class="article-body">{self.body()}</section>',
        }[kind]
        first, last = [self.masthead, self.nav, self.notice, self.ad, self.form], [self.comments, self.side, self.form, self.notice, self.ad, self.nav]
        some = lambda makers, n: "".join(m() for m in self.rnd.sample(makers, self.rnd.randrange(n)))
        before, after = (some(first, 4), some(last, 4)) if kind != "bare" else ("", "")
        head = f"<head><title>{self.words(2, 6)}</title><style>p {{}}</style></head>"
        inner = before + wrap() + after + (self.footer() if kind != "bare" else "")
        if self.rnd.random() < 0.2:
            inner = f'<form id="aspnetForm" method="post">{inner}</form>'
        body = self.rnd.choice(["<body>", "<body>", '<body class="has-sidebar menu-open">', '<body class="no-banner page-header">'])
        return f"<!DOCTYPE html><html>{head}{body}{inner}</body></html>"


KINDS = ("article", "own header", "main", "main and ads", "divs", "post", "plain", "bare", "state words", "table", "sections")


def labelled(seeds):
    """(html, main text) of so many pages."""
    out = []
    for s in seeds:
        m = Maker(s)
        html = m.page(KINDS[s % len(KINDS)])
        out.append((html, "\n".join(m.main)))
    return out
