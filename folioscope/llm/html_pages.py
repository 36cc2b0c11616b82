"""Made-up pages with known main text, from which the block labeller learns.

No table labels page blocks, so the labeller is fitted on pages drawn from a bounded number of layouts: semantic
elements, telling class names or bare containers around an article, and the parts that do not belong to it.
"""

from __future__ import annotations

import html
import random

# Words and names that pages use for their parts (fixed values of this generator).
MENU = "Home|About us|Contact|Login|Register|Search|News|Sport|Shop|Blog|Archive|Topics|Start|Über uns|Kontakt|Anmelden|Accueil|Connexion|Inicio|Contacto|Menu|Help|FAQ".split("|")
FOOTER = "All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|© 2024|Sitemap|Powered by|Back to top|Follow us".split("|")
NOTICE = "We use cookies to improve your experience.|Accept all|This site uses cookies.|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|Please enable JavaScript|Your browser is out of date|Maintenance tonight|Accept|Decline".split("|")
ADVERT = "Advertisement|Sponsored|Buy now|50% off|Subscribe today|Anzeige|Publicité|Publicidad|Limited offer|Click here|Free trial".split("|")
FORM = "Email address|Your name|Subscribe to our newsletter|Send|Submit|Search|Sign up|Password|Leave a comment|Post comment".split("|")
RELATED = "Related articles|Read more|You may also like|Most popular|Trending|Share|Tweet|Previous|Next|Tags|Recent posts".split("|")
COMMENT = "Reply|Comments|3 comments|Report|Like|says:|wrote|Kommentare|Commentaires|Comentarios".split("|")

PARTS = {
    "menu": (MENU, 'nav|div class="menu"|div class="navbar"|div id="navigation"|ul class="nav"|div class="breadcrumb"|div class="topbar"|nav class="main-nav"|div role="navigation"'),
    "header": (MENU, 'header|div class="header"|div id="header"|div class="site-header"|div class="masthead"|div class="banner"|header class="page-header"'),
    "footer": (FOOTER, 'footer|div class="footer"|div id="footer"|div class="site-footer"|footer class="bottom"|div class="copyright"|div role="contentinfo"'),
    "sidebar": (RELATED, 'aside|div class="sidebar"|div id="sidebar"|aside class="widget"|div class="related"|section class="related-posts"|div class="share"|div class="social"|div class="tags"|div class="recommended"|div class="rail"'),
    "notice": (NOTICE, 'div class="cookie"|div id="cookie-notice"|div class="notice"|div class="alert"|div class="consent"|div role="alert"|section class="banner"|div class="popup"|div class="modal"|p class="notice"|div class="gdpr"'),
    "advert": (ADVERT, 'div class="ad"|div class="ads"|div class="advert"|div id="ad-top"|aside class="ad"|div class="sponsored"|div class="promo"|section class="advertisement"|ins class="adsbygoogle"|div class="banner-ad"'),
    "form": (FORM, 'form|div class="newsletter"|form class="search"|form id="login"|div class="subscribe"|fieldset|form class="comment-form"'),
    "comments": (COMMENT, 'section class="comments"|div id="comments"|div class="comment-list"|ol class="comments"|div class="discussion"|section id="reader-comments"|div class="replies"|div class="respond"'),
}
MAIN = 'article|article|main|div class="content"|div id="content"|div class="post"|div class="entry-content"|div class="article-body"|section class="story"|div class="text"|div|div role="main"|div class="post-content"|td|section'.split("|")
#: Families of layouts; a labeller can be fitted on some and measured on the others.
LAYOUTS = ("telling", "semantic", "bare", "opaque")
OUTER = 'div|div class="container"|div class="wrapper"|div id="page"|main|section|div class="row"|div class="layout"'.split("|")


class _Page:
    def __init__(self, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> None:
        self.r = random.Random(seed)
        letters = [a + b for a in ("b", "ch", "d", "f", "g", "l", "m", "n", "r", "s", "st", "th", "v", "") for b in ("a", "e", "i", "o", "u", "en", "er", "ion", "é", "ü")]
        self.syllables = self.r.sample(letters, 40)
        self.extra = self.r.choice(["", "", "", "!!", "$$$", " |"])
        weights = {"telling": 5, "semantic": 3, "bare": 2, "opaque": 3}
        self.layout = self.r.choices(layouts, [weights[x] for x in layouts])[0]
        self.main: set[str] = set()
        self.count = 0

    def words(self, n: int, stop: bool = True) -> str:
        w = ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 4))) + (self.extra if self.r.random() < 0.7 else "") for _ in range(n)]
        self.count += 1
        text = f"{' '.join(w).capitalize()} {self.count}"
        return text + ("." if stop else "")

    def shell(self, telling: str) -> str:
        """A container of this page's family in place of a telling one."""
        name = telling.split()[0]
        if self.layout == "semantic":
            return name
        if self.layout == "bare":
            return name if name in ("form", "fieldset", "td", "ul", "ol", "p") else "div"
        if self.layout == "opaque" and name not in ("form", "fieldset", "td"):
            kind = "class" if self.r.random() < 0.8 else "id"
            value = "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=self.r.randint(2, 6)))
            return f'{self.r.choice(["div", "div", "section"]) if name not in ("ul", "ol") else name} {kind}="{value}"'
        return telling

    def inline(self, text: str) -> str:
        out = []
        for w in text.split(" "):
            x = self.r.random()
            w = html.escape(w)
            tag = "b" if x < 0.01 else "i" if x < 0.02 else "em" if x < 0.03 else "span" if x < 0.035 else None
            out.append(f'<a href="/{len(out)}">{w}</a>' if 0.035 < x < 0.05 else f"<{tag}>{w}</{tag}>" if tag else w)
        return " ".join(out)

    def kept(self, tag: str, text: str) -> str:
        self.main.add(text)
        end = "" if tag == "p" and self.r.random() < 0.15 else f"</{tag.split()[0]}>"
        if tag == "p" and self.r.random() < 0.1:
            return f"<p><b>{html.escape(text)}<br>"
        return f"<{tag}>{self.inline(text)}{end}"

    def linked(self) -> str:
        """A short paragraph that is for a good part a link."""
        before = self.words(self.r.randint(1, 4), False) + " "
        words, after = self.words(self.r.randint(1, 3), False).lower(), self.r.choice([".", ".", " " + self.words(self.r.randint(1, 4)).lower()])
        self.main.add(" ".join(f"{before}{words}{after}".split()))
        return f'<p>{html.escape(before)}<a href="/{self.count}">{html.escape(words)}</a>{html.escape(after)}</p>'

    def comment(self) -> str:
        """A reader's comment: a name, perhaps a date, some lines or paragraphs, perhaps buttons and answers."""
        r = self.r
        name = f"<b>{self.words(1, False)}</b>" if r.random() < 0.6 else f'<a href="/u">{self.words(1, False)}</a> {r.choice(["says:", "wrote:", "2 days ago", "12.03.2024", ""])}'
        body = "".join(f"<p>{html.escape(self.words(r.choice([2, 5, 12, 40, 80])))}</p>" for _ in range(r.choice([1, 1, 1, 2, 3])))
        more = f"<p>{r.choice(COMMENT)}</p>" if r.random() < 0.3 else ""
        return f'<div class="comment"><p>{name} {html.escape(r.choice(COMMENT)) if r.random() < 0.3 else ""}</p>{body}{more}</div>'

    def part(self, kind: str) -> str:
        phrases, shells = PARTS[kind]
        shell = self.shell(self.r.choice(shells.split("|")))
        say = lambda: self.r.choice(phrases) if self.r.random() < (0.5 if self.layout != "bare" else 0.8) else self.words(self.r.randint(1, 3 if kind in ("menu", "header", "form") else 14), stop=kind not in ("menu", "header", "form"))
        items = []
        if kind == "comments" and (self.layout in ("bare", "opaque") or self.r.random() < 0.4):
            items.append(f"<h3>{self.r.choice(['Comments', '3 comments', 'Kommentare', 'Commentaires', 'Comentarios', 'Discussion', 'Leave a reply'])}</h3>")
        for _ in range(self.r.randint(1, 6)):
            text = html.escape(say())
            if kind in ("menu", "header"):
                items.append(self.r.choice([f'<li><a href="/x">{text}</a></li>', f'<a href="/x">{text}</a>', f"<span>{text}</span>", f'<p><a href="/x">{text}</a></p>']))
            elif kind == "form":
                items.append(self.r.choice([f"<label>{text}</label><input name=a>", f"<button>{text}</button>", f"<p>{text}</p>", f"<legend>{text}</legend>"]))
            elif kind == "comments":
                plain = f'<div class="comment"><p><b>{self.words(1, False)}</b> {text}</p><p>{html.escape(self.words(self.r.randint(3, 40)))}</p></div>'
                items.append(plain if self.r.random() < 0.5 else self.comment())
            else:
                items.append(self.r.choice([f"<p>{text}</p>", f'<li><a href="/x">{text}</a></li>', text, f"<h3>{text}</h3>", f"<div>{text}</div>"]))
        body = "".join(items)
        if "<li>" in body and not shell.startswith(("ul", "ol")):
            body = f"<ul>{body}</ul>"
        return f"<{shell}>{body}</{shell.split()[0]}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(self.kept(r.choice(["h1", "h1", "h1", "h2", 'h1 class="title"']), self.words(r.randint(2, 9), False)))
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            x = r.random()
            if r.random() < 0.12:  # an article may say what other parts say
                self.count += 1
                phrase = r.choice(r.choice(list(PARTS.values()))[0])
                # other parts never end such a phrase with a full stop of its own
                plain = self.layout in ("telling", "semantic") and phrase[-1].isalpha() and r.random() < 0.5
                out.append(self.kept("p", f"{phrase}." if plain else f"{phrase} {self.count}."))
            if x < 0.64:
                out.append(self.kept("p", self.words(r.choice([1, 2, 4, 10, 25, 60]))))
            elif x < 0.69:
                out.append(self.linked())
            elif x < 0.75:
                out.append(self.kept(r.choice(["h2", "h3"]), self.words(r.randint(1, 6), False)))
            elif x < 0.82:
                out.append("<ul>" + "".join(self.kept("li", self.words(r.randint(1, 12), False)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                out.append("<blockquote>" + self.kept("p", self.words(r.randint(5, 30))) + "</blockquote>")
            elif x < 0.9:
                head = "<tr>" + "".join(self.kept("th", self.words(r.randint(1, 2), False)) for _ in range(3)) + "</tr>" if r.random() < 0.3 else ""
                out.append(f"<table>{head}" + "".join("<tr>" + "".join(self.kept("td", self.words(r.randint(1, 4), False)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif x < 0.92:
                out.append(self.kept("pre", self.words(r.randint(3, 12), False)))
            elif x < 0.96:
                caption = self.kept("figcaption", self.words(r.choice([2, 5, 12]), r.random() < 0.5))
                out.append(f'<figure><img src="/i.png" alt="">{caption}</figure>')
            else:
                out.append("<dl>" + "".join(self.kept("dt", self.words(r.randint(1, 3), False)) + self.kept("dd", self.words(r.randint(2, 12))) for _ in range(r.randint(1, 4))) + "</dl>")
            if r.random() < 0.12:
                out.append(self.part(r.choice(["advert", "sidebar", "form", "notice"])))
        if r.random() < 0.2:
            out.append(self.linked())
        return "".join(out)

    def make(self) -> str:
        r = self.r
        shell = self.shell(r.choice(MAIN))
        body = f"<{shell}>{self.article()}</{shell.split()[0]}>"
        if r.random() < 0.4:
            body = f"<{shell}>{self.article()}{self.part('comments')}</{shell.split()[0]}>" if r.random() < 0.5 else body + self.part("comments")
        before = [self.part(k) for k in r.sample(["menu", "header", "notice", "advert", "form", "menu"], r.randint(1, 4))]
        after = [self.part(k) for k in r.sample(["sidebar", "advert", "form", "footer", "notice"], r.randint(0, 3))] + [self.part("footer")] * (r.random() < 0.85)
        if r.random() < 0.4:
            before, after = before[1:], [*after, before[0]] if r.random() < 0.2 else after
        middle = body if r.random() < 0.5 else f"<{(o := r.choice(OUTER))}>{body}{self.part('sidebar') if r.random() < 0.4 else ''}</{o.split()[0]}>"
        title = html.escape(self.words(4, False))
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def made_page(seed: int, layouts: tuple[str, ...] = LAYOUTS) -> tuple[str, set[str]]:
    """The markup of a page of one of these families and the texts of its main blocks."""
    page = _Page(seed, layouts)
    markup = page.make()
    return markup, {" ".join(t.split()) for t in page.main}
