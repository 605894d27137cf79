"""Training of the block labeller on synthetic pages: python -m quern.llm.train_html writes html_weights.npz."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np

from quern.llm import html
from quern.llm.html import HIDDEN, INPUTS

PAGES, EPOCHS, BATCH, RATE = 30_000, 6, 50, 0.01
#: Names that layouts give to parts of a page.
PARTS = {
    "nav": ["nav", "div.menu", "div.navbar", "ul.nav", "div#navigation", "nav.main-menu", "div.breadcrumbs", "header nav", "div.topnav", "ul.menu", "div.nav-wrapper nav", "div#menu", "nav.pagination", "div.pager", "ol.breadcrumb", "div.lang-switch"],
    "header": ["header", "div.header", "div#masthead", "header.site-header", "div.top-bar", "div.logo", "header.banner", "div#top", "div.branding"],
    "ad": ["div.ad", "div.ads", "aside.advert", "div.banner-ad", "section.sponsored", "div.promo", "div.advertisement", "div#ad-slot", "div.sponsor", "div.ad-container div", "ins.adsbygoogle"],
    "side": ["aside", "div.sidebar", "aside.sidebar", "div#side", "div.widget", "section.related", "div.related-posts", "div.rail", "div#secondary", "div.col-right", "div.most-read", "section.recommended", "div.teasers", "div.widget-area"],
    "notice": ["div.cookie-notice", "div#consent", "div.notice", "div.alert", "section.newsletter", "div.gdpr", "div.cookie-banner", "div.cookies", "div#cookie-bar", "div.popup", "div.modal", "div.consent-banner", "div.paywall", "div.toast", "div.overlay", "div.privacy-banner", "div.subscribe-box", "div.warning"],
    "form": ["form", "form.search", "form.subscribe", "div.login form", "form#newsletter", "div.search-box form", "form.contact-form"],
    "comments": ["div.comments", "section.comments", "div#comments", "ul.comment-list", "div.comment", "ol.commentlist", "div.discussion", "div#disqus_thread", "section.responses", "div.user-reviews", "div.replies"],
    "share": ["div.share", "ul.social", "div.tags", "div.share-buttons", "div.social-links", "p.share", "div.toolbar", "div.tag-list"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom", "div.legal", "div#colophon", "div.site-info"],
    "main": ["article", "main article", "div.content", "div#content", "main", "div.post", "div.entry-content", "section.article", "div.article-body", "article.post", "div.story", "div.text", "div.main-content", "div.post-body", "section", "div", "div div", "main div", "div.container div.row div.col", "td", "div.single-post", "div.body-copy", "div.richtext"],
}
#: What pages say beside their articles.
SAYS = {
    "nav": "Home|About us|Contact|News|Products|Services|Blog|Archive|Sports|Login|Accueil|Actualités|À propos|Startseite|Über uns|Kontakt|Inicio|Noticias|Contacto|Next|Previous|2|3|»|Shop|Help".split("|"),
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you agree to our policy.|Nous utilisons des cookies pour améliorer votre expérience.|Wir verwenden Cookies.|Utilizamos cookies propias y de terceros.|Subscribe to our newsletter and never miss a story.|Sign up for updates.|Your browser is out of date.|Please enable JavaScript.|You have reached your limit of free articles.|Abonnez-vous à notre lettre.".split("|"),
    "button": "Accept all|Accept|Reject|OK|Close|Search|Subscribe|Send|Log in|Read more|Accepter|Refuser|Zustimmen|Aceptar|Submit|Manage settings|Got it|Sign up".split("|"),
    "share": "Share|Tweet|Facebook|Print|E-mail this|Tags: news, local|Share this article|Partager|Teilen|Compartir|Follow us|Like".split("|"),
    "footer": "All rights reserved.|Privacy policy|Terms of use|Imprint|Impressum|Mentions légales|Aviso legal|Sitemap|Powered by a content system|Back to top".split("|"),
    "side": "Related articles|Most read|Recent posts|Categories|You may also like|À lire aussi|Meistgelesen|Lo más leído|Trending|Archives|Popular".split("|"),
    "ad": "Advertisement|Sponsored|Buy now and save 20%|Limited offer|Werbung|Publicité|Publicidad|Get your free quote today|Best prices guaranteed".split("|"),
    "comments": "Great article, thanks!|I disagree with this.|Reply|Leave a comment|2 comments|First!|Posted by a reader|Répondre|Kommentare|So true, I had the same problem last year.|Log in to comment".split("|"),
    "header": "The Daily Page|Weather 12°|Your trusted source|My account|Cart (0)|Since 1990".split("|"),
    "form": "Your name|E-mail address|Search the site|Password|Message|Username|Votre adresse".split("|"),
}
SYLLABLES = "the an er on in re at st en th ou ing ed ti le que eau aux ment de un sch ein ver keit os ci do ga es ra mi to lo ka né ü ß ç".split()
COMMON = "the of and to in a is that for it was on with as by at from this his her which are but had not we they one all their there been has when who will more if out so what up about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def word(r: random.Random) -> str:
    if r.random() < 0.35:
        return r.choice(COMMON)
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def sentence(r: random.Random, n: int) -> str:
    text = ""
    while n > 0:
        k = min(n, r.choice((4, 8, 12, 18)))
        text += " ".join(word(r) + r.choice(("", "", "", ",", "&amp;", "###")) * (r.random() < 0.1) for _ in range(k)).capitalize() + r.choice((".", ".", ".", "", "!", "?")) + " "
        n -= k
    return text.strip()


def wrap(r: random.Random, spec: str, inner: str) -> str:
    for one in reversed(spec.split()):
        tag, _, name = one.partition(".")
        tag, _, ident = tag.partition("#")
        if name and r.random() < 0.2:
            name = name.replace("-", r.choice(("_", "__", "-"))) + r.choice(("", " " + word(r), "-wrap", " clearfix"))
        attributes = f' class="{name}"' * bool(name) + f' id="{ident}"' * bool(ident) + r.choice(("", "", "", ' data-x="1"', ' style="top:0"'))
        inner = f"<{tag}{attributes}>{inner}" + f"</{tag}>" * (r.random() < 0.95)
    return inner


def article(r: random.Random) -> str:
    """Paragraphs with the mark 1 before each text that counts and 0 before each that doesn't. A page has one way to set a paragraph."""
    out = []
    opening = r.choice(("<p>", "<p>", "<p>", "<p>", "<div>", '<div class="p">', '<div class="paragraph">', "<section><p>", "<span>", '<p class="lead">', "<dd>", "<tr><td>", "<pre>"))
    closing = "".join(f"</{t.split()[0]}>" for t in reversed(opening.replace("<", "").split(">")[:-1]))
    if opening == "<span>":
        opening, closing = "", "<br><br>"
    if r.random() < 0.75:
        out.append(wrap(r, r.choice(("h1", "h1", "h1", "h1.title", "h2", "header h1", "div.headline")), f"\x01{sentence(r, r.randint(2, 12))}"))
    if r.random() < 0.2:
        out.append(wrap(r, r.choice(("p.byline", "div.author", "time", "p.date", "span.meta")), f"\x01By {word(r).title()} {word(r).title()}, {r.randint(1, 28)} May"))
    lists = r.random() < 0.12  # instructions, tables of contents, recipes
    broken = r.choice((0.0, 0.0, 0.1, 0.3))  # how often something else stands between paragraphs
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
        if r.random() < broken:
            out.append(part(r, r.choice(("ad", "notice", "form", "share", "side"))))
        roll, text = r.choice((0.3, 0.75, 0.8, 0.8, 0.8)) if lists else r.random(), sentence(r, r.choice((1, 3, 8, 20, 50, 120)))
        if roll < 0.66:
            out.append(f"{opening}\x01{text}{closing}")
        elif roll < 0.73:
            out.append(f"<p><b>\x01{text}<br>{sentence(r, 5)}")
        elif roll < 0.79:
            out.append(f"<h{r.randint(2, 4)}>\x01{sentence(r, 4)}</h2>")
        elif roll < 0.84:
            tag = r.choice(("ul", "ul", "ol"))
            out.append(f"<{tag}>" + "".join(f"<li>\x01{r.choice(('', '', '', '200 g ', '1 ', '3. '))}{sentence(r, r.randint(1, 12))}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>")
        elif roll < 0.87:
            out.append(f"<blockquote>\x01{text}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>\x01{text}</p></blockquote>")
        elif roll < 0.90:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>\x01{sentence(r, r.choice((1, 3)))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif roll < 0.91:
            out.append("<dl>" + "".join(f"<dt>\x01{sentence(r, r.choice((1, 3)))}</dt><dd>\x01{sentence(r, r.choice((5, 15)))}</dd>" for _ in range(r.randint(1, 5))) + "</dl>")
        elif roll < 0.92:
            out.append(f'<figure><img src="a.jpg"><figcaption>\x01{sentence(r, r.choice((3, 8, 15)))}</figcaption></figure>')
        elif roll < 0.95:
            out.append(f'{opening}\x01{sentence(r, 6)} <a href="/{word(r)}">{word(r)} {word(r)}</a> {sentence(r, 6)}{closing}')
        else:
            out.append(f"<p>\x01{text} &quot;{word(r)}&quot;</p>")
    if r.random() < 0.25:
        out.append(part(r, "share"))
    if r.random() < 0.15:
        out.append(part(r, "comments"))
    return "".join(out)


def said(r: random.Random, kind: str, n: int) -> str:
    return r.choice(SAYS[kind]) if r.random() < 0.5 else sentence(r, n)


def button(r: random.Random) -> str:
    return wrap(r, r.choice(("button", "a", "button.btn", "span.button", "div.actions button")), f"\x00{r.choice(SAYS['button'])}")


def part(r: random.Random, kind: str) -> str:
    link = lambda: f'<a href="/{word(r)}">\x00{said(r, "nav", 1)}</a>'
    if kind == "nav":
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.7 else r.choice((" ", " | ", " &gt; ")).join(link() for _ in range(4))
    elif kind == "footer":
        inner = f"\x00&copy; {word(r)}.example &middot; {said(r, 'footer', r.randint(2, 14))}" if r.random() < 0.6 else "".join(f"<p>\x00{said(r, 'footer', 4)}</p>" for _ in range(r.randint(1, 4))) + link() * (r.random() < 0.5)
    elif kind == "form":
        inner = f"<label>\x00{said(r, 'form', 1)}</label><input>" * r.randint(1, 3) + (f"<p>\x00{said(r, 'notice', 8)}</p>" if r.random() < 0.3 else "") + button(r)
    elif kind == "comments":
        name = r.choice(("div.comment", "li", "div.reply", "article.comment", "p"))
        inner = f"<h3>\x00{said(r, 'comments', 2)}</h3>" * (r.random() < 0.5) + "".join(wrap(r, name, (f"<b>\x00{word(r)}</b> " if r.random() < 0.3 else "") + f"<p>\x00{said(r, 'comments', r.choice((4, 12, 40)))}</p>") for _ in range(r.randint(1, 6)))
    elif kind == "side":
        inner = f"<h3>\x00{said(r, 'side', 3)}</h3>" * (r.random() < 0.6) + ("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>" if r.random() < 0.6 else f"<p>\x00{sentence(r, r.choice((6, 20, 60)))}</p>")
    elif kind == "share":
        inner = "".join(wrap(r, r.choice(("a", "li", "span")), f"\x00{r.choice(SAYS['share'])}") for _ in range(r.randint(1, 5)))
    else:
        inner = f"\x00{said(r, kind, r.choice((2, 8, 20, 45)))}" if r.random() < 0.6 else f"<p>\x00{said(r, kind, r.choice((2, 8, 20)))}</p>"
        inner += button(r) * (kind == "notice" and r.random() < 0.6)
    return wrap(r, r.choice(PARTS[kind]), inner)


def renamed(r: random.Random, text: str) -> str:
    """A page whose classes and ids say nothing, or are of another language; in half of them tags say nothing either."""
    names: dict[str, str] = {}
    text = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="{names.setdefault(m[2], word(r) + r.choice(("", "-" + word(r), str(r.randint(1, 9)))))}"', text)
    if r.random() < 0.5:
        text = re.sub(r"<(/?)(nav|header|footer|aside|main|article|section)\b", r"<\1div", text)
    return text


def page(r: random.Random) -> str:
    if r.random() < 0.06:  # nothing but what stands beside an article
        kinds = [k for k in ("notice", "header", "nav", "nav", "ad", "form", "share", "footer") if r.random() < 0.5]
        return f"<html><body>{''.join(part(r, k) for k in kinds) or part(r, 'nav')}</body></html>"
    return renamed(r, layout(r)) if r.random() < 0.3 else layout(r)


def layout(r: random.Random) -> str:
    if r.random() < 0.06:  # nothing but an article
        body = r.choice((article(r), f"<p>\x01{sentence(r, r.choice((10, 40, 150)))}</p>", f"\x01{sentence(r, 60)}"))
        return r.choice((body, f"<html><body>{body}</body></html>"))
    before = [part(r, kind) for kind in ("notice", "header", "nav", "ad", "side", "form") if r.random() < 0.45]
    after = [part(r, kind) for kind in ("share", "comments", "side", "ad", "form", "notice") if r.random() < 0.25]
    if r.random() < 0.6:
        after.append(part(r, "footer"))
    r.shuffle(before)
    main = wrap(r, r.choice(PARTS["main"]), article(r))
    if r.random() < 0.1:
        main = f"<table><tr><td>{part(r, 'nav')}</td><td>{article(r)}</td></tr></table>"
    body = "".join([*before, main, *after])
    if r.random() < 0.4:
        body = f'<div class="{r.choice(("wrapper", "page", "container", "site", "app", "layout"))}">{body}</div>'
    title = f"<title>{word(r)}</title>" * (r.random() < 0.9)
    return f"<!DOCTYPE html><html><head>{title}<style>p{{margin:0}}</style></head><body{r.choice(('', '', ' class=home'))}>{body}</body></html>"


def sample(r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of the blocks of a page; the marks are taken out of the texts again."""
    while True:
        found = html.blocks(page(r))
        labels = np.array(["\x01" in text for _, text, _ in found], np.float32)
        clean = [(path, text.replace("\x01", "").replace("\x00", "").strip(), linked) for path, text, linked in found]
        keep = [k for k, c in enumerate(clean) if c[1]]
        if keep:
            return html.vectors([clean[k] for k in keep]), labels[keep]


def forward(x, there, w, back):
    """States with what the gradient needs."""
    n, t, _ = x.shape
    h, c, steps = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
    out = np.zeros((n, t, HIDDEN))
    for k in range(t - 1, -1, -1) if back else range(t):
        full = np.concatenate([x[:, k], h, np.ones((n, 1))], axis=1)
        z = full @ w
        g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        on = there[:, k, None]
        c2 = f * c + i * a
        steps.append((k, full, i, f, o, a, c, np.tanh(c2), on))
        h, c = np.where(on, o * np.tanh(c2), h), np.where(on, c2, c)
        out[:, k] = h
    return out, steps


def backward(grad, steps, w):
    dw, dh, dc = np.zeros_like(w), 0.0, 0.0
    for k, full, i, f, o, a, c, tc, on in reversed(steps):
        dh = dh + grad[:, k]
        own, dcn = np.where(on, dh, 0), np.where(on, dc, 0)
        dcn = dcn + own * o * (1 - tc * tc)
        dz = np.concatenate([dcn * a * i * (1 - i), dcn * c * f * (1 - f), own * tc * o * (1 - o), dcn * i * (1 - a * a)], axis=1)
        dw += full.T @ dz
        dh = np.where(on, dz @ w[INPUTS:-1].T, dh)
        dc = np.where(on, dcn * f, dc)
    return dw


def train(seed: int = 5) -> dict[str, np.ndarray]:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = sorted((sample(r) for _ in range(PAGES)), key=lambda s: len(s[0]))
    w = {k: rng.normal(0, 0.15, (INPUTS + HIDDEN + 1, 4 * HIDDEN)) for k in ("ahead", "back")} | {"out": rng.normal(0, 0.15, 2 * HIDDEN + 1)}
    for k in ("ahead", "back"):
        w[k][-1, HIDDEN : 2 * HIDDEN] = 1.0
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        starts, loss = rng.permutation(range(0, PAGES, BATCH)), 0.0
        for s in starts:
            rows = data[s : s + BATCH]
            t = max(len(x) for x, _ in rows)
            x, y, there = np.zeros((len(rows), t, INPUTS)), np.zeros((len(rows), t)), np.zeros((len(rows), t), bool)
            for k, (a, b) in enumerate(rows):
                x[k, : len(a)], y[k, : len(a)], there[k, : len(a)] = a, b, True
            (ha, sa), (hb, sb) = forward(x, there, w["ahead"], False), forward(x, there, w["back"], True)
            both = np.concatenate([ha, hb, np.ones((*ha.shape[:2], 1))], axis=2)
            p = 1 / (1 + np.exp(-(both @ w["out"])))
            d = np.where(there, p - y, 0) / there.sum()
            loss += float(-np.log(np.where(y > 0, p, 1 - p)[there] + 1e-9).mean())
            grads = {"out": np.einsum("nt,nth->h", d, both)}
            dh = d[:, :, None] * w["out"][:-1]
            grads |= {"ahead": backward(dh[:, :, :HIDDEN], sa, w["ahead"]), "back": backward(dh[:, :, HIDDEN:], sb, w["back"])}
            step += 1
            for k, g in grads.items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                w[k] -= RATE * (0.5**epoch) ** 0.5 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        print(epoch, round(loss / len(starts), 4))
    return {k: v.astype(np.float32) for k, v in w.items()}


def accuracy(weights: dict[str, np.ndarray], pages: int = 300, seed: int = 99) -> float:
    r = random.Random(seed)
    data = [sample(r) for _ in range(pages)]
    scores = html.Labeller(weights).scores([x for x, _ in data])
    return float(np.concatenate([(s >= 0.5) == (y > 0) for s, (_, y) in zip(scores, data, strict=True)]).mean())


if __name__ == "__main__":
    found = train()
    print("held-out accuracy", accuracy(found))
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **found)
