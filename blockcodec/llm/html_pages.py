"""Generated web pages to train the extraction on: data-mark="1" is main text."""

from __future__ import annotations

import random

SYLLABLES = "an ar be con de el en er es est in ing ion is la le men na ne no on or ou pa per ra re ri ro sa se si so st ta te ti to tra un ver vi".split()
NOISE = ("", "", "", "", "%%%", "***", "###", "$$$", "&amp;&amp;", " |", "!!")


def training_pages(n: int, seed: int):
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(r, n, noise=""):
    out = []
    for _ in range(n):
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(w + (noise if r.random() < 0.9 else ""))
    return out


def _sentences(r, n, noise=""):
    out = []
    for _ in range(n):
        w = _words(r, r.randint(1, 18), noise)
        out.append(" ".join(w).capitalize() + r.choice(".....!?"))
    return " ".join(out)


def _names(r, names, chance=0.75):
    if r.random() > chance:
        return ""
    name = r.choice(names) + r.choice(("", "", "-wrap", "-box", " block", "_inner", "-1"))
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def _links(r, n):
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _words(r, n))


def _nav(r):
    tag = r.choice(("nav", "nav", "div", "ul", "section"))
    names = ("menu", "nav", "navbar", "navigation", "breadcrumb", "topbar")
    return f'<{tag}{_names(r, names, 0.4 if tag == "nav" else 1)} data-mark="0">' + (_links(r, r.randint(2, 9)) if tag == "ul" else f"<ul>{_links(r, r.randint(2, 9))}</ul>") + f"</{tag}>"


def _side(r, kind):
    tags, names = {
        "header": (("header", "header", "div"), ("header", "masthead", "site-header", "banner")),
        "footer": (("footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal")),
        "aside": (("aside", "aside", "div", "section"), ("sidebar", "related", "widget", "side-rail", "recommended", "promo")),
        "ad": (("div", "div", "aside", "section", "p"), ("ad", "ads", "advert", "sponsored", "promo", "adsense", "banner")),
        "notice": (("div", "section", "p", "dialog"), ("cookie-notice", "notice", "consent", "alert", "gdpr", "newsletter", "popup")),
        "form": (("form",), ("search", "login", "subscribe", "signup", "comment-form")),
        "comments": (("section", "div", "ol", "aside"), ("comments", "discussion", "replies", "comment-list", "disqus")),
        "share": (("div", "ul"), ("share", "social", "tags", "pager", "pagination")),
    }[kind]
    tag = r.choice(tags)
    bare = tag in ("header", "footer", "aside", "form")
    open_ = f'<{tag}{_names(r, names, 0.5 if bare else 1)} data-mark="0">'
    if kind == "form":
        body = f"<label>{' '.join(_words(r, 2))}</label><input name=q>" + (f"<p>{_sentences(r, 1)}</p>" if r.random() < 0.5 else "") + f"<button>{' '.join(_words(r, 1))}</button>"
    elif kind == "comments":
        each = r.choice(("div", "li", "article", "p")) if tag != "ol" else "li"
        body = f"<h3>{' '.join(_words(r, 2))}</h3>" * (tag != "ol") + "".join(f'<{each}{_names(r, ("comment", "reply"), 0.7)}><b>{_words(r, 1)[0]}</b> ' + (f"<p>{_sentences(r, r.randint(1, 4))}</p>" if each != "p" else _sentences(r, 2)) + f"</{each}>" for _ in range(r.randint(1, 5)))
    elif kind == "share":
        body = _links(r, r.randint(2, 5)) if tag == "ul" else "".join(f'<a href="#">{w}</a> ' for w in _words(r, 4))
    elif kind == "footer":
        body = f"&copy; {r.choice(('example.com', 'site.example.org'))} &middot; {_sentences(r, r.randint(1, 3))}" + (_nav(r) if r.random() < 0.3 else "")
        body = f"<p>{body}</p>" if r.random() < 0.4 else body
    elif kind == "header":
        body = (f"<h1>{' '.join(_words(r, 3))}</h1>" if r.random() < 0.4 else f"<div>{' '.join(_words(r, 2))}</div>") + (_nav(r) if r.random() < 0.6 else "") + (f"<p>{_sentences(r, 1)}</p>" if r.random() < 0.3 else "")
    elif kind == "aside":
        body = f"<h3>{' '.join(_words(r, 2))}</h3>" + (f"<ul>{_links(r, r.randint(2, 6))}</ul>" if r.random() < 0.6 else f"<p>{_sentences(r, r.randint(1, 4))}</p>")
    else:
        body = _sentences(r, r.randint(1, 3))
        body = f"<p>{body}</p>" if tag not in ("p",) and r.random() < 0.5 else body
    return open_ + body + f"</{tag}>"


def _article(r):
    noise = r.choice(NOISE)
    long_ = r.random() < 0.7
    out = [f"<h1>{' '.join(_words(r, r.randint(2, 9), noise))}</h1>"] if r.random() < 0.85 else []
    if r.random() < 0.15:
        out.append(f"<p><i>{' '.join(_words(r, 3))}</i></p>")
    for _ in range(r.randint(2, 16) if long_ else r.randint(1, 2)):
        kind = r.random()
        text = _sentences(r, r.randint(1, 8) if r.random() < 0.8 else 1, noise)
        if kind < 0.72:
            out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}")
        elif kind < 0.82:
            out.append(f"<p><b>{text}<br><p>{_sentences(r, 2, noise)}</p>")
        elif kind < 0.88:
            out.append(f"<h2>{' '.join(_words(r, 4, noise))}</h2>")
        elif kind < 0.92:
            out.append("<ul>" + "".join(f"<li>{_sentences(r, 1, noise)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.95:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.97:
            out.append(f"<pre>{text}</pre>")
        else:
            out.append("<table>" + "".join(f"<tr><td>{_words(r, 1)[0]}</td><td>{' '.join(_words(r, 2))}</td></tr>" for _ in range(3)) + "</table>")
    for kind in ("ad", "share", "aside", "form", "comments", "notice"):
        if r.random() < 0.12:
            out.insert(r.randint(1, len(out)), _side(r, kind))
    return "".join(out)


def _page(r):
    tag = r.choice(("article", "article", "article", "main", "div", "section", "div"))
    names = ("content", "article", "post", "entry", "story", "main-text", "article-body", "page")
    body = f'<{tag}{_names(r, names, 0.3 if tag in ("article", "main") else 0.9)} data-mark="1">{_article(r)}</{tag}>'
    for _ in range(r.choice((0, 0, 1, 2))):
        wrap = r.choice(("div", "main", "section", "div"))
        inside = [body] + [_side(r, k) for k in ("aside", "ad", "comments", "share", "notice") if r.random() < 0.25]
        if r.random() < 0.3:
            r.shuffle(inside)
        body = f'<{wrap}{_names(r, ("wrapper", "container", "content", "layout", "row", "site", "page"), 0.7)}>' + "".join(inside) + f"</{wrap}>"
    before = [p for p, c in ((_nav(r), 0.7), (_side(r, "header"), 0.5), (_side(r, "notice"), 0.3), (_side(r, "ad"), 0.5), (_side(r, "form"), 0.2)) if r.random() < c]
    after = [p for p, c in ((_side(r, "comments"), 0.3), (_side(r, "aside"), 0.35), (_side(r, "ad"), 0.2), (_side(r, "form"), 0.15), (_side(r, "footer"), 0.8), (_side(r, "notice"), 0.15), (_nav(r), 0.15)) if r.random() < c]
    title = " ".join(_words(r, 4))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>' + "".join(before) + body + "".join(after) + ("</body></html>" if r.random() < 0.8 else "")
