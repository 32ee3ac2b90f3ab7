"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A scanner turns a page into leaf blocks, the stretches of text between block-level tags, each with its
ancestors' tags and class names. The field labels the sequence as content or not from features of ancestors
and text and from neighbouring labels; it is trained by maximum likelihood (forward-backward, AdaGrad) on
labelled pages and decoded by Viterbi. The labelled pages come from a generator of templates with a seed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigspark.llm.common import map_batches, small_batches

#: Labelled pages of the generator that the field is trained on, its seed, and passes over them.
TRAIN_PAGES, SEED, EPOCHS = 1200, 11, 7

#: Blocks of the training pages that a feature must hold for.
LEAST = 3

# HTML's element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = "script|style|template|noscript|title|textarea|select|svg|iframe|object|canvas|audio|video"
#: What can be in a head beside unseen elements: it ends before text and any other tag, also where its own end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta".split())
#: Start tags that close an open one: inside which an open tag of the second set ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

SECTIONS = frozenset("article aside dialog figure footer form header main nav section".split())

_ATTRS = r"""(?:"[^"<]*"|'[^'<]*'|[^'"<>])*+>"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<empty>svg)\b{_ATTRS}(?<=/>)|<(?P<unseen>{UNSEEN})\b{_ATTRS}.*?(?:</(?P=unseen)\s*>|(?=<body\b)|\Z)|</?(?P<tag>[a-z][a-z0-9:-]*){_ATTRS}|</?(?P<loose>[a-z][a-z0-9:-]*)[^<>]*>?|<[!?][^>]*>?", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")


@dataclass(eq=False, slots=True)
class Node:
    """An open element: what it adds to the features of its ancestors, so that a page's nodes take memory and time linear in the page."""

    tag: str
    names: tuple[str, ...]  # feature names of its tag and of the words in its class, id, role and itemprop
    added: tuple[str, ...]  # those that no ancestor has
    near: frozenset[str]  # words of the nearest element that has any, itself or an ancestor
    sections: tuple[str, ...]  # the two innermost sectioning elements, itself among them
    parent: Node | None


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None  # the innermost open element
    linked: int  # characters within links

    @property
    def tags(self) -> tuple[str, ...]:
        """Ancestors from the outside, the nearest last."""
        out, n = [], self.node
        while n:
            out.append(n.tag)
            n = n.parent
        return tuple(reversed(out))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page with text, in order; white space inside is one space."""
    out: list[Block] = []
    stack: list[Node] = []
    active: Counter[str] = Counter()  # names of the open elements
    opened: Counter[str] = Counter()  # and their tags
    text: list[str] = []
    linked = links = at = 0
    page = page or ""

    def end() -> None:
        nonlocal linked
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            if own:
                out.append(Block(own, stack[-1] if stack else None, linked))
            text.clear()
        linked = 0

    def push(tag: str, words: set[str]) -> None:
        up = stack[-1] if stack else None
        names = (f"in={tag}", *(f"hint={w}" for w in sorted(words)))
        added = tuple(n for n in names if not active[n])
        active.update(names)
        opened[tag] += 1
        sections = ((*up.sections, tag)[-2:] if tag in SECTIONS else up.sections) if up else ((tag,) if tag in SECTIONS else ())
        stack.append(Node(tag, names, added, frozenset(words) or (up.near if up else frozenset()), sections, up))

    def pop() -> str:
        node = stack.pop()
        active.subtract(node.names)
        opened[node.tag] -= 1
        return node.tag

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if stack and stack[-1].tag == "head" and text and text[-1].strip():
            pop()
        if m["unseen"] or m["empty"]:
            continue
        tag = (m["tag"] or m["loose"] or "").lower()
        if not tag:
            continue
        closing = page[m.start() + 1] == "/"
        if stack and stack[-1].tag == "head" and not closing and tag not in IN_HEAD:
            pop()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        end()
        links = 0
        if closing:
            while opened[tag] and pop() != tag:
                pass
            continue
        shut = CLOSES.get(tag)
        if stack and (shut and stack[-1].tag in shut or tag in PARAGRAPH_ENDS and stack[-1].tag == "p"):
            pop()
        if tag not in VOID and not page.startswith("/>", m.end() - 2):
            push(tag, {w for v in NAMES.findall(m[0]) for w in PARTS.findall("".join(v).lower())} if "=" in m[0] else set())
    if at < len(page):
        text.append(page[at:])
        if stack and stack[-1].tag == "head" and page[at:].strip():
            pop()
        if links:
            linked += len(page) - at
    end()
    return out


def _local(own: list[Block]) -> list[list[str]]:
    """Features of each block's text, of its place among the blocks, of its element and sections, and of its kin: the words of the blocks whose elements have the same parent, or are children of its grandparent."""
    out, n = [], len(own)
    words = [b.text.count(" ") + 1 for b in own]
    kin: Counter[int] = Counter()
    for b, w in zip(own, words, strict=True):
        kin[id(b.node.parent) if b.node else 0] += w
    most = max(kin.values(), default=0)
    for i, b in enumerate(own):
        size, last, node = len(b.text), b.text[-1], b.node
        tag, inner, up = (node.tag, node.sections, node.parent) if node else ("", (), None)
        near, far = kin[id(up) if node else 0], kin[id(up.parent)] if up and id(up.parent) in kin else 0
        f = ["bias", f"words={min(words[i], 64).bit_length()}", f"links={min(4, 5 * b.linked // size)}", f"end={last if last in '.!?:;,…' else 'w' if last.isalnum() else 'o'}"]
        f += [f"own={tag}", f"sections={'>'.join(inner)}", f"section={inner[-1] if inner else ''} own={tag}"]
        f += [f"kin={min(near, 1023).bit_length()}", f"far={min(far, 1023).bit_length()}", f"most={near == most}{far == most}", f"up={up.tag if up else ''} own={tag}"]
        if "©" in b.text or "|" in b.text or "»" in b.text or "·" in b.text:
            f.append("mark")
        if b.text.count(",") + b.text.count(".") >= 2:
            f.append("sentences")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


def features(own: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block: its local ones, those of all its ancestors, and of the nearest that has names."""
    out = _local(own)
    for f, b in zip(out, own, strict=True):
        node = b.node
        f += [f"near={w}" for w in sorted(node.near)] if node else []
        while node:
            f += node.added
            node = node.parent
    return out


@dataclass
class Field:
    """Weights: of features by label (0 not content, 1 content), and of transitions between labels."""

    names: dict[str, int]
    state: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2)

    def _up(self, node: Node | None, known: dict[int, tuple[float, float, float, float]]) -> tuple[float, float, float, float]:
        """A node's sums of weights, by label: of all names to the root, and of the nearest names; made once for each node from its parent's."""
        path, weights, names = [], self._pairs(), self.names
        while node and id(node) not in known:
            path.append(node)
            node = node.parent
        got = known[id(node)] if node else (0.0, 0.0, 0.0, 0.0)
        for n in reversed(path):
            u, v, p, q = got
            for x in n.added:
                if (k := names.get(x)) is not None:
                    u, v = u + weights[k][0], v + weights[k][1]
            if not n.parent or n.near is not n.parent.near:
                p = q = 0.0
                for w in n.near:
                    if (k := names.get(f"near={w}")) is not None:
                        p, q = p + weights[k][0], q + weights[k][1]
            got = known[id(n)] = u, v, p, q
        return got

    def emissions(self, own: list[Block]) -> list[tuple[float, float]]:
        """Sums of the weights of each block's features, by label."""
        weights, names, out = self._pairs(), self.names, []
        known: dict[int, tuple[float, float, float, float]] = {}
        for b, f in zip(own, _local(own), strict=True):
            u, v, p, q = self._up(b.node, known)
            u, v = u + p, v + q
            for x in f:
                if (k := names.get(x)) is not None:
                    u, v = u + weights[k][0], v + weights[k][1]
            out.append((u, v))
        return out

    def decode(self, own: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not own:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        back, a, b = [], 0.0, 0.0
        for i, (u, v) in enumerate(self.emissions(own)):
            if i:
                to0, to1 = b + s10 > a + s00, b + s11 > a + s01
                back.append((to0, to1))
                a, b = (b + s10 if to0 else a + s00) + u, (b + s11 if to1 else a + s01) + v
            else:
                a, b = u, v
        label, out = b > a, [b > a]
        for to in reversed(back):
            label = to[label]
            out.append(label)
        return out[::-1]

    def _pairs(self) -> list[tuple[float, float]]:
        if (kept := self.__dict__.get("_kept")) is None:
            kept = self.__dict__["_kept"] = list(map(tuple, self.state.tolist()))
        return kept


def fit(pages: list[tuple[list[Block], list[bool]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """A field of the greatest (penalised) likelihood of the pages' labels."""
    names: dict[str, int] = {}
    rows = []
    made = [(features(own), labels) for own, labels in pages]
    often = Counter(x for page, _ in made for f in page for x in f)
    for page, labels in made:
        ids = [np.array([names.setdefault(x, len(names)) for x in f if often[x] >= LEAST]) for f in page]
        if ids:
            rows.append((ids, np.array(labels, int)))
    state, step = np.zeros((len(names), 2)), np.zeros((2, 2))
    s2, t2 = np.full_like(state, 1e-6), np.full_like(step, 1e-6)
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, y = rows[r]
            n = len(y)
            emit = np.array([state[i].sum(0) for i in ids])
            fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
            fwd[0] = emit[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + step, axis=0) + emit[i]
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(step + (emit[i + 1] + bwd[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(fwd[-1])
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), y] -= 1
            g = decay * step
            if n > 1:
                joint = np.exp(fwd[:-1, :, None] + step + (emit[1:] + bwd[1:])[:, None, :] - z)
                np.add.at(joint, (np.arange(n - 1), y[:-1], y[1:]), -1)
                g = g + joint.sum(0)
            t2 += g * g
            step -= rate * g / np.sqrt(t2)
            flat = np.concatenate(ids)
            touched = np.unique(flat)
            grad = np.zeros((len(touched), 2))
            np.add.at(grad, np.searchsorted(touched, flat), np.repeat(p, [len(i) for i in ids], axis=0))
            grad += decay * state[touched]
            s2[touched] += grad * grad
            state[touched] -= rate * grad / np.sqrt(s2[touched])
    return Field(names, state, step)


# -- labelled pages ----------------------------------------------------------------------------------------


#: Element pairs that hold an article, and class words of what is not part of it, by family; the families in HELD are left
#: out of training where pages are made to measure how the field does on templates that it has not seen.
CONTAINERS = {"article": [("<article>", "</article>")] * 3, "post": [("<main><article class='post'>", "</article></main>")], "main": [("<main>", "</main>")], "content": [('<div class="content">', "</div>")], "plain": [("<div>", "</div>")], "none": [("", "")], "id": [('<div id="main">', "</div>"), ('<div id="story">', "</div>")], "section": [('<section class="entry">', "</section>"), ("<section>", "</section>")]}
NOTICES = {"advert": "ad|ads|advert|ad banner|sponsored|promo", "boxed": "ad|ads|advertisement|sponsored|promo|banner", "consent": "cookie-notice|cookie|gdpr consent|notice|cookie-banner|popup|modal", "aside": "sidebar|widget|related", "side": "sidebar|related|widget|recommended|side-bar|box|panel", "form": "search|newsletter|signup|login", "share": "share|social|tags|breadcrumb|pagination|newsletter|subscribe"}
HELD = frozenset({"id", "section", "boxed", "share"})


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED, held: bool | None = None) -> list[tuple[str, list[str]]]:
    """Pages of varied templates with the texts of their content blocks, in page order.

    Templates differ in the container of the article (with and without telling names), in what surrounds it
    and what is put inside it. Content has headings, paragraphs, lists, quotes, code and tables, short and long.
    held: only the families of HELD (true), only the others (false), or all.
    """
    containers = [k for k in CONTAINERS if held is None or (k in HELD) == held]
    notices = [k for k in NOTICES if held is None or (k in HELD) == held]
    rng = np.random.default_rng(seed)
    coin = lambda p: rng.random() < p
    pick = lambda x: x[int(rng.integers(len(x)))]
    parts = "an ber con de el for ge hi in ja ko lan mo ner or per qua ris sta tion un ver we xi yo zen é ü ñ".split()

    def word() -> str:
        return "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high + 1)))).capitalize()

    def sentence() -> str:
        s = words(1, 18)
        return s.replace(" ", ", ", 1) + pick("....!?") if coin(0.3) else s + pick("....!?")

    def prose() -> str:
        s = " ".join(sentence() for _ in range(int(rng.integers(1, 6))))
        if coin(0.12):  # noisy marks are content too
            s = " ".join(w + pick(["***", "%%%", "&&&", "###", "!!", ""]) for w in s.split())
        return s.upper() if coin(0.05) else s

    def page() -> tuple[str, list[str]]:
        kept: list[str] = []
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

        def text(tag: str, s: str) -> str:
            kept.append(" ".join(s.split()))
            mark = pick(["b", "i", "em", "strong", "span", "u"]) if coin(0.4) else ""
            body = f"<{mark}>{esc(s)}" + ("" if coin(0.3) else f"</{mark}>") if mark else esc(s)  # inline tags are left open at times
            open_ended = tag in ("p", "li") and coin(0.2)
            return f"<{tag}>{body}" + ("<br>" if coin(0.1) else "") + ("" if open_ended else f"</{tag}>")

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{i}">{esc(words(1, 3))}</a></li>' for i in range(k))

        def named(*names: str) -> str:
            if coin(0.2):
                return ""
            return f' {pick(["class", "id"])}="{pick(names)}"'

        few = lambda: int(rng.integers(2, 8))

        def heading() -> str:
            tag = pick(["h2", "h3", "h3", "h4"])
            return f"<{tag}>{words(1, 3)}</{tag}>" if coin(0.8) else f"<p>{words(1, 3)}</p>"

        def notice() -> str:
            kind = pick(notices)
            word_of = pick(NOTICES[kind].split("|")) if coin(0.9) else word()  # a name that tells nothing, at times
            inner = lambda: f"<p>{esc(prose())}</p>"
            side = lambda: (heading() if coin(0.6) else "") + pick([lambda: f"<ul>{links(few())}</ul>", lambda: esc(prose()), inner])()
            return {
                "advert": lambda: f'<div class="{word_of}">{esc(prose())}</div>',
                "boxed": lambda: f'<div class="{word_of}">{inner()}</div>',
                "consent": lambda: f'<div class="{word_of}">{inner()}<button>{word()}</button></div>',
                "aside": lambda: f"<aside{named(word_of)}>{side()}</aside>",
                "side": lambda: f"<div class=\"{word_of}\">{heading() if coin(0.6) else ''}{inner()}{f'<ul>{links(few())}</ul>' if coin(0.6) else ''}</div>",
                "form": lambda: f"<form{named(word_of)}><label>{words(1, 3)}</label><p>{esc(sentence())}</p><input name=q><button>{word()}</button></form>",
                "share": lambda: f'<div class="{word_of}">{esc(words(1, 6))} <a href=#>{word()}</a></div>',
            }[kind]()

        def comments() -> str:
            inner = "".join(f"<{t}{named('comment', 'reply')}><p>{esc(prose())}</p></{t}>" for t in [pick(["div", "li", "article"])] * few())
            tag = pick(["section", "div", "ol"])
            return f'<{tag} {pick(["class", "id"])}="{pick(["comments", "comment-list", "replies", "discussion", "respond", "comments-area"])}">{heading()}{inner}</{tag}>'

        def article() -> str:
            out = [text(pick(["h1", "h1", "h2"]), words(1, 12))] if coin(0.85) else []
            if out and a.startswith("<article") and coin(0.3):
                out = [f"<header>{out[0]}</header>"]
            if coin(0.15):
                out.append(notice())
            for _ in range(int(rng.integers(1, pick([3, 5, 12, 12])))):
                r = rng.random()
                if r < 0.7:
                    out.append(text("p", prose()))
                elif r < 0.76:
                    out.append(text("h2", words(1, 6)))
                elif r < 0.82:
                    out.append("<ul>" + "".join(text("li", pick([sentence, lambda: words(1, 5)])()) for _ in range(few())) + "</ul>")
                elif r < 0.86:
                    out.append("<blockquote>" + text("p", prose()) + "</blockquote>")
                elif r < 0.9:
                    out.append(text("pre", words(3, 20)))
                elif r < 0.94:
                    out.append("<table><tr>" + "".join(text("td", words(1, 3)) for _ in range(3)) + "</tr></table>")
                else:
                    out.append(notice())
            if coin(0.15):
                out.append(comments())
            if a.startswith("<article") and coin(0.1):
                out.append(f"<footer>{esc(words(2, 6))}</footer>")
            return "".join(out)

        code = lambda: "".join(pick(["if(a<b)", "x='</div>';", '"<p>"+y', ".c>.d{color:red}", f"#{word()}{{}}", "\n", "/* */"]) for _ in range(few()))
        unseen = lambda: pick([lambda: f"<style>{code()}</style>", lambda: f"<script>{code()}</script>", lambda: f"<!-- {words(1, 5)} -->", lambda: f"<noscript>{words(2, 6)}</noscript>", lambda: "<link rel=icon href=/i>", lambda: ""])()
        head = (pick(["<!doctype html>", ""]) + pick(["<html>", f'<html lang="{word()[:2]}">']) + f"<head>{unseen()}<title>{words(1, 8)}</title>{unseen()}{unseen()}" + pick(["</head><body>", "</head><body>", "<body>", "</head>"])) if coin(0.9) else ""
        top = [f"<nav{named('menu', 'navbar')}><ul>{links(few())}</ul></nav>"] if coin(0.8) else []
        if coin(0.4):
            top.insert(0, f"<header{named('header', 'masthead', 'top')}><p>{esc(words(1, 6))}</p><a href=/>{word()}</a></header>")
        if coin(0.15):
            top.append(f'<div class="{pick(["menu", "nav", "header", "navigation", "topbar"])}"><ul>{links(few())}</ul></div>')
        top += [notice() for _ in range(int(rng.integers(0, 3)))]
        if coin(0.4):
            top.append(unseen())
        a, b = pick([x for k in containers for x in CONTAINERS[k]])
        body = a + article() + b
        tail = [comments()] if coin(0.3) else []
        tail += [notice() for _ in range(int(rng.integers(0, 2)))]
        if coin(0.85):
            f = f"&copy; {word()}.{word()}.com &middot; {esc(prose())}" if coin(0.6) else esc(words(2, 12))
            tail.append(pick([f"<footer>{f}</footer>", f"<footer><p>{f}</p><ul>{links(few())}</ul></footer>", f'<div class="{pick(["footer", "site-footer", "copyright", "legal"])}">{f}</div>']))
        return head + "".join(top) + body + "".join(tail) + ("</body></html>" if coin(0.8) else ""), kept

    return [page() for _ in range(n)]


def labelled(page: str, kept: list[str]) -> tuple[list[Block], list[bool]]:
    """The page's blocks, each true if it is the next of the kept texts."""
    own, at, labels = blocks(page), 0, []
    for b in own:
        hit = at < len(kept) and b.text == kept[at]
        at += hit
        labels.append(hit)
    return own, labels


@lru_cache(1)
def trained() -> Field:
    return fit([labelled(*p) for p in labelled_pages()])


def main_text(page: str | None, crf: Field) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, keep in zip(own, crf.decode(own), strict=True) if keep)


def extract(pages: DataFrame, crf: Field | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, `text` string (empty if a page has none, or is null or empty) and `n_chars` long (code points).

    crf: a field from fit() (default: one trained on the generator's pages). Every row gives one, repeated ones too; no pages give no
    rows; other columns are not read, and `keep` must not name the results. No shuffle; the field's size is fixed, and a page
    takes time and memory linear in its length.
    """
    small_batches(pages.sparkSession)
    narrow = pages.select(*keep, html)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    sent = pages.sparkSession.sparkContext.broadcast(crf or trained())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, sent.value) for p in b[html].to_pylist()]
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return map_batches(narrow, run, schema)
