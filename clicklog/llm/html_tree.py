"""Trees of block elements of web pages, and their alignment with a reference tree by simple tree matching.

Everything here is a loop over the page or its nodes, without recursion and in about linear time, so that deep, long or
broken pages cost what their size says. Inline markup is part of a block's text, so it need not be closed. Tags and
attributes are read by HTML's rules: an unquoted value may hold quotes, what follows a quoted value starts another
attribute, ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text, and a tag or comment that the page never
closes goes on to its end.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from functools import lru_cache

# fixed values: element names of HTML
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "noembed", "noframes", "iframe", "template", "xmp"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "head", "html"} | RAW
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
NEVER = set("script style noscript template iframe head title nav footer aside button select textarea menu dialog svg canvas object embed".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tr": {"tr"}}
# fixed values: words of class, id, role and label that name what is not the article; adverts and reader comments are
# named so inside an article too
FOREIGN = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus replies".split())
ASIDE = set("banner promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot notice notices alert cookie cookies consent gdpr popup modal overlay reply discussion share sharing social related recommended newsletter subscribe signup login search widget toolbar pagination pager copyright legal complementary contentinfo".split())
#: Words that may follow the telling word of a name, and words by which a name tells of something else.
HOLDERS = set("area bar bars block blocks body bottom box boxes btn button buttons container column col feed form group holder icon icons inner item items label left link links list lists meta outer panel post posts region right row section sections slot small space stories thread top unit units wrap wrapper zone".split())
OTHERWISE = set("and below beside has no non not or under with without".split())
TITLED = {"article", "content", "entry", "main", "post", "story"}
HOLDING = {"article", "entry", "post", "story"}

#: Labels that a parent of the reference tree has this often are repeated parts: all of them are one slot.
REPEATED = 4
#: Bits of a node's flags: its name speaks against it (weakly, firmly), its tag does, it is within an article, it is an
#: article or main element, it is made to hold an article alone.
WEAK, FIRM, BARRED, WITHIN, ITSELF, HOLDER = 1, 2, 4, 8, 16, 32
#: Share of the page's varying text that makes an element the one with the article.
MOST = 0.9

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>="'<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'=<`]++))?+)*+)\s*+/?>""")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(["'])))?+)""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
_NUMBER = re.compile(r"&#(?:([0-9]++)|[xX]([0-9a-fA-F]++));?")
_WORD = re.compile(r"(?<![a-z0-9])[a-z]+")
_DIGITS = re.compile(r"\d+")
_MASK = (1 << 64) - 1


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@lru_cache(maxsize=1 << 16)
def _label_hash(label: str) -> int:
    return text_hash(label)


def joint(a: int, b: int) -> int:
    """A 64-bit hash of two."""
    x = (a * 0x9E3779B97F4A7C15 + b + 0x632BE59BD9B4E019) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    return x ^ (x >> 29)


def decoded(text: str) -> str:
    """Character references as characters; numbers of any length are read."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _NUMBER.sub(_short, text)
    return entities.unescape(text)


def _short(m: re.Match) -> str:
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"


def telling(name: str) -> int:
    """WEAK or FIRM if a class, id, role or label calls its element something that is not the article, else 0."""
    found = _WORD.findall(name)
    if not found or OTHERWISE.intersection(found):
        return 0
    while len(found) > 1 and found[-1] in HOLDERS:
        found.pop()
    if found[-1] in FOREIGN:
        return FIRM
    return WEAK if found[-1] in ASIDE and not (found[-1] == "header" and TITLED.intersection(found)) else 0


class Page:
    """A page's block elements in page order (0 is the root) and its blocks of text, ``(node, text)``."""

    def __init__(self, page: str):
        self.parent, self.label, self.flags, self.blocks = [0], [""], [HOLDER], []
        self._read(page)

    def _attributes(self, page: str, at: int) -> tuple[dict[str, str], int]:
        """Attributes of a tag from ``at``, and where the tag ends."""
        found: dict[str, str] = {}
        while m := _ATTRIBUTE.match(page, at):
            at = m.end()
            if m[1]:
                return found, at
            if m[6]:
                break
            found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
        return found, len(page)

    def _add(self, tag: str, names: dict[str, str], parent: int, outer: str) -> int:
        above = self.flags[parent]
        said = 0
        if tag not in ("html", "body"):
            for k in ("class", "id", "role", "aria-label"):
                if v := names.get(k, "").lower():
                    said |= max(map(telling, [v] if k == "aria-label" else v.split()), default=0)
        first = names.get("class", "").lower().split()[:1]
        itself = tag in ("article", "main")
        if itself:
            said &= FIRM
        elif tag == "form":
            said = FIRM
        flags = (said & FIRM or said) | above & (BARRED | WITHIN)
        if tag in NEVER or tag == "header" and not above & WITHIN:
            flags |= BARRED
        if itself and not said:
            flags |= ITSELF | WITHIN
        if tag == "article" or first and tag not in LEAVES and HOLDING.intersection(_WORD.findall(first[0])):
            flags |= HOLDER
        self.parent.append(parent)
        self.label.append(tag + "." + _DIGITS.sub("0", first[0]) if first else tag)
        self.flags.append(flags)
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack, tags, is_open, run = [0], [""], {}, []

        def border() -> None:
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    if tags[-1] == "head":  # text ends a head that was not closed
                        pop()
                    self.blocks.append((stack[-1], text))

        def pop() -> None:
            stack.pop()
            is_open[tags.pop()] -= 1

        start = at = 0
        while (lt := page.find("<", at)) >= 0:
            names, m = None, _TAG.match(page, lt)
            if m is not None:
                end, rest = m.end(), m[3]
            elif (m := _OPEN.match(page, lt)) is not None:
                names, end = self._attributes(page, m.end())
                rest = ""
            else:
                kind = page[lt + 1 : lt + 2]
                if kind not in ("!", "?", "/") or kind == "/" and lt + 2 >= len(page):
                    at = lt + 1
                    continue
                if page.startswith("<!--", lt):
                    closed = _COMMENT_END.search(page, lt + 2)
                    end = closed.end() if closed else len(page)
                else:
                    end = page.find(">", lt) + 1 or len(page)
            if lt > start:
                run.append(decoded(page[start:lt]))
            start = at = end
            if m is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE and is_open.get(tag):
                    border()
                    while is_open[tag] and tags[-1] != tag:
                        pop()
                    if is_open[tag]:
                        pop()
                continue
            if tags[-1] == "head" and tag not in IN_HEAD:
                border()
                if tags[-1] == "head":
                    pop()
            if tag in INLINE:
                if tag == "br":
                    run.append(" ")
                continue
            if tag in RAW:
                closed = _RAW_END[tag].search(page, at)
                start = at = closed.end() if closed else len(page)
                continue
            border()
            if tags[-1] == "p" and (tag in CLOSES_P or tag in SAME):
                pop()
            if tag == "tr" and tags[-1] in ("td", "th"):
                pop()
            if tags[-1] in SAME.get(tag, ()):
                pop()
            if names is None:
                names = self._attributes(rest + ">", 0)[0] if rest else {}
            node = self._add(tag, names, stack[-1], tags[-1])
            if tag not in VOID:
                stack.append(node)
                tags.append(tag)
                is_open[tag] = is_open.get(tag, 0) + 1
        if start < len(page):
            run.append(decoded(page[start:]))
        border()

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for n in range(1, len(self.parent)):
            out[self.parent[n]].append(n)
        return out


class Reference:
    """The reference tree: ``label``, ``below`` (children) and ``many`` (a repeated part) of each node."""

    def __init__(self, written: str):
        self.label, self.below, self.many = [], [], []
        stack: list[int] = []
        for line in written.split("\n"):
            level, many, label = line.split(" ", 2)
            node = len(self.label)
            self.label.append(label)
            self.below.append([])
            self.many.append(many == "*")
            del stack[int(level) :]
            if stack:
                self.below[stack[-1]].append(node)
            stack.append(node)

    @staticmethod
    def written(page: Page) -> str:
        """A page's tree in page order, a line (level, whether repeated, label) for each node; of repeated parts the first."""
        below, lines, todo = page.children(), [], [(0, 0, ".")]
        while todo:
            node, level, many = todo.pop()
            lines.append(f"{level} {many} {page.label[node]}")
            times: dict[str, int] = {}
            for c in below[node]:
                times[page.label[c]] = times.get(page.label[c], 0) + 1
            kept, seen = [], set()
            for c in below[node]:
                label = page.label[c]
                if times[label] < REPEATED:
                    kept.append((c, level + 1, "."))
                elif label not in seen:
                    seen.add(label)
                    kept.append((c, level + 1, "*"))
            todo += reversed(kept)
        return "\n".join(lines)


def heaviest(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of ``(i, j, weight)`` with positive weights, a chain ascending in i and j of the greatest weight in all."""
    ends_j: list[int] = []  # of the best chains, ascending in j and in weight
    ends: list[tuple[int, int]] = []  # (weight, pair)
    back: list[int] = []
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][1]))
    came = [-1] * len(pairs)
    for k in order:
        _, j, w = pairs[k]
        at = bisect_left(ends_j, j)
        if at:
            w += ends[at - 1][0]
            came[k] = ends[at - 1][1]
        last = at
        while last < len(ends) and ends[last][0] <= w:
            last += 1
        if last == at and at < len(ends) and ends_j[at] == j:
            continue  # a better chain ends there
        ends_j[at:last], ends[at:last] = [j], [(w, k)]
    k = ends[-1][1] if ends else -1
    while k >= 0:
        back.append(k)
        k = came[k]
    return [pairs[k][:2] for k in reversed(back)]


def align(page: Page, tree: Reference) -> list[int]:
    """A slot for each node of the page, by simple tree matching with the reference tree.

    Nodes match when their labels do; of the matchings that keep the children's order the one of most nodes is taken.
    Repeated parts match by their label alone, all of them. A node without a match has the slot of its label under
    its parent's. Equal subtrees are matched once.
    """
    below, n = page.children(), len(page.parent)
    kinds: dict[tuple, int] = {}
    kind, example, height = [0] * n, [], []
    for x in range(n - 1, -1, -1):
        key = page.label[x], *(kind[c] for c in below[x])
        if key not in kinds:
            kinds[key] = len(kinds)
            example.append(x)
            height.append(1 + max((height[kind[c]] for c in below[x]), default=0))
        kind[x] = kinds[key]

    by_label = [{} for _ in tree.label]
    for y, under in enumerate(tree.below):
        for j, q in enumerate(under):
            by_label[y].setdefault(tree.label[q], []).append((j, q))
    todo, size = [(kind[0], 0)], {}
    found = {todo[0]}
    for a, y in todo:
        for c in below[example[a]]:
            for _, q in by_label[y].get(page.label[c], ()):
                if (kind[c], q) not in found:
                    found.add((kind[c], q))
                    todo.append((kind[c], q))
    matched: dict[tuple[int, int], dict[int, int]] = {}
    for a, y in sorted(todo, key=lambda p: height[p[0]]):
        pairs, total, where = [], 1, {}
        for i, c in enumerate(below[example[a]]):
            for j, q in by_label[y].get(page.label[c], ()):
                weight = size[kind[c], q]
                if tree.many[q]:
                    where[i] = q
                    total += weight
                else:
                    pairs.append((i, j, weight))
        weights = {(i, j): w for i, j, w in pairs}
        for i, j in heaviest(pairs):
            where[i] = tree.below[y][j]
            total += weights[i, j]
        size[a, y], matched[a, y] = total, where

    slot, of = [0] * n, [-1] * n
    of[0] = 0
    for x in range(n):
        where = matched[kind[x], of[x]] if of[x] >= 0 else {}
        for i, c in enumerate(below[x]):
            if i in where:
                of[c] = where[i]
                slot[c] = joint(1, where[i])
            else:
                slot[c] = joint(slot[x], _label_hash(page.label[c]))
    return slot


def paths(page: Page) -> list[int]:
    """A hash of the labels from the root to each node."""
    out = [0] * len(page.parent)
    for n in range(1, len(out)):
        out[n] = joint(out[page.parent[n]], _label_hash(page.label[n]))
    return out


def article(parent: list[int], flags: list[int], at: list[int], sizes: list[int], fixed: list[bool]) -> list[bool]:
    """Which blocks (of the nodes ``at``, with ``sizes`` characters) are the article's; ``fixed`` ones are in template slots.

    What varies finds the article. A fixed block is the article's if it is inside it: headings and lines that a host's
    articles have in common are text of each.

    Names speak against an element, but not if it has MOST of the page's varying text, nor if it is around the only
    article or main element with text. Inside the page's article, which is the last element in page order that is made
    to hold one and has MOST of the varying text that no name speaks against, only firm names count.
    """
    n = len(parent)
    own = [0] * n
    for node, size, same in zip(at, sizes, fixed, strict=True):
        own[node] += 0 if same else size
    total, holds = own.copy(), [False] * n
    for x in range(n - 1, 0, -1):
        holds[x] = holds[x] or bool(flags[x] & ITSELF and total[x])
        total[parent[x]] += total[x]
        holds[parent[x]] = holds[parent[x]] or holds[x]
    named, free = [False] * n, False
    for x in range(1, n):
        named[x] = named[parent[x]] or bool(flags[x] & (WEAK | FIRM))
        free = free or bool(own[x] and flags[x] & WITHIN) and not named[x]
    against, spoken, plain = [False] * n, [False] * n, own.copy()
    for x in range(1, n):
        against[x] = bool(flags[x] & (WEAK | FIRM)) and not (total[x] >= MOST * total[0] or holds[x] and not free)
        spoken[x] = spoken[parent[x]] or against[x]
        if spoken[x]:
            plain[x] = 0
    for x in range(n - 1, 0, -1):
        plain[parent[x]] += plain[x]
    place = max((x for x in range(1, n) if flags[x] & HOLDER and plain[x] >= MOST * plain[0] > 0), default=-1)
    inside, out = [False] * n, [False] * n
    for x in range(1, n):
        inside[x] = x == place or inside[parent[x]]
        out[x] = out[parent[x]] or against[x] and not (inside[x] and not flags[x] & FIRM)
    return [not out[node] and (inside[node] or not same) for node, same in zip(at, fixed, strict=True)]
