"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens: tags with the path of the elements they stand in, and text segments with their path. Over all
pages of a host, tokens with the same occurrence vector (how often in which page) form a class; vectors are compared by sums
over pages of two 32-bit hashes, so they are aggregated without gathering a host's pages, and repeated pages add up. A class is
valid if it is large and frequent: CLASS_SIZE tokens in CLASS_PAGES pages at least. The class that occurs once in every page is
the root of the host's template; classes in every page that occur several times, and optional ones in NESTED_SHARE of the pages
at least, nest in it. A class's tokens are ordered by where they stand first, on average over the host's pages.

A page is parsed against its host's template: an occurrence of a class takes the class's tokens in their order, occurrences of
other classes lie wholly inside, and one that does not come to its end is none. The tokens of whole occurrences are the
template's in this page; the gaps between them are its slots, and what a page has there is its own.

Slots are judged by host, not by name. What a page has in the template's elements is summed over the host's pages: text outside
links, text inside links, and how many different texts there are. From the whole page down, the element of the root (these stand
once in every page) that holds HOLDS of what is around it (text outside links, times the share of different texts) is entered,
unless that would leave a heading (h1) outside, as a heading belongs to its text. Where this ends is the content: its slots are
the page's text, but for elements inside it that are mostly links, or say the same on nearly all pages where the content varies,
and for the template's own elements that a role, class name or id calls furniture (comments, say; what the article itself calls its
parts decides nothing).
The template's own text segments in it are furniture as whole blocks, unless these are over half of the text (copies of one
article on many of a host's pages). HTML's own elements for what is no text (nav, aside, form, script, ...) go inside it too.

Hosts with fewer than CLASS_PAGES pages have no template, and a page that does not keep to its host's goes by paths alone: text
is taken if no element that holds it is furniture by its element, role, class name or id, inside article and main where there are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches, stash

CLASS_SIZE, CLASS_PAGES, NESTED_SHARE = 3, 5, 0.3
#: Share of what is around an element from which it is entered; share of links from which an element is a menu; shares of different
#: texts up to which an element says the same everywhere, and from which the content varies.
HOLDS, LINKS, SAME, VARIED = 0.5, 0.5, 0.1, 0.5
#: Different tokens that a task counts before it hands the counts on.
COUNTED = 100_000

# fixed values: elements by what they mean
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe select".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics svg g tspan".split()
)
_FURNITURE = frozenset("nav footer aside form button dialog menu script style noscript template iframe select textarea title head".split())
_NO_TEXT = frozenset("script style noscript template iframe select textarea title head".split())
_MAIN = frozenset(("article", "main"))
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# fixed values: parts of class names and ids that name furniture, and parts that stand beside them without changing that
_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay sidebar side rail related recommended share sharing "
    "social subscribe newsletter signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead footer copyright comment comments commentlist reply replies "
    "respond disqus widget".split()
)
_BESIDE = frozenset(
    "site main page top bottom left right primary secondary global inner outer list item items box block wrap wrapper container section area group row col column bar panel link links button "
    "buttons btn icon icons count title heading text content body info warning success danger slot unit message post posts article articles stories network media header sticky fixed mobile "
    "desktop js is has form thread".split()
)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])|[^\W\d_]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


@lru_cache(10_000)
def names_furniture(value: str) -> bool:
    """Whether one of the names says furniture: all its parts do, or stand beside such (cookie-notice, related-posts), while
    share-price or side-effects say something else."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if any(p in _NAMES for p in parts) and all(p in _NAMES or p in _BESIDE or len(p) == 1 for p in parts):
            return True
    return False


class Step(NamedTuple):
    """A token of a page: kind is open, close or text; path stands for the open elements (a hash of their names and classes,
    made from the one above, so that deep pages cost no more)."""

    kind: str
    name: str
    path: int
    text: str
    furniture: bool
    main: bool
    block: bool
    depth: int
    named: bool = False


@lru_cache(200_000)
def _path(path: int, label: str) -> int:
    """The path below, a hash; a host's pages have the same ones over and over."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}/{label}".encode("utf-8", "surrogatepass"))


def walk(page: str, names: bool = True, elements: bool = True) -> Iterator[Step]:
    """Tags and text segments in page order, from tags that need not be closed or nested well. names: furniture goes by roles, class
    names and ids too, and headers outside the main text are furniture; elements: it goes by elements."""
    stack: list[tuple[str, int, bool, bool]] = []  # name, path, furniture, main
    path = 0
    at, size = 0, len(page)

    def state() -> tuple[bool, bool]:
        return stack[-1][2:] if stack else (False, False)

    def below(label: str) -> int:
        return _path(path, label)

    while at < size:
        lt = page.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at:
            yield Step("text", "", path, page[at:lt], *state(), False, len(stack))
        if lt == size:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, lt)
        if not tag:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":  # a tag that does not end
                end = page.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            else:
                yield Step("text", "", path, "<", *state(), False, len(stack))
                at = lt + 1
            continue
        at = tag.end()
        closing, name, rest = tag[1], tag[2].lower(), tag[3]
        block = name not in _INLINE
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            yield Step("close", name, path, "", *state(), block, len(stack))
            # an inline end does not close the blocks around it
            if depth is not None and (block or all(x[0] in _INLINE for x in stack[depth + 1 :])):
                del stack[depth:]
                path = stack[-1][1] if stack else 0
            continue
        ends = ("p",) if name in _ENDS_P else _SAME.get(name, ())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    path = stack[-1][1] if stack else 0
                    break
                if stack[i][0] not in _INLINE and stack[i][0] not in ends:
                    break
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        label = f"{name}.{given['class']}" if given.get("class") else name
        furniture, main = state()
        furniture = furniture or elements and name in _FURNITURE or name in _NO_TEXT
        named = False
        if given:
            named = given.get("role", "").lower() in _ROLES or given.get("aria-hidden", "") == "true"
            named = named or any(names_furniture(given[k]) for k in ("class", "id") if given.get(k)) and name not in ("html", "body", "article", "main")
            main = main or given.get("role", "").lower() == "main"
        furniture = furniture or names and (named or name == "header" and not main)
        main = main or name in _MAIN
        yield Step("open", name, path, label, furniture, main, block, len(stack), named)
        if name in _VOID or rest.endswith("/"):
            continue
        if name in _RAW:  # up to its end tag nothing is markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
                yield Step("close", name, below(label), "", True, main, block, len(stack) + 1)
                continue
            if name in ("script", "style"):
                return
        path = below(label)
        stack.append((name, path, furniture, main))


def token(step: Step) -> str | None:
    """What a step counts as: tags and text segments (white space apart) with their path."""
    if step.kind == "text":
        text = " ".join(step.text.split())
        return f"{step.path}|{text}" if text else None
    return f"{step.path}|{step.kind}:{step.text or step.name}"


def _hash(text: str, is_text: bool) -> int:
    """64 bits; the last one says whether it is a text segment's."""
    import xxhash

    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)) & -2 | is_text


@lru_cache(200_000)
def _tag_hash(path: int, kind: str, label: str) -> int:
    return _hash(f"{path}|{kind}:{label}", False)


def token_hash(step: Step) -> int | None:
    if step.kind != "text":
        return _tag_hash(step.path, step.kind, step.text or step.name)
    text = token(step)
    return None if text is None else _hash(text, True)


class Slot(NamedTuple):
    """What the host's pages have in an element of the template, without what is in others inside it: pages, different texts,
    characters outside and inside links, and whether any stands in a heading. Element 0 is the whole page."""

    element: int
    above: int
    pages: int
    different: int
    free: int
    linked: int
    heading: bool


class Template:
    """A host's classes with their tokens in order, and which element of the root is the content."""

    def __init__(self, rows: list[tuple[int, int, int]], root: int | None = None, slots: list[Slot] | None = None):
        """rows: class, how far from the page's start, token; root: the class of the tokens that are once in every page."""
        self.place: dict[int, tuple[int, int]] = {}
        self.size: dict[int, int] = {}
        self.root = root
        for cls, _, own in sorted(rows):
            self.place[own] = cls, self.size.get(cls, 0)
            self.size[cls] = self.size.get(cls, 0) + 1
        self.has_texts = any(own & 1 for own in self.place)
        self.content, self.dropped, self.outside = _judged(slots or [], frozenset(t for t, (c, _) in self.place.items() if c == root))

    def __bool__(self) -> bool:
        return bool(self.place)

    def tokens(self, steps: list[Step]) -> list[int | None]:
        """The steps' tokens; those of text segments only where the template has any."""
        return [None if s.kind == "text" and not self.has_texts else token_hash(s) for s in steps]

    def parse(self, tokens: list[int | None]) -> list[bool]:
        """Which of a page's tokens are the template's: those of whole occurrences, in order and nested."""
        known = [False] * len(tokens)
        stack: list[tuple[int, list[int]]] = []  # class, places in the page
        at: dict[int, list[int]] = {}  # class -> where it stands in the stack
        last: list[int] = []  # of each occurrence the last place taken
        for i, own in enumerate(tokens):
            if own not in self.place:
                continue
            cls, place = self.place[own]
            if place == 0:
                at.setdefault(cls, []).append(len(stack))
                stack.append((cls, [i]))
                last.append(0)
            elif at.get(cls) and last[at[cls][-1]] < place:
                depth = at[cls][-1]
                while len(stack) > depth + 1:  # what has begun inside has not come to its end
                    at[stack.pop()[0]].pop()
                    last.pop()
                stack[-1][1].append(i)
                last[-1] = place
            else:
                continue
            if place == self.size[cls] - 1:
                for k in stack.pop()[1]:
                    known[k] = True
                at[cls].pop()
                last.pop()
        return known


def _judged(slots: list[Slot], root: frozenset[int]) -> tuple[int, frozenset[int], frozenset[int]]:
    """The content's element (0: the whole page), elements inside it that are not content, and the content and what holds it."""
    own = {s.element: s for s in slots}
    for s in slots:
        if s.above not in own:
            own[s.above] = Slot(s.above, 0, 0, 0, 0, 0, False)
    below: dict[int, list[int]] = {}
    for e, s in own.items():
        if e:
            below.setdefault(s.above, []).append(e)
    order, todo = [], [0]
    while todo:
        order.append(todo.pop())
        todo += below.get(order[-1], ())
    mass, free, linked, heading = ({} for _ in range(4))
    for e in reversed(order):
        s = own.get(e, Slot(e, 0, 0, 0, 0, 0, False))
        for held, x in ((mass, s.free * s.different / max(s.pages, 1)), (free, s.free), (linked, s.linked), (heading, s.heading)):
            held[e] = x + sum(held[c] for c in below.get(e, ()))
    now, around = 0, set()
    while inner := [e for e in below.get(now, ()) if e in root]:
        best = max(inner, key=lambda e: (mass[e], e))
        if not mass[best] or mass[best] < HOLDS * mass[now] or heading[now] > heading[best]:
            break
        now = best
        around.add(now)
    if now == 0:
        return 0, frozenset(), frozenset()
    varied = lambda e: own[e].different / max(own[e].pages, 1)
    content_varies = max((varied(e) for e in (now, *below.get(now, ())) if own[e].pages), default=0) >= VARIED
    out, todo = set(), list(below.get(now, ()))
    for e in todo:
        todo += below.get(e, ())
        if linked[e] and linked[e] >= LINKS * (linked[e] + free[e]) or content_varies and own[e].pages >= CLASS_PAGES and varied(e) <= SAME:
            out.add(e)
    return now, frozenset(out), frozenset(around)


class _Inside:
    """Which of the template's elements, from outside in, hold each step of a page, and whether one of the template's elements that is
    named furniture does."""

    def __init__(self, template: Template, names: bool):
        self.template, self.names, self.held, self.called = template, names, [], []

    def at(self, step: Step, own: int | None, known: bool) -> tuple[list[tuple[int, int]], bool]:
        """For a text segment; others only move on."""
        depth, held, called = step.depth, self.held, self.called
        while held and held[-1][0] >= depth:
            held.pop()
        while called and called[-1][0] >= depth:
            called.pop()
        if known and step.kind == "open" and step.name not in _VOID:
            # the content itself, and what holds it, may have any name
            if self.names and step.named and (any(e == self.template.content for _, e in held) or own not in self.template.outside):
                called.append((depth, own))
            held.append((depth, own))
        return held, bool(called)


NO_TEMPLATE = Template([])


def extract(page: str | None, template: Template = NO_TEMPLATE, elements: bool = True, names: bool = True) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    page = page or ""
    if template:
        steps = list(walk(page, False, elements))
        tokens = template.tokens(steps)
        known = template.parse(tokens)
        if template.content == 0 or any(k and t == template.content for k, t in zip(known, tokens, strict=True)):
            inside = _Inside(template, names)
            wanted = []
            for step, own, is_known in zip(steps, tokens, known, strict=True):
                held, called = inside.at(step, own, is_known)
                if step.kind != "text" or called:
                    wanted.append(False)
                    continue
                elements_ = [e for _, e in held]
                wanted.append((not template.content or template.content in elements_) and not (template.dropped and template.dropped.intersection(elements_)))
            blocks = _slot_blocks(steps, known, wanted)
            return "\n\n".join(blocks)
    return "\n\n".join(_blocks(list(walk(page, names, elements))))


def _slot_blocks(steps: list[Step], known: list[bool], wanted: list[bool]) -> list[str]:
    """Blocks of the wanted steps; without those that are the template's as a whole, unless they are over half of the text."""
    piece: list[str] = []
    blocks: list[tuple[str, bool]] = []
    own = False  # whether a segment of the piece is not the template's

    def flush() -> None:
        nonlocal own
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            blocks.append((text, own))
        own = False

    for step, is_known, is_wanted in zip(steps, known, wanted, strict=True):
        if step.kind != "text":
            if step.name == "br":
                piece.append(" ")
            elif step.block:
                flush()
        elif is_wanted and not step.furniture:
            piece.append(step.text)
            own = own or not is_known and not step.text.isspace()
    flush()
    kept = [text for text, own in blocks if own]
    return [text for text, _ in blocks] if 2 * sum(map(len, kept)) < sum(len(text) for text, _ in blocks) else kept


def _blocks(steps: list[Step]) -> list[str]:
    """Blocks by paths alone: inside article and main, if there are."""
    pages_main = any(s.main and not s.furniture for s in steps if s.kind == "open")
    return _slot_blocks(steps, [False] * len(steps), [s.main or not pages_main for s in steps])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task's pages: for each host and token its pages, occurrences, where it stands first, and the vector's
    hashes. A page counts by its content, so pages without an id are told apart."""
    import xxhash

    held: dict[tuple[str, int], list[int]] = {}
    low = (1 << 32) - 1

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(held), 20_000):
            own = list(held.items())[lo : lo + 20_000]
            columns = [pa.array([k[0] for k, _ in own], pa.string()), pa.array([k[1] for k, _ in own], pa.int64())]
            columns += [pa.array([v[i] for _, v in own], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, _COUNTED)
        held.clear()

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = page.as_py() or ""
            seed = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))
            times: dict[int, list[int]] = {0: [1, 0]}  # token 0 counts the host's pages
            for i, step in enumerate(walk(page)):
                h = token_hash(step)
                if h is not None:
                    times.setdefault(h, [0, i])[0] += 1
            vectors: dict[int, int] = {}
            for h, (n, first) in times.items():
                if n not in vectors:
                    vectors[n] = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
                own = held.setdefault((host, h), [0, 0, 0, 0, 0])
                own[0] += 1
                own[1] += n
                own[2] += first
                own[3] += vectors[n] & low
                own[4] += vectors[n] >> 32
        if len(held) > COUNTED:
            yield from hand_on()
    yield from hand_on()


_COUNTED = ("host", "token", "pages", "times", "first", "v1", "v2")


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """host, token, first (where it stands first, summed), pages, cls, class_size: the tokens of valid equivalence classes, for
    pages (host, html). cls names the class: a hash of its vector."""
    counted = pages.select("host", "html").mapInArrow(_count, "host string, " + ", ".join(f"{c} long" for c in _COUNTED[1:]))
    counts = counted.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in _COUNTED[2:]]).where(F.col("pages") >= CLASS_PAGES)
    counts = stash(counts.select("host", "token", "first", "pages", F.xxhash64("pages", "times", "v1", "v2").alias("cls")), "tokens")
    sizes = counts.groupBy("host", "cls").agg(F.count("*").alias("class_size")).where(F.col("class_size") >= CLASS_SIZE)
    return counts.join(sizes, ["host", "cls"]).select("host", "token", "first", "pages", "cls", "class_size")


def _slots(batches: Iterator[pa.RecordBatch], elements: bool, names: bool) -> Iterator[pa.RecordBatch]:
    """(host, html, template, root) to a row for each element of the template with text in a page: host, element, above, text (a hash),
    free, linked, heading."""
    import xxhash

    sets: dict[str, Template] = {}
    for batch in batches:
        rows = []
        for host, page, *template in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
            own = sets[host] if host in sets else _held(sets, host, *(x.as_py() for x in template))
            page = page.as_py()
            steps = list(walk(page or "", False, elements))
            tokens = own.tokens(steps)
            inside, links, headings = _Inside(own, names), [], []
            found: dict[tuple[int, int], list] = {}
            for step, token_, known in zip(steps, tokens, own.parse(tokens), strict=True):
                for open_ in (links, headings):
                    while open_ and open_[-1] >= step.depth:
                        open_.pop()
                held, called = inside.at(step, token_, known)
                if step.kind == "open" and step.name in ("a", "h1"):
                    (links if step.name == "a" else headings).append(step.depth)
                if step.kind == "text" and not known and not called and not step.furniture and (text := step.text.strip()):
                    chain = [0, *(e for _, e in held)]
                    for at in range(len(chain) - 2, 0, -1):  # what holds it, up to what is there already
                        if (chain[at], chain[at - 1]) in found:
                            break
                        found[chain[at], chain[at - 1]] = [xxhash.xxh64(), 0, 0, 0]
                    key = (chain[-1], chain[-2] if held else 0)
                    slot = found.setdefault(key, [xxhash.xxh64(), 0, 0, 0])
                    slot[0].update(text.encode("utf-8", "surrogatepass"))
                    slot[1 + bool(links)] += len(text)
                    slot[3] = slot[3] or int(bool(headings))
            rows += [(host, *key, s[0].intdigest() - (1 << 63), *s[1:]) for key, s in found.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], _SLOT)


_SLOT = ("host", "element", "above", "text", "free", "linked", "heading")


def _held(sets: dict[str, Template], host: str, template: list | None, root: int | None, slots: list | None = None) -> Template:
    """The host's template, of those that a task keeps for a while."""
    if host not in sets:
        if len(sets) > 1000:
            sets.clear()
        sets[host] = Template([(x["cls"], x["first"], x["token"]) for x in template or ()], root, [Slot(*(x[f] for f in Slot._fields)) for x in slots or ()])
    return sets[host]


def templates(pages: DataFrame) -> DataFrame:
    """host, template, root: class, place and token of the host's root class and of the classes nested in it, at most mean tokens a
    page / NESTED_SHARE of them; which class is the root."""
    classes = stash(occurrence_classes(pages), "classes")
    total = classes.where("token = 0").select("host", F.col("pages").alias("n_pages"), F.col("cls").alias("root"))
    nested = classes.join(total, "host").where((F.col("token") != 0) & (F.col("pages") >= NESTED_SHARE * F.col("n_pages")))
    return nested.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("cls", "first", "token"))).alias("template"), F.min("root").alias("root"))


def judged_slots(pages: DataFrame, known: DataFrame, elements: bool = True, names: bool = True) -> DataFrame:
    """host, slots of pages (host, html) by templates (host, template, root): a Slot for each element of the template with text. A page's
    text in an element is a row of its hash and lengths, which are counted by text and then by element."""
    rows = pages.join(known, "host").select("host", "html", "template", "root").mapInArrow(lambda batches: _slots(batches, elements, names), "host string, " + ", ".join(f"{c} long" for c in _SLOT[1:]))
    texts = rows.groupBy("host", "element", "above", "text").agg(F.count("*").alias("n"), F.sum("free").alias("free"), F.sum("linked").alias("linked"), F.max("heading").alias("heading"))
    has = F.col("free") + F.col("linked") > 0
    slots = texts.groupBy("host", "element", "above").agg(F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("pages"), F.count_if(has).alias("different"), F.sum("free").alias("free"), F.sum("linked").alias("linked"), (F.max("heading") > 0).alias("heading"), F.sum("n").alias("n"))
    # a page whose tags are not nested as the host's others are may have an element elsewhere: the most frequent place counts
    slots = slots.groupBy("host", "element").agg(F.max_by(F.struct("above", "pages", "different", "free", "linked", "heading"), F.struct("n", "above")).alias("slot"))
    return slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("element", "slot.*"))).alias("slots"))


def extract_pages(pages: DataFrame, elements: bool = True, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of pages (page_id, url, html). elements: what HTML's elements for other
    things than text hold goes, wherever it stands; names: so do elements that a role, class name or id calls furniture, of those
    that are the template's.

    A null or empty page has an empty text; a null url is the host of no name; null ids, repeated rows and ties pass
    through; other columns are not carried; an empty table gives an empty result. A template's size is bounded by
    its host's pages' sizes; it is joined to its host's pages, which Spark may split.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    known = stash(templates(own), "templates")
    known = stash(known.join(judged_slots(own.select("host", "html"), known, elements, names), "host", "left"), "judged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for name, page, *template in zip(batch.column(2).to_pylist(), batch.column(3), *(batch.column(c) for c in (4, 5, 6)), strict=True):
                own = sets[name] if name in sets else _held(sets, name, *(x.as_py() for x in template))
                texts.append(extract(page.as_py(), own, elements, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ("page_id", "url", "text", "n_chars"))

    return own.join(known, "host", "left").select("page_id", "url", "host", "html", "template", "root", "slots").mapInArrow(run, "page_id long, url string, text string, n_chars long")
