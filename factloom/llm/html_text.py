"""Main text of web pages, by tag-class paths on which a host's pages agree.

Each page scores its containers; votes for generalised paths are summed per host
in Spark; every page is read again with its host's winning paths. A null html
gives an empty text; a null or broken URL shares the host ''. A page that has no
container on a winning path falls back to its own best one. The winner is lifted
to the container of the whole article. Inside an article only what is surely not its own
is left out by its name: reader comments, adverts and the like always, other names where
they hold no heading of it and are mostly links. Repeated rows repeat; an empty table
gives no rows. Very long and very deep pages are whole and are read in linear time; a tag
whose quotes never close ends at the next `>`. Only page_id, url and html are read.
"""

import html as entities
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from .common import map_columns, table

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTE = re.compile("[>\"']")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"[\s\xa0]+")
# Element names by their part in a page. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table tbody td tfoot th thead tr ul summary".split())
CONTAINER = frozenset("article main section div td body".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = tuple(".!?…:。！？।؟")
CLOSES_P = BLOCK | {"form", "nav", "aside", "footer"}
HARD = frozenset("button select option head object audio video canvas".split())
TAGS = frozenset("nav header footer aside dialog menu".split())
LEFT_OUT = HARD | TAGS | {"form"}
WORDS = r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget"
BOILERPLATE = re.compile(rf"(?:^|[\s_-]){WORDS})(?:$|[\s_-])", re.I)
#: A name that is one of the words, or begins with one.
WHOLE = re.compile(rf"(?:^|\s){WORDS})(?:$|\s)", re.I)
STARTS = re.compile(rf"(?:^|\s){WORDS})(?:$|[\s_-])", re.I)
#: Names that are boilerplate inside an article, too; what is named for a header or for what is related may be the article's own.
SURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", re.I)
TITLES = frozenset("h1 h2".split())
#: An element that would be left out stays if it holds more than this share of the page's text and no article stands elsewhere.
SHARE = {"part": 0.5, "whole": 0.9, "tag": 1.0}


def tags(source):
    """(start, end, close, name, attributes) of each tag or markup in the page; name is None for comments and declarations."""
    at = source.find("<")
    last = source.rfind(">")
    last_cdata = source.rfind("]]>")
    #: Where a tag ends that goes on at a place outside of quotes, -1 if its quotes never close.
    ends = {}

    def closing(k):
        """The `>` outside of quotes from a place on; each place behind a quote is looked at once."""
        seen, found = [], None
        while found is None:
            if k in ends:
                found = ends[k]
            elif not (q := QUOTE.search(source, k)):
                found = -1
            elif q.group() == ">":
                found = q.start()
            else:
                seen.append(k)
                k = source.find(q.group(), q.end()) + 1
                if not k:
                    found = -1
        for k in seen:
            ends[k] = found
        return found

    while 0 <= at:
        end, close, name, about = -1, "", None, ""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
        elif source.startswith("<![CDATA[", at) and at < last_cdata:
            end = source.find("]]>", at) + 3
        elif at > last:
            pass  # nothing closes a tag any more
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
        elif m := NAME.match(source, at + 1):
            close, name = m.group(1), m.group(2).lower()
            shut = closing(m.end())
            shut = source.find(">", m.end()) if shut < 0 else shut
            about, end = source[m.end() : shut], shut + 1
        if end > 0:
            to = yield at, end, close, name, about
            if to is not None:  # the reader says where it goes on
                yield
            at = source.find("<", max(end, to or 0))
        else:
            at = source.find("<", at + 1)


class Page:
    """Blocks of text of a page: (container, text, whether a heading), boilerplate and markup left out.

    A container is a number; equal paths of tags and classes have equal numbers, and each
    knows its parent. Elements named like boilerplate, forms and the TAGS are judged once
    the whole page is read, since a template's outer element can be named after what
    surrounds it; they form a tree by number, inner ones after outer ones.
    """

    def __init__(self, source):
        self.raw, self.stack, self.held = [], [], []
        #: Containers: number by (parent, name), and by number the parent, name and depth. The page is number 0.
        self.number, self.parent, self.style, self.depth = {}, [0], [""], [0]
        #: Open elements by name, with their places on the stack; places of open blocks.
        self.where, self.block_at = defaultdict(list), []
        #: Judged elements: kind, the judged one around each, whether a title is in it. Then the innermost open one, and that around the outermost article.
        self.kinds, self.around, self.titled = [], [], []
        self.out, self.article = -1, None
        self.dropped = 0
        at, found = 0, tags(source)
        for start, end, close, name, about in found:
            if not self.dropped:
                self.hold(source[at:start])
            at = end
            if name is None or name in ("svg", "math") and not close and about.rstrip().endswith("/"):
                pass
            elif name in RAW and not close:
                m = re.compile(f"</{name}\\s*>", re.I).search(source, at)
                at = m.end() if m else len(source)
            elif name == "br":
                self.hold("" if self.dropped else " ")
            elif close:
                self.close(name)
            else:
                self.open(name, about)
            found.send(at)
        if not self.dropped:
            self.hold(source[at:])
        self.end_block()
        lost = self.left_out()
        self.blocks = []
        for container, pieces, heading in self.raw:
            text = SPACE.sub(" ", entities.unescape("".join(p[0] for p in pieces if p[1] < 0 or not lost[p[1]]))).strip()
            if text:
                self.blocks.append((container, text, heading))

    def hold(self, text):
        if text:
            self.held.append((text, self.out, self.article, bool(self.where.get("a"))))

    def left_out(self):
        """For each judged element, whether it is left out: all but those that hold the page's article or most of its text."""
        n = len(self.kinds)
        if not n:
            return []
        tagged = [False] * n
        for o in range(n):
            tagged[o] = self.kinds[o] == "tag" or self.around[o] >= 0 and tagged[self.around[o]]
        # the last place counts the page
        texts, articles, free, links = ([0] * (n + 1) for _ in range(4))
        for _, pieces, _ in self.raw:
            for s, o, article, linked in pieces:
                size = len(s.strip())
                texts[o] += size
                links[o] += size * linked
                free[o] += 0 if o >= 0 and tagged[o] else size
                if article is not None:
                    articles[article] += size
        for o in range(n - 1, -1, -1):
            for sums in (texts, articles, free, links):
                sums[self.around[o]] += sums[o]
            if self.titled[o] and self.around[o] >= 0:
                self.titled[self.around[o]] = True
        # judged elements without anything of an article say nothing of how much the article is
        beside = sum(texts[o] for o in range(n) if not articles[o] and (self.around[o] < 0 or articles[self.around[o]]))
        kept = [articles[o] > articles[-1] / 2 and texts[o] > (texts[-1] - beside) / 4 for o in range(n)]
        # an element is open to the reader if all judged ones around it and itself are kept
        clear = [False] * n
        for o in range(n):
            clear[o] = kept[o] and (self.around[o] < 0 or clear[self.around[o]])
        if not any(s and article is not None and (article < 0 or clear[article]) for _, pieces, _ in self.raw for s, _, article, _ in pieces):
            kept = [k or self.kinds[o] in SHARE and free[o] > SHARE[self.kinds[o]] * free[-1] for o, k in enumerate(kept)]
        lost = [False] * n
        for o, kind in enumerate(self.kinds):
            own = kind == "head" and self.titled[o] or kind in ("head", "soft") and 2 * links[o] <= texts[o]
            lost[o] = not (kept[o] or own) or self.around[o] >= 0 and lost[self.around[o]]
        return lost

    def kind(self, name, words, core, inside):
        """How an element is judged: not at all, by its tag, by a whole name or a part of one, or as a part of the article."""
        kind = "tag" if name in TAGS and not (name == "header" and inside) else "part" if name == "form" else None
        if kind or not words or core or name in ("body", "html") or not BOILERPLATE.search(words):
            return kind
        if inside and not SURE.search(words):
            return "head" if re.search("header|masthead", words, re.I) else "soft"
        return "whole" if WHOLE.search(words) else "part"

    def container(self):
        """The number of the innermost open container."""
        return self.stack[-1][5] if self.stack else 0

    def open(self, name, about):
        if name in CLOSES_P and self.where["p"]:
            self.close("p")
        if name in ("li", "td", "tr", "dd", "dt") and self.stack and self.stack[-1][0] == name:
            self.close(name)
        block = name in BLOCK or name in LEFT_OUT
        if block:
            self.end_block()
        if name in VOID:
            return
        marks = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(about)} if about else {}
        words = " ".join(marks.values())
        core = name in ("article", "main")
        inside = bool(self.where["article"] or self.where["main"])
        hard = name in HARD
        kind = None if hard or self.dropped else self.kind(name, words, core, inside)
        first = self.article is None and (core or marks.get("role") in ("article", "main")) and not STARTS.search(words)
        here = self.container()
        if name in CONTAINER:
            style = ".".join(re.sub(r"\d+", "#", w) for w in sorted(marks.get("class", "").split())[:2])
            key = here, f"{name}.{style}" if style else name
            if key not in self.number:
                self.number[key] = len(self.parent)
                self.parent.append(here)
                self.style.append(key[1])
                self.depth.append(self.depth[here] + 1)
            here = self.number[key]
        self.where[name].append(len(self.stack))
        if block:
            self.block_at.append(len(self.stack))
        self.stack.append((name, block, hard, kind, first, here))
        self.dropped += hard
        if first:
            self.article = self.out
        if kind:
            self.kinds.append(kind)
            self.around.append(self.out)
            self.titled.append(False)
            self.out = len(self.kinds) - 1
        if name in TITLES and self.out >= 0:
            self.titled[self.out] = True

    def close(self, name):
        if not self.where[name]:
            return
        place = self.where[name][-1]
        block = name in BLOCK or name in LEFT_OUT
        if not block and self.block_at and self.block_at[-1] > place:
            return  # inline elements left open stay open: only the block between is closed
        if block:
            self.end_block()
        while len(self.stack) > place:
            name, block, hard, kind, first, _ = self.stack.pop()
            self.where[name].pop()
            if block:
                self.block_at.pop()
            self.dropped -= hard
            if kind:
                self.out = self.around[self.out]
            if first:
                self.article = None

    def end_block(self):
        if self.held:
            if not all(p[0].isspace() for p in self.held):
                self.raw.append((self.container(), self.held, any(self.where[h] for h in HEADING)))
            self.held = []

    def path(self, container):
        """The tags and classes down to a container."""
        out = []
        while container:
            out.append(self.style[container])
            container = self.parent[container]
        return tuple(reversed(out))

    def at(self, path):
        """The container of a path, None if the page has none."""
        here = 0
        for name in path:
            here = self.number.get((here, name))
            if here is None:
                return None
        return here

    def scores(self):
        """{container: score}: text of a container's own blocks, half for blocks one container below, more for sentences."""
        scores = {}
        for here, text, _ in self.blocks:
            value = len(text) + 20 * (text.count(". ") + text.endswith((".", "!", "?")))
            for up in range(3):
                if not here:
                    break
                scores[here] = scores.get(here, 0) + value / 2**up
                here = self.parent[here]
        return {c: s * (2 if self.style[c].split(".")[0] in ("article", "main") else 1) for c, s in scores.items()}

    def containers(self):
        """{path: score} of the containers that may win, those of more than half of the best score."""
        scores = self.scores()
        best = max(scores.values(), default=0)
        return {self.path(c): s for c, s in scores.items() if s > best / 2}

    def lowest(self, line):
        """By container, the deepest container of a line from the page down that it lies in."""
        within = {c: c for c in line}
        for c in range(len(self.parent)):  # parents come first
            if c not in within:
                within[c] = within[self.parent[c]]
        return within

    def whole(self, best):
        """The container of the whole article that `best` is part of.

        That is the outermost article around it, else the main. From there, up to the
        main or, without article and main, to the page, a container takes over if what
        it adds is mostly headings and sentences.
        """
        line = [best]
        while line[-1]:
            line.append(self.parent[line[-1]])
        line.reverse()
        names = [self.style[c].split(".")[0] for c in line]
        top = names.index("main") if "main" in names else 0
        if "article" in names:
            line = line[: names.index("article") + 1]
            top = top or len(line) - 1
        elif top:
            line = line[: top + 1]
        # what each container of the line has beside the next one
        beside, prose = dict.fromkeys(line, 0), dict.fromkeys(line, 0)
        within = self.lowest(line)
        for c, t, heading in self.blocks:
            beside[within[c]] += len(t)
            prose[within[c]] += len(t) * (heading or ". " in t or t.endswith(ENDS))
        at, added, said = len(line) - 1, 0, 0
        for up in range(len(line) - 2, top - 1, -1):
            added, said = added + beside[line[up]], said + prose[line[up]]
            if said > 0.75 * added:
                at, added, said = up, 0, 0
        return line[at]

    def text(self, paths):
        """The blocks of the article around the best of the given paths that the page has, else around its own best container."""
        scores = self.scores()
        best = next((c for c in map(self.at, paths) if c in scores), max(scores, key=scores.get, default=0))
        best = self.whole(best)
        within = self.lowest([0, best])
        return "\n\n".join(t for c, t, _ in self.blocks if within[c] == best)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def host_paths(pages, share=0.02):
    """(host, paths): a host's paths with at least `share` of its votes, most votes first; a page's vote for a path is its share of the page's best score.

    No more than 1 / share paths can have that many, so that a host's list is bounded.
    """

    def votes(frames):
        for frame in frames:
            sums = {}
            for h, source in zip(frame["host"], frame["html"], strict=True):
                scores = Page(source or "").containers()
                best = max(scores.values(), default=0)
                for p, s in scores.items():
                    key = h, p
                    sums[key] = sums.get(key, 0) + round(1000 * s / best)
            yield pd.DataFrame([(h, list(p), v) for (h, p), v in sums.items()], columns=["host", "path", "votes"])

    summed = pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(votes, "host string, path array<string>, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    all_votes = summed.groupBy("host").agg(F.sum("votes").alias("all"))
    kept = summed.join(all_votes, "host").where(F.col("votes") >= share * F.col("all"))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return kept.groupBy("host").agg(F.transform(best_first, lambda x: x["path"]).alias("paths"))


def extract(pages, broadcast_hosts=200_000):
    """Per page: page_id, url, text, n_chars. Winning paths are broadcast for few hosts, else joined by shuffle."""
    from .common import cut

    paths = cut(host_paths(pages))
    paths = F.broadcast(paths) if paths.count() <= broadcast_hosts else paths
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(paths, "host", "left")

    def step(ids, urls, sources, chosen):
        texts = [Page(s or "").text(list(map(tuple, c or []))) for s, c in zip(sources, chosen, strict=True)]
        return ids, urls, texts, list(map(len, texts))

    return map_columns(joined, ["page_id", "url", "html", "paths"], lambda: step, "page_id bigint, url string, text string, n_chars bigint")


def op1_html_text(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
