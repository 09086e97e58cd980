"""Main text of web pages by consensus: every page's containers are scored, hosts vote on generalised paths, and the winning path, widened to the whole article, extracts."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm import shared as S
from arachne.llm import urls

# Elements without main text, whatever they hold.
SKIPPED = frozenset("head title nav header footer aside form script style noscript template iframe svg math object canvas audio video button select option textarea input label menu dialog map".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that may hold the main text.
CONTAINERS = frozenset("article body div main section td".split())
#: Words of a class or an id that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments disqus discussion respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget pagination pager toolbar skip copyright legal disclaimer".split()
)
#: Depth of the element tree, as in browsers: what is nested deeper belongs to the element there.
MAX_DEPTH = 512
#: Weight of a container's name in its score. Parameters.
NAMED = {"article": 2.0, "main": 1.5}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
#: The attributes of a tag in order, each a whole name and its value; a stray quoted string has no name.
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|"[^"]*"|'[^']*'""")
SPLIT = re.compile(r"[^a-z]+")
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w")
CLOSES_P = BLOCKS - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "body", "html"}


class Page:
    """The blocks of a page and the containers around them, in time and memory that grow with the page.

    Containers are numbered as they open, so those inside container c are c to last[c]. A block knows its innermost
    container, or -1. Elements nested deeper than MAX_DEPTH belong to the element there, as in browsers.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters in links
        self.plain: list[bool] = []  # whether a block has words outside links
        self.tags: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.path: list[int] = []  # number of the generalised path of each container
        self._steps: list[tuple[int, str]] = []  # of each path: the path before its last step, and the step
        self._read(source)

    def path_text(self, number: int) -> str:
        steps = []
        while number >= 0:
            number, step = self._steps[number]
            steps.append(step)
        return "/".join(reversed(steps))

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, path, skipped from here, container or -1
        still: dict[str, int] = {}  # open elements of each tag
        deep: dict[str, int] = {}  # of those that aren't on the stack
        known: dict[tuple[int, str], int] = {}
        buffer: list[str] = []
        linked = 0
        plain = False
        inner = -1
        skip = links = 0

        def flush() -> None:
            nonlocal linked, plain
            if buffer:
                text = SPACE.sub(" ", html_lib.unescape("".join(buffer))).strip()
                if text:
                    self.blocks.append((text, inner, linked))
                    self.plain.append(plain)
                buffer.clear()
            linked = 0
            plain = False

        def pop() -> None:
            nonlocal skip, links, inner
            tag, _, skipped, container = stack.pop()
            still[tag] -= 1
            skip -= skipped
            links -= tag == "a"
            if container >= 0:
                self.last[container] = len(self.parent) - 1
                inner = self.parent[container]

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at and not skip:
                buffer.append(source[at:stop])
                linked += (stop - at) if links else 0
                plain = plain or not links and WORD.search(html_lib.unescape(source[at:stop])) is not None
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:  # an end tag
                if tag in BLOCKS:
                    flush()
                if deep.get(tag):
                    deep[tag] -= 1
                    continue
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if still.get(tag) else -1
                if depth >= 0 and (tag in BLOCKS or all(stack[i][0] not in BLOCKS for i in range(depth + 1, len(stack)))):
                    deep.clear()
                    while len(stack) > depth:
                        pop()
                continue
            if tag in BLOCKS or tag == "br":
                if tag == "br":
                    if not skip:
                        buffer.append(" ")
                else:
                    flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P or tag in ("li", "td", "th", "tr"):  # what HTML closes by itself
                own = {"p"} if tag in CLOSES_P else {tag, "p"}
                for i in range(len(stack) - 1, -1, -1) if any(still.get(x) for x in own) else ():
                    if stack[i][0] in own:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in BLOCKS:
                        break
            kind, hidden = "", False
            for a in ATTR.finditer(m[3]) if m[3] else ():
                name, value = (a[1] or "").lower(), a[2] or a[3] or a[4] or ""
                if name == "class" or name == "id" and not kind:
                    kind = value
                hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
                if name in ("class", "id", "role") and not MARKS.isdisjoint(SPLIT.split(value.lower())) and tag not in ("body", "html", "article", "main"):
                    hidden = True
                if name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(SPLIT.split(value.lower())):
                    hidden = True
            skipped = hidden or tag in SKIPPED
            if len(stack) >= MAX_DEPTH and (skip or not skipped):
                deep[tag] = deep.get(tag, 0) + 1
            else:
                path = stack[-1][1] if stack else -1
                if tag != "html":
                    step = tag + ("." + ".".join(sorted(DIGITS.sub("#", kind.lower()).split())) if kind and tag != "body" else "")
                    above, path = path, known.setdefault((path, step), len(known))
                    if path == len(self._steps):
                        self._steps.append((above, step))
                container = -1
                if tag in CONTAINERS and not skip and not skipped:
                    container = len(self.parent)
                    self.parent.append(inner)
                    self.last.append(-1)
                    self.path.append(path)
                    self.tags.append(tag)
                    inner = container
                stack.append((tag, path, skipped, container))
                still[tag] = still.get(tag, 0) + 1
                skip += skipped
                links += tag == "a"
            if tag in RAW:
                close = re.compile(rf"</{tag}", re.I).search(source, at)
                at = close.start() if close else end
        flush()
        while stack:
            pop()

    def scores(self) -> list[float]:
        """Of each container: its characters outside links; of an inner container's score 0.7 counts."""
        out = [0.0] * len(self.parent)
        for text, c, linked in self.blocks:
            if c >= 0:
                out[c] += max(0.0, len(text) - 2.0 * linked)
        for c in range(len(out) - 1, -1, -1):
            if self.parent[c] >= 0:
                out[self.parent[c]] += 0.7 * out[c]
        return [s * NAMED.get(t, 1.0) for s, t in zip(out, self.tags, strict=True)]

    def votes(self) -> dict[str, float]:
        """The path of the best container, with 1 for a vote, and of others that come near it."""
        total: dict[int, float] = {}
        for path, score in zip(self.path, self.scores(), strict=True):
            total[path] = total.get(path, 0.0) + score
        best = max(total.values(), default=0.0)
        return {self.path_text(p): s / best for p, s in total.items() if best > 0 and s >= 0.5 * best}

    def _inside(self, chosen: set[int]) -> list[bool]:
        """Of each container whether it is or lies in a chosen one."""
        out: list[bool] = []
        for c, p in enumerate(self.parent):
            out.append(c in chosen or p >= 0 and out[p])
        return out

    def _outermost(self, tag: str) -> list[int]:
        """Of each container the outermost one of that tag around it, itself included, or -1; one more entry for none."""
        out: list[int] = []
        for c, p in enumerate(self.parent):
            above = out[p] if p >= 0 else -1
            out.append(above if above >= 0 else c if self.tags[c] == tag else -1)
        return [*out, -1]

    def widened(self, chosen: set[int]) -> set[int] | None:
        """chosen and, for each article that it lies in, the lowest container of all its blocks with words outside links; None is the page.

        An article is what the outermost main holds, or without one the outermost article, or without both the page.
        """
        inside = [*self._inside(chosen), False]
        mains, articles = self._outermost("main"), self._outermost("article")
        scopes = {mains[c] if mains[c] >= 0 else articles[c] for _, c, _ in self.blocks if inside[c]}
        reach: dict[int, tuple[int, int]] = {}  # of each scope the first and the last container of its blocks
        for (_, c, _), plain in zip(self.blocks, self.plain, strict=True):
            if plain or inside[c]:
                for scope in {-1, mains[c], articles[c]} & scopes:
                    lo, hi = reach.get(scope, (c, c))
                    reach[scope] = min(lo, c), max(hi, c)
        out = set(chosen)
        for lo, hi in reach.values():
            while lo >= 0 and self.last[lo] < hi:
                lo = self.parent[lo]
            if lo < 0:
                return None
            out.add(lo)
        return out

    def text(self, path: str | None) -> str:
        """The blocks in containers of that path, widened; without any, in those of the page's own best path; without containers, all."""
        votes = self.votes()
        if path is None or path not in votes:
            path = min(votes, key=lambda p: (-votes[p], p), default=None)
        chosen = None
        if path is not None:
            same = {p for p in set(self.path) if self.path_text(p) == path}
            chosen = self.widened({i for i, p in enumerate(self.path) if p in same})
        inside = None if chosen is None else [*self._inside(chosen), False]
        return "\n\n".join(t for t, c, _ in self.blocks if inside is None or inside[c])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: dict[tuple[str, str], float] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for path, score in Page(source or "").votes().items():
                total[host, path] = total.get((host, path), 0.0) + round(score, 3)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(source or "").text(path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row.

    First pass: each page votes for its best-scored container paths (tags and classes, digits generalised); votes are
    summed for each host. Second pass: the host's winner extracts, or where a page lacks it the page's own best, widened
    to the lowest container around all text of the article that is neither marked nor only links. Winning paths are
    broadcast while they are few, else joined. Cases: null or empty html gives an empty text; a null url, or one without
    host, votes with the others of its kind; ties go to the first path in order; rows that repeat, and null ids, are
    extracted each; broken markup is read as far as it goes; very long and very deep pages are read whole, in time that
    grows with the page; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.expr(urls.host("url")))
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path string, score double")
    best = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score")).groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("best"))
    winners = S.saved(best.select("host", F.col("best.path").alias("path")), "paths")
    joined = rows.join(S.maybe_broadcast(winners, winners.count(), 50_000), "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


#: DuckDB SQL of the same result for pages whose main text is their one article, of plain blocks and the named references below.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?(h[1-6]|p|li|ul|ol|div|section|blockquote)( [^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""
