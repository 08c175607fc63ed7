"""HTML extraction by equivalence classes of tokens.

1. Each page becomes a stream of tags and texts with the path of elements they stand in.
2. For each host, a token's occurrence vector says how often each page has it. Vectors are kept as
   sums of a hash of the page for each occurrence, which merge in any order and at any skew.
   Tokens with equal vectors are a class.
3. A class is valid if it has enough tokens and pages; the class of tokens that every page has once
   is the root of the host's template, and valid classes that most pages have are nested in it. A class that
   fewer pages have is of one kind of the host's pages, if it holds an element and enough pages have it.
4. What the template does not fix are slots. A page's text is that of its slots in the article,
   or, where no element says which part that is, of slots outside of menus, notices and the like.

Pages are read twice, for their tokens and, once templates are known, for their slots, so nothing of
a page is kept between. Vectors and classes are DataFrame functions.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.tuning import small_batches
from ridgeline.session import cut

#: A host's template needs so many different pages, a class so many tokens; in articles it counts from SURE pages on.
PAGES, TOKENS, SURE = 3, 2, 10
#: Up to so many template tokens, templates are broadcast (8 bytes each, and the hosts' names), and as many of kinds of pages.
FEW = 500_000
#: Tokens of a host are dealt to so many shares where the number of its pages is looked up.
SHARES = 32

# Elements that never hold main text, those of them that stand in a line without cutting it, those
# whose words belong to the line they stand in, elements that do hold main text, elements without content,
# elements whose content is not markup, elements that stand inside a line, and names that mark
# boxes around an article.
ASIDE = frozenset("nav header footer aside form head button menu dialog label fieldset".split())
HUSHED = frozenset("script style noscript template title select textarea option iframe svg object canvas audio video input annotation annotation-xml".split())
PRESSED = frozenset(("button", "label"))
LINES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 caption figcaption summary".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mmultiscripts semantics".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
BOXES = re.compile(r"^(ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|header|masthead|topbar|footer|sidebar|side|aside|comment|comments|commentlist|disqus|reply|replies|respond|notice|notices|alert|cookie|cookies|consent|gdpr|popup|modal|overlay|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|widget|widgets|pager|pagination|toolbar|copyright|legal|disclaimer|meta|byline)$", re.I)
# Words that beside names of boxes only say which part of a page it is.
PLACES = frozenset("area areas bar bars block blocks body bottom box boxes button buttons container content form group holder inner item items left link links list lists main outer page panel post posts primary right row secondary section sections site slot top unit wrap wrapper".split())
# Boxes that no page has its main text in. The other names of BOXES may also stand on a wrapper.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond cookie cookies consent gdpr share sharing related recommended newsletter subscribe subscription copyright".split())
# Last words of names of boxes, whatever the words before them, first ones, and words that make a name tell a state instead.
LAST = frozenset("ad ads advert adverts advertisement comment comments commentlist replies newsletter meta byline".split())
FIRST = frozenset(("sponsored", "promoted"))
STATES = frozenset("has no not with without is show hide hidden enabled disabled".split())
# Parts of an article whose ids are anchors, and names of boxes that also are subjects of such parts.
ANCHORED = frozenset("section p h1 h2 h3 h4 h5 h6".split())
SUBJECTS = frozenset("advertisement advertising promotion copyright cookie cookies consent gdpr subscription".split())
#: How far a text is aside: not, in a box told by its name, in an article that such a box holds, for certain, left out without a cut.
SHOWN, NAMED, WITHIN, CERTAIN, HIDDEN = range(5)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
BLANKS = re.compile(r"\s+")


class Reader:
    """One page: its blocks of text, each with its path and whether it stands in the article or aside."""

    def __init__(self, page: str):
        self.tokens: Counter = Counter()
        self.blocks: list[tuple[int, str, bool, int]] = []  # token, text, in the article, how far aside
        self.stack: list[tuple[str, str, bool, int]] = []  # element, path, in the article, how far aside
        self.text: list[str] = []
        self.solid = False  # whether a block has words beside those of buttons and labels
        self.place: tuple[str, bool, int] | None = None
        at = 0
        while at < len(page):
            m = TAG.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                self.words(page[at:end])
            if not m:
                break
            at = m.end()
            found = NAME.match(m[0])
            if not found or not m[0].endswith(">"):
                continue
            name = found[1].lower()
            if m[0][1] == "/":
                self.close(name)
            else:
                self.open(name, m[0])
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    self.close(name)
                    at = stop.end() if stop else len(page)
        self.flush()

    def words(self, raw: str) -> None:
        place = self.stack[-1][1:] if self.stack else ("", False, SHOWN)
        if place[2] == HIDDEN:
            return
        if self.place is not None and (place[1], place[2]) != self.place[1:]:
            self.flush()
        if self.place is None:
            self.place = place
        self.text.append(raw)
        self.solid = self.solid or not raw.isspace() and not (place[2] < CERTAIN and any(s[0] in PRESSED for s in self.stack))

    def flush(self) -> None:
        if self.text and (self.solid or self.place and self.place[2] == CERTAIN):
            text = BLANKS.sub(" ", html.unescape("".join(self.text))).strip()
            if text:
                path, main, aside = self.place
                token = _hash(f"{path}\n{text}") | 1  # odd: a text
                self.tokens[token] += 1
                self.blocks.append((token, text, main, aside))
        self.text, self.place, self.solid = [], None, False

    def open(self, name: str, tag: str) -> None:
        _, path, main, aside = self.stack[-1] if self.stack else ("", "", False, SHOWN)
        if name == "br":
            if aside != HIDDEN:
                self.text.append("\n")
            return
        if name in HUSHED:
            aside = HIDDEN
        inline = name in INLINE or aside == HIDDEN or name in PRESSED and aside < CERTAIN and any(s[0] in LINES for s in self.stack)
        if not inline:
            self.flush()
        if name in VOID:
            return
        while self.stack and name in CLOSED_BY.get(self.stack[-1][0], ()):
            self.stack.pop()
        _, path, main, above = self.stack[-1] if self.stack else ("", "", False, SHOWN)
        aside = HIDDEN if aside == HIDDEN else above
        marks = [(kind.lower(), v.strip("\"'")) for kind, v in MARK.findall(tag)] if "=" in tag else []
        path = _path(path, name, " ".join(v for _, v in marks))
        is_main = name in MAIN or ("role", "main") in marks
        if inline:
            pass
        elif name in ASIDE and not (name == "header" and main):
            aside = CERTAIN
        elif is_main:
            aside = WITHIN if aside == NAMED else aside
        elif marks and name not in ("html", "body"):
            box = max(_box(v, main, main and kind == "id" and name in ANCHORED) for kind, v in marks)
            aside = CERTAIN if aside == WITHIN and box else max(aside, box)
        self.stack.append((name, path, main or is_main, aside))
        self.tokens[_hash(path) & ~1] += 1  # even: an element

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            found, *_, aside = self.stack[i]
            if found == name:
                if not (name in INLINE or aside == HIDDEN or name in PRESSED and aside < CERTAIN):
                    self.flush()
                del self.stack[i:]
                break
            if name in INLINE and found not in INLINE:
                break
        else:
            if not (name in INLINE or name in HUSHED or self.stack and self.stack[-1][3] == HIDDEN):
                self.flush()


_boxes: dict[tuple[str, bool, bool], int] = {}


def _box(marks: str, main: bool, anchor: bool) -> int:
    """How far aside an element's names put it; main: in an article, where headers belong to the text; anchor: the names are those of a part of it."""
    key = (marks, main, anchor)
    if key not in _boxes:
        if len(_boxes) > 100_000:
            _boxes.clear()
        found = SHOWN
        for mark in marks.split():
            words = [w.lower() for w in re.split(r"[-_]", re.sub(r"([a-z])([A-Z])", r"\1-\2", mark)) if w and not w.isdigit()]
            boxes = [w for w in words if BOXES.match(w)]
            if boxes and all(w in boxes or w in PLACES for w in words):
                found = max(found, CERTAIN if NEVER.intersection(words) else NAMED if not (main and set(boxes) == {"header"}) else SHOWN)
                if anchor and (found == NAMED or SUBJECTS.intersection(words)):
                    found = SHOWN
            elif words and not anchor and (words[-1] in LAST or words[0] in FIRST) and not STATES.intersection(words):
                found = max(found, NAMED)
        _boxes[key] = found
    return _boxes[key]


_paths: dict[tuple[str, str, str], str] = {}


def _path(path: str, name: str, marks: str) -> str:
    """A short name for an element under a path."""
    key = (path, name, marks)
    if key not in _paths:
        if len(_paths) > 100_000:
            _paths.clear()
        _paths[key] = xxhash.xxh64_hexdigest("\n".join(key))
    return _paths[key]


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))


def _tokens(pages: DataFrame) -> DataFrame:
    """host, key, tokens of pages of html, host, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [[{"token": t, "n": n} for t, n in Reader(page or "").tokens.items()] for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(tokens, kind)], names=["host", "key", "tokens"])

    kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))
    return pages.select("html", "host", "key").mapInArrow(run, "host string, key long, tokens array<struct<token:long,n:long>>")


def classes(pages: DataFrame) -> DataFrame:
    """host, token, pages, of, framed: the tokens of valid classes, how many of the host's different pages have each, and whether its class holds an element. pages: html, host."""
    pages = pages.select("html", "host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("key"))
    read = _tokens(pages).dropDuplicates(["host", "key"])  # copies of a page say nothing about what the host's pages share
    hosts = pages.groupBy("host").agg(F.count_distinct("key").alias("of")).where(f"of >= {PAGES}")
    seen = read.select("host", "key", F.explode("tokens").alias("t")).select("host", "key", "t.*")
    # The occurrence vector, as sums of two hashes of the page, cut to 31 bits so that they cannot wrap.
    half = lambda seed: F.sum(F.col("n") * F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 31))).alias(f"v{seed}")
    vectors = seen.groupBy("host", "token").agg(half(1), half(2), F.count("*").alias("pages")).where(f"pages >= {PAGES}")
    # A host may have most tokens: its one row is repeated for each share of them.
    share = F.pmod("token", F.lit(SHARES)).cast("int").alias("share")
    hosts = hosts.select("host", "of", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    vectors = vectors.select("*", share).join(hosts, ["host", "share"])
    valid = vectors.groupBy("host", "v1", "v2").agg(F.count("*").alias("members"), F.bool_or(F.expr("token & 1 = 0")).alias("framed")).where(f"members >= {TOKENS}")
    return vectors.join(valid, ["host", "v1", "v2"]).select("host", "token", "pages", "of", "framed")


def templates(pages: DataFrame) -> DataFrame:
    """host, always, mostly: texts that each host's template fixes, those of the root class and of valid classes nested in it. pages: html, host."""
    return _shared(classes(pages))


def _shared(found: DataFrame) -> DataFrame:
    """templates() of classes()."""
    root = (F.col("pages") == F.col("of")) & (F.col("of") >= SURE)
    # Tokens that at least half of the pages have: no more than twice what a page holds.
    return found.where("2 * pages >= of").groupBy("host").agg(F.collect_set(F.when(root, F.col("token"))).alias("always"), F.collect_set("token").alias("mostly"))


# Texts of kinds of pages, in classes(). A host's kinds together may have any number, so a page is given only its own.
KINDS = f"2 * pages < of AND pages >= {SURE} AND framed AND token & 1 = 1"


def _of_kinds(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with kinds: those texts of found (host, token) that the page has."""
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("html", F.lit(""))))
    read = _tokens(rows.join(found.select("host").distinct(), "host", "left_semi")).dropDuplicates(["host", "key"])
    own = read.select("host", "key", F.explode("tokens.token").alias("token")).join(found, ["host", "token"]).groupBy("host", "key").agg(F.collect_set("token").alias("kinds"))
    return rows.join(own, ["host", "key"], "left").drop("key")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of each page.

    Character references are decoded, white space in a block is one space, blocks follow in page
    order with \\n between them. Null or empty html, and a page without main text, have the empty
    text. A null url counts as a host of its own. A host with fewer than three different pages has
    no template; then only its elements tell. In an article only texts of the root class go, those
    that every page of a host with ten different pages or more has; elsewhere those of classes that most pages have, and of
    those with an element that ten or more have, as pages of one kind. Scripts, pictures and choices inside a
    line are left out without cutting it; formulas keep their words, and so do buttons and labels in a line that
    has other words too. An element whose name is that
    of a box is aside, but for ids of an article's sections that may be their subjects; an article in it, or else its texts, count only where a page has no other
    main text. Rows that repeat are pages
    each. An empty table gives no rows. Other columns are not looked at. Long pages are read whole.
    """
    small_batches(pages.sparkSession, 256)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"), host.alias("host"))
    valid = cut(classes(rows).where(f"2 * pages >= of OR {KINDS}"))
    found, kinds = cut(_shared(valid)), valid.where(KINDS).select("host", "token")
    size = found.agg(F.sum(F.size("mostly") + 8)).first()[0] or 0
    found = F.broadcast(found) if size <= FEW else found
    few = kinds.count() <= FEW
    rows = rows.withColumn("kinds", F.lit(None).cast("array<long>")) if few else _of_kinds(rows, kinds)
    held = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.tokens) for r in kinds.groupBy("host").agg(F.collect_list("token").alias("tokens")).collect()} if few else {})
    rows = rows.join(found, "host", "left").select(id_col, url_col, "html", "always", "mostly", "kinds", "host")

    def text(page: str | None, always: list | None, mostly: list | None, own: list | None, host: str) -> str:
        reader = Reader(page or "")
        own = held.value.get(host, frozenset()).intersection(token for token, *_ in reader.blocks).union(own or ())
        return slots(reader, set(always or ()), own.union(mostly or ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def slots(reader: Reader, always: set[int] = frozenset(), mostly: set[int] = frozenset()) -> str:
    """A page's main text: what its host's template leaves open of the article, or else of what is not aside."""
    of = lambda level, fixed: [text for token, text, _, aside in reader.blocks if aside == level and token not in fixed]
    story = [(token, text) for token, text, main, aside in reader.blocks if main and aside == SHOWN]
    if story:
        return "\n".join(text for token, text in story if token not in always)
    if any(aside == WITHIN for *_, aside in reader.blocks):
        return "\n".join(of(WITHIN, always))
    return "\n".join(of(SHOWN, mostly) or of(NAMED, mostly))


def article_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, declared: extract()'s text without templates, in one pass, and the language that the html element declares (null: none)."""
    small_batches(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [slots(Reader(page or "")) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), batch.column(3)], names=[id_col, url_col, "text", "declared"])

    declared = F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), F.when(declared != "", declared).alias("declared"))
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("declared", T.StringType())])
    return rows.mapInArrow(run, schema)
