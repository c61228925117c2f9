"""Main text of web pages: page structure, and boilerplate found by suffix arrays per host.

A page becomes blocks of text. Blocks in navigation, headers, footers, sidebars,
notices, adverts, forms and comments are out, blocks in the page's article are
in. A word inside a longer class name (``entry-header``) is only a guess at
chrome, which repeats on the host confirm. For every host the tokens of all other visible blocks are put one page after
another; a suffix array finds the long token runs that pages share. A run is
boilerplate if pages of ``MANY_TEXTS`` different texts hold it, and a block that
such runs cover goes. What the page's own markup leaves open is decided so: it
stays only as far as it is not covered.

Pages that carry one text with another counter, menu or advert count as one: a
page's text is named by its article, or else by its rarest runs that make up
``OWN`` of its open tokens, which copies have in common.

A large host is dealt over shards of pages, each with a suffix array of its own.
Shards report their runs with the number of their pages; totals go back by host
and run to the shards that reported the run, so no task holds a whole host or
more runs than its shard has.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from starling.llm.common import measured, utf8
from starling.session import cut_lineage

# A run is this many tokens, or whole neighbouring blocks that are shorter together but have LEAST_TOKENS.
RUN_TOKENS = 16
LEAST_TOKENS = 5
# Boilerplate is what pages of this many different texts hold.
MANY_TEXTS = 4
# The rarest tokens that name a page's text are at least this share of its open tokens.
OWN = 0.25
# A block goes if at least this share of its tokens is covered.
COVERED = 0.8
# Tokens in a shard of a host, on average.
SHARD_TOKENS = 500_000

# What markup says of a block: article, chrome, nothing, perhaps chrome inside an article, perhaps chrome elsewhere.
KEEP, DROP, OPEN, GUESS_IN, GUESS_OUT = range(5)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style template noscript iframe noembed noframes xmp svg math canvas object audio video select datalist option textarea button title head".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids: for reader comments and adverts, which are other on every page, and for layout.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored sponsors".split())
LAYOUT_WORDS = frozenset(
    """banner breadcrumb breadcrumbs consent cookie cookies footer form header masthead menu modal nav navbar navigation newsletter notice notices
    notification pager pagination popup related share sharing sidebar sidebars signup skip social subscribe subscription toolbar widget""".split()
)
# Ends of elements that the start of another one implies.
CLOSES = {
    "p": BLOCKS - {"html", "head", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "title"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
BARRIERS = frozenset("table td th ul ol dl article main section div body nav aside footer header form blockquote".split())

_TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/](?P<odd>[^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


NO, GUESS, YES = 0, 1, 2


def _named_chrome(value: str) -> int:
    """What a class or id says: ``YES`` for a whole name or a word for comments or adverts, ``GUESS`` for a part of a longer name."""
    found = NO
    for word in value.split():
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        if any(p in COMMENT_WORDS or p in ADVERT_WORDS for p in parts) or (parts and all(p in LAYOUT_WORDS for p in parts)):
            return YES
        if any(p in LAYOUT_WORDS for p in parts):
            found = GUESS
    return found


def _chrome(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element is no part of the main text, by its name and attributes."""
    if name in CHROME or (name == "header" and not in_article):
        return YES
    if not attrs or name in ("html", "body", "main"):
        return NO
    found = NO
    for match in _ATTRIBUTE.finditer(attrs):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if name == "article":
            # A reader's comment may be an article; other words say how an article is laid out.
            if key == "class" and any(re.split(r"[^a-z]+", word)[0] in COMMENT_WORDS for word in value.split()):
                return YES
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return YES
        if key == "role" and value in CHROME_ROLES:
            return YES
        if key in ("class", "id"):
            found = max(found, _named_chrome(value))
            if found == YES:
                return YES
    return found


class _Open:
    """The open elements, with the places of the names that ends are looked up by."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, *state) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, *state))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()

    def last(self, name: str) -> int:
        """The depth of the innermost open element of that name, or -1."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def close_implied(self, name: str) -> None:
        """End the elements that the start of ``name`` ends."""
        for open_name, starts in CLOSES.items():
            depth = self.last(open_name) if name in starts else -1
            if depth >= 0:
                passed = ("td", "th") if open_name == "tr" else ()
                if depth > max(self.last(b) for b in BARRIERS if b != open_name and b not in passed):
                    self.cut(depth)


_PAGE_PART = re.compile(r"<(?:(article|main|h1)[\s>]|/form[\s>])", re.I)


def _page_forms(source: str) -> list[int]:
    """The starts of forms' ends and of page parts in order, the latter as negative numbers."""
    return [-m.start() if m[1] else m.start() for m in _PAGE_PART.finditer(source)]


def _holds_page(parts: list[int], at: int) -> bool:
    """Whether a form that starts at ``at`` has an article, main part or top heading before it ends."""
    after = bisect_right(parts, at, key=abs)
    return after < len(parts) and parts[after] < 0


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """The page's visible blocks in order: what markup says of each (``KEEP`` and so on), and its text.

    Character references are decoded and white space runs become one space. A
    ``br`` is white space. Unclosed and misnested tags, comments and pages that
    end inside a tag or reference are read as far as they go, in time linear
    in the page. A form around the page's article or heading is no chrome.
    """
    source = page or ""
    opened = _Open()
    out: list[tuple[int, str]] = []
    text: list[str] = []
    parts: list[int] | None = None

    def state() -> tuple[bool, int, bool]:
        return opened.stack[-1][1:] if opened.stack else (False, NO, False)

    def flush() -> None:
        if text:
            words = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            hidden, chrome, article = state()
            if words and not hidden:
                kind = DROP if chrome == YES else (GUESS_IN if article else GUESS_OUT) if chrome == GUESS else KEEP if article else OPEN
                out.append((kind, words))

    at, lowered = 0, None
    while True:
        match = _TAG.search(source, at)
        if not match:
            if not state()[0]:
                text.append(source[at:])
            break
        if not state()[0] and match.start() > at:
            text.append(source[at : match.start()])
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            depth = opened.last(name)
            if (name == "p" and depth < 0) or (depth >= 0 and (name in BLOCKS or name in HIDDEN)):
                flush()
            if depth >= 0:
                opened.cut(depth)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS or name in HIDDEN:
            flush()
        opened.close_implied(name)
        if name in VOID:
            continue
        attrs = match["attrs"] or ""
        if attrs.rstrip().endswith("/") and name in ("svg", "path", "g"):
            continue
        hidden, chrome, article = state()
        said = _chrome(name, attrs, article or (name in ("article", "main") and chrome != YES))
        if name == "form" and said == YES:
            parts = _page_forms(source) if parts is None else parts
            said = NO if _holds_page(parts, match.start()) else YES
        chrome = max(chrome, said)
        article = article or (name in ("article", "main") and chrome != YES)
        if name in ("article", "main") and chrome == GUESS:
            chrome = NO  # an article inside a part that was only guessed to be chrome
        hidden = hidden or name in HIDDEN
        if name in RAW:
            if lowered is None:
                lowered = source.lower()
                if len(lowered) != len(source):  # a letter whose lower case is longer
                    lowered = source
            end = lowered.find(f"</{name}", at)
            at = len(source) if end < 0 else end
            if end >= 0:
                stop = source.find(">", end)
                at = len(source) if stop < 0 else stop + 1
            continue
        opened.push(name, hidden, chrome, article)
    flush()
    return out


# -------------------------------------------------------------------- suffix arrays


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer sequence, in their order, by prefix doubling."""
    n = len(tokens)
    if n < 2:
        return np.arange(n)
    _, rank = np.unique(tokens, return_inverse=True)
    rank, width = rank.astype(np.int64) + 1, 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] if width < n else second[:0]
        key = rank * (rank.max() + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if rank.max() == n or width >= n:
            return order
        width *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Equal leading tokens, up to ``most``, of each suffix and the one before it in order."""
    n = len(tokens)
    padded = np.concatenate([tokens, -1 - np.arange(most)])
    out, alive = np.zeros(n, dtype=np.int64), np.ones(max(n - 1, 0), dtype=bool)
    for k in range(most):
        alive &= padded[order[1:] + k] == padded[np.minimum(order[:-1] + k, n + most - 1)]
        out[1:] += alive
    return out


def _stream(pages: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the pages' blocks one after another with a separator of its own after each page, and page numbers."""
    tokens, owner = [], []
    for i, words in enumerate(pages["tokens"]):
        own = np.frombuffer(words, dtype=np.int64)
        tokens += [own, np.array([-2 - i], dtype=np.int64)]
        owner.append(np.full(len(own) + 1, i))
    return np.concatenate(tokens), np.concatenate(owner)


def _groups(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream's suffixes of full length in order, and their group of equal first ``RUN_TOKENS`` tokens."""
    order = suffix_array(tokens)
    prefixes = common_prefixes(tokens, order, RUN_TOKENS)
    group = np.cumsum(prefixes < RUN_TOKENS)
    bad = np.concatenate([[0], np.cumsum(tokens < 0)])
    stop = np.minimum(order + RUN_TOKENS, len(tokens))
    whole = (order + RUN_TOKENS <= len(tokens)) & (bad[stop] == bad[order])
    return order[whole], group[whole]


def _run_names(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    name = np.zeros(len(starts), dtype=np.uint64)
    for k in range(RUN_TOKENS):
        name = (name ^ tokens[starts + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def _short_runs(pages: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, stops, names)`` of whole neighbouring blocks with ``LEAST_TOKENS`` tokens and fewer than ``RUN_TOKENS``."""
    starts, stops, names, first = [], [], [], 0
    for words, lengths in zip(pages["tokens"], pages["lengths"]):
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(int).tolist()
        for i in range(len(ends) - 1):
            j = i + 1
            while j < len(ends) - 1 and ends[j] - ends[i] < LEAST_TOKENS:
                j += 1
            if LEAST_TOKENS <= ends[j] - ends[i] < RUN_TOKENS:
                starts.append(first + ends[i])
                stops.append(first + ends[j])
                names.append(xxhash.xxh64_intdigest(words[8 * ends[i] : 8 * ends[j]] + bytes(e - ends[i] for e in ends[i + 1 : j + 1])))
        first += ends[-1] + 1
    return np.array(starts, dtype=np.int64), np.array(stops, dtype=np.int64), np.array(names, dtype=np.uint64).view(np.int64)


def _all_runs(pages: pd.DataFrame, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, stops, names)`` of every run in the shard's stream."""
    bad = np.concatenate([[0], np.cumsum(tokens < 0)])
    starts = np.arange(max(0, len(tokens) - RUN_TOKENS + 1))
    starts = starts[bad[starts + RUN_TOKENS] == bad[starts]]
    short = _short_runs(pages)
    return tuple(np.concatenate(c) for c in zip((starts, starts + RUN_TOKENS, _run_names(tokens, starts)), short))


def _frame(columns: dict, **types: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(columns[c], dtype=t) for c, t in types.items()})


def _shard_runs(pages: pd.DataFrame) -> pd.DataFrame:
    """Every run of the shard once, with the number of pages that hold it."""
    tokens, owner = _stream(pages)
    starts, group = _groups(tokens)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(group))))
    held = np.unique(place * len(pages) + owner[starts])
    count = np.bincount(held // len(pages), minlength=len(heads))
    short, _, short_names = _short_runs(pages)
    pairs = pd.DataFrame({"run": short_names, "page": owner[short]}).drop_duplicates().groupby("run").size()
    run = np.concatenate([_run_names(tokens, starts[heads]), pairs.index.to_numpy(dtype=np.int64)])
    count = np.concatenate([count, pairs.to_numpy(dtype=np.int64)])
    if pages["shards"].iloc[0] == 1:  # no other shard can hold the run
        run, count = run[count > 1], count[count > 1]
    return _frame({"site": np.full(len(run), pages["site"].iloc[0]), "shard": np.full(len(run), pages["shard"].iloc[0]), "run": run, "pages": count}, site="int64", shard="int64", run="int64", pages="int64")


def _known(names: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are among ``runs``, and their places in the sorted ``runs``."""
    at = np.minimum(np.searchsorted(runs, names), len(runs) - 1)
    return runs[at] == names, at


def _shard_texts(pages: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """``(site, shard, run, text)``: runs that enough pages hold, with up to ``MANY_TEXTS`` names of texts of the shard's pages.

    ``counted`` has the shard's runs that two pages of the host hold, and how many do.
    """
    tokens, owner = _stream(pages)
    starts, stops, names = _all_runs(pages, tokens)
    counted = counted.sort_values("run")
    runs, counts = counted["run"].to_numpy(dtype=np.int64), counted["pages"].to_numpy(dtype=np.int64)
    found, at = _known(names, runs)
    starts, stops, names, count = starts[found], stops[found], names[found], counts[at[found]]
    # A token is as common as the most common run that covers it.
    common = np.ones(len(tokens), dtype=np.int64)
    for k in range(RUN_TOKENS):
        reach = starts + k < stops
        np.maximum.at(common, starts[reach] + k, count[reach])
    first = np.searchsorted(owner, np.arange(len(pages)))
    by_page = np.argsort(owner[starts], kind="stable")
    page_runs = np.split(by_page, np.searchsorted(owner[starts][by_page], np.arange(1, len(pages))))
    texts = []
    for i, (key, article, article_tokens, lengths, numbers) in enumerate(zip(*(pages[c] for c in ("page_key", "article", "article_tokens", "lengths", "numbers")))):
        is_open = np.repeat(np.asarray(numbers) >= 0, lengths)
        own = np.sort(common[first[i] : first[i] + len(is_open)][is_open])
        if article_tokens and article_tokens >= len(own):
            texts.append(article)
            continue
        level = own[max(int(np.ceil(OWN * len(own))) - 1, 0)] if len(own) else 1
        mine = page_runs[i]
        inside = is_open[starts[mine] - first[i]] & is_open[stops[mine] - 1 - first[i]]
        mine = mine[inside & (count[mine] <= level)]
        # The smallest of the rare runs is the same in copies, whatever else differs on the page.
        texts.append(int(names[mine].min()) if level > 1 and len(mine) else key)
    many = count >= MANY_TEXTS
    seen = pd.DataFrame({"run": names[many], "text": np.array(texts, dtype=np.int64)[owner[starts[many]]]}).drop_duplicates()
    seen = seen[seen.groupby("run").cumcount() < MANY_TEXTS]
    return _frame({"site": np.full(len(seen), pages["site"].iloc[0]), "shard": np.full(len(seen), pages["shard"].iloc[0]), "run": seen["run"].to_numpy(), "text": seen["text"].to_numpy()}, site="int64", shard="int64", run="int64", text="int64")


def _covered_blocks(pages: pd.DataFrame, shared: np.ndarray) -> list[tuple[int, list[int]]]:
    """For each page key, the open blocks that shared runs cover."""
    tokens, owner = _stream(pages)
    hits = np.zeros(len(tokens) + 1, dtype=np.int64)
    starts, stops, names = _all_runs(pages, tokens)
    found, _ = _known(names, np.sort(shared))
    np.add.at(hits, starts[found], 1)
    np.add.at(hits, stops[found], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hits[:-1]) > 0)])
    first = np.searchsorted(owner, np.arange(len(pages)))
    out = []
    for i, (key, lengths, numbers) in enumerate(zip(pages["page_key"], pages["lengths"], pages["numbers"])):
        ends = first[i] + np.cumsum(lengths)
        share = covered[ends] - covered[ends - np.asarray(lengths)]
        gone = [int(n) for n, c, size in zip(numbers, share, lengths) if n >= 0 and c >= COVERED * size]
        if gone:
            out.append((int(key), gone))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host; a null or odd url has the host ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_key(html: Column) -> Column:
    return F.xxhash64(F.coalesce(html, F.lit("")))


def boilerplate(pages: DataFrame) -> DataFrame:
    """``(host, page_key, gone)``: numbers of a page's open blocks that repeat on other texts of its host.

    ``pages`` has ``host``, ``page_key`` and ``html``. Pages with equal keys are
    copies of one page, and pages of one text do not make each other boilerplate.
    """
    token_type = "host string, page_key long, tokens binary, lengths array<int>, numbers array<int>, n int, article long, article_tokens int"
    schema = pa.schema([("host", pa.string()), ("page_key", pa.int64()), ("tokens", pa.binary()), ("lengths", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32())), ("n", pa.int32()), ("article", pa.int64()), ("article_tokens", pa.int32())])
    digest = xxhash.xxh64_intdigest

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, key, html in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, lengths, numbers, article = [], [], [], []
                for i, (kind, text) in enumerate(blocks_of(html)):
                    if kind == KEEP:
                        article.append(text)
                    else:
                        own = [digest(utf8(w)) >> 1 for w in text.split()]
                        tokens += own
                        lengths.append(len(own))
                        numbers.append(-1 if kind == DROP else i)
                if tokens:
                    article = " ".join(article)
                    out.append((host, key, np.array(tokens, np.int64).tobytes(), lengths, numbers, len(tokens), digest(utf8(article)) >> 1, len(article.split())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    tokens = cut_lineage(pages.select("host", "page_key", "html").mapInArrow(streams, token_type).dropDuplicates(["host", "page_key"]))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("n") / SHARD_TOKENS)).cast("int").alias("shards")
    # Hosts have numbers, so that rows of runs are short.
    plan = cut_lineage(tokens.groupBy("host").agg(shards).withColumn("site", F.monotonically_increasing_id()))
    size = 64 * plan.count()
    dealt = tokens.join(measured(plan, size), "host").withColumn("shard", F.pmod("page_key", F.col("shards")).cast("long"))
    by_shard = dealt.groupBy("site", "shard")
    runs = cut_lineage(by_shard.applyInPandas(_shard_runs, "site long, shard long, run long, pages long"))
    # Totals return to the shards that reported the run: no shard gets more runs than it holds.
    totals = runs.groupBy("site", "run").agg(F.sum("pages").alias("total")).where("total > 1")
    counted = runs.select("site", "shard", "run").join(totals, ["site", "run"]).select("site", "shard", "run", F.col("total").alias("pages"))

    def texts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = {"site": [], "shard": [], "run": [], "text": []}
        return _shard_texts(left, right) if len(left) and len(right) else _frame(nothing, site="int64", shard="int64", run="int64", text="int64")

    seen = cut_lineage(by_shard.cogroup(counted.groupBy("site", "shard")).applyInPandas(texts, "site long, shard long, run long, text long"))
    shared = seen.groupBy("site", "run").agg(F.countDistinct("text").alias("texts")).where(F.col("texts") >= MANY_TEXTS).select("site", "run")
    spread = seen.select("site", "shard", "run").distinct().join(shared, ["site", "run"]).select("site", "shard", "run")

    def covered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _covered_blocks(left, right["run"].to_numpy(dtype=np.int64)) if len(left) and len(right) else []
        host = left["host"].iloc[0] if len(left) else None
        columns = {"host": ([host] * len(found), object), "page_key": ([k for k, _ in found], "int64"), "gone": ([g for _, g in found], object)}
        return pd.DataFrame({c: pd.Series(v, dtype=t) for c, (v, t) in columns.items()})

    return by_shard.cogroup(spread.groupBy("site", "shard")).applyInPandas(covered, "host string, page_key long, gone array<int>")


@F.pandas_udf(StringType())
def _main_text(html: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for page, numbers in zip(html, gone):
        drop = set() if numbers is None else set(numbers.tolist())
        blocks = blocks_of(page)
        # Outside an article a guess at chrome stands if the page has an article.
        out_kinds = (OPEN, GUESS_IN) if any(kind == KEEP for kind, _ in blocks) else (OPEN, GUESS_IN, GUESS_OUT)
        out.append("\n".join(text for i, (kind, text) in enumerate(blocks) if kind == KEEP or (kind in out_kinds and i not in drop)))
    return pd.Series(out, dtype=object)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each page added as ``name``; blocks are joined by line ends.

    Null and empty pages have an empty text. Pages of one host are compared;
    null and odd urls share the host ''. Repeated rows and copies of a page get
    equal texts, and pages of one text do not count as repeats of each other. A column called
    ``name`` is replaced, all others are kept.
    """
    keyed = pages.withColumns({"__host": host_of(F.col(url_col)), "__page": _page_key(F.col(html_col))})
    gone = cut_lineage(boilerplate(keyed.select(F.col("__host").alias("host"), F.col("__page").alias("page_key"), F.col(html_col).alias("html"))))
    size = gone.agg(F.sum(64 + F.length("host") + 4 * F.size("gone"))).first()[0]
    gone = gone.select(F.col("host").alias("__gone_host"), F.col("page_key").alias("__gone_page"), F.col("gone").alias("__gone"))
    joined = keyed.join(measured(gone, size), (F.col("__host") == F.col("__gone_host")) & (F.col("__page") == F.col("__gone_page")), "left")
    return joined.withColumn(name, _main_text(F.col(html_col), F.col("__gone"))).drop("__host", "__page", "__gone_host", "__gone_page", "__gone")
