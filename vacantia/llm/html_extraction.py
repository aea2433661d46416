"""Main text of web pages with the suffixes of each host's pages.

A page becomes a stream of text blocks. Long token runs that occur on two different pages of a host or more are the
site's boilerplate. Blocks that such runs cover lose them and keep only their own unique runs. Text inside an article
or main element is the main text unless many pages have the run, as some pages quote each other; and an article that
such runs cover for the most part is a near copy of others, which stays whole. What remains is then checked by the
markup: menus, headers, footers, sidebars, notices, adverts, forms and reader comments are never main text.

No host is ever one task. Equal runs begin suffixes that are neighbours in the host's suffix array. Suffixes are dealt
by host and name, so equal ones meet whatever the size of the host: first only those of the runs' anchors (the least
few tokens in a run, which equal runs share), then the runs themselves where an anchor occurs often enough.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.tables import SLICE, per_text

# Tokens that make a run long.
RUN = 12
# A block is boilerplate if repeated runs cover this share of its tokens.
COVERED = 0.5
# Pages of a host that make a run boilerplate inside an article too.
MANY = 5
# Tokens whose runs a task names at a time, and different words it remembers.
PART_TOKENS = 1 << 15
KEPT = 1 << 20
# Tokens of an anchor, and bytes of the names of anchors (which only have to tell what cannot be repeated) and of runs.
GRAM = 5
SHORT, WHOLE = 4, 8
# What a dealt name asks: whether two pages have it, whether ``many`` have it; and the most pages that a batch counts,
# in the same byte. ``many`` is no more than that.
ASKS_TWO, ASKS_MANY, MOST = 64, 128, 63
# Places that a task deals at a time, and buckets for each partition of the pages.
DEALT = 1 << 17
PARTS = 4

# Elements whose content is no text of the page.
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are never main text.
_BESIDE = frozenset("nav footer aside form button select textarea label fieldset dialog menu".split())
_MAIN = frozenset(("article", "main"))
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img input".split()
)
# An open one of these ends where another of them begins.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDED = {name: [n for n, by in _ENDS.items() if name in by] for name in {x for by in _ENDS.values() for x in by}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id attributes that name what is never main text; the second list holds outside articles only,
# the third is all that counts for an article element itself.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification popup modal overlay newsletter subscribe subscription paywall social share "
    "sharing related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs comment "
    "comments commentlist respond disqus login signup widget toolbar pagination pager skip".split()
)
_OUTER_HINTS = frozenset("header footer masthead topbar bottom legal copyright".split())
_ARTICLE_HINTS = frozenset("ad ads advert advertisement comment comments promo sponsored related teaser".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|[^<]+|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+|[0-9]+")

SURE, UNDECIDED, BESIDE = 0, 1, 2


def _state(name: str, rest: str, above: int) -> int | None:
    """What the text in an element is, given what it would be outside: None if it is no text at all."""
    if name in _SILENT:
        return None
    if above == BESIDE:
        return BESIDE
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
    words = set(_NAME.findall(found.get("class", "") + " " + found.get("id", "")))
    role = found.get("role", "")
    if name in _MAIN or role in _MAIN or "articlebody" in found.get("itemprop", ""):
        return BESIDE if words & _ARTICLE_HINTS else SURE
    if name in ("html", "body"):
        return above
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    if name in _BESIDE or hidden or role in _ROLES or words & _HINTS:
        return BESIDE
    if above == UNDECIDED and (name == "header" or words & _OUTER_HINTS):
        return BESIDE
    return above


def blocks_of(page: str) -> list[tuple[str, int]]:
    """Blocks of a page in order: text with white space folded, and its state.

    Markup may be broken: an end without a beginning is passed over, an element without an end lasts as long as
    the one around it.
    """
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    # Open elements: name, and the state of their text (None: silent); and how many of a name are open, so that an end
    # without a beginning looks for none.
    stack: list[tuple[str, int | None]] = [("", UNDECIDED)]
    opened: Counter[str] = Counter()

    def close() -> None:
        state = stack[-1][1]
        if parts and (text := " ".join(html.unescape("".join(parts)).split())) and state is not None:
            blocks.append((text, state))
        parts.clear()

    def drop(to: int) -> None:
        if any(n not in _INLINE for n, _ in stack[to:]) or stack[to - 1][1] != stack[-1][1]:
            close()
        opened.subtract(n for n, _ in stack[to:])
        del stack[to:]

    at = 0
    while token := _TOKEN.match(page, at):
        at = token.end()
        name = token["name"] or token["name2"]
        if name is None:
            if page[token.start()] != "<" or at == token.start() + 1:
                if stack[-1][1] is not None:
                    parts.append(token[0])
            continue
        name = name.lower()
        if token["end"] or token["end2"]:
            for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    drop(depth)
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE:
            # A paragraph ends where any block begins, an item where its sibling begins.
            ended = opened["p"] or any(opened[n] for n in _ENDED.get(name, ()))
            for depth in range(len(stack) - 1, 0, -1) if ended else ():
                open_name = stack[depth][0]
                if open_name == "p" or name in _ENDS.get(open_name, ()):
                    drop(depth)
                    break
                if open_name not in _INLINE:
                    break
            close()
        if name in _VOID:
            continue
        rest = token["rest"] if token["name"] else token["rest2"]
        above = stack[-1][1]
        state = None if above is None else _state(name, rest or "", above)
        if state != above and name in _INLINE:
            close()
        if not (rest or "").endswith("/") or name in _INLINE:
            stack.append((name, state))
            opened[name] += 1
        if state is None and name in ("script", "style"):
            # Their text ends at the end tag only, whatever it looks like.
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    close()
    return blocks


def _parse() -> Callable[[list[bytes | None]], list[dict]]:
    def one(page: bytes | None) -> dict:
        found = blocks_of((page or b"").decode(errors="replace"))
        return {"blocks": [{"text": t, "state": s} for t, s in found]}

    return lambda pages: [one(p) for p in pages]


def _packed() -> Callable:
    """A column function of a page's host and markup: its host and blocks in a few bytes."""

    def one(host: str, page: bytes | None) -> bytes:
        blocks = blocks_of((page or b"").decode(errors="replace"))
        # The text of a block has no line break.
        lines = [json.dumps(host), "".join(str(s) for _, s in blocks), *(t for t, _ in blocks)]
        return zlib.compress("\n".join(lines).encode())

    @F.arrow_udf("binary")
    def pack(hosts: pa.Array, pages: pa.Array) -> pa.Array:
        out, texts = [], pages.cast(pa.large_binary())
        for at in range(0, len(texts), SLICE):
            out += map(one, hosts.slice(at, SLICE).to_pylist(), texts.slice(at, SLICE).to_pylist())
        return pa.array(out, pa.binary())

    return pack


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``record`` (columns to keep), ``row`` (rows with the same number are repeated rows), ``host``, ``copy`` (pages with
    the same copy number are copies of one page of a host), the ``blocks`` with their states in order, and both host and
    blocks as a ``page`` of a few bytes."""
    blocks = per_text(_parse, "blocks array<struct<text:string,state:int>>")(F.col("html"))["blocks"]
    # A null url has no host; such pages are taken as one site.
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("record"),
        F.xxhash64(*[F.col(f"`{c}`") for c in keep], "url", "html").alias("row"),
        host.alias("host"),
        F.xxhash64(host, "html").alias("copy"),
        blocks.alias("blocks"),
        _packed()(host, "html").alias("page"),
    )


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` or more tokens that occurs on two different pages.

    ``tokens`` are numbers of the concatenated streams, ``page`` the number of each token's page. Suffixes are
    ranked by one token, then two, four, ... until the rank decides ``run`` tokens; suffixes of equal rank are
    neighbours in the suffix array, and their run is repeated if their pages differ. It is what ``repeated_places``
    must find over all tasks, for streams that one task can hold.
    """
    count = len(tokens)
    if count < run:
        return np.zeros(count, bool)
    # A token that ends a page is followed by nothing that could be equal elsewhere.
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        joined = rank[: len(rank) - step] * (count + 1) + rank[step:]
        rank = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        width += step
    inside = page[: len(rank)] == page[width - 1 :]
    starts = np.nonzero(inside)[0]
    order = starts[np.lexsort((page[starts], rank[starts]))]
    if not len(order):
        return np.zeros(count, bool)
    # The suffix array in stretches of equal rank; within one, pages ascend, so its ends tell whether they differ.
    first = np.append(True, np.diff(rank[order]) != 0)
    group = np.cumsum(first) - 1
    ends = np.append(np.nonzero(first)[0][1:], len(order)) - 1
    shared = page[order[np.nonzero(first)[0]]] != page[order[ends]]
    edges = np.zeros(count + 1, np.int64)
    hits = order[shared[group]]
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + width, -1)
    return np.cumsum(edges)[:count] > 0


def unique_runs(blocks: list[list[str]], share: float = COVERED) -> Callable[[np.ndarray], list[str]]:
    """What stays of a page's blocks, given which of their tokens are covered."""

    def kept(covered: np.ndarray) -> list[str]:
        out, at = [], 0
        for words in blocks:
            own = covered[at : at + len(words)]
            at += len(words)
            if own.sum() < share * len(words):
                out.append(" ".join(words))
                continue
            cuts = np.nonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8)))[0].reshape(-1, 2)
            out.append(" ".join(" ".join(words[a:b]) for a, b in cuts.tolist()))
        return out

    return kept


def unpacked(page: bytes) -> tuple[str, list[int], list[str]]:
    """A page's host, and the states and texts of its blocks."""
    host, states, *texts = zlib.decompress(page).decode().split("\n")
    return json.loads(host), [int(x) for x in states], texts


class _Numbers(dict):
    """64 bits for a word."""

    def __missing__(self, word: str) -> int:
        number = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = number
        return number


def _joined(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    names = names * np.uint64(0x9E3779B97F4A7C15) + values
    names ^= names >> np.uint64(29)
    return names


def gram_names(values: np.ndarray, sites: np.ndarray, size: int) -> np.ndarray:
    """64 bits for the ``size`` tokens at each place; those of different hosts have different names."""
    count = max(len(values) - size + 1, 0)
    names = sites[:count]
    for at in range(size):
        names = _joined(names, values[at : at + count])
    return names


def anchors(names: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring names is, the leftmost of equal ones."""
    mixed = names * np.uint64(0xD6E8FEB86659FD93)
    count = max(len(names) - width + 1, 0)
    least, where = mixed[:count].copy(), np.arange(count)
    for at in range(1, width):
        other = mixed[at : at + count]
        less = other < least
        least[less], where[less] = other[less], np.nonzero(less)[0] + at
    return where


def _shut(numbers: np.ndarray) -> bytes:
    steps = np.diff(numbers, prepend=0).astype("<i4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _opened(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4")[:, 0], dtype=np.int64)


def _batch(copies: np.ndarray, page: np.ndarray, at: np.ndarray, needs: np.ndarray, asks: np.ndarray, names: np.ndarray, width: int, buckets: int) -> list[dict]:
    """Rows of some pages' named places: the different names with the number of pages that have them and what they ask,
    dealt to buckets, and one row (with ``copies``) that tells the places of each name."""
    different, first, entry = np.unique(names, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    different, entry = different[order], rank[entry]
    pages = np.bincount(np.unique(entry * len(copies) + page) // len(copies), minlength=len(different))
    asked = sum((np.bincount(entry, asks & bit, len(different)) > 0) * bit for bit in (ASKS_TWO, ASKS_MANY))
    count = (np.minimum(pages, MOST) | asked).astype(np.uint8)
    batch = int.from_bytes(blake2b(copies.tobytes(), digest_size=8).digest(), "little", signed=True)
    listed = needs > 0
    rows = [
        {
            "key": batch % buckets,
            "batch": batch,
            "entry": _shut(entry[listed]),
            "count": zlib.compress(needs[listed].astype(np.uint8).tobytes(), 1),
            "page": _shut(page[listed]),
            "at": _shut(at[listed]),
            "copies": copies.tobytes(),
        }
    ]
    # The bucket tells a part of the name.
    rest, key = np.divmod(different, np.uint64(buckets))
    dealt = np.argsort(key, kind="stable")
    for own in np.split(dealt, np.nonzero(np.diff(key[dealt]))[0] + 1):
        rows.append(
            {
                "key": int(key[own[0]]),
                "batch": batch,
                "names": rest[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
                "entry": _shut(own),
                "count": zlib.compress(count[own].tobytes(), 1),
            }
        )
    return rows


_DEALT = pa.schema(
    [("key", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("names", "entry", "count", "page", "at", "copies")]]
)
_DEALT_DDL = "key int, batch long, names binary, entry binary, count binary, page binary, at binary, copies binary"


def _deal_task(run: int, piece: int, buckets: int, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names the anchors of all pages or, if ``exact``, the runs whose anchor is among the page's ``places``."""
    width, gram = WHOLE if exact else SHORT, min(GRAM, run)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        held: list[tuple] = []
        found: list[tuple[np.ndarray, ...]] = []
        copies: list[int] = []
        tokens = 0

        def named() -> None:
            sizes = [len(x[1]) for x in held]
            page = np.repeat(np.arange(len(held)), sizes)
            sites = np.repeat(np.array([x[0] for x in held], np.uint64), sizes)
            values, state, at, shared = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            short = gram_names(values, sites, gram)
            anchor = anchors(short, run - gram + 1)
            starts = np.nonzero((page[: len(anchor)] == page[run - 1 :]) & (at[run - 1 :] - at[: len(anchor)] == run - 1))[0]
            starts = starts[shared[anchor[starts]]]
            # Where repeated runs count: beside articles any, in them those of many pages, in menus none.
            two, often = (x[starts + run] > x[starts] for x in (np.concatenate(([0], np.cumsum(state == s))) for s in (UNDECIDED, SURE)))
            asks = two * ASKS_TWO + often * ASKS_MANY
            if exact:
                places, needs = starts, np.where(two, 1, np.where(often, 2, 0))
                names = sites[starts]
                for i in range(run):
                    names = _joined(names, values[starts + i])
            else:
                asked = np.zeros(len(values), np.int64)
                for bit in (ASKS_TWO, ASKS_MANY):
                    asked[np.unique(anchor[starts[(asks & bit) > 0]])] |= bit
                places = np.unique(anchor[starts])
                names, asks, needs = short[places], asked[places], np.ones(len(places), np.int64)
            if len(places):
                found.append((page[places] + len(copies), at[places], needs, asks, names))
                copies.extend(x[5] for x in held)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                rows = _batch(np.array(copies, np.int64), *(np.concatenate(x) for x in zip(*found)), width, buckets)
                for at in range(0, len(rows), SLICE):
                    yield pa.RecordBatch.from_pylist(rows[at : at + SLICE], _DEALT)
            found.clear()
            copies.clear()

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                for row in batch.slice(at, SLICE).to_pylist():
                    host, states, texts = unpacked(row["page"])
                    words = " ".join(texts).split()
                    if len(words) < run:
                        continue
                    state = np.repeat(np.array(states, np.int8), [t.count(" ") + 1 for t in texts])
                    own, shared = np.arange(len(words)), np.ones(len(words), bool)
                    if exact:
                        # Runs of an anchor lie in the tokens about it.
                        met, _ = _placed(row["places"])
                        about = covered(np.maximum(met - run + gram, 0), len(words) + 2 * run, 2 * run - gram)[: len(words)]
                        own, shared = np.nonzero(about)[0], np.isin(own, met)[about]
                        words, state = [words[i] for i in own], state[about]
                    values = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
                    held.append((numbers[host], values, state, own, shared, row["copy"]))
                    tokens += len(own)
                    if tokens >= piece:
                        named()
                        tokens = 0
                        if sum(len(x[0]) for x in found) >= DEALT:
                            yield from out()
                    if len(numbers) > KEPT:
                        numbers.clear()
        if held:
            named()
        yield from out()

    return task


def _meet(width: int, many: int) -> Callable[[pa.Table], pa.Table]:
    """Names of a bucket that as many pages have as they ask for, told to their batches with whether ``many`` have them."""

    def meet(bucket: pa.Table) -> pa.Table:
        rows = bucket.to_pylist()
        out, dealt = [r for r in rows if r["copies"]], [r for r in rows if not r["copies"]]
        if dealt:
            short = np.frombuffer(b"".join(r["names"] for r in dealt), np.uint8).reshape(-1, width)
            full = np.zeros((len(short), 8), np.uint8)
            full[:, :width] = short
            counts = np.frombuffer(b"".join(zlib.decompress(r["count"]) for r in dealt), np.uint8)
            _, name = np.unique(full.view("<u8")[:, 0], return_inverse=True)
            pages = np.bincount(name, counts & MOST)
            two, often = (np.bincount(name, counts & bit) > 0 for bit in (ASKS_TWO, ASKS_MANY))
            level = (((pages > 1) & two | (pages >= many) & often) * (1 + (pages >= many)))[name]
            at = 0
            for r in dealt:
                own = level[at : at + len(r["names"]) // width]
                at += len(own)
                if (met := own > 0).any():
                    often = (own[met] > 1).astype(np.uint8)
                    out.append({"batch": r["batch"], "entry": _shut(_opened(r["entry"])[met]), "count": zlib.compress(often.tobytes(), 1)})
        return pa.Table.from_pylist(out, _DEALT)

    return meet


def _told(batch: pa.Table) -> pa.Table:
    """The places of a batch's pages that have a name which has been met elsewhere."""
    rows = batch.to_pylist()
    whole = next(r for r in rows if r["copies"])
    copies, page, at, entry = np.frombuffer(whole["copies"], np.int64), *(_opened(whole[c]) for c in ("page", "at", "entry"))
    level = np.zeros(1 + max([entry.max(initial=0), *(_opened(r["entry"])[-1] for r in rows if not r["copies"])]), np.uint8)
    for r in rows:
        if not r["copies"]:
            level[_opened(r["entry"])] = 1 + np.frombuffer(zlib.decompress(r["count"]), np.uint8)
    kept = level[entry] >= np.frombuffer(zlib.decompress(whole["count"]), np.uint8)
    page, places = page[kept], (2 * at + (level[entry] > 1))[kept]
    first = np.nonzero(np.diff(page, prepend=-1))[0]
    told = [_shut(own) for own in np.split(places, first[1:])] if len(page) else []
    return pa.table({"copy": pa.array(copies[page[first]]), "places": pa.array(told, pa.binary())})


def _placed(places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where a page's runs begin, and which of them are on many pages."""
    both = _opened(places)
    return both >> 1, (both & 1).astype(bool)


def _listed() -> Callable:
    """A column function of ``places`` in bytes: as an array."""

    @F.arrow_udf("array<struct<at:int,often:boolean>>")
    def listed(places: pa.Array) -> pa.Array:
        rows = [[{"at": a, "often": o} for a, o in zip(*(x.tolist() for x in _placed(p)))] for p in places.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("often", pa.bool_())])))

    return listed


def covered(starts: list[int] | np.ndarray, count: int, run: int = RUN) -> np.ndarray:
    """Which of ``count`` tokens lie in a run that begins at one of the places."""
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, np.array(starts, np.int64), 1)
    np.add.at(edges, np.array(starts, np.int64) + run, -1)
    return np.cumsum(edges)[:count] > 0


def _main(run: int, share: float) -> Callable:
    """A column function of ``page`` and ``places``: the page's main text."""

    def one(page: bytes, places: bytes | None) -> str:
        _, states, left = unpacked(page)
        if places:
            words = [x.split() for x in left]
            sizes = [len(x) for x in words]
            at, many = _placed(places)
            hits, often = (covered(x, sum(sizes), run) for x in (at, at[many]))
            sure = np.repeat([s == SURE for s in states], sizes)
            # An article that is repeated as a whole is a copy with few changes, not a part of the site.
            if often[sure].sum() >= share * sure.sum():
                often[:] = False
            left = unique_runs(words, share)(np.where(sure, often, hits))
        # The check by markup.
        return "\n\n".join(x for x, s in zip(left, states) if x and s != BESIDE)

    @F.arrow_udf("string")
    def main(pages: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(pages), SLICE):
            out += map(one, pages.slice(at, SLICE).to_pylist(), places.slice(at, SLICE).to_pylist())
        return pa.array(out, pa.string())

    return main


def packed(found: DataFrame) -> DataFrame:
    """``copy`` and ``page``, a row for each different page.

    The passes over the pages all read these two columns, so Spark shuffles them by ``copy`` once.
    """
    return found.select("copy", "page").dropDuplicates(["copy"])


def _met(pages: DataFrame, buckets: int, run: int, many: int, exact: bool) -> DataFrame:
    """``copy`` and ``places`` (in bytes) of the names that as many pages have as decide anything."""
    dealt = pages.mapInArrow(_deal_task(run, PART_TOKENS, buckets, exact), _DEALT_DDL)
    met = dealt.groupBy("key").applyInArrow(_meet(WHOLE if exact else SHORT, many), _DEALT_DDL)
    return met.groupBy("batch").applyInArrow(_told, "copy long, places binary")


def _places(pages: DataFrame, buckets: int, run: int, many: int) -> DataFrame:
    anchored = _met(pages, buckets, run, many, False)
    return _met(pages.join(anchored, "copy"), buckets, run, many, True)


def _buckets(found: DataFrame) -> int:
    return PARTS * found.rdd.getNumPartitions()


def repeated_places(found: DataFrame, run: int = RUN, many: int = MANY) -> DataFrame:
    """``copy`` and ``places``: where runs begin in its stream that are on another page of the host too, and whether
    ``many`` pages have them. Places that decide nothing are left out: in menus, and in articles unless often.

    First the anchors of runs are dealt by name, the least of the GRAM tokens in each: equal runs have equal anchors,
    and neighbouring runs mostly the same one. Runs are then dealt where as many pages have the anchor as decide
    anything. A batch of pages deals a name once, with the number of its pages, so neither a run on all pages nor a
    page with many copies makes a large group; buckets grow in number with the input, not in size.
    """
    places = _places(packed(found), _buckets(found), run, many)
    return places.select("copy", _listed()("places").alias("places"))


def extracted(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``text`` (blocks joined by an empty line) and ``n_chars`` of each page.

    A null or empty page, and a page of nothing but boilerplate, has an empty text. Repeated rows give a row each.
    """
    found = parsed(pages, keep)
    texts = packed(found)
    both = texts.join(_places(texts, _buckets(found), RUN, MANY), "copy", "left").join(found.select("copy", "record"), "copy")
    kept = [F.col(f"record.`{c}`").alias(c) for c in keep]
    return both.select(*kept, _main(RUN, COVERED)("page", "places").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    return extracted(pages, ["page_id", "url"])
