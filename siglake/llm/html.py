"""HTML main text by equivalence-class template deduction.

Pass 1 reads every page into tokens: an element's place (its path of container
tags with their first class, known by a digest made from its parent's) and the
text of a block at its place. Tokens of
one host that occur equally often on each of its pages, i.e. share an
occurrence vector, form an equivalence class. Vectors are compared by a
mergeable signature, the sum over pages of occurrences times a hash of the page
modulo 2 ** 64, so a hot host is just a larger partial sum. A class is valid
if it has least_size tokens or more and stands on least_pages pages or more;
its texts are the template's own and its places frame slots. Classes nest by
the paths of their places: what stands below a place once on nearly every page
lies in that slot, and sums over what lies below are made by pointer jumping. The article's slot is the innermost one that still holds
nearly all text and headings outside valid classes. All text in it is kept,
however many pages share it, so a slot inside an article element is never
chosen, nor one with less than half of a host's text. Where valid classes
leave next to nothing, as on a host of copies, all text counts.

Pass 2 extracts from every page what fills the slot. Neither pass shuffles
pages; hosts' templates (a path) are joined, by broadcast
where a count shows them to be few.

Menus, footers, sidebars, notices, adverts, forms and comments are known by
their elements and by words in class, id and role. In the article's slot, and
inside article and main elements, words tell nothing: there navigation, asides,
footers and forms go by their elements, and a box goes as reader comments or an
advert only if it is a container and every name in its class and id says so.
A header there is part of the article.

Edge cases. Null html: an empty page, empty text. Null url: a host of its own.
Repeated pages: a row each. Unclosed elements end with their parent; text after
a cut is kept. Long and deep pages: time and memory linear in their length, as
places are digests, end tags of nothing open are passed over, and no pattern
looks beyond the next angle bracket. Ties between slots: the deepest, then the
greatest digest. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import checked_broadcast, materialize
from siglake.llm.trie import rolled_up

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title|object|math|canvas|audio|video)\b[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^<>]*+>""",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that never nest in text, and so have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CONTAINERS = frozenset("html body main article section div header footer nav aside table tbody tr td ul ol form center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav footer aside form button dialog fieldset menu".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar nav navbar navigation menu header footer masthead comment comments reply replies respond disqus cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager widget copyright toolbar search".split()
)
CONTENT = frozenset("content main article post entry story body text page wrapper container".split())
CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"])}
SPACE = re.compile(r"\s+")


#: Names of boxes that hold nothing but reader comments or adverts, as far as whole names go.
BOX = re.compile(r"(?:(?:reader|user)[-_]?)?(?:comments?|repl(?:y|ies)|respond|disqus)(?:[-_]?(?:list|section|area|thread|block|box|wrapper|container))?|(?:ads?|adverts?|advertis(?:e?ments?|ing)|sponsored)(?:[-_]?(?:slot|block|box|banner|unit|wrapper|container))?", re.I)
BOXES = frozenset("div section aside ul ol ins figure".split())


def is_noise(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no article text. inside: in the article's slot, or within an article or main element."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if "=" not in attrs or name in ("html", "body", "main", "article"):
        return False
    if inside:
        if name not in BOXES:
            return False
        names = [x for m in ATTR.finditer(attrs) if m[1].lower() != "role" for x in (m[2] or m[3] or m[4] or "").split()]
        return bool(names) and all(BOX.fullmatch(x) for x in names)
    words = set()
    for m in ATTR.finditer(attrs):
        words.update(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()))
    found = words & NOISE
    return bool(found) and (not words & CONTENT or bool(found & {"comment", "comments", "sidebar", "footer"} and name != "section" and not words & {"main", "article", "wrapper", "container", "page"}))


ROOT = b""


def page_blocks(page: str, labelled: bool = True, main: bytes | None = None) -> tuple[list[tuple[bytes, str]], dict[bytes, list], set[int], list[bool]]:
    """The blocks as (place, text); for each place how often it occurs, its parent, its depth and whether it lies inside an article; which blocks are headings; which lie in the slot main. labelled: without blocks that their elements or classes mark as noise."""
    blocks: list[tuple[bytes, str]] = []
    heads: set[int] = set()
    own: list[bool] = []
    places: dict[bytes, list] = {}
    stack: list[tuple] = []  # name, and the state before it: place, depth, noise, inside article or main, inside article, in the slot
    opened: dict[str, int] = {}  # elements on the stack, by name
    place, depth, noise, inside, article, slot, held, at = ROOT, 0, False, False, False, False, [], 0

    def flush():
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                if stack and stack[-1][0] in HEADINGS:
                    heads.add(len(blocks))
                blocks.append((place, text))
                own.append(slot)
            held.clear()

    def push(name):
        stack.append((name, place, depth, noise, inside, article, slot))
        opened[name] = opened.get(name, 0) + 1

    def pop(k):
        nonlocal place, depth, noise, inside, article, slot
        if stack[k][0] not in INLINE:  # of those only noise is here, and it doesn't end a block
            flush()
        _, place, depth, noise, inside, article, slot = stack[k]
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if not noise and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if opened.get(name):
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name not in INLINE:
                flush()
            continue
        if name in INLINE:
            if name == "br" or name == "img":
                held.append(" ")
            elif labelled and not m["attrs"].endswith("/") and is_noise(name, m["attrs"], inside or slot):
                push(name)
                noise = True
            continue
        flush()
        closes = CLOSED_BY.get(name) or (frozenset(["p"]) if name not in VOID else None)
        if closes and any(opened.get(x) for x in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CONTAINERS and stack[k][0] not in closes:
                    break
                if stack[k][0] in closes:
                    pop(k)
                    break
        if name in VOID or m["attrs"].endswith("/"):
            continue
        push(name)
        noise = noise or (labelled and is_noise(name, m["attrs"], inside or slot))
        if name in CONTAINERS and not noise:
            first = next((x[2] or x[3] or x[4] or "" for x in ATTR.finditer(m["attrs"]) if x[1].lower() == "class"), "").split()
            parent, place, depth = place, xxhash.xxh3_128_digest(place + f"/{name}{'.' + first[0] if first else ''}".encode(errors="replace")), depth + 1
            places.setdefault(place, [0, parent, depth, article])[0] += 1
            slot = slot or place == main
        inside = inside or name in ("article", "main")
        article = article or name == "article"
    if not noise and at < len(page):
        held.append(page[at:])
    flush()
    return blocks, places, heads, own


def _hash(kind: str, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind.encode() + b"\0" + value)


def page_tokens(pages: DataFrame, labelled: bool = True) -> DataFrame:
    """host, token, place, is_text, of places also parent, depth and inside (an article), and summed over the host's pages: pages and total (occurrences), signature, chars and heads (of texts: characters, and headings)."""
    keys = [("host", pa.string()), ("token", pa.int64()), ("place", pa.binary()), ("is_text", pa.bool_()), ("parent", pa.binary()), ("depth", pa.int64()), ("inside", pa.bool_())]
    schema = pa.schema([*keys, *((c, pa.int64()) for c in ("pages", "total", "signature", "chars", "heads"))])

    def tokens(batches):
        sums: dict[tuple, list[int]] = {}

        def out():
            by, cols = list(zip(*sums)), list(zip(*sums.values()))
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            by[1], cols[2] = signed(by[1]), signed(cols[2])
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(by + cols, schema)], schema=schema)
            sums.clear()
            return batch

        for batch in batches:
            for i, url, host, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "host", "html"))):
                blocks, places, heads, _ = page_blocks(page or "", labelled)
                r = _hash("page", f"{i} {url}".encode(errors="replace"))
                here: dict[tuple, list[int]] = {(_hash("place", p), p, False, parent, depth, inside): [n, 0, 0] for p, (n, parent, depth, inside) in places.items()}
                here[_hash("place", ROOT), ROOT, False, None, 0, False] = [1, 0, 0]
                for k, (place, text) in enumerate(blocks):
                    t = here.setdefault((_hash("text", place + b"\0" + text.encode(errors="replace")), place, True, None, None, None), [0, 0, 0])
                    t[0] += 1
                    t[1] += len(text)
                    t[2] += k in heads
                for token, (n, chars, titles) in here.items():
                    s = sums.setdefault((host, *token), [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] = (s[2] + n * r) % (1 << 64)
                    s[3] += chars
                    s[4] += titles
                if len(sums) > 200_000:
                    yield out()
        if sums:
            yield out()

    rows = pages.mapInArrow(tokens, "host string, token bigint, place binary, is_text boolean, parent binary, depth bigint, inside boolean, pages bigint, total bigint, signature bigint, chars bigint, heads bigint")
    # signatures add modulo 2 ** 64: as two halves, which do not overflow
    halves = [F.sum(F.expr("signature & 4294967295L")).alias("low"), F.sum(F.expr("shiftrightunsigned(signature, 32)")).alias("high")]
    return (
        rows.groupBy("host", "token", "place", "is_text", "parent", "depth", "inside")
        .agg(*[F.sum(c).alias(c) for c in ("pages", "total", "chars", "heads")], *halves)
        .withColumn("signature", F.expr("struct(low & 4294967295L as low, (high + shiftrightunsigned(low, 32)) & 4294967295L as high)"))
        .drop("low", "high")
    )


def template_texts(tokens: DataFrame, *, least_pages: int = 3, least_size: int = 2) -> DataFrame:
    """The text tokens of valid classes. Tokens on fewer pages go before classes are formed, so a class is no larger than a host's template."""
    frequent = tokens.where(F.col("pages") >= least_pages)
    valid = frequent.groupBy("host", "signature").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return frequent.where("is_text").join(valid.select("host", "signature"), ["host", "signature"], "left_semi")


def templates(tokens: DataFrame, *, support: float = 0.95, held_text: float = 0.9, least_text: float = 0.5, least_left: float = 0.1, max_broadcast: int = 20_000, **classes) -> DataFrame:
    """host and main (place of the article's slot). Texts in the slot are never told apart by how often they occur, as an article may repeat on all pages of a host."""
    tokens = materialize(tokens, "tokens")
    texts = tokens.where("is_text").select("host", "place", "chars", "heads", F.col("chars").alias("left"), F.col("heads").alias("left_heads"))
    fixed = template_texts(tokens, **classes).select("host", "place", F.lit(0).alias("chars"), F.lit(0).alias("heads"), (-F.col("chars")).alias("left"), (-F.col("heads")).alias("left_heads"))
    values = ["chars", "heads", "left", "left_heads"]
    sums = [F.sum(c).alias(c) for c in values]
    direct = texts.union(fixed).groupBy("host", "place").agg(*sums)
    at = lambda place: F.unhex(F.md5(F.concat(F.col("host").cast("binary"), F.lit(b"/"), F.col(place))))
    frames = tokens.where("not is_text").join(direct.drop("is_text"), ["host", "place"], "left").select(
        at("place").alias("key"), F.when(F.col("depth") > 0, at("parent")).alias("parent"), "host", "place", "depth", "inside", "pages", "total", *[F.coalesce(direct[c], F.lit(0)).cast("bigint").alias(c) for c in values]
    )
    frames = materialize(frames, "frames")
    # every place holds what lies at and below it
    held = frames.select("key", *values)
    for more in rolled_up(frames, values):
        held = held.unionByName(more)
    frames = materialize(frames.drop(*values).join(held.groupBy("key").agg(*sums), "key"), "held")
    root = frames.where("depth = 0").select("host", F.col("pages").alias("n"), F.col("chars").alias("all_chars"), F.col("left").alias("all_left"), F.col("left_heads").alias("all_heads"))
    slots = frames.join(checked_broadcast(materialize(root, "roots"), max_broadcast), "host").where((F.col("pages") >= support * F.col("n")) & (F.col("total") == F.col("pages")))
    slots = slots.where("not inside")
    told = F.col("all_left") >= least_left * F.col("all_chars")
    by_left = (F.col("left") >= held_text * F.col("all_left")) & (F.col("chars") >= least_text * F.col("all_chars")) & (F.col("left_heads") >= held_text * F.col("all_heads"))
    slots = slots.where(F.when(told, by_left).otherwise(F.col("chars") >= F.col("all_chars")))
    main = slots.groupBy("host").agg(F.max_by("place", F.struct("depth", "place")).alias("main"))
    return materialize(main, "templates")


def extract_text(pages: DataFrame, *, max_broadcast: int = 20_000, labelled: bool = True, **options) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    todo = pages.select("page_id", "url", host.alias("host"), "html")
    found = checked_broadcast(templates(page_tokens(todo, labelled), max_broadcast=max_broadcast, **options), max_broadcast)
    kinds = {c: todo.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches):
        for batch in batches:
            texts, n_blocks = [], []
            for page, main in zip(*(batch[c].to_pylist() for c in ("html", "main"))):
                blocks, places, _, inner = page_blocks(page or "", labelled, main)
                own = [t for (_, t), x in zip(blocks, inner) if x or not main or main not in places]
                texts.append("\n".join(own))
                n_blocks.append(len(own))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_blocks, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    joined = todo.join(found, "host", "left").select("page_id", "url", "html", "main")
    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint")
