"""URL and HTML columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import col, let, normalize_space, strip

# Named entities; "&amp;" is decoded after all others.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "sect": "§", "para": "¶", "deg": "°", "times": "×", "frac12": "½",
}


def url_host(url: Column | str) -> Column:
    """Network location without ``www.``, port kept; empty when there is no ``//``."""
    host = F.regexp_extract(col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit(""))


def domain_in(url: Column | str, domains: Iterable[str]) -> Column:
    return url_host(url).isin(list(domains))


def unescape(c: Column | str) -> Column:
    """Decode numeric entities and the named ones of ``ENTITIES``."""
    out = col(c)

    def decode(match: Column, base: int) -> Column:
        # One piece after "&#": digits, ";", then plain text. Nine digits are beyond any character.
        digits = F.regexp_extract(match, r"^[xX]?0*([0-9a-fA-F]{0,9})[0-9a-fA-F]*;", 1)
        long = match.rlike(r"^[xX]?0*[1-9a-fA-F][0-9a-fA-F]{8}")
        code = F.lpad(F.conv(F.concat(F.lit("0"), digits), base, 16), 10, "0")
        none = code.between("000000D800", "000000DFFF") | (code > "000010FFFF") | (code == "0" * 10) | long
        code = F.when(none, F.lit("0000FFFD")).otherwise(F.substring(code, 3, 8))
        return F.concat(F.decode(F.unhex(code), "UTF-32"),
                        F.regexp_replace(match, r"^[xX]?[0-9a-fA-F]+;", ""))

    def piece(p: Column, i: Column) -> Column:
        return (F.when(i == 0, p)
                .when(p.rlike(r"^[0-9]+;"), decode(p, 10))
                .when(p.rlike(r"^[xX][0-9a-fA-F]+;"), decode(p, 16))
                .otherwise(F.concat(F.lit("&#"), p)))

    numeric = F.concat_ws("", F.transform(F.split(out, "&#"), piece))
    out = F.when(F.contains(out, F.lit("&#")), numeric).otherwise(out)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def visible_html(html: Column | str) -> Column:
    """Markup without scripts, styles and comments."""
    out = F.regexp_replace(col(html), r"(?is)<script\b.*?</script\s*>", "")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


# Elements that hold nothing, and those whose text is wanted.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("p", "article", "section")
TAG = r"<[^>]*>"
_STACK, _DONE = "array<struct<name:string,at:int>>", "array<struct<name:string,first:int,last:int>>"


def block_spans(tags: Column) -> Column:
    """``(name, first, last)`` of every wanted element, by the tags between which its text lies.

    A stack of open elements runs over the tags: an end tag closes the innermost open element of its
    name and all that is open inside it, one without an open element is ignored, and what is open at the
    end closes there. Elements may nest in their own kind.
    """
    name = lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][^\s/>]*)", 1))
    listed = F.transform(tags, lambda t, i: F.struct(
        F.when(name(t).isin(*VOID) | F.endswith(t, F.lit("/>")), "").otherwise(name(t)).alias("name"), (i + 1).cast("int").alias("at")))
    start = F.struct(F.array().cast(_STACK).alias("open"), F.array().cast(_DONE).alias("done"))

    def spans(closed: Column, last: Column) -> Column:
        wanted = F.filter(closed, lambda s: s["name"].isin(*BLOCKS))
        return F.transform(wanted, lambda s: F.struct(s["name"].alias("name"), s["at"].alias("first"), last.alias("last")))

    def step(state: Column, tag: Column) -> Column:
        opened = F.struct(F.concat(state["open"], F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("at")))).alias("open"),
                          state["done"].alias("done"))

        def closed(depth: Column) -> Column:
            left = F.size(state["open"]) - depth
            inner = F.slice(state["open"], left + 1, depth)
            return F.when(depth == 0, state).otherwise(F.struct(
                F.slice(state["open"], F.lit(1), left).alias("open"), F.concat(state["done"], spans(inner, tag["at"])).alias("done")))

        depth = F.array_position(F.reverse(F.transform(state["open"], lambda s: s["name"])), F.substring(tag["name"], 2, 1_000_000))
        return (F.when(tag["name"] == "", state)
                .when(F.startswith(tag["name"], F.lit("/")), let(depth.cast("int"), closed)).otherwise(opened))

    end = (F.size(tags) + 1).cast("int")
    return F.aggregate(listed, start, step, lambda state: F.concat(state["done"], spans(state["open"], end)))


def page_blocks(html: Column | str, blocks: bool = True) -> Column:
    """The paragraphs of a page in their order, then the lines of its articles, then of its sections.

    An element's text are the text nodes inside it, those of inner elements included, stripped, the
    blank ones left out, joined by a blank. That of an article or section is cut where a node itself holds
    a line break; line breaks inside tags or between them do not cut. Text that lies in several wanted
    elements comes once for each.
    """

    def texts(nodes: Column, spans: Column, name: str) -> Column:
        own = F.array_sort(F.transform(F.filter(spans, lambda s: s["name"] == name), lambda s: F.struct(
            s["first"].alias("first"), s["last"].alias("last"))))
        return F.transform(own, lambda s: F.array_join(F.filter(
            F.slice(nodes, s["first"] + 1, s["last"] - s["first"]), lambda n: n != ""), " "))

    def listed(nodes: Column, spans: Column) -> Column:
        paragraphs = F.transform(texts(nodes, spans, "p"), normalize_space)
        if not blocks:
            return paragraphs
        lines = [F.flatten(F.transform(texts(nodes, spans, tag), lambda t: F.transform(F.split(t, "\n"), normalize_space)))
                 for tag in BLOCKS[1:]]
        return F.concat(paragraphs, *lines)

    def pieces(markup: Column) -> Column:
        nodes = F.transform(F.split(markup, TAG, -1), lambda n: strip(unescape(n)))
        return let(nodes, lambda n: let(block_spans(F.regexp_extract_all(markup, F.lit(TAG), F.lit(0))), lambda s: listed(n, s)))

    return let(visible_html(html), pieces)
