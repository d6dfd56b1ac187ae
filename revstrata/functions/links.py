"""Links, templates, references and keys in wiki text; column expressions, but for contexts, which need positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from revstrata.functions.arrow import by_row


def links(text: Column) -> Column:
    """array<struct<anchor, target>> of [[target#part|anchor]]: none with a colon, none whose target is empty.

    The anchor is what follows the first pipe, or the target.
    """

    def one(link: Column) -> Column:
        target = F.regexp_replace(link, r"(?s)[|#].*$", "")
        anchor = F.when(F.instr(link, "|") > 0, F.substring(link, F.instr(link, "|") + 1, F.length(link))).otherwise(target)
        return F.struct(anchor.alias("anchor"), target.alias("target"))

    raw = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.filter(F.transform(F.filter(raw, lambda x: (x != "") & (F.instr(x, ":") == 0)), one), lambda x: x["target"] != "")


def one_line_links(text: Column) -> Column:
    """As links, without those whose anchor has a line end."""
    return F.filter(links(text), lambda x: F.instr(x["anchor"], "\n") == 0)


def link_contexts(text: Column | str) -> Column:
    """Links with the offset of their content and up to 20 characters on either side, line ends and tabs as spaces."""
    return by_row(_contexts, "array<struct<anchor:string, target:string, offset:int, pre:string, post:string>>")(text)


def _contexts(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    blank, out = str.maketrans("\n\t", "  "), []
    for m in re.finditer(r"(?s)\[\[(.*?)\]\]", text):
        link = m[1]
        target = re.split(r"[|#]", link, maxsplit=1)[0]
        if not target or ":" in link:
            continue
        bar = link.find("|")
        out.append({
            "anchor": link[bar + 1 :] if bar >= 0 else target, "target": target, "offset": m.start(1),
            "pre": text[max(0, m.start() - 20) : m.start()].translate(blank), "post": text[m.end() : m.end() + 20].translate(blank),
        })
    return out


def references(text: Column) -> Column:
    """http references with the white space that ends them."""
    return F.regexp_extract_all(text, F.lit(r"http://\S+?\s"), F.lit(0))


_SKIPPED_TEMPLATES = ("-", "good article", "r from camelcase", "refend")


def templates(text: Column, excluded: str | None = None) -> Column:
    """Names in {{...}}: those without parameters, namespaces or line ends, cut at #, but for icons, sidebars and a few markers.

    excluded: a further pattern of names to leave out.
    """

    def real(x: Column) -> Column:
        lower = F.lower(x)
        ok = (x != "") & (F.instr(x, "|") <= 1) & (F.instr(x, "\n") <= 1) & (F.instr(x, ":") == 0)
        ok = ok & ~x.endswith("icon") & ~x.endswith("sidebar") & ~lower.isin(*_SKIPPED_TEMPLATES)
        return ok & ~x.rlike(excluded) if excluded else ok

    raw = F.regexp_extract_all(text, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1))
    return F.filter(F.transform(F.filter(raw, real), lambda x: F.regexp_replace(x, r"(?s)#.*$", "")), lambda x: x != "")


def graph_key(s: Column) -> Column:
    """A name as a knowledge-graph key: other than ASCII letters, digits, _ and -, a character is $ and its hexadecimal code in
    UTF-16, so two of them beyond the basic plane.

    A name shorter than two characters has the key WTF.
    """
    code = lambda n: F.concat(F.lit("$"), F.lpad(F.hex(n), 4, "0"))
    high = lambda c: (F.ascii(c) - 0x10000).bitwiseAND(0xFFC00) / 1024 + 0xD800
    pair = lambda c: F.concat(code(high(c).cast("int")), code((F.ascii(c) - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
    one = lambda c: F.when(c.rlike("^[A-Za-z0-9_-]$"), c).when(F.ascii(c) > 0xFFFF, pair(c)).otherwise(code(F.ascii(c)))
    return F.when(F.length(s) >= 2, F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")).when(s.isNotNull(), F.lit("WTF"))
