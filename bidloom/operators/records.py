"""Priced records from the text lines of supplier documents, as windows over lines.

Each layout tells lines apart by patterns.  Lines that open a segment (an anchor, a
row, a no-offer, a marker, a total) are counted along the document, so a segment
runs over lines and pages up to the next one; anchors are counted the same way into
blocks.  One line of a segment holds the item, the others its text.  Lines are only
told apart; a segment keeps the few that its values stand in, and these are read once
a record.  Modes that stay on within a block (optional, alternative) are running
maxima over segments, and references that a layout states once are carried forward.
A document's lines are shuffled and sorted once.

Defined results: a document without any signature has no records and one row in
``unsupported``; of several signatures the first of LAYOUTS holds; an anchor without
its row gives no record; null content is an empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import numbers, references
from bidloom.functions.binding import once

_MONEY = r"([0-9.,]+)"
_UNIT, _PM_UNIT = "(ST|M|KG|L)", r"(St(?:ück|ueck)?|Stk\.?|m|kg|L)"
_RE_NUMBER = r"^(?:[0-9]+\.){2}[0-9]+(?:-[0-9]+)?\.?$"
# The formats of four suppliers' documents.  signature: patterns that all stand in the document.  item: the line of a segment's
# values, which fields name by group.  The other patterns open segments (anchor, break, no_offer, marker, optional, stop) or are left out of texts (noise).
LAYOUTS: dict[str, dict] = {
    "GC_LVNR": {
        "signature": [r"(?i)\bPOS\s+[0-9]+\s+LVNR\b"],
        "anchor": r"(?i)^POS\s+([0-9]+)\s+LVNR\s+([0-9]+\s+[0-9]+\s+[0-9]+)\b(.*)$",
        "break": r"(?i)^POS\s+[0-9]+\s+LVNR\b|^[0-9]+\s+[0-9]+\s+[0-9]+(?:-[0-9]+)?\s+(?:Bauseits|siehe vorige Pos)",
        "item": rf"(?i)^(\S+)\s+(.+?)\s+{_MONEY}\s+{_UNIT}\s+{_MONEY}\s+{_MONEY}$",
        "fields": {"article": 1, "description": 2, "quantity": 3, "unit": 4, "unit_price": 5, "total_price": 6},
        "no_offer": r"(?i)^([0-9]+\s+[0-9]+\s+[0-9]+(?:-[0-9]+)?)\s+(Bauseits|siehe vorige Pos)$",
        "stop": r"(?i)^(?:Objektsumme|Zwischensumme|Endbetrag)\b",
    },
    "P_AND_M": {
        "signature": [r"(?i)\bAngebotsposition\b"],
        "anchor": r"(?i)\bAngebotsposition\b",
        "break": r"(?i)^[0-9]+\s+\S+\s+[0-9.,]+\s+(?:St|Stück|Stueck|Stk|m|kg|L)\b",
        "item": rf"(?i)^([0-9]+)\s+(\S+)\s+{_MONEY}\s+{_PM_UNIT}\s+{_MONEY}\s+{_MONEY}$",
        "fields": {"position": 1, "article": 2, "quantity": 3, "unit": 4, "unit_price": 5, "total_price": 6},
        "refused": r"(?i)\bnicht anbieten\b",
        "optional": r"(?i)optional bieten wir",
    },
    "SPECIALIZED_LV_POS": {
        "signature": [r"(?i)\bzu\s+LV-Pos\.\s*:"],
        "anchor": r"(?i)\bzu\s+LV-Pos\.\s*:",
        "item": rf"(?i)^([0-9]{{8,}})\s+{_MONEY}\s+{_UNIT}\s+{_MONEY}\s+{_MONEY}$",
        "fields": {"article": 1, "quantity": 2, "unit": 3, "unit_price": 4, "total_price": 5},
        "net": rf"(?i)^Positionsnetto\s+{_MONEY}\s+{_MONEY}$",
        "noise": r"(?i)^(?:Kundenrabatt|Positionsnetto|Anschrift:|Schelmenwasenstraße|E-Mail:|Internet:)",
    },
    "REISSER_LV_POS": {
        "signature": [r"(?i)Materialnr\.", r"(?i)LV\.Pos\."],
        "item": rf"(?i)^([0-9.]+)\s+\S+\s+([0-9]{{7,}})\s+(.+?)\s+{_MONEY}\s+{_UNIT}\s+{_MONEY}\s+{_MONEY}$",
        "fields": {"position": 1, "article": 2, "description": 3, "quantity": 4, "unit": 5, "unit_price": 6, "total_price": 7},
        "marker": r"(?i)^([0-9.]+)\s+Wahlweise bieten wir an:?$",
        "choice": rf"(?i)^\S+\s+([0-9]{{7,}})\s+(.+?)\s+{_MONEY}\s+{_UNIT}\s+{_MONEY}$",
        "choice_fields": {"article": 1, "description": 2, "quantity": 3, "unit": 4, "unit_price": 5},
        "no_offer": r"(?i)^([0-9.]+)\s+\*{2}\s+(bauseits)$",
        "stop": r"(?i)^(?:Summe Positionen|Mehrwertsteuer|Endbetrag)\b",
        "noise": rf"(?i){_RE_NUMBER}|^(?:Alte Materialnr|Stat\. WarenNr|PME:)",
    },
}
ALTERNATIVE, PER_HUNDRED = r"(?i)\balternativ\b", r"(?i)\bper\s+100\b"
REFUSAL_TEXT = "Diese Ausschreibungsposition können wir Ihnen nicht anbieten."
UNSUPPORTED_TEXT = "No supported deterministic supplier layout signature found."
FIELDS = ["position", "article", "description", "quantity", "unit", "unit_price", "total_price"]
FOOTER = 0.9  # lines from here down the page are no part of a text
GC, PM, SP, RE = LAYOUTS


def _cleaned(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s\x{00A0}]+", " "))
    return lines.select("document_id", "seq", "page", "y", text.alias("content"))


SIGNS = [(name, p) for name, spec in LAYOUTS.items() for p in spec["signature"]]


def _signs() -> Column:
    """The signatures that stand in a line, as bits."""
    return sum((F.when(F.col("content").rlike(p), 1 << k).otherwise(0) for k, (_, p) in enumerate(SIGNS)), F.lit(0))


def _layout(signs: Column) -> Column:
    out = F
    for name in LAYOUTS:
        bits = sum(1 << k for k, (n, _) in enumerate(SIGNS) if n == name)
        out = out.when(signs.bitwiseAND(F.lit(bits)) == bits, name)
    return out.otherwise("UNSUPPORTED")


def layouts(lines: DataFrame) -> DataFrame:
    """document_id, layout: the first layout all of whose signatures stand in the document, else UNSUPPORTED."""
    found = lines.withColumn("content", F.coalesce("content", F.lit(""))).groupBy("document_id").agg(F.bit_or(_signs()).alias("signs"))
    return found.select("document_id", _layout(F.col("signs")).alias("layout"))


def unsupported(lines: DataFrame) -> DataFrame:
    """document_id, error: the documents of no known layout."""
    return layouts(_cleaned(lines)).filter("layout = 'UNSUPPORTED'").select("document_id", F.lit(UNSUPPORTED_TEXT).alias("error"))


def _by_layout(what: str, make) -> Column:
    out = F
    for name, spec in LAYOUTS.items():
        if what in spec:
            out = out.when(F.col("layout") == name, make(spec[what], spec))
    return out.otherwise(F.lit(None))


def _is(what: str) -> Column:
    return F.coalesce(_by_layout(what, lambda p, _: F.col("content").rlike(p)), F.lit(False))


def _group(c: Column, what: str, n: int) -> Column:
    return F.nullif(_by_layout(what, lambda p, _: F.regexp_extract(c, p, n)), F.lit(""))


def _fields(c: Column, what: str, fields: str) -> Column:
    """An item line's values in the order of FIELDS, '' where the layout names none, by one match: a cleaned line has no line break."""
    return F.split(_by_layout(what, lambda p, spec: F.regexp_replace(c, p, "\n".join(f"${spec[fields][f]}" if f in spec[fields] else "" for f in FIELDS))), "\n", -1)


def _kind() -> Column:
    """What a line opens, or null."""
    out = F
    for name, spec in LAYOUTS.items():
        kinds = F
        for kind in ("anchor", "optional", "row", "no_offer", "marker", "stop", "break"):
            pattern = spec.get("item" if kind == "row" and name in (PM, RE) else kind)
            if pattern:
                holds = F.col("content").rlike(pattern)
                kinds = kinds.when(holds & references.has_basis_reference(F.col("content")) if kind == "anchor" and name != GC else holds, kind)
        out = out.when(F.col("layout") == name, kinds.otherwise(F.lit(None)))
    return out.otherwise(F.lit(None))


def _segmented(lines: DataFrame, failures: bool) -> DataFrame:
    """Lines with layout, kind, segment and block: kind opens a segment, ``head`` is what opened it, ``after`` whether it is the next line,
    ``anchor`` the last anchor (content, page).  Documents of no layout are left out, or with ``failures`` kept as their first line."""
    doc = W.partitionBy("document_id").orderBy("seq")
    upto = doc.rowsBetween(W.unboundedPreceding, 0)
    d = lines.withColumn("signs", F.bit_or(_signs()).over(doc.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    d = d.withColumn("layout", _layout(F.col("signs"))).withColumn("kind", _kind())
    opened, anchor = F.col("kind").isNotNull(), F.col("kind") == "anchor"
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    d = d.withColumns(
        {
            "nth": F.row_number().over(doc),
            "segment": F.count("kind").over(upto),
            "anchors": F.count(F.when(anchor, 1)).over(upto),
            "head": last("kind"),
            "anchor": last(F.when(anchor, F.struct("content", "page"))),
            "after": ~opened & F.lag("kind").over(doc).isNotNull(),
        }
    )
    d = d.withColumn("block", F.when(F.col("layout") == PM, F.col("anchors")).otherwise(F.col("segment")))
    known = F.col("head").isNotNull() & F.col("document_id").isNotNull()
    return d.filter(known | ((F.col("layout") == "UNSUPPORTED") & (F.col("nth") == 1)) if failures else known)


def supplier_records(lines: DataFrame, failures: bool = False) -> DataFrame:
    """Records of lines (document_id, seq, page, y, content).

    document_id, layout, reference, position, article, description, quantity,
    unit, unit_price, total_price, price_basis, role, page, continuation, n_lines.
    With ``failures`` also a row of each document of no known layout: layout
    UNSUPPORTED, the error as description, role ERROR.
    """
    d = _segmented(_cleaned(lines), failures)
    layout, head, content = F.col("layout"), F.col("head"), F.col("content")
    first = F.col("kind").isNotNull()
    fits = (
        F.when(layout == GC, (head == "anchor") & F.col("after") & _is("item"))
        .when(layout == PM, (F.col("kind") == "row") & (F.col("anchors") > 0))
        .when(layout == SP, (head == "anchor") & ~first & _is("item"))
        .otherwise((F.col("kind") == "row") | ((head == "marker") & ~first & _is("choice")))
    )
    text = ((F.col("y") < FOOTER) | (layout == RE)) & ~first & ~((layout == GC) & F.col("after")) & ~_is("noise")
    told = (layout == PM) & ~first & (head != "row") & content.rlike(ALTERNATIVE)
    line = F.struct("seq", "content")
    # The lines that a segment's values stand in: its item, texts, net prices, and the first one that states a reference.
    rows = d.groupBy("document_id", "layout", "block", "segment", "head").agg(
        F.first(F.when(first, F.struct("content", "page")), ignorenulls=True).alias("opening"),
        F.min(F.when(fits, line)).alias("item"),
        F.collect_list(F.when(text, line)).alias("texts"),
        F.min(F.when(_is("net"), line)).alias("net"),
        F.min(F.when((layout == RE) & (head != "stop") & references.has_basis_reference(content), line)).alias("stated"),
        F.first("anchor").alias("anchor"),
        F.bool_or(F.col("page") != F.col("anchor.page")).alias("other_page"),
        F.bool_or(told).alias("told"),
        F.bool_or(_is("refused") & (F.col("anchors") > 0)).alias("refused"),
        F.count("*").alias("n_lines"),
    )
    opening, item = F.col("opening.content"), F.col("item.content")
    opens_told = (layout == PM) & (head != "optional") & opening.rlike(ALTERNATIVE)
    block = W.partitionBy("document_id", "block").orderBy("segment")
    upto, whole = block.rowsBetween(W.unboundedPreceding, 0), block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("opens_told", opens_told).withColumns(
        {
            "is_optional": F.max(F.coalesce(head == "optional", F.lit(False))).over(upto),
            "told_before": F.max(F.col("told") | F.col("opens_told")).over(block.rowsBetween(W.unboundedPreceding, -1)),
            "is_refused": F.max("refused").over(whole),
            "n_block": F.sum("n_lines").over(whole),
            "nth": F.row_number().over(block),
            # A reference stated once holds for the segments after it, too.
            "carried": F.last("stated", ignorenulls=True).over(W.partitionBy("document_id").orderBy("block", "segment").rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    none, lost = head == "no_offer", layout == "UNSUPPORTED"
    rows = rows.filter(F.when(F.col("is_refused"), F.col("nth") == 1).otherwise(F.col("item").isNotNull() | F.coalesce(none, F.lit(False)) | lost))
    refused = F.col("is_refused")
    own = F.when(layout == GC, references.normalize_reference(F.when(head == "anchor", _group(opening, "anchor", 2)).when(none, _group(opening, "no_offer", 1))))
    reference = own.otherwise(once(F.when(layout == RE, F.col("carried.content")).otherwise(F.col("anchor.content")), references.basis_reference))
    place = F.when(head == "anchor", F.when(layout == GC, _group(opening, "anchor", 1)).when(layout == SP, F.nullif(F.regexp_extract(opening, r"^([0-9]+)\b", 1), F.lit(""))))
    place = place.when(head == "marker", _group(opening, "marker", 1)).when(none & (layout == RE), _group(opening, "no_offer", 1))
    kept = F.filter("texts", lambda x: F.when(F.col("item").isNull(), layout != SP).when(layout == SP, x["seq"] > F.col("item.seq")).otherwise(x["seq"] != F.col("item.seq")))
    texts = F.array_join(F.transform(F.array_sort(kept), lambda x: x["content"]), " ")
    alternative = F.when(layout == PM, F.coalesce("told_before", F.lit(False)) | F.col("opens_told")).when(layout == GC, (head == "anchor") & F.coalesce(_group(opening, "anchor", 3).rlike(ALTERNATIVE), F.lit(False))).otherwise(F.lit(False))
    fields = F.when(head == "marker", _fields(item, "choice", "choice_fields")).otherwise(_fields(item, "item", "fields"))
    net = F.col("net.content")
    rows = rows.select(
        "document_id", "layout", "segment", "block", "head", "anchor", F.col("opening.page").alias("page"), "other_page", "is_optional", "is_refused", F.when(refused, F.col("n_block")).otherwise(F.col("n_lines")).alias("n_lines"),
        reference.alias("reference"), place.alias("place"), _group(opening, "no_offer", 2).alias("refusal"), alternative.alias("is_alternative"), texts.alias("texts"), fields.alias("v"),
        _group(net, "net", 1).alias("net_unit"), _group(net, "net", 2).alias("net_total"),
    )
    v = {f: F.nullif(F.get("v", F.lit(k)), F.lit("")) for k, f in enumerate(FIELDS)}
    rows = rows.withColumns({"whole": F.trim(F.concat_ws(" ", v["description"], "texts")), **{f"_{f}": c for f, c in v.items()}}).drop("v", "texts")
    whole_text, of_record = F.col("whole"), ~refused & ~lost
    role = F.when(lost, "ERROR").when(refused, "NOT_OFFERED").when(none, F.when(F.lower("refusal") == "bauseits", "PROVIDED_BY_OTHERS").otherwise("NOT_OFFERED"))
    role = role.when(F.col("is_optional"), "OPTIONAL").when(F.col("is_alternative") | (head == "marker"), "ALTERNATIVE")
    only = lambda c: F.when(of_record, c)
    out = rows.select(
        "document_id", "layout", "segment", "block", F.when(~lost, F.col("reference")).alias("reference"),
        only(F.coalesce("_position", "place")).alias("position"), only(F.col("_article")).alias("article"),
        F.when(lost, UNSUPPORTED_TEXT).when(refused, REFUSAL_TEXT).when(none, F.col("refusal")).when(whole_text == "", F.col("_article")).otherwise(whole_text).alias("description"),
        only(numbers.quantity_number(F.col("_quantity"))).alias("quantity"),
        only(F.when(F.col("_unit").rlike("(?i)^st"), "St").otherwise(F.col("_unit"))).alias("unit"),
        only(numbers.german_number(F.coalesce("net_unit", "_unit_price"))).alias("unit_price"), only(numbers.german_number(F.coalesce("net_total", "_total_price"))).alias("total_price"),
        F.when(~lost, F.when(~refused & (layout == GC) & whole_text.rlike(PER_HUNDRED), 100).otherwise(1)).alias("price_basis"), role.alias("role"),
        F.when(refused, F.col("anchor.page")).when(~lost, F.col("page")).alias("page"),
        F.when(~lost, F.coalesce(F.when(refused, F.lit(False)).when(layout == PM, F.col("page") != F.col("anchor.page")).when(layout == SP, F.col("other_page")), F.lit(False))).alias("continuation"), "n_lines",
    )
    # The first undecided record of a reference is primary, the others are its components; within a block where the layout has blocks.
    alone = F.concat(F.lit("#"), F.col("segment").cast("string"))
    scope = F.when(layout == PM, F.col("block").cast("string")).otherwise(F.coalesce("reference", alone))
    nth = F.row_number().over(W.partitionBy("document_id", scope, F.col("role").isNull()).orderBy("segment"))
    return out.withColumn("role", F.coalesce("role", F.when(nth == 1, "PRIMARY").otherwise("MANDATORY_COMPONENT"))).drop("segment", "block")
