"""Merkle-tree fingerprints of texts (operator 6), in DataFrame functions only.

A text is cut into sections (up to and with a blank line), these into paragraphs (lines, with their line end), these
into spans (up to a sentence's end, 96 characters at most). Spans are the leaves; every node's hash is the SHA-256 of
its children's hashes. All characters are in some leaf, so equal roots mean equal texts, and a node that differs
leads down to the edit.

A fingerprint reads ``root:sections:leaves``. ``root`` is 64 hex digits. ``sections`` are separated by ``;``, each is
its tag, ``/`` and its paragraphs, separated by ``,``, each a tag, ``*`` and its number of leaves. ``leaves`` are tags
in the order of the text, separated by ``,``. A tag is the first 8 hex digits of the node's hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, text_of

SPAN = r"(?s)[^.!?]{0,96}+[.!?]+|[^.!?]{1,96}+"
ROWS_PER_BUCKET = 2048
MAX_BUCKETS = 1 << 15


def _tag(hashed: Column) -> Column:
    return F.substring(hashed, 1, 8)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (null: empty) as ``out``; other columns stay as they are."""
    held = free_name(df, "_tree")
    spans = lambda p: F.transform(F.regexp_extract_all(p, F.lit(SPAN), F.lit(0)), lambda x: F.sha2(x, 256))
    paragraph = lambda p: F.struct(spans(p).alias("leaves"))
    tree = F.transform(F.split(text_of(text), r"(?<=\n\n)", -1), lambda s: F.transform(F.split(s, r"(?<=\n)", -1), paragraph))
    hashed = F.transform(F.col(held), lambda s: F.transform(s, lambda p: F.struct(F.sha2(F.array_join(p["leaves"], ""), 256).alias("node"), p["leaves"].alias("leaves"))))
    sections = F.transform(F.col(held), lambda s: F.struct(F.sha2(F.array_join(s["node"], ""), 256).alias("node"), s.alias("parts")))
    shape = F.array_join(
        F.transform(held, lambda s: F.concat(_tag(s["node"]), F.lit("/"), F.array_join(F.transform(s["parts"], lambda p: F.concat(_tag(p["node"]), F.lit("*"), F.size(p["leaves"]).cast("string"))), ","))), ";"
    )
    leaves = F.array_join(F.transform(F.flatten(F.transform(held, lambda s: F.flatten(s["parts"]["leaves"]))), _tag), ",")
    root = F.sha2(F.array_join(F.col(held)["node"], ""), 256)
    for step in (tree, hashed, sections):
        df = df.withColumn(held, step)
    return df.withColumn(out, F.concat_ws(":", root, shape, leaves)).drop(held)


def leaf_tags(fingerprint: str) -> Column:
    """The distinct leaf tags of a fingerprint; none for an empty text."""
    return F.array_distinct(F.filter(F.split(F.substring_index(F.col(fingerprint), ":", -1), ","), lambda x: x != ""))


def likeness(a: str, b: str, tags_a: Column | None = None, tags_b: Column | None = None) -> Column:
    """1 for equal roots, else the share of leaves that both have: 2 * common / (leaves of a + leaves of b)."""
    x, y = (leaf_tags(a) if tags_a is None else tags_a), (leaf_tags(b) if tags_b is None else tags_b)
    common = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(common)


def differing_paragraphs(a: str, b: str) -> Column:
    """Where the trees of two fingerprints differ: (section, paragraph) positions, from 0.

    Sections with equal tags at equal positions are not gone into. A section or paragraph that only one side has
    differs. Equal roots give an empty array; a null fingerprint gives null.
    """
    sections = lambda f: F.split(F.split(F.col(f), ":")[1], ";")
    parts = lambda s: F.coalesce(F.split(F.substring_index(s, "/", -1), ","), F.array().cast("array<string>"))

    def of(s: Column, i: Column) -> Column:
        x, y = parts(s["x"]), parts(s["y"])
        pairs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~p["x"].eqNullSafe(p["y"])).alias("differs")))
        return F.when(s["x"].eqNullSafe(s["y"]), F.filter(pairs, lambda p: F.lit(False))).otherwise(F.filter(pairs, lambda p: p["differs"]))

    zipped = F.arrays_zip(sections(a).alias("x"), sections(b).alias("y"))
    return F.transform(F.flatten(F.transform(zipped, of)), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))


def _bucket(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are at most ``key``, by binary search."""
    held = F.lit(bounds) if bounds else F.array().cast("array<long>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.try_element_at(held, at + s) <= key, at + s).otherwise(at))


def with_next(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``{column: new}``, that column of the next row by ``key``; after the last row, of the first.

    Null keys come first. Rows with one key are in the order of ``columns``' values; equal rows follow each other. A
    table of one row is its own next. Rows are dealt into ranges of about ROWS_PER_BUCKET rows (quantiles of ``key``);
    each range also gets the first rows of the range after it, so no window spans the table. There are at most
    MAX_BUCKETS ranges: beyond MAX_BUCKETS * ROWS_PER_BUCKET rows they hold more rows each. Rows of one key are in one range.
    """
    n = df.count()
    m = min(MAX_BUCKETS, math.ceil(n / ROWS_PER_BUCKET))
    bounds: list[int] = []
    if m > 1:
        cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / m) for i in range(1, m)]), F.lit(max(10_000, 10 * m)))).first()[0]
        bounds = sorted(set(cuts or []))
    names = {x: free_name(df, x) for x in ("_key", "_bucket", "_first", "_own", "_to", "_at")}
    k, own, first, to, at = (F.col(names[x]) for x in ("_key", "_bucket", "_first", "_to", "_at"))
    low = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long"))
    ranged = df.withColumn(names["_key"], low).withColumn(names["_bucket"], _bucket(bounds, k))
    firsts = df.select(low.alias(names["_key"])).withColumn(names["_bucket"], _bucket(bounds, k)).groupBy(own.alias(names["_own"])).agg(F.min(k).alias(names["_first"]))
    before = firsts.select(
        first, F.coalesce(F.lag(names["_own"]).over(Window.orderBy(names["_own"])), F.max(names["_own"]).over(Window.partitionBy())).alias(names["_to"])
    )  # at most MAX_BUCKETS rows
    marked = ranged.join(F.broadcast(before), k == first, "left")
    home = F.struct(own.alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(to.alias("b"), F.lit(1).alias("guest"))
    dealt = marked.withColumn(names["_at"], F.explode(F.when(to.isNull(), F.array(home)).otherwise(F.array(home, guest))))
    window = Window.partitionBy(at["b"]).orderBy(at["guest"], k, *columns)
    follow = dealt.select("*", *[F.lead(c).over(window).alias(new) for c, new in columns.items()])
    return follow.where(at["guest"] == 0).drop(*names.values())


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> the fingerprint of every text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document's. Null
    text is empty; a null id comes before all others. Rows with one id are taken in the order of their texts. Other
    columns are not read; an empty table gives an empty one.
    """
    base = with_fingerprint(docs.select("doc_id", text_of().alias("text")), "text", "fingerprint")
    follow = with_next(base, "doc_id", {"text": "next_text", "fingerprint": "next_fingerprint"})
    sized = follow.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars AS INT) - _half)"), F.expr("substring(next_text, 1, _half)"))
    full = with_fingerprint(sized.withColumn("edited", edited), "edited", "edited_fingerprint")
    full = full.withColumn("_tags", leaf_tags("fingerprint"))
    return full.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", F.col("_tags")).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", F.col("_tags")).alias("near_next"),
        F.size(differing_paragraphs("fingerprint", "edited_fingerprint")).cast("long").alias("n_differing_paragraphs"),
    )
