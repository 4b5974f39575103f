"""Several values packed in one field: split to one row per value, positions kept.

The field is split on quote characters. Quote pieces and plain pieces then alternate, and
an array fold walks over them with a small state: outside quotes a piece is split on the
delimiters, inside quotes it is a literal that is kept whole. The fold puts the entries
together again and their ordinal is their position. All of it is built-in SQL, evaluated
in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "struct<head:string,lit:string,tail:string>"
STATE = f"struct<done:array<{ENTRY}>,head:string,lit:string,tail:string,mark:string,shut:boolean,fresh:boolean>"


def _char_class(chars: str) -> str:
    return "[" + "".join(re.escape(c) if c != "\t" else r"\t" for c in chars) + "]"


def packed_entries(field: Column, delimiters: str = ";|,\t", quotes: str = "\"'", assign: str = "=") -> Column:
    """array<struct<key,value>> of the entries of one field, in order, empty entries left out.

    State of the fold: ``head`` is the plain text of the entry so far, ``lit`` the literal
    of its quoted value (null if none), ``tail`` what follows the closing mark; ``mark`` is
    the open mark or the one that was just met (``shut``), since the same mark once more
    stands for a literal mark.
    """
    delim, quote, eq = _char_class(delimiters), _char_class(quotes), re.escape(assign)
    pieces = F.split(field, f"(?<={quote})|(?={quote})")
    none = F.lit(None).cast("string")
    opens = rf"^\s*(?:[^\s{eq}]+[\s{eq}]+|{eq}[\s{eq}]*)$"
    entry = lambda h, l, t: F.struct(h.alias("head"), l.alias("lit"), t.alias("tail"))

    def state(done, head, lit, tail, mark, shut, fresh) -> Column:
        return F.struct(
            done.alias("done"), head.alias("head"), lit.alias("lit"), tail.alias("tail"),
            mark.alias("mark"), shut.alias("shut"), fresh.alias("fresh"),
        ).cast(STATE)

    false, true = F.lit(False), F.lit(True)

    def plain(s: Column, piece: Column) -> Column:
        """A piece outside quotes: every delimiter in it ends an entry."""
        parts = F.split(piece, delim)
        first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
        quoted = s["lit"].isNotNull()
        head = F.when(quoted, s["head"]).otherwise(F.concat(s["head"], first))
        tail = F.when(quoted, F.concat(s["tail"], first)).otherwise(s["tail"])
        middle = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: entry(p, none, F.lit("")))
        ended = F.concat(s["done"], F.array(entry(head, s["lit"], tail)), middle).cast(f"array<{ENTRY}>")
        return F.when(F.size(parts) == 1, state(s["done"], head, s["lit"], tail, none, false, false)).otherwise(
            state(ended, last, none, F.lit(""), none, false, false)
        )

    def fold(s: Column, piece: Column) -> Column:
        is_quote = piece.rlike(f"^{quote}$")
        inside = s["mark"].isNotNull() & ~s["shut"]
        escaped = (s["mark"] == '"') & s["lit"].endswith("\\") & ~s["fresh"]
        unescaped = F.concat(F.substring(s["lit"], F.lit(1), F.length(s["lit"]) - 1), piece)
        return (
            F.when(
                inside & is_quote & (piece == s["mark"]),
                F.when(escaped, state(s["done"], s["head"], unescaped, s["tail"], s["mark"], false, true)).otherwise(
                    state(s["done"], s["head"], s["lit"], s["tail"], s["mark"], true, false)
                ),
            )
            .when(inside, state(s["done"], s["head"], F.concat(s["lit"], piece), s["tail"], s["mark"], false, false))
            .when(s["shut"] & is_quote & (piece == s["mark"]), state(s["done"], s["head"], F.concat(s["lit"], piece), s["tail"], s["mark"], false, true))
            .when(is_quote & s["lit"].isNull() & s["head"].rlike(opens), state(s["done"], s["head"], F.lit(""), s["tail"], piece, false, true))
            .otherwise(plain(s, piece))
        )

    start = state(F.array().cast(f"array<{ENTRY}>"), F.lit(""), none, F.lit(""), none, false, false)
    folded = F.aggregate(pieces, start, fold, lambda s: F.concat(s["done"], F.array(entry(s["head"], s["lit"], s["tail"]))).cast(f"array<{ENTRY}>"))
    kept = F.filter(folded, lambda e: e["lit"].isNotNull() | e["head"].rlike(r"\S"))
    rtrim = lambda c: F.regexp_replace(c, r"\s+$", "")

    def split_entry(e: Column) -> Column:
        head = F.regexp_replace(e["head"], r"^\s+", "")
        key = F.regexp_extract(head, rf"^[^\s{eq}]*", 0)
        rest = rtrim(F.regexp_replace(F.substring(head, F.length(key) + 1, F.length(head)), rf"^[\s{eq}]+", ""))
        value = F.when(e["lit"].isNotNull(), F.concat(e["lit"], rtrim(e["tail"]))).otherwise(rest)
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(kept, split_entry)


def split_packed(
    df: DataFrame,
    field: str,
    keys: list[str],
    *,
    delimiters: str = ";|,\t",
    quotes: str = "\"'",
    names: tuple[str, str, str] = ("pos", "attr_key", "attr_value"),
) -> DataFrame:
    """One row per entry of ``field``: ``keys``, position from 1, entry key, entry value.

    Defined cases: null, blank and ``.`` fields give no rows; entries of blanks only do not
    count; an entry without a value has the empty string; a quoted value runs to the same
    mark or to the end of the field, a doubled mark in it stands for one, as does a
    backslash before the mark within double quotes; quote marks anywhere else are plain
    text; text after a closing mark is added to the value. Rows are never merged: repeated
    input rows give repeated entries. Columns other than ``keys`` and ``field`` are dropped,
    so clashing names do no harm.
    """
    pos, key, value = names
    usable = F.col(field).rlike(r"\S") & (F.trim(F.col(field)) != ".")
    src = df.where(usable).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(field).alias("_field"))
    rows = src.select(*[f"_k{i}" for i in range(len(keys))], F.posexplode(packed_entries(F.col("_field"), delimiters, quotes)).alias("_p", "_e"))
    return rows.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], (F.col("_p") + 1).cast("int").alias(pos), F.col("_e.key").alias(key), F.col("_e.value").alias(value)
    )
