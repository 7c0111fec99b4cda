"""Scores of extracted rows against an answer key."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.functions.cells import arabic
from inkfold.functions.text import clean_text


def same_field(field: str, key: Column, got: Column) -> Column:
    """Whether two cells agree: ids on their digits, trade names without blanks, stops and case, figures as they are (null equals null), texts with single blanks."""
    if field == "recipient_id":
        digits = lambda c: F.regexp_replace(arabic(F.coalesce(c, F.lit(""))), r"\D", "")
        return digits(key) == digits(got)
    if field in ("balance_brought", "received", "issued", "balance"):
        return key.eqNullSafe(got)
    if field == "trade_name":
        bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s.]", "")
        return bare(key) == bare(got)
    return clean_text(key) == clean_text(got)


def page_quality(rows: DataFrame, page: list[str]) -> DataFrame:
    """page, rows, confidence: the number of rows and the mean of their confidences, nulls left out, to four digits."""
    return rows.groupBy(*page).agg(F.count("*").alias("rows"), F.bround(F.avg("confidence"), 4).alias("confidence"))


def cell_scores(pairs: DataFrame, columns: list[str], numbers: list[str], identity: str | None = None) -> DataFrame:
    """column, right, n, share over pairs by place (key_*, got_*), a row for each column and one for all cells together.

    Figures must be equal, a missing one may be empty; texts may differ in blanks. identity: a column that is scored on its digits as well.
    """
    same = {c: F.coalesce(F.col(f"key_{c}").eqNullSafe(F.col(f"got_{c}")) if c in numbers else clean_text(F.col(f"key_{c}")) == clean_text(F.col(f"got_{c}")), F.lit(False)) for c in columns}
    listed = [F.struct(F.lit(n).alias("ord"), F.lit(c).alias("column"), ok.cast("int").alias("right"), F.lit(True).alias("cell")) for n, (c, ok) in enumerate(same.items())]
    if identity:
        listed.append(F.struct(F.lit(len(columns)).alias("ord"), F.lit(f"{identity}*").alias("column"), same_field("recipient_id", F.col(f"key_{identity}"), F.col(f"got_{identity}")).cast("int").alias("right"), F.lit(False).alias("cell")))
    one = pairs.select(F.explode(F.array(*listed)).alias("s")).select("s.*")
    by_column = one.groupBy("ord", "column").agg(F.sum("right").alias("right"), F.count("*").alias("n"))
    whole = one.where("cell").agg(F.lit(len(columns) + 1).alias("ord"), F.lit("all cells").alias("column"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"), F.count("*").alias("n"))
    return by_column.unionByName(whole).select("ord", "column", "right", "n", F.round(F.coalesce(F.try_divide("right", "n"), F.lit(0.0)), 6).alias("share"))


def review_rates(pairs: DataFrame, fields: list[str], by: list[str], flag: str = "got_needs_review") -> DataFrame:
    """by, rows, review_rate, wrong, unflagged: of the rows that were got, the share that is flagged, those that differ from the key and those of them that no flag shows."""
    both = F.coalesce(F.col("in_key") & F.col("in_got"), F.lit(False))
    right = both
    for f in fields:
        right = right & same_field(f, F.col(f"key_{f}"), F.col(f"got_{f}"))
    got, flagged = F.coalesce("in_got", F.lit(False)), F.coalesce(flag, F.lit(False))
    rate = F.round(F.try_divide(F.count_if(got & flagged), F.count_if(got)), 6)
    return pairs.groupBy(*by).agg(F.count_if(got).alias("rows"), rate.alias("review_rate"), F.count_if(got & ~right).alias("wrong"), F.count_if(got & ~right & ~flagged).alias("unflagged"))


def error_rate(key: Column, got: Column) -> Column:
    """An aggregate: edit distances over lengths (1 at least) of the key's texts."""
    k, g = clean_text(key), clean_text(got)
    return F.sum(F.levenshtein(k, g)) / F.sum(F.greatest(F.length(k), F.lit(1)))


def aligned(key: DataFrame, got: DataFrame, page: list[str], signature: str, order: str) -> DataFrame:
    """Full outer pairs (key_*, got_*) of rows with one signature on one page, the n-th with the n-th."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*page, signature).orderBy(order))
        own = [F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in (*page, signature)]
        return df.select(*page, signature, n.alias("__n"), *own, F.lit(True).alias(f"in_{side}"))

    return numbered(key, "key").join(numbered(got, "got"), [*page, signature, "__n"], "full").drop("__n")


def paired_in_order(key: list, got: list) -> list[tuple[int | None, int | None]]:
    """Places (in key, in got) of two signature sequences, aligned in order; blocks that differ are paired as far as both reach."""
    out: list[tuple[int | None, int | None]] = []
    for _, i, j, k, m in SequenceMatcher(None, key, got, autojunk=False).get_opcodes():
        n = min(j - i, m - k)
        out += [(i + x, k + x) for x in range(n)] + [(x, None) for x in range(i + n, j)] + [(None, x) for x in range(k + n, m)]
    return out


def aligned_in_order(key: DataFrame, got: DataFrame, page: list[str], signature: str, order: str) -> DataFrame:
    """Full outer pairs (key_*, got_*) of each page's rows in order, by ordered alignment of their signatures; misread rows pair too."""

    def rows(df: DataFrame, side: str) -> DataFrame:
        own = F.struct(*[F.col(c) for c in df.columns if c not in page])
        return df.select(*page, F.struct(F.col(order).alias("o"), F.col(signature).cast("string").alias("s"), own.alias("row")).alias(f"__{side}"))

    both = rows(key, "key").unionByName(rows(got, "got"), allowMissingColumns=True)
    pages = both.groupBy(*page).agg(*[F.array_sort(F.collect_list(f"__{s}")).alias(f"__{s}") for s in ("key", "got")])
    pairs = F.udf(lambda k, g: [{"k": x, "g": y} for x, y in paired_in_order(list(k), list(g))], "array<struct<k:int,g:int>>", useArrow=True)
    placed = pages.withColumn("__at", F.explode(pairs(F.col("__key")["s"], F.col("__got")["s"])))
    out = [F.col(c) for c in page]
    for side, df, at in (("key", key, "k"), ("got", got, "g")):
        place = F.col("__at")[at]
        row = F.get(F.col(f"__{side}"), place)["row"]
        out += [row[c].alias(f"{side}_{c}") for c in df.columns if c not in page] + [F.when(place.isNotNull(), True).alias(f"in_{side}")]
    return placed.select(*out)


def zipped(key: DataFrame, got: DataFrame, page: list[str], order: str) -> DataFrame:
    """Pairs by place on the page; what one side has more is left out."""
    n = F.row_number().over(Window.partitionBy(*page).orderBy(order))
    rename = lambda df, side: df.select(*page, n.alias("__n"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in page])
    return rename(key, "key").join(rename(got, "got"), [*page, "__n"]).drop("__n")


def report(pairs: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Rows in the key and got, missing, extra, and for each field the number of pairs that agree and their share."""
    both = F.col("in_key") & F.col("in_got")
    flag = lambda c: F.coalesce(c, F.lit(False))
    ok = {f: flag(both) & same_field(f, F.col(f"key_{f}"), F.col(f"got_{f}")) for f in fields}
    perfect = flag(both)
    for f in fields:
        perfect = perfect & ok[f]
    counted = [F.count_if(flag(F.col("in_key"))).alias("key_rows"), F.count_if(flag(F.col("in_got"))).alias("got_rows")]
    counted += [F.count_if(flag(F.col("in_key")) & ~flag(F.col("in_got"))).alias("missing"), F.count_if(~flag(F.col("in_key"))).alias("extra"), F.count_if(perfect).alias("perfect")]
    n = F.count_if(flag(both))
    return pairs.groupBy(*by).agg(*counted, *[F.count_if(c).alias(f"{f}_ok") for f, c in ok.items()], *[F.try_divide(F.count_if(c), n).alias(f"{f}_share") for f, c in ok.items()])
