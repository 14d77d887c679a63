"""Fill-in-the-middle arrangements, in DataFrame functions only.

A text is cut into units (code points) at two places that follow from a hash of its id, and
its three parts are put in another order behind sentinels, so that a model learns to fill the
gap. ``restored`` parses the sentinels and gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def hashed(doc_id: Column, k: int, seed: str = "1") -> Column:
    """The k-th group (from 1) of eight hex digits of sha256 of ``seed:doc_id``, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * (k - 1) + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1") -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as doc_id, text, n, form, prefix_chars, middle_chars and output.

    ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``, by the names of the parts
    in their new order; of a hundred ids those from ``plain_from`` on stay plain, and of the
    rest those below ``spm_below`` begin with the suffix. Null and empty texts and texts that
    hold a sentinel are plain, a null one empty; very long texts are cut whole; repeated rows
    share their form; a null id is hashed as an empty one; further columns are ignored; an
    empty table gives no rows.
    """
    h = {k: hashed(F.col("doc_id"), k, seed) for k in range(1, 5)}
    base = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (h[3] % 100 >= plain_from)
    form = F.when(plain, F.lit("plain")).when(h[4] % 100 < spm_below, F.lit("spm")).otherwise(F.lit("psm"))
    base = base.select("doc_id", "text", F.char_length("text").cast("int").alias("n"), form.alias("form"))
    a, b = (F.pmod(h[k], F.col("n") + 1).cast("int") for k in (1, 2))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    base = base.select("*", cut(F.least(a, b)).alias("lo"), cut(F.greatest(a, b)).alias("hi"), cut(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("units"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    lo, hi = F.col("lo"), F.col("hi")
    base = base.select("doc_id", "text", "n", "form", "lo", "hi", part(F.lit(1), lo).alias("p"), part(lo + 1, hi - lo).alias("m"), part(hi + 1, F.col("n") - hi).alias("s"))
    p, s = F.concat(F.lit(PREFIX), "p"), F.concat(F.lit(SUFFIX), "s")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, F.lit(MIDDLE), "m")).otherwise(F.concat(s, p, F.lit(MIDDLE), "m"))
    return base.select("doc_id", "text", F.col("n").cast("long").alias("n"), "form", lo.cast("long").alias("prefix_chars"), (hi - lo).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an arrangement: its parts lie behind the sentinels, in the order that ``form`` names."""
    part = lambda i: F.element_at(F.split(output, SENTINEL), i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def digests(docs: DataFrame) -> DataFrame:
    """The arrangements of ``docs`` and the texts restored from them, as sha256."""
    out = arrange(docs)
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
