"""Fill-in-the-middle: texts cut into units, two cuts drawn from a hash of the id, the middle moved to the end behind sentinels, and texts rebuilt from that.

All of it is native functions in two projections, without a shuffle.  Defined results: a null text counts as empty; an empty text, or one that holds a
sentinel, stays plain; a null doc_id is drawn like an empty one; equal texts with different ids are cut differently, repeated rows alike.  Texts are worked on
whole, whatever their length (a text and its units must fit a row).  Columns other than doc_id and text are not carried.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every document.

    rate: percentage of texts that are transformed; spm: percentage of those with the suffix first.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    units = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("units"), F.sha2(key, 256).alias("h"))

    n = F.size("units").cast("long")
    cuts = [draw(F.col("h"), i) % (n + 1) for i in (0, 1)]
    held = F.lit(False)
    for mark in marks.all():
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (draw(F.col("h"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("h"), 3) % 100 < spm, "spm").otherwise("psm")
    cut = units.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))

    join = lambda start, length: F.array_join(F.slice("units", start.cast("int"), length.cast("int")), "")
    parts = cut.select("doc_id", "text", "n", "form", join(F.lit(1), F.col("a")).alias("p"), join(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), join(F.col("b") + 1, F.col("n") - F.col("b")).alias("s"))
    psm = F.concat(F.lit(marks.prefix), "p", F.lit(marks.suffix), "s", F.lit(marks.middle), "m")
    spm_ = F.concat(F.lit(marks.suffix), "s", F.lit(marks.prefix), "p", F.lit(marks.middle), "m")
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"), output.alias("output"))


def restored(rows: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """rows (form, output) with restored, the text that each output was made from, read from the output and its form alone.

    An output that has not exactly one of each sentinel in the order of its form restores to null.
    """
    quoted = "|".join(rf"\Q{m}\E" for m in marks.all())
    order = {"psm": (marks.prefix, marks.suffix, marks.middle), "spm": (marks.suffix, marks.prefix, marks.middle)}
    place = {"psm": (1, 3, 2), "spm": (2, 3, 1)}  # prefix, middle, suffix among the pieces
    out = F.when(F.col("form") == "plain", F.col("output"))
    for form, seen in order.items():
        whole = (F.size("_pieces") == 4) & (F.regexp_extract_all("output", F.lit(quoted), F.lit(0)) == F.array(*map(F.lit, seen)))
        out = out.when((F.col("form") == form) & whole, F.concat(*[F.get("_pieces", F.lit(i)) for i in place[form]]))
    pieces = F.when(F.col("form") != "plain", F.split("output", quoted, -1))
    return rows.withColumn("_pieces", pieces).withColumn("restored", out).drop("_pieces")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    rows = restored(transformed(docs, **options))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
