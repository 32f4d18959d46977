"""Fill-in-the-middle documents as piece tables.

A document is a list of descriptors ``buffer, start, length`` over immutable buffers: its own text
and one short buffer for each sentinel. At first one descriptor covers the whole text. Cuts split
the descriptors they fall into, an arrangement puts the parts into another order with a sentinel
ahead of each, and the text is never copied until the descriptors are streamed into the output.
The output alone is enough to go back: its sentinels are buffers of known length, so descriptors
over the output are found by the places of the sentinels, and the inverse permutation of the
arrangement orders them. Everything is a narrow projection of Spark's own functions, one row at a
time; there is no shuffle.

``psm`` writes prefix, suffix, middle; ``spm`` suffix, prefix, middle. Cuts and forms follow from
the SHA-256 of the seed, a colon and the id, so they do not depend on the order of rows.

Defined results: a null text is empty; empty texts and texts that hold a sentinel stay plain, as
does the share of texts that the rate leaves out. A null id is hashed as the empty word. Repeated
rows are transformed each, and alike. An empty table gives no rows. Other columns are kept by
:func:`fill_in_middle`, apart from those that it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecheck.llm.common import table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# What follows the sentinels of each form, as places among prefix, middle, suffix.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SENTINELS = (PREFIX, MIDDLE, SUFFIX)
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
TEXT = "text"


def descriptor(buffer: str, start: Column | int, length: Column | int) -> Column:
    return F.struct(
        F.lit(buffer).alias("buffer"), F.lit(start).cast("int").alias("start"), F.lit(length).cast("int").alias("length")
    )


def split_at(pieces: Column, cut: Column) -> Column:
    """The descriptors with the one that holds the place ``cut`` of its buffer split there."""

    def part(p: Column) -> Column:
        def piece(start: Column, length: Column) -> Column:
            return F.struct(p["buffer"].alias("buffer"), start.cast("int").alias("start"), length.cast("int").alias("length"))

        inside = (p["buffer"] == TEXT) & (p["start"] < cut) & (cut < p["start"] + p["length"])
        ahead = cut - p["start"]
        return F.when(inside, F.array(piece(p["start"], ahead), piece(cut, p["length"] - ahead))).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, part))


def between(pieces: Column, low: Column, high: Column) -> Column:
    """The descriptors of the text from ``low`` to ``high``; cuts were made at both."""
    return F.filter(pieces, lambda p: (p["length"] > 0) & (p["start"] >= low) & (p["start"] + p["length"] <= high))


def arranged(pieces: Column, first: Column, second: Column, size: Column, form: str) -> Column:
    """Sentinels and parts in the order of ``form``."""
    bounds = [(F.lit(0), first), (first, second), (second, size)]
    parts = []
    for place in ARRANGEMENTS[form]:
        parts += [F.array(descriptor(SENTINELS[place], 0, len(SENTINELS[place]))), between(pieces, *bounds[place])]
    return F.concat(*parts)


def streamed(pieces: Column, text: Column) -> Column:
    """The text that the descriptors stand for."""

    def read(p: Column) -> Column:
        return F.when(p["buffer"] == TEXT, F.substring(text, p["start"] + 1, p["length"])).otherwise(p["buffer"])

    return F.array_join(F.transform(pieces, read), "")


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers for each id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT, seed: int = SEED,
) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, pieces (the descriptors) and output."""
    text = text_of(text_col)
    h1, h2, h3, h4 = draws(id_col, seed)
    rows = docs.withColumn("n", F.char_length(text).cast("long"))
    rows = rows.withColumn("prefix_chars", F.least(F.pmod(h1, F.col("n") + 1), F.pmod(h2, F.col("n") + 1)))
    rows = rows.withColumn("middle_chars", F.greatest(F.pmod(h1, F.col("n") + 1), F.pmod(h2, F.col("n") + 1)) - F.col("prefix_chars"))
    plain = (F.col("n") == 0) | (F.pmod(h3, F.lit(100)) >= fim_percent)
    for sentinel in SENTINELS:
        plain = plain | F.contains(text, F.lit(sentinel))
    moved = F.when(F.pmod(h4, F.lit(100)) < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", F.when(plain, "plain").otherwise(moved))

    first, second, size = F.col("prefix_chars"), F.col("prefix_chars") + F.col("middle_chars"), F.col("n")
    cut = split_at(split_at(F.array(descriptor(TEXT, 0, size)), first), second)
    whole = F.filter(F.array(descriptor(TEXT, 0, size)), lambda p: p["length"] > 0)
    orders = F.when(F.col("form") == "plain", whole)
    for form in ARRANGEMENTS:
        orders = orders.when(F.col("form") == form, arranged(cut, first, second, size, form))
    rows = rows.withColumn("pieces", orders).withColumn("output", streamed(F.col("pieces"), text))
    for name in ("prefix_chars", "middle_chars"):
        rows = rows.withColumn(name, F.when(F.col("form") != "plain", F.col(name)))
    return rows


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    back = F.when(form == "plain", output)
    for name, order in ARRANGEMENTS.items():
        marks = [F.position(F.lit(SENTINELS[p]), output) for p in order]
        ends = [*marks[1:], F.char_length(output) + 1]
        parts = []
        for place in sorted(order):  # the inverse permutation
            at = order.index(place)
            start = marks[at] - 1 + len(SENTINELS[place])
            parts.append(descriptor(TEXT, start, ends[at] - 1 - start))
        back = back.when(form == name, streamed(F.array(*parts), output))
    return back


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut, arranged and restored."""
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), d AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM t
), f AS (
  SELECT *, least(a, b) AS p, abs(a - b) AS m,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90
              THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), o AS (
  SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, m) AS middle, substr(text, p + m + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM o
"""
