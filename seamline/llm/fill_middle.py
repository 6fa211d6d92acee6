"""Fill-in-middle examples: texts are split by a lookaround regex at the boundaries of their units, and two cuts reorder prefix, middle and suffix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Units:
    """A grammar of units: maximal runs of signs of a class, and every other sign alone."""

    joined: str = "A-Za-z"

    def boundary(self) -> str:
        """A pattern without width for the places between two signs of which one is no sign of the class, inside the text.

        A place inside a sign of two UTF-16 units isn't a boundary.
        """
        return rf"(?<!\A)(?!\z)(?![\x{{DC00}}-\x{{DFFF}}])(?:(?<=[^{self.joined}])|(?=[^{self.joined}]))"


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


PLAIN_FROM, SPM_BELOW = 90, 20


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers by the id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def pieces_of(text: Column, units: Units = Units()) -> Column:
    """The units of a text in order; none of an empty text, which a split would give one empty piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, units.boundary(), -1))


def fill_in_middle(docs: DataFrame, seed: int = 1, units: Units = Units(), marks: Marks = Marks()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text, output) for each row of ``docs`` (doc_id, text).

    n is the number of units; the id draws two cuts between them and the form.
    psm is prefix, suffix, middle; spm is suffix, prefix, middle, each behind
    its mark. A text that is empty or holds a mark stays plain, as do those that
    are drawn to; prefix_chars and middle_chars are null then. A null text
    counts as empty and a null doc_id as an empty id; repeated rows are cut
    alike; other columns are ignored; no rows give no rows. Nothing is shuffled
    and a very long text is one row like others: its units are an array in memory.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.array(*draws(F.col("doc_id"), seed)).alias("_h"))
    cut = rows.withColumn("_units", pieces_of(F.col("text"), units)).withColumn("n", F.size("_units").cast("long"))
    h = lambda k: F.get("_h", F.lit(k))
    ends = F.array_sort(F.array(h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)))
    marked = F.contains("text", F.lit(marks.prefix)) | F.contains("text", F.lit(marks.suffix)) | F.contains("text", F.lit(marks.middle))
    form = F.when((F.col("n") == 0) | marked | (h(2) % 100 >= PLAIN_FROM), "plain").when(h(3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", "n", "_units", form.alias("form"), ends.alias("_ends"))
    first, last = (F.get("_ends", F.lit(k)).cast("int") for k in (0, 1))
    chars = lambda begin, length: F.length(F.array_join(F.slice("_units", begin, length), ""))
    sized = placed.select("doc_id", "text", "n", "form", F.when(F.col("form") != "plain", chars(F.lit(1), first)).alias("_a"), F.when(F.col("form") != "plain", chars(first + 1, last - first)).alias("_b"))
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    prefix, middle, suffix = (F.substring("text", begin, size) for begin, size in ((F.lit(1), a), (a + 1, b), (a + b + 1, F.length("text"))))
    head, tail = (F.concat(F.lit(marks.prefix), prefix), F.concat(F.lit(marks.suffix), suffix))
    output = F.when(F.col("form") == "psm", F.concat(head, tail, F.lit(marks.middle), middle)).when(F.col("form") == "spm", F.concat(tail, head, F.lit(marks.middle), middle)).otherwise(F.col("text"))
    return sized.select("doc_id", "n", "form", F.col("_a").cast("long").alias("prefix_chars"), F.col("_b").cast("long").alias("middle_chars"), "text", output.alias("output"))


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from: its parts stand behind marks, which no part holds."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    middle = F.split_part(output, F.lit(marks.middle), F.lit(2))
    psm = F.concat(between(marks.prefix, marks.suffix), middle, between(marks.suffix, marks.middle))
    spm = F.concat(between(marks.prefix, marks.middle), middle, between(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = rf"""
with docs as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from docs),
placed as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form from cut),
parts as (select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from parts"""
