"""HTML extraction, Unicode normalisation and line cleaning; narrow."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# Elements dropped with their content, and block elements whose closing tag ends a line.
DROPPED = ("script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside")
BLOCKS = "p|div|br|h[1-6]|li|tr|td|blockquote|pre"
# Named entities, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "--"), ("&ndash;", "-"), ("&hellip;", "..."), ("&copy;", "(c)"), ("&reg;", "(R)"))
# Zero-width characters, odd spaces, and lines taken for boilerplate.
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF, 0x00AD)))
ODD_SPACES = "".join(map(chr, (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
BOILERPLATE = (
    r"copyright\s*\d{4}",
    r"all rights reserved",
    r"terms (of|and) (use|service|conditions)",
    r"privacy policy",
    r"cookie (policy|settings|preferences)",
    r"subscribe to (our )?newsletter",
    r"follow us on",
    r"share (this|on)",
    r"click here to",
    r"powered by",
)
URL = r"""(?i)https?://[^\s<>"{}|\\^`\[\]]+"""


def is_html(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("<html") | low.contains("<body") | low.contains("<p>")


def title(html: Column) -> Column:
    """Body of the first title element, without tags, stripped; empty if there is none."""
    return T.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", ""))


def numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal references below 0x10000 decoded, others (and surrogates) removed."""

    def one(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^x?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.length(digits) <= 5, F.when(F.startswith(ref, F.lit("x")), F.conv(digits, 16, 10)).otherwise(digits)).cast("int")
        code = F.when(digits == "", 0).otherwise(code)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when((code < 0x10000) & ~code.between(0xD800, 0xDFFF), sign).otherwise("")

    def part(x: Column) -> Column:
        ref = F.regexp_extract(x, "^([0-9]+|x[0-9a-fA-F]+);", 1)
        return F.when(ref == "", F.concat(F.lit("&#"), x)).otherwise(F.concat(one(ref), F.substr(x, F.length(ref) + 2)))

    return T.let(F.split(text, "&#"), lambda parts: F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(part(x))), ""))


def strip_markup(html: Column) -> Column:
    """Comments and dropped elements removed, block ends as newlines, named entities decoded (first '&amp;')."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?is)<({'|'.join(DROPPED)})[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, rf"(?i)</({BLOCKS})>", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?\s*>", "\n")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return t


def tidy(text: Column, min_paragraph: int = 20) -> Column:
    """Remaining tags removed, white space squeezed, and the paragraphs of ``min_paragraph`` characters or more."""
    t = F.regexp_replace(text, "<[^>]+>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n", "\n\n")
    return F.filter(F.transform(T.lines(t), T.strip), lambda p: F.char_length(p) >= min_paragraph)


def extract(pages: DataFrame, html: str = "html", min_paragraph: int = 20) -> DataFrame:
    """``pages`` with ``title``, ``text``, ``num_paragraphs``, ``original_length``, ``extracted_length``, ``extraction_ratio``.

    A null page has null results.
    """
    marked = strip_markup(F.col(html))
    plain = T.once(pages, {"_marked": marked})
    decoded = T.once(plain, {"_marked": numeric_entities(F.col("_marked"))})
    out = T.once(decoded, {"_p": tidy(F.col("_marked"), min_paragraph)})
    out = out.withColumns({"title": title(F.col(html)), "text": F.array_join("_p", "\n\n"), "num_paragraphs": F.size("_p").cast("long"), "original_length": F.char_length(html).cast("long")})
    out = out.withColumn("extracted_length", F.char_length("text").cast("long"))
    return out.withColumn("extraction_ratio", T.share(F.col("extracted_length"), F.col("original_length"))).drop("_p", "_marked")


def compose(text: Column) -> Column:
    """NFKC; Spark has no function for it. ASCII texts pass untouched and are not sent to Python."""

    @F.pandas_udf("string")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)

    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize(text: Column) -> Column:
    """NFKC, no zero-width characters, plain spaces, no characters of category C but line ends and tabs, LF line ends."""
    t = F.translate(compose(text), ZERO_WIDTH, "")
    t = F.translate(t, ODD_SPACES, " " * len(ODD_SPACES))
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t\r]]", "")
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_short(text: Column) -> Column:
    """The short form: NFKC, four zero-width characters dropped, runs of spaces and tabs one space, at most one blank line
    in a row, stripped."""
    t = F.translate(compose(text), "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF))), "")
    return T.strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def without_urls(text: Column, replacement: str = "") -> Column:
    return F.regexp_replace(text, URL, replacement)


def is_boilerplate(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(BOILERPLATE))


def clean_lines(text: Column, min_words: int = 3, max_newlines: int = 2) -> Column:
    """Lines stripped, short and boilerplate ones dropped, blank ones kept, runs of newlines bounded, ends stripped."""
    kept = F.filter(F.transform(T.lines(text), T.strip), lambda x: (x == "") | ((F.size(T.words(x, lower=False)) >= min_words) & ~is_boilerplate(x)))
    return T.strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{%d,}" % (max_newlines + 1), "\n" * max_newlines))


def clean(text: Column, remove_urls: bool = True) -> Column:
    t = normalize(text)
    return clean_lines(without_urls(t) if remove_urls else t)


def process(pages: DataFrame, html: str = "html", min_output: int = 100) -> DataFrame:
    """Extract, clean, drop results under ``min_output`` characters, and count anew."""
    out = extract(pages, html).withColumn("text", clean(F.col("text"))).where(F.char_length("text") >= min_output)
    out = out.withColumn("extracted_length", F.char_length("text").cast("long"))
    paragraphs = F.size(F.filter(F.split("text", "\n\n"), lambda p: T.strip(p) != "")).cast("long")
    return out.withColumns({"extraction_ratio": T.share(F.col("extracted_length"), F.col("original_length")), "num_paragraphs": paragraphs})


def process_counts(pages: DataFrame, html: str = "html", min_output: int = 100) -> DataFrame:
    """One row: ``total`` pages, those that ``process`` keeps (``succeeded``) and those it drops (``discarded``)."""
    kept = process(pages, html, min_output).agg(F.count("*").alias("succeeded"))
    return pages.agg(F.count("*").alias("total")).crossJoin(F.broadcast(kept)).withColumn("discarded", F.col("total") - F.col("succeeded"))
