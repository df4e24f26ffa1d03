"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Everything but the decoding of character references is a DataFrame expression. A record is a row: its named fields, its block as text and the digests;
write_warc lays rows out as WARC/1.1 files. Identifiers follow from the content, so a rerun gives the same.
"""

from __future__ import annotations

import gzip
import html as html_names
import html.entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The inside of a tag, where a > may stand in quotes; what has no text, title or links (an unclosed one goes on to the
#: end); tags that end a line; all tags. SQL has the same patterns, but for *+, which only saves Java from deep recursion.
INSIDE = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+"""
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<script\b{INSIDE}>.*?(?:</script\b[^>]*>|\z)|<style\b{INSIDE}>.*?(?:</style\b[^>]*>|\z)"
HEAD = rf"(?is)<head\b{INSIDE}>.*?</head\b[^>]*>"
BREAKS = rf"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre)\b{INSIDE}>"
TAGS = rf"<[a-zA-Z/!?]{INSIDE}>|<[a-zA-Z/!?][^>]*>"
#: A character reference, named, decimal or hexadecimal, as in HTML5.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
#: White space in tags. Links: tags are taken one by one, so that none is found in a quoted value, and only <a ...> is
#: given back; attributes are taken one by one, so that the name is href and nothing else.
WS = r"[ \t\n\f\r]"
LINK_TAG = rf"(?i)(<a(?:{WS}|/){INSIDE}>)|<[a-zA-Z/!?]{INSIDE}>"
ATTRIBUTE = rf"""[^ \t\n\f\r"'>/=]+(?:{WS}*={WS}*(?:"[^"]*"|'[^']*'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*))?"""
HREF = rf"(?i)^href{WS}*={WS}*"
#: A character reference in an attribute: without a semicolon, and before a letter, digit or =, it is none.
ATTRIBUTE_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*[;=]?)")
#: Of pages without a date or an HTTP head of their own: the date, and the head's first lines.
DATE = "2024-01-01T00:00:00Z"
STATUS, HEADERS = "HTTP/1.1 200 OK", ("Content-Type: text/html; charset=utf-8",)
#: Characters that may not stand in a header's value.
CONTROL = "[\\x00-\\x1f\\x7f]"


def decoded_text(s: str) -> str:
    """All references of HTML5 in one pass, as html.unescape has them, but that a decoded no-break space is a space
    and a number of over 4000 characters, which Python does not read, is the replacement character."""

    def char(m: re.Match) -> str:
        return "\ufffd" if len(m[0]) > 4000 else html_names.unescape(m[0]).replace("\xa0", " ")

    return REFERENCE.sub(char, s) if "&" in s else s


def decoded_value(s: str) -> str:
    """All references of an attribute's value, as HTML5 has them there; the rest as in decoded_text."""

    def char(m: re.Match) -> str:
        known = m[0][1] == "#" or m[0][1:] in html_names.entities.html5
        return decoded_text(m[0]) if known else m[0]

    return ATTRIBUTE_REFERENCE.sub(char, s) if "&" in s else s


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded_values(c: pd.Series) -> pd.Series:
    return c.map(lambda values: [decoded_value(v) for v in values], na_action="ignore")


@F.pandas_udf(T.StringType())
def _decoded(c: pd.Series) -> pd.Series:
    return c.map(decoded_text, na_action="ignore")


def visible(html: Column) -> Column:
    """Without comments, scripts and styles; null is empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def html_text(html: Column) -> Column:
    """Plain text: comments, scripts, styles and the head go; block tags break lines; white space is squeezed."""
    return _text(visible(html))


def html_title(html: Column) -> Column:
    """The first title outside comments, scripts and styles, decoded, white space squeezed; empty where there is none."""
    return _title(visible(html))


def html_links(html: Column) -> Column:
    """What the a tags outside comments, scripts and styles link to, in order, repeats included, as written but decoded and
    without line ends and tabs: the first href of each tag. Tags that are not closed, and those without a href or with an
    empty one, give none; a null html gives an empty array."""
    return _links(visible(html))


def _text(html: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HEAD, " "), BREAKS, "\n"), TAGS, "")
    c = F.regexp_replace(_decoded(c), "[ \t\r\f]+", " ")
    c = F.regexp_replace(c, " ?\n[ \n]*", "\n")
    return F.regexp_replace(c, "^[ \n]+|[ \n]+$", "")


def _title(html: Column) -> Column:
    c = F.regexp_replace(_decoded(F.regexp_extract(html, TITLE, 1)), "[ \t\r\n\f]+", " ")
    return F.regexp_replace(c, "^ +| +$", "")


def _links(html: Column) -> Column:
    tags = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(1)), lambda t: t != "")
    first = F.transform(tags, lambda t: F.get(F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(HREF)), F.lit(0)))
    bare = F.transform(F.array_compact(first), lambda a: F.regexp_replace(a, HREF, ""))
    value = F.transform(bare, lambda v: F.when(v.substr(1, 1).isin('"', "'"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
    clean = F.transform(_decoded_values(value), lambda v: F.regexp_replace(F.regexp_replace(v, "[\t\n\r]", ""), "^ +| +$", ""))
    return F.filter(clean, lambda v: v != "")


def record_id(kind: str, key: Column) -> Column:
    """<urn:uuid:...> from the md5 of a record's kind and key."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def safe_value(c: Column) -> Column:
    """A header's value with control characters, line ends among them, percent-encoded."""
    coded = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(x), 2, "0"))).otherwise(x))
    return F.when(c.rlike(CONTROL), F.array_join(coded, "")).otherwise(c)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, date_col: str | None = None, headers_col: str | None = None) -> DataFrame:
    """pages -> response rows: (key, record_id, target_uri, date, http, payload, payload_digest, block_digest).

    headers_col: each page's HTTP head as text, status line first; date_col: its date. Without them, and where they
    are null, the head is a stand-in (STATUS, HEADERS and the length) and the date is ``date``. A null url or html is
    empty and a null id is the key "null"; repeated rows give records with the same identifier, as their content is
    the same. Other columns are not read.
    """
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), url, F.sha2(html.cast("binary"), 256))
    http = F.concat(F.lit("\r\n".join([STATUS, *HEADERS, "Content-Length: "])), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    if headers_col:
        http = F.coalesce(F.concat(F.regexp_replace(F.col(headers_col), "[\r\n]+$", ""), F.lit("\r\n\r\n")), http)
    return pages.select(
        F.col(id_col).alias("key"),
        record_id("response", key).alias("record_id"),
        url.alias("target_uri"),
        (F.coalesce(F.col(date_col).cast("string"), F.lit(date)) if date_col else F.lit(date)).alias("date"),
        http.alias("http"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
        digest(F.concat(http, html)).alias("block_digest"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Response rows -> one row each with the fields of its metadata and conversion records.

    (key, target_uri, date, refers_to, payload_digest, source_headers, metadata_id, metadata_block,
    metadata_digest, conversion_id, conversion_block, conversion_digest, title, n_links). refers_to is the
    response's identifier; source_headers its HTTP head without the last blank line, each header of which is a line
    of the metadata block. An empty payload has an empty conversion block, no title and no links.
    """
    df = found.withColumn("__seen", visible(F.col("payload")))
    df = df.withColumns({"title": _title(F.col("__seen")), "links": _links(F.col("__seen")), "conversion_block": _text(F.col("__seen")), "source_headers": F.regexp_replace("http", "(\r\n)+$", "")})
    heads = F.split("source_headers", "\r\n")

    def many(name: str, values: Column) -> Column:
        return F.array_join(F.transform(values, lambda x: F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))), "")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    block = F.concat(
        line("refers-to", F.col("record_id")),
        line("source-status", safe_value(heads[0])),
        many("source-header", F.transform(F.slice(heads, 2, F.size(heads)), safe_value)),
        line("source-payload-digest", F.col("payload_digest")),
        line("title", safe_value(F.col("title"))),
        line("outlinks", F.size("links").cast("string")),
        many("outlink", F.transform("links", safe_value)),
    )
    df = df.withColumn("metadata_block", block)
    return df.select(
        "key",
        "target_uri",
        "date",
        F.col("record_id").alias("refers_to"),
        "payload_digest",
        "source_headers",
        record_id("metadata", F.col("record_id")).alias("metadata_id"),
        "metadata_block",
        digest(F.col("metadata_block")).alias("metadata_digest"),
        record_id("conversion", F.col("record_id")).alias("conversion_id"),
        "conversion_block",
        digest(F.col("conversion_block")).alias("conversion_digest"),
        "title",
        F.size("links").alias("n_links"),
    )


def _laid_out(kind: str, ident: Column, block: Column, mime: str, more: dict[str, Column]) -> Column:
    """A record's head and block. Urls and dates come from the pages, so their control characters are encoded."""
    heads = {"WARC-Type": F.lit(kind), "WARC-Record-ID": ident, "WARC-Date": F.col("date"), "WARC-Target-URI": F.col("target_uri"), **more, "WARC-Block-Digest": digest(block), "Content-Type": F.lit(mime), "Content-Length": F.octet_length(block).cast("string")}
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.concat(F.lit(f"{k}: "), safe_value(v), F.lit("\r\n")) for k, v in heads.items()), F.lit("\r\n"), block)


def warc_records(df: DataFrame) -> DataFrame:
    """Derivative rows -> (key, kind, record): each record's head and block; a conversion and a metadata each."""
    link = {"WARC-Refers-To": F.col("refers_to"), "WARC-Refers-To-Target-URI": F.col("target_uri"), "WARC-Refers-To-Date": F.col("date")}
    made = {
        "metadata": _laid_out("metadata", F.col("metadata_id"), F.col("metadata_block"), "application/warc-fields", link),
        "conversion": _laid_out("conversion", F.col("conversion_id"), F.col("conversion_block"), "text/plain; charset=utf-8", link),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("record")) for k, v in made.items()))
    return df.select("key", F.explode(rows).alias("x")).select("key", "x.kind", "x.record")


def response_records(found: DataFrame) -> DataFrame:
    """Response rows -> (key, kind, record)."""
    record = _laid_out("response", F.col("record_id"), F.concat("http", "payload"), "application/http; msgtype=response", {"WARC-Payload-Digest": F.col("payload_digest")})
    return found.select("key", F.lit("response").alias("kind"), record.alias("record"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Write records as WARC files through Spark's own writer: a record ends with two line ends."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """WARC files, plain or gzip, -> (kind, record_id, target_uri, date, refers_to, block_digest, block binary).

    One file is one task's memory, so keep records_per_file bounded when writing. Heads that are not UTF-8 have
    replacement characters; blocks are bytes as they are. A file cut short gives an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"warc-type": 0, "warc-record-id": 1, "warc-target-uri": 2, "warc-date": 3, "warc-refers-to": 4, "warc-block-digest": 5}
        for batch in batches:
            for content in batch.column(0):
                data, at, rows = content.as_py(), 0, []
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)  # of all members
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at)
                    row, size = [None] * 7, 0
                    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                        name, _, value = line.partition(":")
                        if name.lower() in names:
                            row[names[name.lower()]] = value.strip()
                        elif name.lower() == "content-length":
                            size = int(value)
                    if end < 0 or end + 4 + size + 4 > len(data):
                        raise ValueError("a WARC file is cut short")
                    at = end + 4 + size + 4
                    row[6] = data[end + 4 : end + 4 + size]
                    rows.append(row)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.string()) for i, c in enumerate(columns)], ["kind", "record_id", "target_uri", "date", "refers_to", "block_digest", "block"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")
    return found.mapInArrow(parse, "kind string, record_id string, target_uri string, date string, refers_to string, block_digest string, block binary")
