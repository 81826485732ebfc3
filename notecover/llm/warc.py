"""WARC derivatives (operator 6): a response, a metadata and a conversion record per page.

The response holds the page as it came: status line, source headers and html. From it are
derived a ``metadata`` record (charset, language, title, counts of links, the response's
digests) and a ``conversion`` record (the plain text). Both name the response in
``WARC-Refers-To`` and keep its target and date; all carry block and payload digests
(SHA-1 over UTF-8 bytes, base 16) and lengths in bytes. Record ids are hashes of what the
record is made from, so a run that is repeated names the same records.

Character references in the text, all names of HTML and decimal and hexadecimal numbers, become
characters if they end in a semicolon; others stay as they are.

One narrow pass of SQL functions, no shuffle. The given pages hold no headers of their own, so
those of ``Warc`` stand for them. Defined cases: null html has an empty payload
and text; a null url an empty target; a null page_id takes part in the ids as ``null``;
equal rows make equal records; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html.entities
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C


@dataclass(frozen=True)
class Warc:
    date: str = "1970-01-01T00:00:00Z"          # the crawl's date, where a page has none
    content_type: str = "text/html; charset=utf-8"
    server: str = "unknown"


#: Tags that end a line of text (fixed values).
BLOCK_TAGS = "p|br|div|li|ul|ol|tr|td|th|h[1-6]|article|section|nav|header|footer|table|title|body|head|html"
#: The names met most often are looked up first.
COMMON = ("nbsp", "amp", "quot", "lt", "gt", "apos", "copy", "middot", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "hellip")


def _names() -> dict[str, str]:
    """Characters of all named references that end in a semicolon."""
    table = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} | {"nbsp": " "}
    return {k: table[k] for k in COMMON} | table


def characters(text: Column) -> Column:
    """``text`` with its character references resolved, once and from the left. Numbers without a
    character become U+FFFD, 128 to 159 what Windows-1252 has there, no-break spaces spaces."""
    names = _names()
    table = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))
    latin = F.lit([ord(bytes([b]).decode("cp1252")) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else b for b in range(128, 160)])

    def number(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.ltrim(F.substr(name, F.when(hexadecimal, 3).otherwise(2)), F.lit("0"))
        value = F.when(F.length(digits).between(1, 7), F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)))
        return F.when(F.substring(name, 1, 1) == "#", F.coalesce(value.cast("bigint"), F.lit(0)))

    def char(n: Column) -> Column:
        n = (F.when(n == 160, 32).when(n.between(128, 159), F.get(latin, (n - 128).cast("int")))
             .when((n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), 0xFFFD).otherwise(n).cast("bigint"))
        high = F.hex(F.lit(0xD800) + F.floor((n - 0x10000) / 1024))
        return F.decode(F.unhex(F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(high, F.hex(F.lit(0xDC00) + n % 1024)))), "UTF-16BE")

    parts = F.transform(F.split(text, "&"), lambda x: F.struct(x.alias("x"), F.regexp_extract(
        x, "^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1).alias("name")))
    parts = F.transform(parts, lambda s: F.struct(s["x"].alias("x"), s["name"].alias("name"), F.coalesce(char(number(s["name"])), table[s["name"]]).alias("c")))
    return F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s["x"]).when(s["c"].isNull(), F.concat(F.lit("&"), s["x"]))
                                    .otherwise(F.concat(s["c"], F.substr(s["x"], F.length(s["name"]) + 2)))), "")


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, block tags end lines, white space is
    joined, character references become characters."""
    t = F.regexp_replace(html, "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    t = F.regexp_replace(t, f"(?i)</?({BLOCK_TAGS})(\\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    t = F.regexp_replace(characters(t), "[ \\t\\r\\f]+", " ")
    t = F.regexp_replace(t, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(c.cast("binary")))


def derive(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """Three rows per row of pages(page_id, url, html): page_id, record_type, record_id,
    refers_to, target_uri, date, content_type, headers, block, content_length, block_digest,
    payload_digest."""
    d = C.only(pages, page_id="bigint", url="string", html="string").select(
        "page_id", F.coalesce("url", F.lit("")).alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    d = d.withColumn("source", F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {p.content_type}\r\nServer: {p.server}\r\nContent-Length: "),
                                        F.octet_length("html").cast("string"), F.lit("\r\n\r\n")))
    d = (d.withColumn("response_id", _urn("response", F.col("page_id"), F.col("uri"), F.sha1(F.col("html").cast("binary"))))
         .withColumn("payload_digest", _digest(F.col("html"))).withColumn("text", plain_text(F.col("html"))))
    lang = F.lower(F.regexp_extract("html", "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z-]+)", 1))
    title = F.regexp_replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1), "\\s+", " ")
    fields = F.concat(
        F.lit("source-content-type: " + p.content_type + "\r\nsource-server: " + p.server + "\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nlanguage: "), lang, F.lit("\r\ntitle: "), title,
        F.lit("\r\nlinks: "), F.regexp_count("html", F.lit("(?i)<a\\s[^>]*href")).cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\n"))

    def record(kind: str, refers: Column, content_type: str, block: Column, payload: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), refers.alias("refers_to"), F.lit(content_type).alias("content_type"),
                        block.alias("block"), payload.alias("payload_digest"))

    none = F.lit(None).cast("string")
    three = d.select("page_id", "uri", "response_id", F.explode(F.array(
        record("response", none, "application/http; msgtype=response", F.concat("source", "html"), F.col("payload_digest")),
        record("metadata", F.col("response_id"), "application/warc-fields", fields, none),
        record("conversion", F.col("response_id"), "text/plain; charset=utf-8", F.col("text"), _digest(F.col("text"))))).alias("r")).select("page_id", "uri", "response_id", "r.*")
    three = (three.withColumn("record_id", F.when(F.col("record_type") == "response", F.col("response_id"))
                              .otherwise(_urn("derived", F.col("record_type"), F.col("response_id"))))
             .withColumn("block_digest", _digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long")))
    optional = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\r\n"))).otherwise(F.lit(""))
                for name, c in (("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"))]
    headers = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
                       F.lit(f"\r\nWARC-Date: {p.date}\r\nWARC-Target-URI: "), F.col("uri"), F.lit("\r\n"), *optional,
                       F.lit("WARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
                       F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    return three.select("page_id", "record_type", "record_id", "refers_to", F.col("uri").alias("target_uri"), F.lit(p.date).alias("date"),
                        "content_type", headers.alias("headers"), "block", "content_length", "block_digest", "payload_digest")


def write(records: DataFrame, path: str) -> None:
    """Records in WARC form, as compressed text parts (headers, block, two empty lines), one gzip stream a part."""
    (records.select(F.concat("headers", "block", F.lit("\r\n\r\n")).alias("value"))
     .write.option("compression", "gzip").option("lineSep", "").text(path))
