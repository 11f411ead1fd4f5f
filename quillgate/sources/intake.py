"""Manifest and URL checks, filename hints, text and JSONL scans, and visible page text."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgate.operators.numbering import number_within
from quillgate.session import prepare

# Hints in file names, in order of priority; sources that a hint may not raise
HINTS = {
    "official": ["official", "exchange", "regulator", "agency", "ministry", "gov", "government"],
    "social": ["social", "tweet", "xpost", "x_post", "reddit"],
    "community": ["community", "forum", "board", "thread"],
    "news": ["news", "article", "wire", "headline", "press"],
    "analyst": ["analyst", "commentary", "opinion", "research"],
}
TRUSTED = ["official", "company"]
ALIASES = {"finance_commentary": "analyst", "commentary": "analyst", "forum": "community", "mixed": "unknown"}
SKIPPED_TAGS = frozenset("button footer form head header nav noscript option script select style svg textarea".split())
BLOCK_TAGS = frozenset("article br dd div dt h1 h2 h3 h4 h5 h6 li main p section td th tr".split())
KEPT_TAGS = frozenset("article body html main".split())
BOILERPLATE = [
    "ambox", "catlinks", "infobox", "metadata", "mw-editsection", "mw-table-of-contents", "navbox", "sidebar", "toccolours",
    "vector-main-menu", "vector-toc",
]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole .txt and .md files: path, text (byte order mark dropped), is_valid; ordered scans sort by lower name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(path)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return raw.select("path", F.when(ok, text).alias("text"), ok.alias("is_valid"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON Lines; a missing file has none, blank lines are none, a broken one fails the read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A manifest object's sources, one row each with its place."""
    whole = spark.read.option("multiLine", True).schema(f"issue_id string, sources array<struct<{source}>>").json(path)
    return whole.select("issue_id", F.posexplode("sources").alias("at", "source")).select("issue_id", "at", "source.*")


def duplicate_names(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Second and later rows of a name, ignoring case, with the place of the first."""
    rows = df.withColumn("__name", F.lower(name))
    return number_within(rows, [*keys, "__name"], order, "nth", "first_at").drop("__name").filter("nth > 1")


# Services whose host names hold the address that they resolve to
EMBEDDING_HOSTS = (".nip.io", ".sslip.io")


def _address(text: str):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    mapped = getattr(ip, "ipv4_mapped", None)
    if mapped is not None:
        return mapped
    # The older form of a v4 address within a v6 one; :: and ::1 stand for themselves.
    return ipaddress.IPv4Address(int(ip)) if ip.version == 6 and 1 < int(ip) < 1 << 32 else ip


@lru_cache(10_000)
def host_problem(host: str) -> str | None:
    """The first rule that a host breaks, without asking any name server; it fails closed."""
    name = host.strip().removeprefix("[").removesuffix("]").rstrip(".").lower()
    if not name:
        return "missing host"
    if not name.isascii() or not re.fullmatch(r"[a-z0-9._~%:-]+", name):
        return "host not in ASCII form"
    if name == "localhost" or name.endswith(".localhost"):
        return "localhost"
    for suffix in EMBEDDING_HOSTS:
        if name.endswith(suffix):
            rest = name.removesuffix(suffix)
            parts = [rest, rest.replace("-", "."), rest.rsplit(".", 1)[-1].replace("-", "."), ".".join(rest.split(".")[-4:])]
            if any((ip := _address(p)) is not None and not ip.is_global for p in parts):
                return "address not global"
    ip = _address(name)
    if ip is not None:
        return None if ip.is_global else "address not global"
    if ":" in name:
        return "host not in ASCII form"
    if re.fullmatch(r"(0x[0-9a-f]+|[0-9]+)(\.(0x[0-9a-f]+|[0-9]+))*", name):
        return "address not canonical"
    return None


@F.pandas_udf(StringType())
def _host_problems(hosts: pd.Series) -> pd.Series:
    return hosts.map(host_problem, na_action="ignore")


def url_problem(url: Column) -> Column:
    """The first rule of the URL policy that the URL breaks, or null.  Plain host names of letters stay in the JVM;
    addresses, and names that may stand for one, are parsed."""
    prepare()
    trimmed = F.trim(url)
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", ""))
    port = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    plain = host.rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$") & ~host.rlike(r"\.(nip|sslip)\.io$") & ~host.endswith(".localhost")
    return (
        F.when(url.isNull() | (trimmed == ""), "missing url")
        .when(~scheme.isin("http", "https"), "scheme not allowed")
        .when(host == "", "missing host")
        .when(authority.contains("@"), "credentials in url")
        .when((port != "") & ~port.isin("80", "443"), "port not allowed")
        .otherwise(_host_problems(F.when(~plain, host)))
    )


def path_problem(path: Column, allow_absolute: bool = False) -> Column:
    """The first rule of the path policy that a manifest's path breaks, or null.  Absolute paths must be allowed expressly;
    links, missing files and paths that leave their folder by a link are found where the files are read."""
    return (
        F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "looks like a url")
        .when(path.rlike(r"^([A-Za-z]:[\\/]|\\\\)"), "windows absolute path")
        .when(path.startswith("/") & F.lit(not allow_absolute), "absolute path")
        .when(path.rlike(r"(^|[\\/])\.\.([\\/]|$)"), "parent directory")
        .when(~F.lower(path).rlike(r"\.(txt|md)$"), "suffix not allowed")
    )


def filename_type(name: Column) -> tuple[Column, Column]:
    """The source type that a file name hints at (never a trusted one), and whether a trusted hint was ignored."""
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "[^a-z0-9]+", " "), " ")
    hint = None
    for kind, hints in HINTS.items():
        met = F.arrays_overlap(words, F.array(*map(F.lit, hints)))
        hint = F.when(met, kind) if hint is None else hint.when(met, kind)
    return F.when(hint.isin(TRUSTED), "unknown").otherwise(F.coalesce(hint, F.lit("unknown"))), F.coalesce(hint.isin(TRUSTED), F.lit(False))


class _Visible(HTMLParser):
    """Visible text; a depth counter, not a name stack, closes skipped elements, so nesting does not leak."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skipped, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.depth += tag == self.skipped
            return
        names = " ".join((v or "").lower() for k, v in attrs if k in ("class", "id", "role"))
        if tag in SKIPPED_TAGS or (tag not in KEPT_TAGS and tag not in ("br", "hr", "img", "input", "meta", "link") and any(b in names for b in BOILERPLATE)):
            self.skipped, self.depth = tag, 1
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skipped:
            self.depth -= tag == self.skipped
            if not self.depth:
                self.skipped = None
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skipped and data.strip():
            self.parts.append(" ".join(data.split()))


def visible_text(df: DataFrame, key: str, page: str) -> DataFrame:
    """key, text: lines of visible text of each page; a page without any gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h in b.column(1).to_pylist():
                v = _Visible()
                v.feed(h or "")
                v.close()
                lines = (" ".join(x.split()) for x in " ".join(v.parts).splitlines())
                texts.append("\n".join(x for x in lines if x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.select(key, df[page].cast("string")).mapInArrow(run, f"{key} {kind}, text string")
