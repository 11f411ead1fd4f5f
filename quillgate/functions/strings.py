"""Small column functions for names, paths, bytes and figures in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column, empty: str = "issue") -> Column:
    """Runs of anything but ASCII letters, digits, dash and underscore become one underscore; blank becomes `empty`."""
    out = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "[^a-zA-Z0-9_-]+", "_")
    return F.when(out == "", empty).otherwise(out)


def metadata(text: Column) -> Column:
    """One line, with the six signs escaped that make Markdown code and links; null is empty."""
    line = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(line, r"([\\`\[\]()])", r"\\$1")


def no_headings(text: Column) -> Column:
    """A number sign that starts a line is escaped, so that foreign text makes no heading."""
    return F.regexp_replace(text, "(?m)^#", r"\\#")


def folded(path: Column) -> Column:
    """An absolute path without empty parts, `.` and `..`; `..` at the top stays there."""
    empty = F.array().cast("array<string>")
    step = lambda held, part: F.when(part.isin("", "."), held).when(part == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def whole(path: Column, base: Column) -> Column:
    """A path as one from the root: a relative one begins at the base."""
    return folded(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def manifest_path(path: Column, base: Column) -> Column:
    """(file_path, warnings) as a manifest in the folder `base` states a file: relative to the folder if it lies in it, else
    as it is, with a warning."""
    at, root = whole(path, base), folded(base)
    prefix = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    inside = at.startswith(prefix) & (at != root)
    held = F.when(at == root, F.lit(".")).when(inside, F.substring(at, F.length(prefix) + 1, F.length(at))).otherwise(path)
    return F.struct(held.alias("file_path"), F.when(~(inside | (at == root)), F.array(F.lit("absolute_path_requires_allow_absolute_flag"))).alias("warnings"))


def shown_path(path: Column, base: Column | str) -> Column:
    """A path as reports show it: from the base folder on, or of one outside it only the name; an unknown one was not
    generated.  Both are folded first, so that no detour leads out of the base unseen."""
    inside = manifest_path(path, F.lit(base) if isinstance(base, str) else base)
    name = F.regexp_extract(folded(path), r"([^/]*)$", 1)
    outside = F.concat(F.lit("<redacted-external-path>/"), F.when(name == "", "path").otherwise(name))
    return F.when(F.coalesce(path, F.lit("")) == "", "not generated").when(inside["warnings"].isNull(), inside["file_path"]).otherwise(outside)


def decoded(content: Column, charset: str = "UTF-8") -> Column:
    """Text of bytes, what is no character replaced, line ends as line feeds."""
    text = F.make_valid_utf8(content.cast("string")) if charset.upper() in ("UTF-8", "UTF8") else F.decode(content, charset)
    return F.regexp_replace(text, "\r\n?", "\n")


def digest(content: Column) -> Column:
    """SHA-256 and length of bytes."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def metric(value: Column) -> Column:
    """Three decimals, or n/a."""
    return F.when(value.isNotNull(), F.format_string("%.3f", value.cast("double"))).otherwise("n/a")
