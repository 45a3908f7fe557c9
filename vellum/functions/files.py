"""Expressions over file names, media types, paths and bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.config import FORMATS, MAGIC, MEDIA, READABLE, WRITABLE


def _lookup(c: Column, pairs) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), F.coalesce(c, F.lit("")))


def extension(name: Column) -> Column:
    """Last suffix of a name in lower case, with its dot; none for a leading or trailing dot."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.](?:[^/]*)?(\.[^./\s]+)$", 1))


def detect_format(name: Column, media: Column) -> Column:
    """Extension by the name if it is a known one, else by the media type, else null."""
    own = extension(name)
    by_media = _lookup(F.lower(F.trim(F.split_part(F.coalesce(media, F.lit("")), F.lit(";"), F.lit(1)))), MEDIA)
    return F.coalesce(F.when(_lookup(own, [f[:2] for f in FORMATS]).isNotNull(), own), by_media)


def kind_of(ext: Column) -> Column:
    """Kind of an extension; an unknown one is an error."""
    found = _lookup(F.lower(ext), [f[:2] for f in FORMATS])
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("Unsupported format "), ext)).cast("string"))


def label_of(ext: Column) -> Column:
    return F.coalesce(_lookup(F.lower(ext), [(f[0], f[2]) for f in FORMATS]), F.upper(F.regexp_replace(ext, r"^\.+", "")))


def output_label(out: Column, own: Column) -> Column:
    """What a file will be made into, by the extensions of the output and of the file; either may be empty."""
    named = F.coalesce(own, F.lit("")) != ""
    same = (F.coalesce(out, F.lit("")) == "") | (named & F.coalesce(same_kind(out, own), F.lit(False)))
    return F.when(same & named, F.concat(label_of(own), F.lit(" (same as input)"))).when(same, "same as input").otherwise(label_of(out))


def page_entry(name: Column, data: Column) -> Column:
    """Whether an entry of a package is a page: by its name, and a plain .xml by what its first 4 KiB say."""
    low = F.lower(name)
    head = F.lower(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"))
    fits = low.rlike(r"\.(?:xhtml|html|htm|xml)$") & ~low.endswith("container.xml") & ~F.contains(low, F.lit("meta-inf/"))
    return fits & (~low.endswith(".xml") | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("1999/xhtml")))


def same_kind(a: Column, b: Column) -> Column:
    return _lookup(F.lower(a), [f[:2] for f in FORMATS]) == _lookup(F.lower(b), [f[:2] for f in FORMATS])


def readable(ext: Column) -> Column:
    """Whether files of an extension can be read; null for unknown ones."""
    return _lookup(F.lower(ext), [f[:2] for f in FORMATS]).isin(*READABLE)


def writable(ext: Column) -> Column:
    """Whether files of an extension can be written; null for unknown ones."""
    return _lookup(F.lower(ext), [f[:2] for f in FORMATS]).isin(*WRITABLE)


def outputs() -> list[str]:
    """Extensions that conversion offers: the first of each kind that can be written."""
    first: dict[str, str] = {}
    for ext, kind, _ in FORMATS:
        if kind in WRITABLE:
            first.setdefault(kind, ext)
    return list(first.values())


def image_type(data: Column, hint: Column) -> Column:
    """struct(ext, mime) by first bytes, then by the hinted extension."""
    head = F.hex(F.substring(data, 1, 2048))
    of = lambda ext, mime: F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"))
    found = reduce(lambda w, m: w.when(head.startswith(m[0]), of(m[1], m[2])), MAGIC[1:], F.when(head.startswith(MAGIC[0][0]), of(*MAGIC[0][1:])))
    found = found.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), of(".webp", "image/webp"))
    text = F.lower(F.decode(F.substring(data, 1, 2048), "ISO-8859-1"))
    found = found.when(F.regexp_replace(head, "^(?:09|0A|0B|0C|0D|20)+", "").startswith("3C") & F.coalesce(text.contains("<svg"), F.lit(False)), of(".svg", "image/svg+xml"))
    known = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp", ".svg": "image/svg+xml"}
    hinted = F.lower(F.coalesce(hint, F.lit("")))
    for ext, mime in known.items():
        found = found.when(hinted == ext, of(".jpg" if ext == ".jpeg" else ext, mime))
    return found.otherwise(of(".bin", "application/octet-stream"))


def normal_path(base: Column, href: Column) -> Column:
    """href without fragment, percent-decoded, joined to the folder base, with . and .. resolved."""
    bare = F.regexp_replace(F.split_part(href, F.lit("#"), F.lit(1)), r"\+", "%2B")
    whole = F.concat_ws("/", F.when(base != "", base), F.coalesce(F.try_url_decode(bare), bare))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done: (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & up(done), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(walked, "/")


def part_name(name: Column, i: Column, n: Column) -> Column:
    ext = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^./]+$", "")
    return F.when(n == 1, name).otherwise(F.concat(stem, F.lit(" (part "), i.cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"), ext))


def safe_css(css: Column) -> Column:
    """Style sheet without imports, font faces and outside addresses."""
    css = F.regexp_replace(css, r"(?i)@import[^;]*;?", "")
    css = F.regexp_replace(css, r"(?is)@font-face\s*\{[^}]*\}", "")
    return F.regexp_replace(css, r"(?i)url\s*\([^)]*\)", "none")


def short_id(url: Column) -> Column:
    """Ten hex digits that stand for an address."""
    return F.left(F.sha1(url), F.lit(10))


def is_image(name: Column) -> Column:
    """Whether a name has the extension of a picture that packages can hold."""
    return extension(name).isin(".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".svg")


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def data_of_uri(uri: Column) -> Column:
    """Bytes of a data: address, base64 or percent-encoded; null if it is none or its base64 is damaged."""
    meta, rest = F.regexp_extract(uri, "(?s)^data:([^,]*),", 1), F.regexp_extract(uri, "(?s)^data:[^,]*,(.*)$", 1)
    packed = F.try_to_binary(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest), r"\s+", ""), F.lit("base64"))
    plain = F.encode(F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest), "UTF-8")
    return F.when(~uri.rlike("(?s)^data:[^,]*,"), None).when(F.contains(meta, F.lit(";base64")), packed).otherwise(plain)


def worker_url(url: Column) -> Column:
    """Address of a worker with a scheme and without brackets and closing slashes."""
    bare = F.regexp_replace(F.trim(url), r"^[<>]+|[<>]+$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def valid_worker(url: Column) -> Column:
    """A host with a dot, localhost or an address, an optional port, an optional path without white space."""
    return url.rlike(r"(?i)^https?://(?:(?:[\w-]+\.)+[\w-]+|localhost)(?::\d+)?(?:/\S*)?$")
