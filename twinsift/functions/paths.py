"""Columns over paths, names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the file categories; every other extension is Other.
FILE_TYPES = {
    "Videos": ".mp4 .mkv .avi .mov .wmv .webm .m4v .mpg .mpeg .ts .mts .m2ts .flv .vob .3gp .ogv".split(),
    "Images": ".jpg .jpeg .png .gif .bmp .webp .tif .tiff .heic .heif .avif .ico .svg .raw .cr2 .cr3 .nef .arw .dng .psd".split(),
    "Archives": ".zip .zipx .7z .rar .tar .gz .bz2 .xz .tgz .tbz2 .txz .zst .cab .iso".split(),
    "Documents": ".pdf .doc .docx .docm .odt .rtf .txt .md .xls .xlsx .xlsm .ods .csv .ppt .pptx .pptm .odp .epub .mobi".split(),
    "Audio": ".mp3 .wav .flac .aac .m4a .ogg .opus .wma .aiff .aif .alac .ape .mid .midi".split(),
}
# What copies of a file are called.
COPY_PREFIX = r"^Copy(?:\s+of)?[\s_-]+"
COPY_SUFFIX = r"[\s_-]+Copy(?:\s*\(\d+\))?$"


def casefold(text: Column) -> Column:
    """Caseless form, JVM-side: through upper case, so that ß meets SS; final sigma and dotless i are kept apart.

    A private character stands in for dotless i, and sits between the conversions lest they be taken for one.
    """
    held = "\ue000"
    upper = F.translate(F.upper(F.translate(text, "ı", held)), held, held)
    return F.translate(F.lower(upper), f"ς{held}", "σı")


def text_key(text: Column, case_sensitive: bool = False) -> Column:
    return text if case_sensitive else casefold(text)


def parent(path: Column) -> Column:
    """The folder of an absolute path; the root's parent is the root."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; '' for names like .profile or a."""
    return F.regexp_extract(name(path), r"^.*[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return n.substr(F.lit(1), F.length(n) - F.length(suffix(path)))


def filename_key(path: Column, *, ignore_copy: bool = False, case_sensitive: bool = False) -> Column:
    """Name by which files are matched; with ``ignore_copy``, without the marks that copying adds to the stem."""
    base = stem(path)
    if ignore_copy:
        flags = "(?U)" if case_sensitive else "(?iU)"
        base = F.regexp_replace(F.regexp_replace(base, flags + COPY_PREFIX, ""), flags + COPY_SUFFIX, "")
    return text_key(F.concat(base, suffix(path)), case_sensitive)


def parts(path: Column) -> Column:
    """Names from the root down, the root left out."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def ancestors(path: Column, *, itself: bool = False) -> Column:
    """Every folder above a path, '/' first; with ``itself``, the path last."""
    p = parts(path)
    up = F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(p, 1, k), "/")))
    every = F.when(F.size(p) == 0, F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), up))
    return every if itself else F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.slice(every, 1, F.size(p)))


def is_within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies below it."""
    return (path == folder) | (folder == "/") | F.startswith(path, F.concat(folder, F.lit("/")))


def folder_key(path: Column, root: Column, *, full: bool = False, from_root: bool = False, depth_limit: int | None = None, case_sensitive: bool = False) -> Column:
    """What two files' folders are compared by: the name, the full path, the path below the root, or its first names.

    With a depth, a flag tells paths that are shorter than it apart from those cut to it.
    """
    folder = parent(path)
    below = parts(folder)
    if from_root:
        n = F.size(parts(root))
        below = F.slice(below, n + 1, F.greatest(F.size(below) - n, F.lit(0)))
    fold = lambda x: text_key(x, case_sensitive)
    if depth_limit is not None:
        head = F.array_join(F.transform(F.slice(below, 1, depth_limit), fold), "/")
        return F.concat_ws("|", F.when(F.size(below) >= depth_limit, "full").otherwise("short"), head)
    if from_root:
        return F.array_join(F.transform(below, fold), "/")
    return fold(folder if full else name(folder))


def date_key(time_ns: Column, date_only: bool) -> Column:
    """Nanoseconds, or the calendar day of the session's time zone."""
    if not date_only:
        return time_ns.cast("string")
    return F.date_format(F.timestamp_micros(F.floor(time_ns / F.lit(1000)).cast("long")), "yyyy-MM-dd")


def file_type(path: Column) -> Column:
    ending = casefold(suffix(path))
    out = F.lit("Other")
    for kind, endings in reversed(FILE_TYPES.items()):
        out = F.when(ending.isin(endings), kind).otherwise(out)
    return out


def check_file_types(selected) -> frozenset[str] | None:
    """The categories to keep; None keeps all, an unknown one is an error."""
    if selected is None:
        return None
    selected = frozenset(selected)
    if unknown := selected - FILE_TYPES.keys() - {"Other"}:
        raise ValueError(f"unknown file categories: {sorted(unknown)}")
    return selected


def similar_text(a: Column, b: Column, tolerance: int) -> Column:
    """Edit distance at most ``tolerance``; work stops beyond it."""
    return F.levenshtein(a, b, tolerance) >= 0


def format_bytes(n: Column) -> Column:
    """1,234 B, 1.21 KiB and so on up to TiB."""
    out = F.concat(F.format_number(n / float(1 << 40), 2), F.lit(" TiB"))
    for k, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        out = F.when(n < (1 << (k + 10)), F.concat(F.format_number(n / float(1 << k), 2), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" B"))).otherwise(out)


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def rejection(attributes: Column, tag: Column, *, allow_cloud: bool = False) -> Column:
    """Why an entry must not be followed or read, or null: a link, an unknown reparse point, a cloud or offline entry."""
    # Attribute bits, the bit of redirecting tags, and the family of cloud tags.
    reparse, redirects, cloud, offline = 0x400, 0x20000000, 0x9000001A, 0x1000 | 0x40000 | 0x400000
    is_reparse = attributes.bitwiseAND(F.lit(reparse)) != 0
    other = tag.bitwiseAND(F.lit(~0xF000 & 0xFFFFFFFF)) != cloud
    out = F.when(is_reparse & (tag.bitwiseAND(F.lit(redirects)) != 0), "link").when(is_reparse & other, "unsupported reparse point")
    if not allow_cloud:
        out = out.when(is_reparse, "cloud entry")
    return out.when(attributes.bitwiseAND(F.lit(offline)) != 0, "not available locally")
