"""Names, formats and stages of files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings and the format they are read as.
FORMATS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "csv": "txt", "html": "txt", "htm": "txt", "md": "txt", "hwp": "hwp", "xls": "xlsx", "txt": "txt"}
# Endings of files that hold no text.
BINARY = ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "psd", "mp4", "mkv", "avi", "mov", "wav", "mp3", "zip", "7z", "rar", "tar", "gz", "stl", "obj", "stp", "step", "123dx", "ps", "eps", "bak", "tmp", "lnk", "exe", "dll", "doc", "ppt"]
#: Only the beginning of a file is hashed.
HASHED_BYTES = 8 * 1024 * 1024


def doc_key(rel_path: Column) -> Column:
    """The document's key: 16 hex digits of its relative path. The root isn't hashed, so equal paths below two roots collide."""
    return F.substring(F.sha1(rel_path), 1, 16)


def content_sha(content: Column) -> Column:
    """SHA-256 of the first 8 MiB of a binary column."""
    return F.sha2(F.substring(content, 1, HASHED_BYTES), 256)


def stage_of(rel_path: Column) -> Column:
    """The first part of the path, '' for a file at the root, null for null."""
    parts = F.split(rel_path, "/")
    return F.when(rel_path.isNull(), F.lit(None)).when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))


def extension(file_name: Column) -> Column:
    """The lower-case ending without its dot; '' if there is none, as for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name, r"[^/]\.([^./]+)$", 1))


def format_of(ext: Column) -> Column:
    """The format that a file ending is read as; null if it isn't read. Case, blanks and a leading dot don't matter."""
    own = F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")
    out = F.lit(None).cast("string")
    for fmt in sorted(set(FORMATS.values())):
        out = F.when(own.isin([k for k, v in FORMATS.items() if v == fmt]), fmt).otherwise(out)
    return out


def skip_reason(ext: Column) -> Column:
    """Why a file isn't read: null for read formats, unsupported_binary for known binaries, else unknown_extension."""
    own = F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")
    return F.when(format_of(ext).isNotNull(), F.lit(None)).when(own.isin(BINARY), "unsupported_binary").otherwise("unknown_extension")


def stored_format(status: Column, ext: Column) -> Column:
    """What the format column holds: the mapped format of ok rows, the raw ending of others, ``none`` without one."""
    return F.when(status == "ok", format_of(ext)).otherwise(F.when(F.coalesce(ext, F.lit("")) == "", "none").otherwise(ext))


def excluded(rel_path: Column, names: list[str]) -> Column:
    """Whether any part of the path, the file's name included, is one of the excluded names."""
    return F.arrays_overlap(F.split(rel_path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def lock_file(file_name: Column) -> Column:
    """Office lock files."""
    return file_name.startswith("~$")
