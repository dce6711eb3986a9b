"""Column expressions over paths, names, text and metadata. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import fixed_values as V

LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def literal_map(values: dict[str, str]) -> Column:
    """A dictionary of strings as a map literal."""
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def any_match(text: Column, patterns) -> Column:
    """True when at least one regular expression is found in ``text``."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(pattern)
    return hit


# ---- paths ---------------------------------------------------------------------------------
def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_path(path: Column) -> Column:
    """Everything before the last slash; the root folder is the empty string."""
    return _before_last(path, "/")


def _before_last(text: Column, mark: str) -> Column:
    """Everything before the last ``mark``, a single sign; the empty string where there is none."""
    left = F.length(text) - F.length(F.substring_index(text, mark, -1)) - 1
    return F.substring(text, F.lit(1), F.greatest(left, left * 0))


def suffix(name: Column) -> Column:
    """Lower-cased last extension; dot files such as ``.env`` have none."""
    last = F.substring_index(name, ".", -1)
    has_one = (last != "") & (F.length(name) > F.length(last) + 1)
    return F.when(has_one, F.lower(F.concat(F.lit("."), last))).when(name.isNotNull(), F.lit(""))


def detect_language(name: Column) -> Column:
    lowered = F.lower(name)
    container = lowered.isin(*V.CONTAINER_FILE_NAMES) | lowered.startswith(V.CONTAINER_FILE_PREFIX)
    by_extension = F.try_element_at(literal_map(V.LANGUAGE_BY_EXTENSION), suffix(name))
    return F.when(container, F.lit(V.CONTAINER_LANGUAGE)).otherwise(
        F.coalesce(by_extension, F.lit(V.UNKNOWN_LANGUAGE)))


def in_ignored_directory(path: Column) -> Column:
    """True when a directory segment (never the file name itself) is one of the skipped names."""
    return path.rlike(f"(?:^|/)(?:{'|'.join(map(re.escape, V.IGNORED_DIRECTORIES))})/")


def ancestor_folders(folder: Column) -> Column:
    """All prefixes of a folder path, from the root ``""`` down to the folder itself."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def dotted_prefixes(name: Column) -> Column:
    """``a.b.c`` -> ``[a, a.b, a.b.c]``."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "."))


def text_prefixes(text: Column) -> Column:
    """Every non-empty leading substring."""
    return F.when(F.length(text) > 0, F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n)))


# ---- text ----------------------------------------------------------------------------------
def count_lines(text: Column) -> Column:
    """Number of lines with every Unicode line break recognised and CRLF counted once."""
    def without(mark: str) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))

    plain = without("\n")
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    every = F.length(unified) - F.length(F.translate(unified, LINE_BREAKS, ""))
    breaks = F.when(text.rlike("[" + LINE_BREAKS.replace("\n", "") + "]"), every).otherwise(plain)
    last = F.right(text, F.lit(1))
    open_line = F.when((text == "") | last.isin(*LINE_BREAKS), F.lit(0)).otherwise(F.lit(1))
    return F.coalesce(breaks + open_line, F.lit(0))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


# ---- symbols -------------------------------------------------------------------------------
def module_name(path: Column) -> Column:
    """Dotted module of a source path: suffix dropped, package initialisers named by their folder."""
    name = file_name(path)
    last = F.substring_index(name, ".", -1)
    has_one = (last != "") & (F.length(name) > F.length(last) + 1)
    stem = F.when(has_one, F.substring(path, F.lit(1), F.length(path) - F.length(last) - 1)).otherwise(path)
    dotted = F.replace(stem, F.lit("/"), F.lit("."))
    return F.when(dotted.contains(".__init__"), F.regexp_replace(dotted, r"(?s)(.)\.__init__$", "$1")).otherwise(dotted)


def parent_package(module: Column) -> Column:
    """Text before the last dot, null when there is no dot."""
    head = _before_last(module, ".")
    return F.when(head != "", head)


def top_package(module: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(module, ".", 1), F.lit("")), F.lit("unknown"))


def visibility(name: Column) -> Column:
    return (F.when(name.startswith("__") & ~name.endswith("__"), "private")
            .when(name.startswith("_"), "protected").otherwise("public"))


def qualified_name(module: Column, class_path: Column, name: Column) -> Column:
    return F.concat_ws(".", module, class_path, name)


def simple_type_name(expression: Column) -> Column:
    """Last dotted part of a base or hint, generics and quotes removed."""
    bare = F.translate(expression, "'\"", "")
    return F.substring_index(F.substring_index(bare, "[", 1), ".", -1)


def line_span(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(end, start, F.lit(0)) - F.coalesce(start, F.lit(0)) + 1)


def import_scope(level: Column) -> Column:
    return F.when(level > 0, "internal").otherwise("external")


# ---- graph vocabulary ----------------------------------------------------------------------
def entity_label(entity_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(V.ENTITY_LABELS), entity_type), F.lit(V.UNKNOWN_LABEL))


def edge_type(relationship: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(V.EDGE_TYPES), relationship), F.upper(relationship))


def known_edge_types(names) -> list[str]:
    """Upper-cased requested types that exist; an empty list means no restriction."""
    known = set(V.EDGE_TYPES.values())
    return [name.upper() for name in (names or []) if name.upper() in known]


def is_known_edge_type(name: Column) -> Column:
    return F.upper(name).isin(*sorted(set(V.EDGE_TYPES.values())))


def clamp_depth(depth: int) -> int:
    """The depth asked for, at least 1."""
    return max(1, int(depth))


def clean_direction(direction: str) -> str:
    return direction if direction in ("outgoing", "incoming", "both") else "outgoing"


# ---- catalog -------------------------------------------------------------------------------
def stripped(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalized_name(name: Column) -> Column:
    return stripped(F.regexp_replace(name, r"(?U)\s+", " "))


def name_error(name: Column) -> Column:
    ok = normalized_name(name).rlike(rf"\A(?:{V.NAME_PATTERN})\z")
    return F.when(~F.coalesce(ok, F.lit(False)),
                  V.NAME_MESSAGE)


def normalized_tags(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.lower(stripped(t))))


def tags_error(tags: Column) -> Column:
    clean = normalized_tags(tags)
    bad = F.exists(clean, lambda t: ~t.rlike(rf"\A(?:{V.TAG_PATTERN})\z"))
    return (F.when(bad, V.TAG_MESSAGE)
            .when(F.size(clean) > V.MAX_TAGS, V.TAG_COUNT_MESSAGE))


def git_source_error(url: Column, branch: Column) -> Column:
    """Null for an acceptable remote; otherwise the first reason to refuse it."""
    clean, ref = stripped(url), stripped(branch)
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    address = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.when(address.startswith("["), F.regexp_extract(address, r"^\[([^\]]*)\]", 1))
                   .otherwise(F.substring_index(address, ":", 1)))
    branch_ok = ref.rlike(rf"\A(?:{V.BRANCH_PATTERN})\z") & ~ref.contains("..") & ~ref.contains("//")
    return (F.when(~scheme.isin("https", "http") | (host == ""), V.GIT_URL_MESSAGE)
            .when(user.rlike("[^:]"), V.GIT_CREDENTIALS_MESSAGE)
            .when(host.isin(*V.LOCAL_HOSTS), V.GIT_HOST_MESSAGE)
            .when(~branch_ok, V.GIT_BRANCH_MESSAGE))
