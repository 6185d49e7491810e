"""Path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language name.
LANGUAGES = {
    ".h": "C/C++",
    ".hxx": "C/C++",
    ".hpp": "C/C++",
    ".c": "C/C++",
    ".cc": "C/C++",
    ".cxx": "C/C++",
    ".cpp": "C/C++",
    ".txx": "C/C++",
    ".java": "Java",
    ".lua": "Lua",
    ".s": "Assembly",
    ".pl": "Perl",
    ".pm": "Perl",
    ".sh": "Shell",
    ".py": "Python",
    ".txt": "Text",
    ".po": "Gettext",
    ".m4": "Autotools",
    ".at": "Autotools",
    ".ac": "Autotools",
    ".am": "Autotools",
    ".htm": "HTML",
    ".html": "HTML",
    ".xhtml": "HTML",
    ".bat": "Batch",
    ".cs": "C#",
    ".hs": "Haskell",
    ".lhs": "Haskell",
    ".js": "JavaScript",
    ".php": "PHP",
    ".php4": "PHP",
    ".php5": "PHP",
    ".scm": "Scheme",
    ".ss": "Scheme",
    ".vb": "Visual Basic",
    ".vbs": "Visual Basic",
    ".go": "Go",
    ".rb": "Ruby",
    ".m": "Objective-C",
}
NO_LANGUAGE = "unknown"


def basename(path: Column) -> Column:
    """Last path component; trailing slashes do not count, the root stays '/'."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(path == "/", F.lit("/")).otherwise(F.substring_index(bare, "/", -1))


def dirname(path: Column) -> Column:
    """Everything before the last component: '.' if there is nothing, '/' at the root."""
    bare = F.rtrim(path, F.lit("/"))
    cut = F.length(bare) - F.length(F.substring_index(bare, "/", -1)) - 1
    return (
        F.when(path == "", F.lit("."))
        .when(bare == "", F.lit("/"))
        .when(cut < 0, F.lit("."))
        .when(cut == 0, F.lit("/"))
        .otherwise(F.substring(bare, F.lit(1), cut))
    )


def display_directory(directory: Column) -> Column:
    """Directory without its leading slash; the root stays '/'."""
    return F.when(F.length(directory) > 1, F.substr(directory, F.lit(2))).otherwise(directory)


def extension(path: Column) -> Column:
    """Lower-cased '.ext' of the file name; null without a dot or for a bare dot-file."""
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"(?s)^.*(\..+)$", 1)
    return F.when((found != "") & (found != name), F.lower(found))


def language(path: Column) -> Column:
    """Language name of a path, the upper-cased extension when the language is not known."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    ext = extension(path)
    known = F.try_element_at(F.create_map(*pairs), ext)
    return F.coalesce(known, F.upper(F.substr(ext, F.lit(2))), F.lit(NO_LANGUAGE))


def shorten_path(path: Column, width: Column) -> Column:
    """Fit a path to a width: keep the tail from a slash on behind '...', pad on the right."""
    tail = F.right(path, width - 3)
    slash = F.instr(tail, "/")
    tail = F.when(slash > 0, F.substr(tail, slash)).otherwise(tail)
    short = F.when(F.length(path) > width, F.concat(F.lit("..."), tail)).otherwise(path)
    return pad_right(short, width)


def pad_right(text: Column, width: Column) -> Column:
    """Pad with spaces, never cut."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)).cast("int")))


def pad_left(text: Column, width: int) -> Column:
    """Pad with spaces, never cut."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)).cast("int")), text)
