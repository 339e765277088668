"""Path predicates: prefixes, extensions, tests, documentation, generated and minified files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is indexed, what is skipped, and how test, documentation and generated files are told.
EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".cs", ".rb", ".php", ".c", ".h", ".cpp",
    ".hpp", ".cc", ".kt", ".swift", ".scala", ".m", ".mm", ".vue", ".svelte", ".cls", ".trigger", ".css", ".scss", ".less", ".html", ".htm",
)
SUFFIXES = ("-meta.xml",)
MARKUP_EXTENSIONS = (".html", ".htm", ".css", ".scss", ".less", ".vue", ".svelte")
TEST_PATTERNS = (
    r"(?i)(^|/)__tests__/",
    r"(?i)(^|/)tests?/",
    r"(?i)(^|/)spec/",
    r"(?i)\.(test|spec)\.[cm]?[jt]sx?$",
    r"(?i)(^|/)test_[^/]+\.py$",
    r"(?i)_test\.py$",
    r"(?i)_test\.go$",
    r"(?i)_spec\.rb$",
    r"(?i)_test\.rb$",
    r"[A-Za-z0-9]Tests?\.(java|kt|cs|scala|swift)$",
    r"(?i)\.test\.(php)$",
)
DOC_PATTERNS = (r"(?i)(^|/)docs?/", r"(?i)\.(md|markdown|html?|rst|txt)$")
GENERATED_PATTERNS = (
    r"(?i)<meta\s+name=[\"']generator[\"']|generated by (?:javadoc|doxygen|jazzy|sphinx|mkdocs|rustdoc|godoc|jsdoc|typedoc|scaladoc|kdoc)",
    r"(?i)(?:jazzy|doxygen|javadoc|pygments|documentation_options|rustdoc|typedoc|jsdoc|epydoc|scaladoc)\.(?:css|js)|class=[\"']dashAnchor|apple_ref/",
)
#: Characters in one line from which a file counts as build output, and the head in which a generator leaves its stamp.
LONGEST_LINE, HEAD = 5000, 4096


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.rlike(p) for p in patterns])


def under(path: Column, prefix: str) -> Column:
    """Whether a path is ``prefix`` or lies below it; every path lies under an empty one."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def under_any(path: Column, prefixes: Column) -> Column:
    """Whether a path lies under one of an array of prefixes; an empty array covers all."""
    return (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/"))))


def is_test(path: Column) -> Column:
    return _any(path, TEST_PATTERNS)


def is_doc(path: Column) -> Column:
    return _any(path, DOC_PATTERNS)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_indexed(path: Column) -> Column:
    """Whether the extension or a suffix of the name is on the list of what is indexed."""
    return extension(path).isin(*EXTENSIONS) | reduce(Column.__or__, [F.lower(path).endswith(s) for s in SUFFIXES])


def is_minified(text: Column) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda x: F.length(x) > LONGEST_LINE)


def is_generated(text: Column) -> Column:
    return _any(F.substring(text, 1, HEAD), GENERATED_PATTERNS)


def url_path(url: Column) -> Column:
    """A URL as a path: without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")


def directory_key(path: Column, depth: int) -> Column:
    """The first ``depth`` segments of a path, fewer where it has fewer; the name itself only at the root."""
    parts = F.split(path, "/", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), "/")
