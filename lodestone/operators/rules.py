"""Declarations and imports by ordered rules: the first rule that holds names the line's symbol.

A file is lexed and matched in one map, ``parsed``, which leaves one row a file with all that later questions ask for: masked text,
depths, ends of blocks, symbols, imports, and the symbol that each line stands in. Tables of lines, symbols and imports are
projections of that row, so none of them is joined or shuffled.

A rule is tried only on lines that hold a word it needs: all those words are one automaton, which reads a line once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines_of
from lodestone.operators.lexer import block_ends, scan

# ---- Fixed values: patterns, and words that look like a method's name but are not. Their order matters.

NOT_A_METHOD = (
    "if", "for", "while", "switch", "catch", "do", "else", "return", "function", "typeof", "delete", "new", "await", "yield",
    "case", "throw", "with", "in", "of", "try", "finally", "import", "export", "default", "synchronized", "lock", "using", "fixed",
    "unless", "until", "elsif", "foreach",
)
_GENERIC = r"(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)"
_TYPE = rf"[A-Za-z_$][A-Za-z0-9_$.]*{_GENERIC}?(?:\[\])*"
_STATEMENT = r"(?!(?:return|throw|new|else|case|await|yield|delete|typeof)\b)"


@dataclass(frozen=True)
class Rule:
    """A pattern whose first group is the name.

    ``needs``: each match holds one of these words; ``methods``: keywords are no name; ``top``: at depth 0 only; ``raw``: on the unmasked
    line.
    """

    kind: str
    pattern: str
    needs: tuple[str, ...] = ()
    methods: bool = False
    top: bool = False
    raw: bool = False


SYMBOL_RULES = (
    Rule("class", r"\b(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_$]+)", ("class",)),
    Rule("interface", r"\b(?:export\s+)?interface\s+([A-Za-z0-9_$]+)", ("interface",)),
    Rule("type", r"\b(?:export\s+)?type\s+([A-Za-z0-9_$]+)\s*[=<]", ("type",), top=True),
    Rule("enum", r"\b(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z0-9_$]+)", ("enum",)),
    Rule("function", r"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*([A-Za-z0-9_$]+)", ("function",)),
    Rule("function", r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*[:=][^=]*=>", ("=>",), top=True),
    Rule("function", r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s+)?function\b", ("function",), top=True),
    Rule("function", r"^\s*(?:[A-Za-z0-9_$]+\.)+([A-Za-z0-9_$]+)\s*=\s*(?:async\s+)?function\b", ("function",)),
    Rule("method", r"^\s+([A-Za-z0-9_$]+)\s*:\s*(?:async\s+)?function\b", ("function",)),
    Rule("method", r"^\s+([A-Za-z0-9_$]+)\s*:\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z0-9_$]+)\s*=>\s*\{\s*\}?\s*$", ("=>",), methods=True),
    Rule("type", r"^\s*(?:(?:public|private|protected|internal|static|final|sealed|abstract)\s+)*record\s+([A-Za-z0-9_$]+)\s*(?:<[^>]*>)?\s*[({]", ("record",)),
    Rule("method", r"^[ \t]+(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*(?:\*\s*)?([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::\s*[^{;]+)?\{.*$", ("{",), methods=True),
    Rule("method", rf"^[ \t]+{_STATEMENT}(?:@[A-Za-z_][A-Za-z0-9_.]*\s*(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|global|static|final|virtual|override|abstract|sealed|synchronized|async|unsafe|transient|webservice|testMethod)\s+)*(?:{_GENERIC}\s+)?{_TYPE}\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(.*\)\s*(?:\{{|$)", ("(",), methods=True),
    Rule("method", rf"^[ \t]+{_STATEMENT}(?:(?:public|private|protected|internal|global|abstract|static|default)\s+)*(?:{_GENERIC}\s+)?{_TYPE}\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^;{{]*\)\s*;\s*$", (";",), methods=True),
    Rule("test", r"""^\s*(?:export\s+)?(?:describe|it|test|context|suite|bench|scenario|feature)(?:\.\w+)?\s*\(\s*['"`]([^'"`]{1,80})['"`]""", ("describe", "it", "test", "context", "suite", "bench", "scenario", "feature"), raw=True),
    Rule("class", r"^\s*class\s+([A-Za-z0-9_]+)", ("class",)),
    Rule("function", r"^\s*(?:async\s+)?def\s+(?:self\.)?([A-Za-z0-9_]+)", ("def",)),
    Rule("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)\s*\(", ("func",)),
    Rule("type", r"^\s*type\s+([A-Za-z0-9_]+)\s+(?:struct|interface)\b", ("type",)),
    Rule("struct", r"\b(?:pub\s+)?struct\s+([A-Za-z0-9_]+)", ("struct",)),
    Rule("enum", r"\b(?:pub\s+)?enum\s+([A-Za-z0-9_]+)", ("enum",)),
    Rule("trait", r"\b(?:pub\s+)?trait\s+([A-Za-z0-9_]+)", ("trait",)),
    Rule("function", r"\b(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)", ("fn",)),
    Rule("object", r"^\s*(?:companion\s+)?object\s+([A-Za-z0-9_]+)", ("object",)),
    Rule("function", r"^\s*(?:(?:public|private|protected|internal|open|override|suspend|inline|operator|abstract|final|tailrec)\s+)*fun\s+(?:<[^>]*>\s*)?([A-Za-z0-9_]+)", ("fun",)),
    Rule("protocol", r"^\s*(?:(?:public|private|fileprivate|internal|open)\s+)?protocol\s+([A-Za-z0-9_]+)", ("protocol",)),
    Rule("function", r"^\s*(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|convenience)\s+)*func\s+([A-Za-z0-9_]+)", ("func",)),
    Rule("class", r"\b(?:public|private|protected|internal|static|final|sealed|abstract|\s)*class\s+([A-Za-z0-9_]+)", ("class",)),
    Rule("type", r"\b(?:public|private|protected|internal|\s)*(?:struct|enum|interface)\s+([A-Za-z0-9_]+)", ("struct", "enum", "interface")),
    Rule("namespace", r"^\s*namespace\s+([A-Za-z_][\w:]*)", ("namespace",)),
    Rule("method", r"^[\w:<>,*&~\s]*?\b[A-Za-z_]\w*::(~?[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\b\s*)?(?:noexcept\b\s*)?(?:\{.*)?$", ("::",), methods=True),
    Rule("function", r"^(?!(?:if|for|while|switch|return|else|do|goto|typedef|using|namespace|template|case|new|delete|throw|await|yield|assert|print|puts|raise|require|require_relative|include|extend|del|not|and|or|elif|elsif|unless|until|import|export|declare|package|trigger|def|fun|func|fn)\b)(?:[A-Za-z_]\w*(?:\s*\*+\s*|\s+))+\**([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:\{.*)?$", ("(",), methods=True),
    Rule("macro", r"^\s*#\s*define\s+([A-Za-z_]\w*)\(", ("define",)),
    Rule("type", r"^\}\s*([A-Za-z_]\w*)\s*;\s*$", ("}",)),
    Rule("trigger", r"^\s*trigger\s+([A-Za-z0-9_]+)\s+on\b", ("trigger",)),
    Rule("method", r"^\s*(?:(?:private|protected|public|override|final|implicit|lazy)\s+)*def\s+(?:self\.)?([A-Za-z0-9_?!]+)", ("def",)),
    Rule("class", r"^\s*(?:class|module)\s+([A-Za-z0-9_:]+)", ("class", "module")),
    Rule("attribute", r"^\s*attr_(?:accessor|reader|writer)\s+:([A-Za-z_]\w*[?!]?)", ("attr_",)),
    Rule("class", r"^\s*@(?:interface|implementation|protocol)\s+([A-Za-z_]\w*)", ("@",)),
    Rule("method", r"^\s*[-+]\s*\([^)]*\)\s*([A-Za-z_][A-Za-z0-9_]*)", ("(",)),
)

OUTLINE_RULES = (
    Rule("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_]+)", ("class",)),
    Rule("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z0-9_]+)", ("interface",)),
    Rule("type", r"^\s*(?:export\s+)?type\s+([A-Za-z0-9_]+)\s*=", ("type",), top=True),
    Rule("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z0-9_]+)", ("enum",)),
    Rule("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*([A-Za-z0-9_]+)", ("function",)),
    Rule("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*[:=].*=>\s*\{?\s*$", ("=>",), top=True),
    Rule("method", r"^\s+([A-Za-z0-9_$]+)\s*:\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z0-9_$]+)\s*=>\s*\{\s*\}?\s*$", ("=>",), methods=True),
    Rule("method", r"^[ \t]+(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*(?:\*\s*)?([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::\s*[^{;]+)?\{\s*\}?\s*$", ("{",), methods=True),
    Rule("class", r"^\s*class\s+([A-Za-z0-9_]+)", ("class",)),
    Rule("function", r"^\s*(?:async\s+)?def\s+([A-Za-z0-9_]+)", ("def",)),
    Rule("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z0-9_]+)\s*\(", ("func",)),
    Rule("type", r"^\s*type\s+([A-Za-z0-9_]+)\s+(?:struct|interface)\b", ("type",)),
    Rule("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)", ("fn",)),
    Rule("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z0-9_]+)", ("struct",)),
    Rule("impl", r"^\s*(impl)(?:\s|<)", ("impl",)),
    Rule("method", rf"^\s*(?:(?:public|private|protected|internal|global|static|final|abstract|virtual|override|sealed|synchronized|async|transient|webservice)\s+)+{_TYPE}\s+([A-Za-z0-9_]+)\s*\([^;{{]*\)\s*\{{?\s*$", ("(",), methods=True),
)

IMPORT_RULES = (
    Rule("import", r"""\bimport\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]""", ("import",), raw=True),
    Rule("import", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", ("require",), raw=True),
    Rule("import", r"""\bexport\s+(?:[^'"]*\s+)?from\s+['"]([^'"]+)['"]""", ("from",), raw=True),
    Rule("import", r"^\s*from\s+([A-Za-z0-9_.]+)\s+import\b", ("from",), raw=True),
    Rule("import", r"^\s*import\s+([A-Za-z0-9_.]+)", ("import",), raw=True),
    Rule("import", r"^\s*use\s+([A-Za-z0-9_:]+)", ("use",), raw=True),
)
STYLE_FILE = r"(?i)\.(css|scss|less)$"
SYMBOLS_A_FILE, OUTLINE_A_FILE, OUTLINE_CHARS = 2000, 400, 200


def is_comment(line: Column) -> Column:
    """A whole-line comment; a function-like macro is none."""
    t = F.ltrim(F.regexp_replace(line, r"^\s+", ""))
    return t.rlike(r"^(//|\*|/\*|--)") | (t.startswith("#") & ~t.rlike(r"^#\s*define\s+[A-Za-z_]\w*\("))


class Matcher:
    """Finds the first of several lists of ordered rules that holds for a line."""

    def __init__(self, *lists: tuple[Rule, ...]) -> None:
        # A dot stops at what ends a line elsewhere; word characters are ASCII.
        self.tries = [[(re.compile(r.pattern.replace(".*", r"[^\r\x85\u2028\u2029]*"), re.ASCII), r) for r in rules] for rules in lists]
        self.starts = [sum(map(len, lists[:k])) for k in range(len(lists))]
        bits: dict[str, int] = {}
        for k, rule in enumerate(r for rules in lists for r in rules):
            for word in rule.needs:
                bits[word] = bits.get(word, 0) | 1 << k
        self.automaton = ahocorasick.Automaton()
        for word, mask in bits.items():
            self.automaton.add_word(word, mask)
        self.automaton.make_automaton()
        self.chosen: dict[int, list] = {}  # of each set of words the rules of each list, in their order

    def words(self, line: str) -> list[list] | None:
        """For each list the rules whose words a raw line holds; masking only takes words away."""
        found = 0
        for _, mask in self.automaton.iter(line):
            found |= mask
        if not found:
            return None
        tries = self.chosen.get(found)
        if tries is None:
            tries = self.chosen[found] = [[t for k, t in enumerate(rules, start) if found >> k & 1] for start, rules in zip(self.starts, self.tries, strict=True)]
        return tries


def first_match(tries: list, line: str, masked: str, depth: int) -> tuple[Rule, str] | None:
    """The rule and the name; a rejected name or depth lets the next rule try."""
    for pattern, rule in tries:
        if rule.top and depth:
            continue
        hit = pattern.search(line if rule.raw else masked)
        if hit and hit[1] and not (rule.methods and hit[1] in _KEYWORDS):
            return rule, hit[1]
    return None


_KEYWORDS = frozenset(NOT_A_METHOD)
_SPACE = " \t\n\x0b\f\r"
_COMMENT, _MACRO = re.compile(r"(?://|\*|/\*|--)"), re.compile(r"#\s*define\s+[A-Za-z_]\w*\(", re.ASCII)
_STYLE = re.compile(STYLE_FILE)
_AT_RULE, _SELECTOR = re.compile(r"@([A-Za-z-]+)[ \t\n\x0b\f\r]*(.*)$"), re.compile(r"[.#][A-Za-z_-][A-Za-z0-9_-]*")


@cache
def _matcher(*names: str) -> Matcher:
    """One for each worker process."""
    return Matcher(*({"symbol": SYMBOL_RULES, "import": IMPORT_RULES, "outline": OUTLINE_RULES}[n] for n in names))


def comment_line(line: str) -> bool:
    """``is_comment`` of a string."""
    text = line.lstrip(_SPACE)
    return _COMMENT.match(text) is not None or (text[:1] == "#" and _MACRO.match(text) is None)


def style_names(masked: str, most: int = 4) -> list[tuple[str, str]]:
    """(name, kind) of a style sheet's line that opens a block: an at-rule, else up to ``most`` different selectors."""
    head = masked.split("{", 1)[0].strip(" ") if "{" in masked else ""
    at = _AT_RULE.match(head)
    if at:
        return [(f"@{at[1]} {re.sub(r'[ \t\n\x0b\f\r]+', ' ', at[2].strip(' '))[:60]}".strip(" "), "at-rule")]
    return [(name, "rule") for name in list(dict.fromkeys(_SELECTOR.findall(head)))[:most]]


def read_file(path: str, text: str, most: int = SYMBOLS_A_FILE) -> dict:
    """All that is known of one file: see ``parsed``."""
    scanned = scan(text)
    lines, masked = [r[1] for r in scanned], [r[2] for r in scanned]
    symbols, imports, owners, truncated, ended = [], [], [], False, 0
    style = _STYLE.search(path) is not None
    words_of = _matcher("symbol", "import").words
    for n, line, code, depth in scanned:
        first = len(symbols) + 1
        if style:
            found = [(name, kind, 0, line.find("@" if kind == "at-rule" else name)) for name, kind in style_names(code)]
        else:
            found = []
        if (tries := words_of(line)) and code.strip(_SPACE) and not comment_line(line):
            if not style and (hit := first_match(tries[0], line, code, depth)):
                found = [(hit[1], hit[0].kind, depth, (line if hit[0].raw else code).find(hit[1]))]
            if hit := first_match(tries[1], line, code, depth):
                imports.append((n, hit[1]))
        for name, kind, at, col in found:
            if len(symbols) == most:
                truncated = True
                break
            symbols.append((len(symbols) + 1, name, kind, n, max(1, col + 1), at))
        if len(symbols) >= first:
            ended = first  # of symbols on one line the first counts
        owners.append(ended)
    return {"masked": "\n".join(masked), "depths": [r[3] for r in scanned], "ends": block_ends(lines, masked), "owners": owners, "symbols": symbols, "imports": imports, "truncated": truncated}


_SYMBOL = pa.struct([("ord", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("col", pa.int64()), ("depth", pa.int64())])
_IMPORT = pa.struct([("line", pa.int64()), ("module", pa.string())])
_KNOWN = {"masked": pa.string(), "depths": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "owners": pa.list_(pa.int32()), "symbols": pa.list_(_SYMBOL), "imports": pa.list_(_IMPORT), "truncated": pa.bool_()}
_KNOWN_DDL = (
    "masked string, depths array<int>, ends array<int>, owners array<int>, symbols array<struct<ord: bigint, name: string, kind: string, line: bigint, col: bigint, depth: bigint>>, "
    "imports array<struct<line: bigint, module: string>>, truncated boolean"
)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """A column of whole values; one of lists, also of tuples, is made from its flat parts."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    flat = [x for value in values for x in value]
    if pa.types.is_struct(kind.value_type):
        fields = list(kind.value_type)
        parts = zip(*flat, strict=True) if flat else [()] * len(fields)
        items = pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields, strict=True)], fields=fields)
    else:
        items = pa.array(flat, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), items)


def parsed(texts: DataFrame, most: int = SYMBOLS_A_FILE) -> DataFrame:
    """One row for each row of ``texts`` (path, text, and more), each file read once where it lies, with:

    ``masked``, the masked lines; ``depths`` before each line; ``ends``, the last line of the block that each line opens (0: not closed);
    ``symbols``, at most ``most``, style sheets giving their selectors, and ``truncated``, whether there are more; ``owners``, the
    place among the symbols of the nearest one at or above each line (0: none); ``imports``.
    """
    names = texts.columns
    at_path, at_text = names.index("path"), names.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(at_path).to_pylist(), batch.column(at_text).to_pylist(), strict=True)
            found = [read_file(path or "", text or "", most) for path, text in rows]
            yield pa.record_batch([*batch.columns, *(_lists([f[k] for f in found], t) for k, t in _KNOWN.items())], names=[*names, *_KNOWN])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(read, f"{given}, {_KNOWN_DDL}")


def symbols(files: DataFrame) -> DataFrame:
    """(path, ord, name, kind, line, col, depth) of ``parsed`` files."""
    return files.select("path", F.inline("symbols"))


def imports(files: DataFrame) -> DataFrame:
    """(path, line, module) of ``parsed`` files; the raw line is read, since masking blanks the module's name."""
    return files.select("path", F.inline("imports"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line, masked, depth) of ``parsed`` files."""
    each = F.arrays_zip(lines_of(F.coalesce("text", F.lit(""))).alias("line"), F.split("masked", "\n").alias("masked"), F.col("depths").alias("depth"))
    rows = files.select("path", F.posexplode(each).alias("at", "l"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.col("l.line").alias("line"), F.col("l.masked").alias("masked"), F.col("l.depth").cast("long").alias("depth"))


def outline(files: DataFrame) -> DataFrame:
    """(path, line, kind, text): the lines of ``parsed`` files that the shorter list of outline rules knows."""

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, plain = _matcher("outline").words, ("//", "#", "*", "/*", "--")
        for batch in batches:
            paths, rows, kinds, texts = [], [], [], []
            for path, text, masked, depths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                for k, (line, code, depth) in enumerate(zip(re.split(r"\r?\n", text or ""), masked.split("\n"), depths, strict=True), 1):
                    if (tries := words_of(line)) and code.strip(_SPACE) and not line.lstrip(" ").startswith(plain) and (hit := first_match(tries[0], line, code, depth)):
                        n += 1
                        if n > OUTLINE_A_FILE:
                            break
                        paths.append(path)
                        rows.append(k)
                        kinds.append(hit[0].kind)
                        texts.append(line.rstrip(" ")[:OUTLINE_CHARS])
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["path", "line", "kind", "text"])

    return files.select("path", "text", "masked", "depths").mapInArrow(outlined, "path string, line long, kind string, text string")
