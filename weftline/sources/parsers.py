"""Source texts to symbols, imports, calls, annotations and elements.

What a regular expression can tell is told by columns. Declarations need
matching brackets, so a tokeniser runs over each text in mapInArrow; it knows
strings, comments and brackets but no grammar beyond the heads of
declarations, so odd code may give approximate ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "path string, ord int, name string, kind string, start_line int, start_col int, end_line int, end_col int, exported boolean, owner string"
CALLS = "path string, sym string, ord int, callee string"

# The types of plain annotations.
ANNOTATION_TYPES = ("systempolicy", "policy", "warning", "note", "gate", "contract", "usage", "tags")

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<arrow>=>|\?->|->|::)|(?P<mark>[^\s\w])|(?P<number>\w+)""",
    re.DOTALL,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Code:
    """The tokens of a text, as (text, start, end), with matching brackets."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, (t, _, _) in enumerate(self.tokens):
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE and stack:
                self.match[stack.pop()] = i
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def word(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column, from 1."""
        lo, hi = 0, len(self.lines)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.lines[mid] <= offset else (lo, mid)
        return lo + 1, offset - self.lines[lo] + 1

    def body(self, i: int, stop: str = ";") -> int:
        """The token that ends the first block from ``i`` on, or ``stop`` before it; brackets on the way are passed over."""
        while i < len(self.tokens):
            t = self.word(i)
            if t == "{":
                return self.match.get(i, len(self.tokens) - 1)
            if t in _OPEN:
                i = self.match.get(i, len(self.tokens) - 1)
            elif t == stop or t in _CLOSE:
                return i if t == stop else i - 1
            i += 1
        return len(self.tokens) - 1

    def statement(self, i: int) -> int:
        """The last token of a statement: its semicolon, or where the next line starts another."""
        last = i
        while i < len(self.tokens):
            t = self.word(i)
            if t == ";":
                return i
            if t in _CLOSE:
                return last
            if i > last and "\n" in self.text[self.tokens[last][2] : self.tokens[i][1]] and re.match(r"[\w$@'\"`{]", t) and re.match(r"[\w$\])}'\"`]", self.word(last)[-1]):
                return last
            if t in _OPEN:
                i = self.match.get(i, len(self.tokens) - 1)
            last, i = i, i + 1
        return last


_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super", "constructor", "with"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "abstract", "final", "get", "set", "export", "default", "declare", "var"}


def _row(code: Code, first: int, last: int, name: str, kind: str, exported: bool, owner: str | None = None) -> tuple:
    return (name, kind, *code.place(code.tokens[first][1]), *code.place(code.tokens[min(last, len(code.tokens) - 1)][2]), exported, owner)


def _head(code: Code, i: int) -> int:
    """The first modifier before token ``i``."""
    while code.word(i - 1) in _MODIFIERS:
        i -= 1
    return i


def _members(code: Code, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(first, name, last token) of the methods of a class body."""
    i = start
    while i < stop:
        first = i
        while code.word(i) in _MODIFIERS and code.word(i + 1) not in ("(", "=", ":", ";", "?", "!"):
            i += 1
        if code.word(i) == "*":
            i += 1
        name = i
        if code.word(i) == "function":
            name = i = i + 1
        i += 1
        if code.word(i) == "<":
            while i < stop and code.word(i) != "(":
                i += 1
        if code.word(i) == "(" and re.match(r"[A-Za-z_$]", code.word(name)):
            end = code.body(code.match.get(i, stop) + 1)
            yield first, name, end
            i = end + 1
        elif first == name and code.word(name) == "@":
            i += 1
            if code.word(i) == "(":
                i = code.match.get(i, stop) + 1
        else:
            i = max(code.statement(name), name) + 1


def script_symbols(text: str) -> list[tuple]:
    """Functions, variables, classes with their methods, interfaces, types and enums of a script, nested ones too, by position of head."""
    code, out = Code(text), []
    for i, (t, _, _) in enumerate(code.tokens):
        if code.word(i - 1) in (".", "?.") or code.word(i + 1) in (":", "=", ")", ","):
            continue
        first = _head(code, i)
        exported = any(code.word(k) == "export" for k in range(first, i))
        name = i + 1 + (code.word(i + 1) == "*")
        named = bool(re.match(r"[A-Za-z_$]", code.word(name)))
        statement = first == 0 or code.word(first - 1) in (";", "{", "}", ")") or "\n" in text[code.tokens[first - 1][2] : code.tokens[first][1]]
        if t == "function" and named and statement:
            out.append(_row(code, first, code.body(name), code.word(name), "function", exported))
        elif t in ("const", "let", "var") and statement and named and code.word(name) != "enum":
            last, k = code.statement(i), i + 1
            while k <= last and re.match(r"[A-Za-z_$]", code.word(k)):
                value = k + 1
                while value < last and code.word(value) not in ("=", ",", ";"):
                    value = code.match.get(value, value) + 1
                kind = "constant"
                if code.word(value) == "=":
                    v = value + 1 + (code.word(value + 1) == "async")
                    after = code.match[v] + 1 if code.word(v) == "(" and v in code.match else v + 1
                    while code.word(after) == ":" or (after < last and code.word(after - 1) == ":"):
                        after += 1
                    if code.word(v) == "function" or code.word(after) == "=>":
                        kind = "function"
                out.append(_row(code, first, last, code.word(k), kind, exported))
                while value < last and code.word(value) != ",":
                    value = code.match.get(value, value) + 1
                k = value + 1 if code.word(value) == "," else last + 1
        elif t == "class" and named and statement:
            last = code.body(name)
            out.append(_row(code, first, last, code.word(name), "class", exported))
            opened = next((k for k, v in code.match.items() if v == last and code.word(k) == "{"), last)
            out += [_row(code, a, z, code.word(n), "method", False, code.word(name)) for a, n, z in _members(code, opened + 1, last) if code.word(n) not in _WORDS]
        elif t in ("interface", "enum") and named and statement:
            out.append(_row(code, first, code.body(name), code.word(name), t, exported))
        elif t == "type" and named and statement and code.word(name + 1) in ("=", "<"):
            out.append(_row(code, first, code.statement(i), code.word(name), "type", exported))
    return out


def php_symbols(text: str) -> list[tuple]:
    """Classes and traits (as class), interfaces, enums, functions, and the methods, properties and constants of classes; exported where public."""
    return [row for row, _ in _php(text)]


def php_modifiers(text: str) -> list[tuple[str, str | None, str | None, bool]]:
    """(namespace, class, visibility, static) of each of php_symbols; classes and functions have no visibility."""
    m = re.search(r"^\s*namespace\s+([\w\\]+)", text, re.MULTILINE)
    out = []
    for row, words in _php(text):
        seen = next((w for w in words if w in ("public", "protected", "private")), "public")
        out.append((m[1] if m else "", row[-1], seen if row[-1] else None, "static" in words))
    return out


def _php(text: str) -> list[tuple[tuple, list[str]]]:
    """Rows of symbols, each with the modifiers before it."""
    code, out, inside = Code(text), [], []
    for i, (t, _, _) in enumerate(code.tokens):
        while inside and i > inside[-1][1]:
            inside.pop()
        owner = inside[-1][0] if inside else None
        name, first = i + 1 + (code.word(i + 1) == "&"), _head(code, i)
        words = [code.word(k) for k in range(first, i)]
        hidden = "private" in words or "protected" in words
        named = bool(re.match(r"[A-Za-z_]", code.word(name)))

        def add(*row):
            out.append((_row(code, first, *row), words))  # noqa: B023

        if t in ("class", "trait", "interface", "enum") and named and code.word(i - 1) not in ("::", "new", "->"):
            last = code.body(name)
            add(last, code.word(name), "class" if t == "trait" else t, True)
            inside.append((code.word(name), last))
        elif t == "function" and named:
            add(code.body(name), code.word(name), "method" if owner else "function", not hidden, owner)
        elif owner and t.startswith("$") and first < i and code.word(i - 1) not in ("(", ","):
            add(code.statement(i), t[1:], "property", not hidden, owner)
        elif owner and t == "const" and named:
            add(code.statement(i), code.word(name), "constant", not hidden, owner)
    return out


def calls(text: str, symbols: list[tuple]) -> list[tuple[str, int, str]]:
    """(symbol, order, callee): names before a bracket within the symbol's lines; of property calls the last name."""
    code, out = Code(text), []
    found = [(code.place(s)[0], t) for i, (t, s, _) in enumerate(code.tokens) if re.match(r"[A-Za-z_$]", t) and t not in _WORDS and code.word(i + 1) == "(" and code.word(i - 1) != "function"]
    for name, kind, start, _, end, _, *_ in symbols:
        if kind in ("function", "method", "class", "constant"):
            seen = dict.fromkeys(t for line, t in found if start <= line <= end and not (t == name and line == start))
            out += [(name, k, t) for k, t in enumerate(seen)]
    return out


PARSERS = {**dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), script_symbols), ".php": php_symbols}


def _mapped(files: DataFrame, schema: str, kinds: list, f, known: dict | None = None) -> DataFrame:
    """Rows of f(path, text, parser) of the files whose extension has a parser; the parsers go to the tasks with the plan."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    known = dict(PARSERS if known is None else known)

    def parser(path: str):
        return known.get("." + path.rsplit(".", 1)[-1] if "." in path else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True) if (parse := parser(p)) for r in f(p, t or "", parse)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def symbols(files: DataFrame, known: dict | None = None) -> DataFrame:
    """``known``: parsers by extension, PARSERS if None."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.string()]
    return _mapped(files, SYMBOLS, kinds, lambda p, t, parse: [(p, k, *s) for k, s in enumerate(parse(t))], known)


def raw_calls(files: DataFrame, known: dict | None = None) -> DataFrame:
    return _mapped(files, CALLS, [pa.string(), pa.string(), pa.int32(), pa.string()], lambda p, t, parse: [(p, *c) for c in calls(t, parse(t))], known)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)^\s*//.*$", "")


def imports(files: DataFrame) -> DataFrame:
    """(path, ord, spec) of import declarations."""
    specs = F.regexp_extract_all(without_comments(F.col("content")), F.lit(r"""(?m)^\s*import\s+(?:[\w$*{},\s]+?\s+from\s+)?['"]([^'"]+)['"]"""), F.lit(1))
    return files.select("path", F.posexplode(specs).alias("ord", "spec"))


def modifiers(files: DataFrame) -> DataFrame:
    """(path, ord, namespace, class_name, visibility, static) of the symbols of PHP files."""
    schema = "path string, ord int, namespace string, class_name string, visibility string, static boolean"
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    return _mapped(files, schema, kinds, lambda p, t, parse: [(p, k, *m) for k, m in enumerate(parse(t))], {".php": php_modifiers})


def php_dependencies(files: DataFrame) -> DataFrame:
    """(path, kind, ord, spec) of what PHP files extend, implement, use and include; included are plain strings only."""
    text = F.regexp_replace(without_comments(F.col("content")), r"(?m)#[^\[\n].*$", "")
    names = lambda pattern: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.split(F.trim(x), r"\s*,\s*")))
    uses = F.transform(names(r"(?m)^\s*use\s+(?!function\b|const\b)([\w\\,\s]+?)(?:\s+as\s+\w+)?\s*;"), lambda x: F.regexp_replace(x, r"\s+as\s+\w+$", ""))
    kinds = {
        "extends": names(r"\b(?:class|interface)\s+\w+\s+extends\s+([\w\\]+(?:\s*,\s*[\w\\]+)*)"),
        "implements": names(r"\bimplements\s+([\w\\]+(?:\s*,\s*[\w\\]+)*)"),
        "use": uses,
        "include": F.regexp_extract_all(text, F.lit(r"""\b(?:include|require)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""), F.lit(1)),
    }
    php = files.where(F.col("path").endswith(".php"))
    rows = [php.select("path", F.lit(kind).alias("kind"), F.posexplode(specs).alias("ord", "spec")) for kind, specs in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


def exports(files: DataFrame) -> DataFrame:
    names = F.regexp_extract_all("content", F.lit(r"export\s+(?:default\s+)?(?:abstract\s+|async\s+)?(?:class|function|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), F.lit(1))
    return files.select("path", F.posexplode(names).alias("ord", "name"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "line_text")).withColumn("line", F.col("k") + 1)


def annotations(files: DataFrame, tag: str) -> DataFrame:
    """(path, line, type, severity, message, tags) of comment lines ``* TAG.type message``."""
    p = rf"^\s*\*\s*{tag}\.({'|'.join(ANNOTATION_TYPES)})\s+(.+)$"
    rows = _lines(files).where(F.col("line_text").rlike(p))
    kind, message = F.regexp_extract("line_text", p, 1), F.trim(F.regexp_extract("line_text", p, 2))
    severity = F.when(kind == "warning", "warning").when(kind == "policy", "error").otherwise("info")
    tags = F.when(kind == "tags", F.transform(F.split(message, ","), lambda x: F.trim(x)))
    return rows.select("path", "line", kind.alias("type"), severity.alias("severity"), message.alias("message"), tags.alias("tags"))


def categorised(files: DataFrame, tag: str) -> DataFrame:
    """(path, line, category, ann_path, value, raw) of comment lines ``* TAG.category.path value`` that are no plain ones."""
    plain, p = rf"^\s*\*\s*{tag}\.({'|'.join(ANNOTATION_TYPES)})\s+(.+)$", rf"^\s*\*\s*{tag}\.(\w+)\.([^\s]+)\s+(.+)$"
    rows = _lines(files).where(F.col("line_text").rlike(p) & ~F.col("line_text").rlike(plain))
    at = lambda k: F.regexp_extract("line_text", p, k)
    raw = F.concat(F.lit(f"{tag}."), at(1), F.lit("."), at(2), F.lit(" "), F.trim(at(3)))
    return rows.select("path", "line", at(1).alias("category"), at(2).alias("ann_path"), F.trim(at(3)).alias("value"), raw.alias("raw"))


def domains(found: DataFrame) -> DataFrame:
    """(path, name, relevance, message, searchable): the last value of each field of the category ``domain``, where there is a name."""
    last = lambda f: F.max_by(F.when(F.col("ann_path") == f, F.col("value")), F.when(F.col("ann_path") == f, F.col("line"))).alias(f)
    rows = found.where(F.col("category") == "domain").groupBy("path").agg(*map(last, ("name", "relevance", "message", "searchable"))).where("name is not null")
    return rows.withColumns({"relevance": F.expr("try_cast(relevance as double)"), "searchable": F.coalesce(F.col("searchable") == "true", F.lit(True))})


def component_symbols(files: DataFrame) -> DataFrame:
    """Of single-file components: the component itself, then props and emits of the script, by line of the script."""
    script = F.regexp_extract("content", r"(?s)<script[^>]*>(.*?)</script>", 1)
    name = F.regexp_extract("path", r"([^/]+)\.vue$", 1)
    vue = files.where(F.col("path").endswith(".vue")).select("path", name.alias("component"), script.alias("script"))
    lines = vue.select("path", F.posexplode(F.split("script", "\n")).alias("k", "text"))
    names = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.substring_index(x, ":", 1))), lambda x: x != "")
    props = F.concat(names(F.regexp_extract("text", r"defineProps<\{([^}]+)\}>", 1)), names(F.regexp_extract("text", r"props:\s*\{([^}]+)\}", 1)))
    emits = F.when(F.col("text").contains("defineEmits"), F.regexp_extract_all("text", F.lit("""['"]([a-zA-Z0-9:-]+)['"]"""), F.lit(1)))
    some = lambda c, kind: lines.select("path", F.explode(c).alias("name"), F.lit(kind).alias("kind"), (F.col("k") + 1).alias("start_line"))
    return vue.select("path", F.col("component").alias("name"), F.lit("component").alias("kind"), F.lit(1).alias("start_line")).unionByName(some(props, "props")).unionByName(some(emits, "emits"))


# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Tags(HTMLParser):
    """Elements as [tag, id, line, column, end line, end column]; one that isn't closed ends with its start tag."""

    def __init__(self, text: str):
        super().__init__()
        self.found: list[list] = []
        self._open: list[list] = []
        self.feed(text)

    def _after(self, raw: str) -> tuple[int, int]:
        line, column = self.getpos()
        breaks = raw.count("\n")
        return line + breaks, (column + len(raw) if not breaks else len(raw) - raw.rindex("\n") - 1) + 1

    def handle_starttag(self, tag, attrs):
        line, column = self.getpos()
        row = [tag, dict(attrs).get("id"), line, column + 1, *self._after(self.get_starttag_text())]
        self.found.append(row)
        if tag not in VOID:
            self._open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self._open and self._open[-1] is self.found[-1]:
            self._open.pop()

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag), None)
        if at is not None:
            rest = self.rawdata[self._offset() :]
            self._open[at][4:] = self._after(rest[: rest.find(">") + 1] or f"</{tag}>")
            del self._open[at:]

    def _offset(self) -> int:
        """Where the parser is in its text."""
        line, column = self.getpos()
        if not hasattr(self, "_starts"):
            self._starts = [0, *(m.end() for m in re.finditer("\n", self.rawdata))]
        return self._starts[line - 1] + column


def elements(files: DataFrame) -> DataFrame:
    """(path, ord, name, tag, has_id, start_line, start_col, end_line, end_col) of the template's elements, in order."""
    schema = "path string, ord int, id string, tag string, has_id boolean, start_line int, start_col int, end_line int, end_col int"
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int32()] * 4]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if p.endswith(".vue"):
                    m = re.search(r"<template[^>]*>(.*)</template>", t or "", re.DOTALL)
                    t = m[1] if m else ""
                rows += [(p, k, i, tag, i is not None, *at) for k, (tag, i, *at) in enumerate(_Tags(t or "").found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    found = number_elements(files.select("path", "content").mapInArrow(run, schema))
    return found.withColumn("name", F.coalesce("id", "name")).drop("id")


def number_elements(found: DataFrame) -> DataFrame:
    """Adds ``name``: tag-n, where n counts the elements of that tag without id in the file."""
    n = F.sum(F.when(F.col("has_id"), 0).otherwise(1)).over(Window.partitionBy("path", "tag").orderBy("ord"))
    return found.withColumn("name", F.concat("tag", F.lit("-"), n.cast("string")))


# The extensions of files that get a summary.
SUMMARISED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".php", ".py", ".rb", ".go", ".rs", ".md", ".mdx")


def summary(path: Column, content: Column, most: int = 200, least: int = 15) -> Column:
    """The text of the first /** */, else /* */ comment that opens a line; else
    the // lines of a file that has nothing else. Over ``least`` characters,
    cut at ``most``; else empty."""
    squeeze = lambda parts: F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))

    def block(pattern):
        body = F.regexp_extract(content, pattern, 1)
        text = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s?", "")))
        return squeeze(F.filter(text, lambda x: (x != "") & ~x.startswith("@") & ~x.startswith("!")))

    rows = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    rows = F.split(F.regexp_replace(F.array_join(rows, "\n"), r"^\n+", ""), "\n")
    slashes = F.forall(rows, lambda x: x.startswith("//"))
    said = F.filter(F.transform(rows, lambda x: F.trim(F.regexp_replace(x, r"^//\s?", ""))), lambda x: (x != "") & ~x.rlike("^[!<=]"))
    found = [block(r"(?ms)^\s*/\*\*(.*?)\*/"), block(r"(?ms)^\s*/\*(.*?)\*/"), F.when(slashes, squeeze(said)).otherwise("")]
    best = F.coalesce(*[F.when(F.length(x) > least, F.substring(x, 1, most)) for x in found], F.lit(""))
    return F.when(F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(*SUMMARISED) & (F.length(content) >= 10), best).otherwise("")
