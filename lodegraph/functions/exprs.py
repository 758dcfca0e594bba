"""Scalar functions and predicates as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_name(q: Column) -> Column:
    """Text after the last dot, unless the dot comes first or there is none."""
    return F.when(F.length(F.regexp_extract(q, r"^(.*)\.[^.]*$", 1)) > 0, F.substring_index(q, ".", -1)).otherwise(q)


def clean_name(label: Column) -> Column:
    """A node's display name: nothing from the first ``(`` on (unless it comes first), then without ``package:``,
    ``project:`` or ``file:`` (in any case), or else only what stands before ``": "``. Null gives an empty text."""
    raw = F.trim(F.coalesce(label, F.lit("")))
    head = F.when(F.instr(raw, "(") > 1, F.trim(F.substring_index(raw, "(", 1))).otherwise(raw)
    prefix = "(?i)^(package|project|file):"
    return F.when(head.rlike(prefix), F.trim(F.regexp_replace(head, prefix, ""))).when(F.instr(head, ": ") > 1, F.trim(F.substring_index(head, ": ", 1))).otherwise(head)


def csv_encode(s: Column) -> Column:
    """Line ends to LF, then backslash escapes for backslash, LF, tab, CR, form feed and backspace."""
    s = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\f", "\\f"), ("\b", "\\b")):
        s = F.replace(s, F.lit(raw), F.lit(code))
    control = r"[\x00-\x07\x0b\x0e-\x1f]"
    coded = F.transform(F.split(s, ""), lambda x: F.when(x.rlike(control), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))).otherwise(x))
    return F.when(s.rlike(control), F.array_join(coded, "")).otherwise(s)


def csv_decode(s: Column) -> Column:
    """Inverse of :func:`csv_encode`; a backslash without a known code stays."""
    parts = F.regexp_extract_all(s, F.lit(r"(\\u[0-9a-f]{4}|\\[\\ntrfb]|[^\\]+|\\)"), F.lit(1))
    known = {"\\\\": "\\", "\\n": "\n", "\\t": "\t", "\\r": "\r", "\\f": "\f", "\\b": "\b"}

    def one(x: Column) -> Column:
        out = F.when(x.rlike(r"^\\u[0-9a-f]{4}$"), F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE"))
        for code, raw in known.items():
            out = out.when(x == code, F.lit(raw))
        return out.otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def csv_quote(s: Column) -> Column:
    """CR and CRLF to LF, quotes doubled, and quotes around what holds a comma, quote, LF or tab."""
    flat = F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(flat.rlike('[,"\n\t]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


def list_format(items: Column) -> Column:
    """Items encoded, with a ``;`` inside an item escaped, joined by ``;`` and quoted as one field; a null item is empty."""
    one = lambda x: F.coalesce(F.replace(csv_encode(x), F.lit(";"), F.lit("\\;")), F.lit(""))
    return F.coalesce(csv_quote(F.array_join(F.transform(items, one), ";")), F.lit(""))


def property_text(value: Column) -> Column:
    """A text property as a field: encoded and quoted; null and empty texts are written as ``""``."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit('""')).otherwise(csv_quote(csv_encode(value)))


#: The literals that add a path through a method.
BRANCH_LITERALS = (" if ", " if(", " for ", " for(", " while ", " while(", " case ", " catch ", " catch(", "&&", "||")


def complexity(source: Column, literals=BRANCH_LITERALS) -> Column:
    """1 plus the occurrences of each branch literal."""
    count = lambda p: ((F.length(source) - F.length(F.replace(source, F.lit(p)))) / len(p)).cast("int")
    return reduce(lambda a, p: a + count(p), literals, F.lit(1))


def lines_of_code(start: Column, end: Column) -> Column:
    return end - start + 1


def is_test_path(path: Column, keywords: list[str]) -> Column:
    """Any keyword inside the lower-cased path."""
    low = F.lower(path)
    return reduce(lambda a, k: a | F.contains(low, F.lit(k)), keywords[1:], F.contains(low, F.lit(keywords[0])))


def is_test_method(annotations: Column, path: Column) -> Column:
    return F.exists(annotations, lambda a: F.contains(a, F.lit("Test"))) | F.contains(path, F.lit("src/test/")) | F.contains(path, F.lit("src\\test\\"))


def is_test_class(name: Column) -> Column:
    return F.endswith(name, F.lit("Test")) | F.endswith(name, F.lit("Tests")) | F.startswith(name, F.lit("Test")) | F.contains(name, F.lit("TestCase"))


#: Descriptors of primitive types.
PRIMITIVES = {"byte": "B", "char": "C", "double": "D", "float": "F", "int": "I", "long": "J", "short": "S", "boolean": "Z", "void": "V"}


def jvm_descriptor(t: Column) -> Column:
    """Descriptor of a type name; anything but a primitive is taken for a class."""
    known = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, t), F.concat(F.lit("L"), F.replace(t, F.lit("."), F.lit("/")), F.lit(";")))


def descriptor_prefix(params: Column) -> Column:
    """``(`` and the descriptors of a comma-separated list; without parameters an empty text, which fits any overload."""
    inner = F.array_join(F.transform(F.split(params, ","), lambda p: jvm_descriptor(F.trim(p))), "")
    return F.when(F.trim(params) == "", F.lit("")).otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def parse_method_id(m: Column) -> Column:
    """``pkg.Class.method(params)`` as struct (class, method, params); all null without a dot before the parenthesis."""
    head = F.substring_index(m, "(", 1)
    params = F.regexp_extract(m, r"\((.*)\)", 1)
    dotted = F.instr(head, ".") > 0
    cls = F.regexp_extract(head, r"^(.*)\.[^.]*$", 1)
    return F.struct(F.when(dotted, cls).alias("class"), F.when(dotted, F.substring_index(head, ".", -1)).alias("method"), F.when(dotted, params).alias("params"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a path elsewhere stays absolute."""
    return F.when(F.startswith(path, F.lit(root)), F.regexp_replace(F.substr(path, F.lit(len(root) + 1)), r"^/+", "")).otherwise(path)


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob, after any text: ``**`` any, ``*`` within a folder, ``?`` one character."""
    rules = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*|.", glob.replace("\\", "/"), flags=re.DOTALL)
    return "^.*" + "".join(rules.get(p) or ("\\" + p if p in ".{}()+|^$[]" else p) for p in parts) + "$"


def excluded(path: Column, root: str, globs: list[str]) -> Column:
    """Whether any glob fits the whole path, or its part below ``root``."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.when(F.startswith(flat, F.lit(root)), F.regexp_replace(F.substr(flat, F.lit(len(root) + 1)), "^/", ""))
    hits = [F.coalesce(p.rlike(glob_regex(g)), F.lit(False)) for g in globs if g for p in (flat, below)]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def location(path: Column, start: Column, end: Column, element: Column) -> Column:
    """``file:start-end::element`` without what is missing; numbers of 0 or less, and an end equal to the start, are missing."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    number = lambda c, mark: F.when(c > 0, F.concat(F.lit(mark), c.cast("string"))).otherwise("")
    last = F.when(end != start, number(end, "-")).otherwise("")
    lines = F.when((start > 0) | (end > 0), F.concat(F.lit(":"), number(start, ""), F.coalesce(last, F.lit(""))))
    head = F.concat(F.when(blank(path), "").otherwise(path), F.coalesce(lines, F.lit("")))
    return F.when(blank(element), head).otherwise(F.concat(head, F.when(head == "", "").otherwise("::"), F.trim(element)))


def trimmed_distinct(items: Column) -> Column:
    """Trimmed, non-blank, distinct items in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def short_signature(signature: Column) -> Column:
    """``m(...)``: what stands between the last dot and the parenthesis; a dot after it counts for nothing. Null gives an empty text."""
    head = F.substring_index(signature, "(", 1)
    name = F.when(F.instr(F.substring_index(signature, "(", -1), ".") > 0, head).otherwise(F.substring_index(head, ".", -1))
    return F.coalesce(F.when(F.instr(signature, "(") > 0, F.concat(name, F.lit("(...)"))).otherwise(signature), F.lit(""))


def versioned_id(base: Column, label: Column) -> Column:
    """``base@label``; an id that ends so already is left; a null or empty one is replaced by a random id."""
    suffix = F.concat(F.lit("@"), label)
    return F.when(F.coalesce(base, F.lit("")) == "", F.concat(F.uuid(), suffix)).when(F.endswith(base, suffix), base).otherwise(F.concat(base, suffix))


def base_id(node_id: Column) -> Column:
    return F.substring_index(node_id, "@", 1)


def version_flow(a: Column, b: Column) -> Column:
    return F.when((F.trim(a) != "") & (F.trim(b) != ""), F.concat(a, F.lit("->"), b))


def truncated(s: Column, limit: int = 500) -> Column:
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def frequency(count: Column) -> Column:
    return F.when(count <= 1, "single").when(count <= 3, "few").when(count <= 10, "several").when(count <= 20, "many").otherwise("heavy")


def compact_lines(lines: Column) -> Column:
    """Up to five line numbers in full, else the first three, dots, and the last two."""
    text = F.transform(lines, lambda x: x.cast("string"))
    short = F.concat(F.slice(text, 1, 3), F.array(F.lit("...")), F.slice(text, -2, 2))
    return F.array_join(F.when(F.size(lines) <= 5, text).otherwise(short), ", ")


def doc_summary(doc: Column) -> Column:
    """First sentence of a doc comment: up to ``.?!`` before white space, or up to ``@``."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(doc, r"^/\*\*|\*/$", ""), r"(?m)^\s*\*\s?", ""))
    return F.trim(F.regexp_extract(F.substring_index(plain, "@", 1), r"(?s)^(.*?[.?!])(?=\s|$)|^(.*)$", 0))


def all_comments(comments: Column) -> Column:
    """``comments`` (array of struct kind, content) as ``/* [KIND] */`` blocks, blank ones left out."""
    some = F.filter(comments, lambda c: F.trim(c["content"]) != "")
    blocks = F.transform(some, lambda c: F.concat(F.lit("/* ["), c["kind"], F.lit("] */\n"), F.trim(c["content"])))
    return F.coalesce(F.array_join(blocks, "\n\n"), F.lit(""))


def best_comment(comments: Column) -> Column:
    """The first doc comment; without one, all comments."""
    doc = F.try_element_at(F.filter(comments, lambda c: c["kind"] == "JAVADOC"), F.lit(1))["content"]
    return F.when(F.coalesce(doc, F.lit("")) != "", doc).otherwise(all_comments(comments))


def strip_doc(source: Column) -> Column:
    """Source without a leading doc comment."""
    return F.when(F.startswith(F.ltrim(source), F.lit("/**")), F.regexp_replace(F.substr(source, F.instr(source, "*/") + 2), r"^\s+", "")).otherwise(source)


def signature(package: Column, cls: Column, method: Column, types: Column) -> Column:
    return F.concat(package, F.lit("."), cls, F.lit("."), method, F.lit("("), F.array_join(types, ","), F.lit(")"))


def node_context(label: Column, docs: Column, comments: Column, summary: Column) -> Column:
    """Label, then docs (comments if there are none), then the summary, a line each."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n", label, F.coalesce(blank(docs), blank(comments)), blank(summary))


def meaningful(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(a1, b1) <= F.least(a2, b2)


def outside_window(t: Column, reference: Column, max_days: int) -> Column:
    """More whole days before the reference than allowed; no bound for 0 or less. Times are epoch seconds."""
    return F.lit(False) if max_days <= 0 else F.floor((reference - t) / 86400) > max_days


def is_method(element: Column) -> Column:
    return F.contains(element, F.lit("(")) & F.contains(element, F.lit(")"))


def is_hotspot(count: Column) -> Column:
    return count >= 10


def confidence(a: Column, b: Column) -> Column:
    """Same key: 1.0 for equal source (two nulls are equal), 0.8 otherwise."""
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(F.lit(0.8))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike; one empty set is unlike any other."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: Properties that a bulk header declares as arrays.
ARRAY_PROPERTIES = (
    "parameterTypes", "parameterNames", "annotations", "exceptions", "calledMethods", "accessedFields", "localVariables",
    "interfaces", "genericTypes", "readBy", "writtenBy", "callLocations", "readLocations", "writeLocations", "callTypes",
    "accessTypes", "descriptions", "leftLocations", "rightLocations", "leftElements", "rightElements",
)
#: Properties that it declares as whole numbers, besides names with ``Count``, ``Number`` or ``Line``.
INT_PROPERTIES = ("occurrences", "complexity", "cyclomaticComplexity", "linesOfCode", "fieldCount", "methodCount", "lineStart", "lineEnd")


def header_type(name: str) -> str:
    """Column type in a bulk CSV header, told from the property's name; the first rule that fits."""
    rules = [
        (name in ARRAY_PROPERTIES, "string[]"),
        (name in INT_PROPERTIES or any(x in name for x in ("Count", "Number", "Line")), "int"),
        (name.startswith(("is", "has")), "boolean"),
        (name in ("confidence", "similarityScore"), "float"),
    ]
    return next((t for fits, t in rules if fits), "string")


def query_text(s: Column) -> Column:
    """A text inside a quoted query literal: backslash, quotes, line ends and tabs escaped; null is empty."""
    for raw, code in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(code))
    return F.coalesce(s, F.lit(""))


def prop(props: Column, key: str, kind: str = "string", default=None) -> Column:
    """A property of the bag as ``kind``; ``default`` where it is missing or does not read as one."""
    return F.coalesce(F.try_element_at(props, F.lit(key)).try_cast(kind), F.lit(default).cast(kind))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one digit; no rows give 0.0%."""
    return F.when(whole > 0, F.format_string("%.1f%%", part * 100.0 / whole)).otherwise("0.0%")


def duration(millis: Column) -> Column:
    """Milliseconds as ``ms``, seconds with one digit, minutes and seconds, or hours, minutes and seconds."""
    seconds = millis / 1000.0
    minutes, rest = F.floor(seconds / 60), seconds % 60
    out = F.when(millis < 1000, F.format_string("%dms", millis)).when(seconds < 60, F.format_string("%.1fs", seconds))
    return out.when(minutes < 60, F.format_string("%dm %.0fs", minutes, rest)).otherwise(F.format_string("%dh %dm %.0fs", F.floor(minutes / 60), minutes % 60, rest))


def byte_size(n: Column, largest: str = "GB") -> Column:
    """Bytes as B, KB and MB with one digit, or GB with two; nothing larger than the unit ``largest``."""
    units = ("B", "KB", "MB", "GB")[: ("B", "KB", "MB", "GB").index(largest) + 1]
    texts = [F.format_string("%dB", n), *(F.format_string("%.2fGB" if u == "GB" else f"%.1f{u}", n / float(1 << 10 * k)) for k, u in enumerate(units[1:], 1))]
    return F.coalesce(*[F.when(n < 1 << 10 * k, text) for k, text in enumerate(texts[:-1], 1)], texts[-1])
