"""Labels, declarations, summaries and contexts of nodes and edges, as Column expressions.

Arguments named after a property are columns that hold it; lists are arrays and flags booleans. A null
flag counts as false and a null list as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _if(when: Column, text: Column | str) -> Column:
    return F.when(when, text).otherwise("")


def _flag(when: Column, word: str) -> Column:
    return _if(F.coalesce(when, F.lit(False)), f"{word} ")


def _list(items: Column, before: str) -> Column:
    """``before`` and the items, or nothing for no items."""
    return _if(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(before), F.array_join(items, ", ")))


def _params(types: Column, names: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.zip_with(types, names, lambda t, n: F.concat_ws(" ", t, n)), ", "), F.lit(")"))


def _first_line(doc: Column) -> Column:
    return F.trim(F.substring_index(F.coalesce(doc, F.lit("")), "\n", 1))


def _annotated(annotations: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(annotations, lambda a: F.concat(F.lit("@"), a, F.lit(" "))), ""), F.lit(""))


def node_label(node_type: Column, name: Column, detail: Column) -> Column:
    """Display label; ``detail`` is the kind of a method or type and the type of a field."""
    method, field = F.concat(name, F.lit("("), detail, F.lit(")")), F.concat(name, F.lit(": "), detail)
    out = F.when(node_type == "METHOD", method).when(node_type == "TYPE", F.concat(name, F.lit(" ("), detail, F.lit(")"))).when(node_type == "FIELD", field)
    for kind in ("FILE", "PACKAGE", "PROJECT"):
        out = out.when(node_type == kind, F.concat(F.lit(f"{kind.capitalize()}:"), name))
    return out


def method_declaration(annotations, visibility, abstract, static, final, synchronized, return_type, name, types, names, exceptions) -> Column:
    """Signature as declared; a constructor has no return type (null) and no modifiers but its visibility."""
    head = F.concat(_annotated(annotations), _if(_some(visibility), F.concat(F.lower(visibility), F.lit(" "))))
    flags = F.concat(_flag(abstract, "abstract"), _flag(static, "static"), _flag(final, "final"), _flag(synchronized, "synchronized"))
    result = F.when(return_type.isNull(), "").otherwise(F.concat(flags, return_type, F.lit(" ")))
    return F.concat(head, result, name, _params(types, names), _list(exceptions, " throws "))


#: The word that declares each kind of type.
TYPE_WORDS = {"CLASS": "class ", "TEST_CLASS": "class ", "INTERFACE": "interface ", "ENUM": "enum ", "ANNOTATION": "@interface "}


def type_declaration(annotations, visibility, abstract, final, static, kind, name, type_params, super_class, interfaces) -> Column:
    """Declaration of a type; an interface extends its interfaces and is never called abstract, and ``Object`` is no superclass."""
    word = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv]), kind), F.lit(""))
    flags = F.concat(_flag(abstract & (kind != "INTERFACE"), "abstract"), _flag(final, "final"), _flag(static, "static"))
    params = _if(F.coalesce(F.size(type_params), F.lit(0)) > 0, F.concat(F.lit("<"), F.array_join(type_params, ", "), F.lit(">")))
    parent = _if(_some(super_class) & (super_class != "java.lang.Object"), F.concat(F.lit(" extends "), X.simple_name(super_class)))
    short = F.transform(interfaces, lambda x: X.simple_name(x))
    supers = F.when(kind == "INTERFACE", _list(short, " extends ")).otherwise(_list(short, " implements "))
    head = F.concat(_annotated(annotations), _if(_some(visibility), F.concat(F.lower(visibility), F.lit(" "))))
    return F.concat(head, flags, word, name, params, parent, supers)


def field_declaration(annotations, visibility, static, final, transient, volatile, type_, name) -> Column:
    flags = F.concat(_flag(static, "static"), _flag(final, "final"), _flag(transient, "transient"), _flag(volatile, "volatile"))
    return F.concat(_annotated(annotations), F.lower(F.coalesce(visibility, F.lit(""))), F.lit(" "), flags, type_, F.lit(" "), name)


def type_summary(kind, name, super_class, interfaces, methods, fields, abstract, final, static, doc) -> Column:
    parent = _if(_some(super_class) & (super_class != "Object"), F.concat(F.lit(" extends "), super_class))
    flags = F.filter(F.array(*[F.when(c, n) for c, n in ((abstract, "abstract"), (final, "final"), (static, "static"))]), lambda x: x.isNotNull())
    marks = _if(F.size(flags) > 0, F.concat(F.lit(" Modifiers: "), F.array_join(flags, ", "), F.lit(".")))
    first = _first_line(doc)
    head = F.concat(kind, F.lit(" "), name, parent, _list(interfaces, " implements "))
    count = F.concat(F.lit(". Contains "), methods.cast("string"), F.lit(" method(s), "), fields.cast("string"), F.lit(" field(s)."))
    return F.concat(head, count, marks, _if(first != "", F.concat(F.lit(" "), first)))


def method_summary(visibility, static, abstract, final, kind, return_type, name, types, names, exceptions, complexity, lines, calls, doc) -> Column:
    head = F.concat(visibility, F.lit(" "), _flag(static, "static"), _flag(abstract, "abstract"), _flag(final, "final"))
    result = F.concat(F.when(kind == "CONSTRUCTOR", "constructor").otherwise(return_type), F.lit(" "))
    numbers = F.concat(F.lit(". Complexity: "), complexity.cast("string"), F.lit(", LOC: "), lines.cast("string"))
    n = F.coalesce(F.size(calls), F.lit(0))
    called = _if(n > 0, F.concat(F.lit(". Calls "), n.cast("string"), F.lit(" method(s)")))
    first = _first_line(doc)
    return F.concat(head, result, name, _params(types, names), _list(exceptions, " throws "), numbers, called, _if(first != "", F.concat(F.lit(". "), first)))


def field_summary(visibility, static, final, transient, volatile, type_, name, initial, annotations, doc) -> Column:
    flags = F.concat(_flag(static, "static"), _flag(final, "final"), _flag(transient, "transient"), _flag(volatile, "volatile"))
    value, first = _if(_some(initial), F.concat(F.lit(" = "), initial)), _first_line(doc)
    return F.concat(visibility, F.lit(" "), flags, type_, F.lit(" "), name, value, _list(annotations, ". Annotations: "), _if(first != "", F.concat(F.lit(". "), first)))


def file_summary(name, package, types, imports) -> Column:
    n = F.coalesce(F.size(imports), F.lit(0))
    more = _if(n > 0, F.concat(F.lit(", Imports: "), n.cast("string"), F.lit(" classes")))
    return F.concat(F.lit("Java file: "), name, F.lit(", Package: "), package, F.lit(", Contains "), types.cast("string"), F.lit(" type(s)"), more)


#: How often an edge is used, in words, by the largest count of each step.
CALL_SUMMARIES = ((1, "Single call relationship"), (3, "Low frequency call"), (10, "Medium frequency call"), (20, "High frequency call"))
MOST_CALLS = "Very high frequency call (potential hotspot)"


def call_summary(count: Column) -> Column:
    out = F
    for limit, text in CALL_SUMMARIES:
        out = out.when(count <= limit, text)
    return out.otherwise(MOST_CALLS)


def call_description(count: Column, lines: Column) -> Column:
    """Lines in full up to three calls, then the first three lines and dots."""
    once = F.concat(F.lit("Called once at line "), lines[0].cast("string"))
    head = F.concat(F.lit("Called "), count.cast("string"), F.lit(" times at lines "))
    some = F.concat(X.compact_lines(F.slice(lines, 1, 3)), F.lit(", ..."))
    return F.when(count == 1, once).otherwise(F.concat(head, F.when(count <= 3, X.compact_lines(lines)).otherwise(some)))


def access_description(verb: str, count: Column, lines: Column) -> Column:
    """``Field read`` or ``Field written``, for edges of several occurrences."""
    s = _if(count > 1, "s")
    return F.concat(F.lit(f"Field {verb} "), count.cast("string"), F.lit(" time"), s, F.lit(" at line"), s, F.lit(" "), X.compact_lines(lines))


def access_summary(verb: str, count: Column) -> Column:
    """``verb`` is access or modification; more than five occurrences are frequent."""
    return F.when(count > 5, f"High frequency field {verb}").otherwise(f"Normal field {verb}")


def edge_context(edge_type: str, src, dst, count, line, lines, kind, summary, hotspot=None, recursive=None, initial=None) -> Column:
    """A CALLS, READS or WRITES edge as text. Many lines are cut to three and two for calls, to two and one for fields."""
    joint, ahead, behind = {"CALLS": (" → ", 3, 2), "READS": (" reads ", 2, 1), "WRITES": (" writes ", 2, 1)}[edge_type]
    n = F.coalesce(count, F.lit(1))
    text = F.transform(lines, lambda x: x.cast("string"))
    cut = F.concat(F.slice(text, 1, ahead), F.array(F.lit("...")), F.slice(text, -behind, behind))
    many = _if(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(" at lines "), F.array_join(F.when(F.size(lines) <= 5, text).otherwise(cut), ", ")))
    place = F.when(n == 1, F.concat(F.lit(" at line "), line.cast("string"))).otherwise(many)
    times = _if(n > 1, F.concat(F.lit(" (×"), n.cast("string"), F.lit(")")))
    marks = [F.when(kind.isNotNull() & (kind != "direct"), F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise("")]
    on = lambda c, t: F.lit("") if c is None else _if(F.coalesce(c, F.lit(False)), t)
    marks += [on(initial, " [INIT]"), _if(summary.isNotNull(), F.concat(F.lit(" ("), summary, F.lit(")")))]
    marks += [on(hotspot, " ⚡HOTSPOT"), on(recursive, " 🔄RECURSIVE")]
    return F.concat(F.lit(edge_type), times, F.lit(": "), src, F.lit(joint), dst, place, *[F.coalesce(m, F.lit("")) for m in marks])


def parameter_context(index, final, type_id, name, var_args, role, annotations) -> Column:
    head = F.concat(F.lit("USES_PARAMETER: #"), index.cast("string"), F.lit(" "), _flag(final, "final"), type_id, F.lit(" "), name)
    marks = _if(F.size(annotations) > 0, F.concat(F.lit(" ["), F.array_join(annotations, ", "), F.lit("]")))
    return F.concat(head, _if(F.coalesce(var_args, F.lit(False)), "..."), _if(_some(role), F.concat(F.lit(" ["), role, F.lit("]"))), marks)


def node_text(node_type, label, path, summary, doc, comments, source) -> Column:
    """A node as a block of text: place, summary, docs (comments without docs) and source, each only if there is any."""
    line = lambda c, name, sep=" ": _if(_some(c), F.concat(F.lit(f"{name}:{sep}"), c, F.lit("\n")))
    notes = F.when(_some(doc), line(doc, "Documentation", "\n")).otherwise(line(comments, "Comments", "\n"))
    head = F.concat(F.lit("=== "), node_type, F.lit(": "), label, F.lit(" ===\n"))
    return F.concat(head, line(path, "Location"), line(summary, "Summary"), notes, line(source, "Source Code", "\n"))
