"""Validation of JSON held in a ``VARIANT`` column against small field specifications.

A specification maps a leaf name to one of ``string``, ``string?``, ``number``, ``number?``, ``int``,
``int?``, ``bool``, ``confidence``, ``strings`` or a tuple of allowed words; ``?`` allows JSON null.

The functions return Spark SQL text: a specification unfolds into hundreds of small expressions, which
the SQL parser builds in one step. Each JSON kind is computed once, as the argument of a lambda.
"""

from __future__ import annotations

Spec = dict[str, "str | tuple[str, ...]"]

SQL_TYPE = {
    "string": "string", "string?": "string", "number": "double", "number?": "double", "int": "int", "int?": "int",
    "bool": "boolean", "confidence": "double", "strings": "array<string>",
}


def parse(raw: str) -> str:
    """Null for text that is not JSON."""
    return f"try_parse_json({raw})"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, use: str) -> str:
    """Evaluate ``value`` once as ``name`` in ``use``."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def member(node: str, name: str) -> str:
    return f"try_variant_get({node}, '$.{name}', 'variant')"


def value(node: str, name: str, kind_of: str) -> str:
    return f"try_variant_get({node}, '$.{name}', '{kind_of}')"


def kind(v: str) -> str:
    """``undefined``, ``null``, ``string``, ``boolean``, ``array``, ``object`` or ``number``."""
    return let(
        f"schema_of_variant({v})",
        "s",
        "CASE WHEN s IS NULL THEN 'undefined' WHEN s = 'VOID' THEN 'null' WHEN s = 'STRING' THEN 'string' "
        "WHEN s = 'BOOLEAN' THEN 'boolean' WHEN startswith(s, 'ARRAY') THEN 'array' "
        "WHEN startswith(s, 'OBJECT') THEN 'object' ELSE 'number' END",
    )


def number(node: str, name: str) -> str:
    """The member as a double when it is a JSON number; a numeric string is not one."""
    return f"CASE WHEN {kind(member(node, name))} = 'number' THEN {value(node, name, 'double')} END"


def expected(path: str, wanted: str, got: str = "got") -> str:
    return f"concat({path}, ': Invalid input: expected {wanted}, received ', {got})"


def says(path: str, text: str) -> str:
    return f"concat({path}, {quoted(': ' + text)})"


def leaf_issue(node: str, path: str, name: str, want) -> str:
    """Null when the member fits, else ``path: message``."""
    return let(kind(member(node, name)), "got", _issue(node, f"concat({path}, '{name}')", name, want))


def _issue(node: str, at: str, name: str, want) -> str:
    if isinstance(want, tuple):
        options = "|".join(f'"{w}"' for w in want)
        words = ", ".join(quoted(w) for w in want)
        fits = f"got = 'string' AND {value(node, name, 'string')} IN ({words})"
        return f"CASE WHEN NOT ({fits}) THEN {says(at, f'Invalid option: expected one of {options}')} END"
    base = want.rstrip("?")
    unless_null = "got <> 'null' AND " if want.endswith("?") else ""
    if base in ("string", "bool"):
        json_kind = "boolean" if base == "bool" else base
        return f"CASE WHEN {unless_null}got <> '{json_kind}' THEN {expected(at, json_kind)} END"
    if base == "strings":
        all_text = f"forall({value(node, name, 'array<variant>')}, t -> {kind('t')} = 'string')"
        return (
            f"CASE WHEN got <> 'array' THEN {expected(at, 'array')} "
            f"WHEN NOT {all_text} THEN {says(at, 'Invalid input: expected string')} END"
        )
    x = value(node, name, "double")
    wrong = f"CASE WHEN {unless_null}got <> 'number' THEN {expected(at, 'number')}"
    if base == "int":
        wrong += f" WHEN got = 'number' AND {x} <> floor({x}) THEN {expected(at, 'int')}"
    if base == "confidence":
        wrong += f" WHEN {x} < 0 THEN {says(at, 'Too small: expected number to be >=0')}"
        wrong += f" WHEN {x} > 1 THEN {says(at, 'Too big: expected number to be <=1')}"
    return wrong + " END"


def object_issues(node: str, path: str, spec: Spec) -> str:
    """All issues of one object, in specification order; ``path`` is SQL text without a final dot."""
    inner = "''" if path == "''" else f"concat({path}, '.')"
    issues = ", ".join(leaf_issue(node, inner, n, w) for n, w in spec.items())
    wrong = f"array({expected(path, 'object', 'obj')})"
    return let(kind(node), "obj", f"CASE WHEN obj <> 'object' THEN {wrong} ELSE array_compact(array({issues})) END")


def array_issues(node: str, name: str, spec: Spec, max_items: int | None = None) -> str:
    """Issues of an array of objects held in member ``name``."""
    items = value(node, name, "array<variant>")
    each = f"flatten(transform({items}, (e, i) -> {object_issues('e', f'concat({quoted(name + chr(46))}, i)', spec)}))"
    limit = ""
    if max_items is not None:
        limit = f"WHEN size({items}) > {max_items} THEN array('{name}: Too big: expected array to have <={max_items} items') "
    wrong = f"array({expected(quoted(name), 'array', 'arr')})"
    return let(kind(member(node, name)), "arr", f"CASE WHEN arr <> 'array' THEN {wrong} {limit}ELSE {each} END")


def object_struct(node: str, spec: Spec) -> str:
    """Typed struct of the members; a member of another JSON type becomes null."""

    def typed(name: str, want) -> str:
        base = "string" if isinstance(want, tuple) else want
        if base in ("number", "number?", "confidence"):
            return number(node, name)
        if base in ("int", "int?"):
            return f"try_cast({number(node, name)} AS int)"
        return value(node, name, SQL_TYPE[base])

    return "named_struct(" + ", ".join(f"'{n}', {typed(n, w)}" for n, w in spec.items()) + ")"


def array_structs(node: str, name: str, spec: Spec) -> str:
    return f"transform({value(node, name, 'array<variant>')}, e -> {object_struct('e', spec)})"


def struct_type(spec: Spec) -> str:
    fields = (f"{n}:{SQL_TYPE['string' if isinstance(w, tuple) else w]}" for n, w in spec.items())
    return "struct<" + ",".join(fields) + ">"


#: JSON types, as a variant's schema names them, of a member that fits without a further look.
FITTING = {
    "string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL\\([0-9]+,[0-9]+\\))", "int": "BIGINT", "bool": "BOOLEAN",
    "confidence": "(BIGINT|DOUBLE|DECIMAL\\([0-9]+,[0-9]+\\))", "strings": "ARRAY<(STRING|VOID)>",
}


def _shape(spec: Spec) -> str:
    """What the schema of an object looks like that fits; its members are in the order of their names."""

    def member_type(want) -> str:
        base = "string" if isinstance(want, tuple) else want.rstrip("?")
        return f"({FITTING[base]}|VOID)" if isinstance(want, str) and want.endswith("?") else FITTING[base]

    return "^OBJECT<" + ", ".join(f"{n}: {member_type(spec[n])}" for n in sorted(spec)) + ">$"


def _in_range(v: str, spec: Spec) -> str:
    """What the schema does not tell of the typed struct ``v``."""
    checks = [f"{v}.{n} BETWEEN 0 AND 1" for n, w in spec.items() if w == "confidence"]
    checks += [f"{v}.{n} IN ({', '.join(map(quoted, w))})" for n, w in spec.items() if isinstance(w, tuple)]
    checks += [f"forall({v}.{n}, t -> t IS NOT NULL)" for n, w in spec.items() if w == "strings"]
    return " AND ".join(checks) or "true"


def quick_object(node: str, name: str, spec: Spec) -> str:
    """The typed struct of an object whose schema shows that it fits, read in one step; null where it must be looked at closer.

    An object with further members, or with a number that may not be whole where one is wanted, is one of those.
    """
    typed = let(f"try_variant_get({node}, '$.{name}', '{struct_type(spec)}')", "v", f"CASE WHEN {_in_range('v', spec)} THEN v END")
    return f"CASE WHEN schema_of_variant({member(node, name)}) RLIKE {quoted(_shape(spec))} THEN {typed} END"


def quick_array(node: str, name: str, spec: Spec) -> str:
    """The typed array where the schema of every item shows that it fits; null where they must be looked at closer.

    The schema of the array itself would not do: it holds the members of all items, also of those that lack some.
    """
    fits = f"forall({value(node, name, 'array<variant>')}, e -> coalesce(schema_of_variant(e) RLIKE {quoted(_shape(spec))}, false))"
    typed = let(
        f"try_variant_get({node}, '$.{name}', 'array<{struct_type(spec)}>')", "v",
        f"CASE WHEN forall(v, e -> {_in_range('e', spec)}) THEN v END",
    )
    return f"CASE WHEN {fits} THEN {typed} END"
