"""Rules and path functions as column expressions, for those that need no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Gates of rules that are used here, over the text: words of which one must be there, and whether in lower case.
GATES: dict[str, tuple[tuple[str, ...], bool]] = {
    "port_option": ((" --port",), False),
    "port_option_equals": ((" --port",), False),
    "kill_port": ((" kill-port ",), False),
    "findstr_port": (("findstr",), True),
    "wmic_process": (("wmic",), True),
    "wmic_interface": (("wmic",), True),
    "current_date": (("wscript", "vbs"), True),
    "tries": (("wscript", "vbs"), True),
    "duration": ((" /duration ",), False),
}

def _rule(name: str) -> tuple[str, str]:
    rule = rules.RULES[name]
    if not isinstance(rule.replacement, str):
        raise ValueError(f"rule {name} needs Python")
    return rule.pattern.pattern, rule.replacement


def java_template(template: str) -> str:
    """Group marks and literal dollars and backslashes as Java's replacements write them."""
    return re.sub(r"\\(\d)|\\?([$\\])", lambda m: f"${m[1]}" if m[1] else "\\" + m[2], template)


def apply(text: Column, *names: str) -> Column:
    """The text after some rules, in the order given."""
    for name in names:
        pattern, template = _rule(name)
        out = F.regexp_replace(text, pattern, java_template(template))
        if name in GATES:
            words, low = GATES[name]
            where = F.lower(text) if low else text
            gate = F.lit(False)
            for w in words:
                gate = gate | F.contains(where, F.lit(w))
            out = F.when(gate, out).otherwise(text)
        text = out
    return text


def short_name(name: Column, keep: bool = False) -> Column:
    """paths.short_name as an expression."""
    extension = F.substring_index(F.substring_index(name, ".", -1), "@", 1)
    dotted = F.when(extension == "exe", name).when(extension.rlike("^[0-9]+$"), "").when(F.length(extension) > 8, ".<ext>").otherwise(F.concat(F.lit("."), extension))
    bare = F.when(name.rlike("^[0-9]+$"), "<n>").when(name.rlike(r"^([0-9]{10}|[0-9]{13})([^0-9A-Za-z_]|$)"), "<timestamp>").otherwise(F.regexp_replace(name, "(.+?)[0-9]+", "$1"))
    return F.when(F.contains(name, F.lit(".")), dotted).otherwise(bare if keep else F.lit(""))


def tagged(tag: str, parts: Column, keep_first: bool = False, keep_name: bool = False) -> Column:
    """paths.tagged as an expression, over an array of parts: the same slots, of which those that hold anything are joined."""
    n = F.size(parts)
    first = F.when(n > 1, F.lower(F.get(parts, F.lit(0)))).otherwise("") if keep_first else F.lit("")
    slots = F.array(F.lit(tag), first, F.when(n > 2, "<path>").otherwise(""), F.lower(short_name(F.element_at(parts, -1), keep_name)))
    return F.when(n > 0, F.array_join(F.filter(slots, lambda x: x != ""), "\\")).otherwise(tag)


def reduce_quotes(command: Column) -> Column:
    """Trim, single spaces, one pair of outer quotes less where there are many, and doubled quotes around a word reduced."""
    c = F.regexp_replace(F.trim(command), r"\s{2,}", " ")
    lead, trail = F.length(F.regexp_extract(c, '^"*', 0)), F.length(c) - F.length(F.rtrim(c, F.lit('"')))
    c = F.when(((lead >= 3) & (trail >= 1)) | ((lead >= 1) & (trail >= 3)), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.trim(F.regexp_replace(c, r'""([^\s"]+)""', '"$1"'))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Without white space of any alphabet at both ends."""
    solid = lambda c: F.ascii(c).between(33, 126)
    return F.when(solid(text) & solid(F.right(text, F.lit(1))), text).otherwise(F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", ""))


def _where(text: Column, literals: tuple[str, ...], out: Column) -> Column:
    """out for texts that hold one of the literals; others stay."""
    some = F.lit(False)
    for x in literals:
        some = some | F.contains(text, F.lit(x))
    return F.when(some, out).otherwise(text)


def prepared(command: Column) -> Column:
    """Operators set apart, spaces and quotes reduced, redirections tagged: cmdline.prepared as an expression. Looking back over a tag's name is bounded, as this engine's patterns ask. Each step is bound to what the one before left, and looks for a literal that it needs before its pattern is tried."""
    from . import cmdline

    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    operators = cmdline.OPERATORS.pattern.replace("[a-zA-Z0-9_]+)", "[a-zA-Z0-9_]{1,64})")
    spaces = lambda t: F.when(is_ascii(t) & ~t.rlike(r"[\t-\r]|  "), t).otherwise(F.regexp_replace(t, r"(?U)\s{2,}", " "))

    def unquoted(t: Column) -> Column:
        lead, trail = F.length(t) - F.length(F.ltrim(t, F.lit('"'))), F.length(t) - F.length(F.rtrim(t, F.lit('"')))
        return F.when((F.least(lead, trail) >= 1) & (F.greatest(lead, trail) >= 3), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    text = bound(strip(command), lambda t: _where(t, ("|", "&", ">>", "<<"), F.regexp_replace(t, operators, " $1 ")))
    text = bound(bound(text, spaces), unquoted)
    text = bound(text, lambda t: _where(t, ('""',), F.regexp_replace(t, r'(?U)""([^\s"]+)""', '"$1"')))
    text = bound(text, lambda t: _where(t, ("<",), F.regexp_replace(t, r"(?U)" + cmdline.OPEN_ANGLE.pattern, "< ")))
    return bound(bound(text, lambda t: _where(t, (">&", "&>"), F.regexp_replace(t, r"(?U)" + cmdline.REDIRECT.pattern, "<r>"))), strip)


def plain_split(text: Column) -> Column:
    """Tokens between white space; a quoted stretch, without its quotes, is one of its own wherever it begins. A quote that nothing closes is a character like others."""
    found = F.regexp_extract_all(text, F.lit(r'(?U)"[^"]*"|\S+'), F.lit(0))
    quoted = lambda t: (F.length(t) >= 2) & F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))
    return F.transform(found, lambda t: F.when(quoted(t), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))
