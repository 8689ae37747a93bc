"""The rules as column expressions, one at a time; the program as a whole goes over Arrow batches (batches.py).

What a template cannot say is made of the matches: the
text is what lies between them and what each match's groups become. Payloads
inside calls are the last rule's; they are decoded by a helper over the matches.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, decode, native, rules
from .native import java_template
from .paths import TAG_PATH
from .shipping import ship

#: Words, white space and letter case as in all of Unicode, as the patterns mean them.
UNICODE = "(?U)"
#: Of rules whose replacement is made from groups: which groups (0 is the match), and what they become.
Made = Callable[[list[Column]], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def java(pattern: str) -> Column:
    return F.lit(UNICODE + pattern)


def occurs(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def made(text: Column, pattern: str, groups: list[int], of_groups: Made) -> Column:
    """The text with each match replaced by what its groups become. Groups that take no part are empty."""
    lists = [F.regexp_extract_all(text, java(pattern), F.lit(g)) for g in groups]
    between = F.split(text, UNICODE + pattern, -1)
    return F.when(~occurs(text, pattern), text).otherwise(_woven_of(between, lists, of_groups))


def _woven_of(between: Column, lists: list[Column], of_groups: Made) -> Column:
    return bound(F.struct(between.alias("b"), *(x.alias(f"g{i}") for i, x in enumerate(lists))), lambda s: _woven(s, len(lists), of_groups))


def _woven(s: Column, n: int, of_groups: Made) -> Column:
    part = lambda i: F.concat(of_groups([F.coalesce(F.get(s[f"g{k}"], i), F.lit("")) for k in range(n)]), F.get(s["b"], i + 1))
    places = F.when(F.size(s["b"]) > 1, F.sequence(F.lit(0), F.size(s["b"]) - 2)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.get(s["b"], F.lit(0)), F.array_join(F.transform(places, part), ""))


def _pieces(path: Column) -> Column:
    return F.filter(F.split(path, r"[\\/]+"), lambda x: x != "")


def _base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*[/\\]", "")


def _first(groups: list[Column]) -> Column:
    return F.coalesce(*(F.nullif(g, F.lit("")) for g in groups), F.lit(""))


def _under(tag: str, keep_first: bool = False, keep_name: bool = False) -> Made:
    return lambda gs: bound(_pieces(_first(gs)), lambda p: native.tagged(tag, p, keep_first, keep_name))


def _of_name(path: Column) -> Column:
    return bound(_pieces(_base_name(path)), lambda p: native.tagged(TAG_PATH, p))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\\")


def _unix_folder(gs: list[Column]) -> Column:
    below = F.ltrim(gs[1], F.lit("/"))
    return F.when(~F.contains(below, F.lit("/")), F.concat(F.lit("\\"), F.lower(gs[0]))).otherwise(_joined(F.lit(TAG_PATH), native.short_name(F.substring_index(below, "/", -1))))


def _linker_out(gs: list[Column]) -> Column:
    return bound(_pieces(gs[0]), lambda p: F.concat(F.lit("/out:"), F.when(F.size(p) > 1, TAG_PATH + "\\").otherwise(""), F.when(F.size(p) > 0, native.short_name(F.element_at(p, -1))).otherwise("")))


def _object_file(gs: list[Column]) -> Column:
    return bound(_pieces(gs[0]), lambda p: F.when(F.size(p) < 2, native.short_name(F.translate(gs[0], "/", "\\"))).otherwise(F.concat(F.lit(TAG_PATH + "\\"), native.short_name(F.element_at(p, -1)))))


def _unc(gs: list[Column]) -> Column:
    return bound(_pieces(_first(gs[1:])), lambda p: F.when(F.contains(gs[0], F.lit("<int_ip>")), native.tagged("<int_ip>", p)).otherwise(native.tagged("<ext_ip>", p)))


MADE: dict[str, tuple[list[int], Made]] = {
    "cmd_separators": ([1], lambda gs: F.when(gs[0] != "", gs[0]).otherwise(" ")),
    "backtick": ([1, 2], lambda gs: F.concat(gs[0], gs[1])),
    "flag_cluster": ([0], lambda gs: F.replace(gs[0], F.lit("/"), F.lit(" /"))),
    "unix_folders": ([1, 2], _unix_folder),
    "program_files": ([1, 2, 3, 4], _under("<program_files>")),
    "program_data": ([1, 2, 3, 4], _under("<ProgramData>", keep_first=True)),
    "users": ([1, 2, 3, 4], _under("<Users>")),
    "windows": ([1, 2, 3, 4], _under("<Windows>", keep_name=True)),
    "drive_c": ([1, 2, 3], _under("<C>", keep_first=True)),
    "other_drives": ([1], _under(TAG_PATH)),
    "linker_out": ([1], _linker_out),
    "object_file": ([1], _object_file),
    "unix_path": ([1], lambda gs: _joined(F.lit(TAG_PATH), native.short_name(gs[0]))),
    "unc_host": ([1, 2], _under("<host>")),
    "unc_address": ([0, 1, 2], _unc),
    "variable_path": ([0], lambda gs: _of_name(F.regexp_replace(gs[0], "^[^%]*%[^%]*%", ""))),
    "relative": ([0], lambda gs: _of_name(gs[0])),
    "simple_relative": ([0], lambda gs: _of_name(gs[0])),
}
PAYLOADS = "base64_call"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _payload_texts(lists: pa.Array) -> pa.Array:
    """Decoded payloads of a text's calls, null for binary ones."""
    return pa.array([None if x is None else [decode.payload_text(p) for p in x] for x in lists.to_pylist()], pa.list_(pa.string()))


def _decoded(text: Column) -> Column:
    """The last rule, outside of functions of elements, where no helper can be called."""
    ship(SparkSession.getActiveSession())
    pattern = rules.RULES[PAYLOADS].pattern.pattern
    found = _payload_texts(F.regexp_extract_all(text, java(pattern), F.lit(1)))
    become = F.transform(found, lambda t: F.coalesce(F.replace(t, F.lit("'"), F.lit("''")), F.lit("<payload>")))
    between = F.split(text, UNICODE + pattern, -1)
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), become.alias("g")), lambda x: F.array(x["b"], F.coalesce(x["g"], F.lit(""))))), "")
    return F.when(occurs(text, pattern), woven).otherwise(text)


def _need(name: str, text: Column) -> Column | None:
    need = rules.NEED.get(name)
    if need is None:
        return None
    return F.contains(text, F.lit(need)) if isinstance(need, str) else occurs(text, need.pattern)


def one(name: str, text: Column, lower: Column, slash: Column) -> Column:
    """A text after one rule, its gate looking at the text and at the snapshots."""
    rule = rules.RULES[name]
    tests = [t for t in (_gate(rule.gate, text, lower, slash), _need(name, text)) if t is not None]
    if name == PAYLOADS:
        out = _decoded(text)
    elif name in MADE:
        out = made(text, rule.pattern.pattern, *MADE[name])
    else:
        out = F.regexp_replace(text, java(rule.pattern.pattern), F.lit(java_template(rule.replacement)))
    if not tests:
        return out
    test = tests[0]
    for t in tests[1:]:
        test = test & t
    return F.when(test, out).otherwise(text)


def _gate(gate: rules.Gate | None, text: Column, lower: Column, slash: Column) -> Column | None:
    if gate is None:
        return None
    out = slash if gate.slash else F.lit(True)
    for words, where in ((gate.text, text), (gate.lower, lower)):
        some = F.lit(False)
        for w in words:
            some = some | F.contains(where, F.lit(w))
        out = out & some if words else out
    return out


def few_ascii(text: Column) -> Column:
    """cmdline.few_ascii as an expression."""
    outside = F.length(F.regexp_replace(text, r"[\x00-\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", ""))
    return ~native.is_ascii(text) & ((F.length(text) - outside) / F.length(text) < 0.8)


def payloads_decoded(text: Column) -> Column:
    """What the program makes of a text that has passed all rules but the last."""
    return native.strip(one(PAYLOADS, text, F.lit(""), F.lit(False)))


def rewrite(df: DataFrame, command: str, out: str = "rewritten") -> DataFrame:
    """df with the command after all rules."""
    ship(df.sparkSession)
    return df.withColumn(out, payloads_decoded(batches.ruled(F.col(command))))
