"""Command lines to trees as a Spark job, level by level.

A level's parts are command lines: the commands themselves first, then the quoted
and encoded parts inside them. Each is prepared and rewritten by column
expressions, and split into slots by a helper: finished tokens, or texts that are
command lines in themselves, which are the next level's parts. Equal parts with
equal surroundings are one, whichever commands hold them. From the last level up,
parts' values are put into the slots that asked for them, by joins; a part that
holds itself stays a token. Nesting has no limit but ``levels``, beyond which a
command is an error.

Commands are far more than the texts that the rules make of them, the shapes. All
commands of a shape have one value, so only shapes are split and have parts. The
one thing that depends on a command's own text is whether a part that deep inside
it is that text again: a shape knows the texts of its deep parts, and commands
that are among those are parsed each on its own.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches, cmdline, decode, program
from ..functions.shipping import ship
from ..sources.shared import stored

LEAF, NESTED, PAYLOAD, CALL = range(4)
#: A slot: its kind, what it has already (as JSON, and plain), and texts to be parsed: the part, or a call's head, and a payload; null if there is none.
_TEXTS = T.ArrayType(T.StringType())
SLOT = T.StructType([T.StructField(n, k) for n, k in (("kind", T.IntegerType()), ("items", _TEXTS), ("leaves", _TEXTS), ("inner", T.StringType()), ("payload", T.StringType()))])
SLOTS = T.StructType([T.StructField("slots", T.ArrayType(SLOT)), T.StructField("error", T.StringType())])


def slots_of(text: str, parent: str | None) -> list[tuple]:
    """The slots of a rewritten command line, as cmdline's steps take its tokens."""
    out, before = [], ""
    for token in filter(None, cmdline.split_windows(text)):
        here = token.lower()
        call = here.find(cmdline.CALL)
        end = call + len(cmdline.CALL)
        if call >= 0 and end < len(token) - 1:
            out.append((CALL, None, None, token[:end], decode.payload_text(token[end:].strip("(").strip("\"'\\"))))
        elif cmdline._payload_follows(before, token):
            out.append((PAYLOAD, None, None, None, decode.payload_text(token)))
        elif cmdline.holds_more(token, parent):
            out.append((NESTED, None, None, token, None))
        else:
            parts = cmdline.cleaned(token.strip("\"'").strip())
            leaves = list(map(cmdline.finished, parts))
            out.append((LEAF, [json.dumps(x, ensure_ascii=False) for x in leaves], leaves, None, None))
            here = parts[0].lower() if len(parts) == 1 else None
        before = here
    return out


@F.arrow_udf(SLOTS)
def _slots(texts: pa.Array, parents: pa.Array) -> pa.Array:
    rows = []
    for text, parent in zip(texts.to_pylist(), parents.to_pylist()):
        try:
            rows.append({"slots": [dict(zip(("kind", "items", "leaves", "inner", "payload"), s)) for s in slots_of(text, parent)], "error": None})
        except Exception as e:  # noqa: BLE001
            rows.append({"slots": [], "error": f"{type(e).__name__}: {e}"})
    slot = pa.struct([("kind", pa.int32()), ("items", pa.list_(pa.string())), ("leaves", pa.list_(pa.string())), ("inner", pa.string()), ("payload", pa.string())])
    return pa.array(rows, pa.struct([("slots", pa.list_(slot)), ("error", pa.string())]))


@F.arrow_udf(T.StructType([T.StructField("item", T.StringType()), T.StructField("leaf", T.StringType())]))
def _whole(texts: pa.Array) -> pa.Array:
    """A part that stays a token."""
    leaves = [cmdline.finished(x) for x in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([json.dumps(x, ensure_ascii=False) for x in leaves], pa.string()), pa.array(leaves, pa.string())], ["item", "leaf"])


def part_id(text: Column, parent: Column, above: Column) -> Column:
    sized = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.md5(F.concat(sized(text), sized(parent), F.array_join(F.transform(above, sized), "")).cast("binary"))


def rewritten(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with its texts prepared and after all rules but the last, which is a shape's own affair."""
    ship(df.sparkSession)
    return df.withColumn(out, batches.rewritten(F.col(text)))


def _level(parts: DataFrame) -> DataFrame:
    """Stored: id, text, above, and the slots of parts (id, text, parent, above, loops: whether they stay tokens)."""
    rows = rewritten(parts, "text", "__new").withColumn("__new", program.payloads_decoded(F.col("__new")))
    found = _slots(F.when(F.col("loops"), F.lit("")).otherwise(F.col("__new")), F.col("parent"))
    rows = rows.withColumns({"__s": found, "__w": _whole(F.when(F.col("loops"), F.col("text")).otherwise(F.lit("")))})
    alone = F.array(F.struct(F.lit(LEAF).alias("kind"), F.array(F.col("__w.item")).alias("items"), F.array(F.col("__w.leaf")).alias("leaves"), F.lit(None).cast("string").alias("inner"), F.lit(None).cast("string").alias("payload")))
    return stored(rows.select("id", "text", "above", F.when(F.col("loops"), alone).otherwise(F.col("__s.slots")).alias("slots"), F.col("__s.error").alias("error")), "parts")


def _asked(level: DataFrame) -> DataFrame:
    """Stored: up (a part), slot, which (0 inner, 1 payload), and the part asked for."""
    slots = level.select(F.col("id").alias("up"), "text", "above", F.posexplode("slots").alias("slot", "s"))  # a shape has no text
    texts = slots.select("up", "text", "above", "slot", F.col("s.kind").alias("kind"), F.posexplode(F.array("s.inner", "s.payload")).alias("which", "inner")).where("inner is not null")
    parent = F.when(F.col("kind") == NESTED, F.col("inner"))
    rows = texts.select("up", "slot", "which", F.col("inner").alias("text"), parent.alias("parent"), F.concat("above", F.filter(F.array("text"), lambda t: t.isNotNull())).alias("above"), F.array_contains("above", F.col("inner")).alias("loops"))
    return stored(rows.withColumn("id", part_id(F.col("text"), F.col("parent"), F.col("above"))), "asked")


def _slot_value(slot: Column, inside: Column, i: Column, field: str) -> Column:
    """What a slot gives: items (JSON) or leaves, out of its own and of the values inside (slot, which, items, leaves)."""
    of = lambda which: F.coalesce(F.get(F.filter(inside, lambda c: (c["slot"] == i) & (c["which"] == which)), F.lit(0))[field], F.array().cast("array<string>"))
    as_list = lambda items: F.array(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))) if field == "items" else items
    binary = F.array(F.lit('"<payload>"' if field == "items" else "<payload>"))
    payload = F.when(slot["payload"].isNull(), binary).otherwise(as_list(of(1)))
    nested = F.when(F.size(of(0)) > 1, as_list(of(0))).otherwise(of(0)) if field == "items" else of(0)
    return F.when(slot["kind"] == LEAF, slot[field]).when(slot["kind"] == NESTED, nested).when(slot["kind"] == PAYLOAD, payload).otherwise(as_list(F.concat(of(0), payload)))


def _value_of(field: str):
    return lambda slot, i: _slot_value(slot, F.col("inside"), i, field)


TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(TEXTS)


def _climbed(level: DataFrame, levels: int) -> DataFrame:
    """Stored: id, items, leaves, error, asked (texts of the parts of a first level as _level gives it) and deep (those of the parts inside these)."""
    made: list[tuple[DataFrame, DataFrame]] = []
    while True:
        asked = _asked(level)
        made.append((level, asked))
        if asked.isEmpty():
            break
        if len(made) >= levels:
            deep = asked.select(F.col("up").alias("id")).distinct().withColumn("deep", F.lit(f"ValueError: command lines inside each other on more than {levels} levels"))
            made[-1] = (level.join(deep, "id", "left").withColumn("error", F.coalesce("error", "deep")).drop("deep"), asked.limit(0))
            break
        level = _level(asked.select("id", "text", "parent", "above", "loops").dropDuplicates(["id"]))
    below: DataFrame | None = None
    for level, asked in reversed(made):
        inside = F.array().cast("array<struct<slot int, which int, items array<string>, leaves array<string>>>")
        rows = level.withColumns({"inside": inside, "wrong": F.lit(None).cast("string"), "asked": _none(), "deep": _none()})
        if below is not None:
            parts = asked.select("up", "slot", "which", "id", F.col("text").alias("part")).join(below, "id")
            met = parts.groupBy("up").agg(F.collect_list(F.struct("slot", "which", "items", "leaves")).alias("inside"), F.max("error").alias("wrong"), F.collect_set("part").alias("asked"), F.array_distinct(F.flatten(F.collect_list(F.concat("deep", "asked")))).alias("deep"))
            rows = level.join(met, F.col("id") == F.col("up"), "left").withColumns({"inside": F.coalesce("inside", inside), "asked": F.coalesce("asked", _none()), "deep": F.coalesce("deep", _none())})
        given = [F.flatten(F.transform("slots", _value_of(field))).alias(field) for field in ("items", "leaves")]
        below = stored(rows.select("id", *given, F.coalesce("error", "wrong").alias("error"), "asked", "deep"), "values")
    return below


def shape_values(shapes: DataFrame, levels: int = cmdline.LEVELS) -> DataFrame:
    """id, items, leaves, error and deep of distinct shapes (id, shape: a text as rewritten leaves it): items are the tree's members as JSON, leaves its tokens."""
    ship(shapes.sparkSession)
    rows = shapes.withColumn("__s", _slots(program.payloads_decoded(F.col("shape")), F.lit(None).cast("string")))
    return _climbed(stored(rows.select("id", F.lit(None).cast("string").alias("text"), _none().alias("above"), "__s.slots", "__s.error"), "shapes"), levels)


def lone_values(parts: DataFrame, levels: int = cmdline.LEVELS) -> DataFrame:
    """values of commands, each with its own text above its parts."""
    ship(parts.sparkSession)
    at = parts.select("id", "text", F.lit(None).cast("string").alias("parent"), _none().alias("above"), F.lit(False).alias("loops"))
    return _climbed(_level(at), levels).drop("asked", "deep")


def shape_id(shape: Column) -> Column:
    return F.md5(shape.cast("binary"))


def values(parts: DataFrame, levels: int = cmdline.LEVELS) -> DataFrame:
    """id, items, leaves and error of commands (id, text)."""
    rows = stored(rewritten(parts, "text", "shape").withColumn("of", shape_id(F.col("shape"))), "rewritten")
    found = shape_values(rows.groupBy(F.col("of").alias("id")).agg(F.first("shape").alias("shape")), levels)
    met = rows.select(F.col("id"), "text", "of").join(found.withColumnRenamed("id", "of"), "of")
    own = F.array_contains("deep", F.col("text"))
    alone = lone_values(met.where(own).select("id", "text"), levels)
    return met.where(~own).select("id", "items", "leaves", "error").unionByName(alone)
