"""From raw command lines to the unique table: parse, filter, group."""

from __future__ import annotations

import ast
import json
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cmdline, program, rules
from ..functions.shipping import ship
from ..sources.shared import stored
from . import parsing
from .features import ascii_share

# Endings and tags that stand for files, and the least numbers of tokens of a command without and with a file.
PROGRAMS = (".exe", ".ps1", ".bat", ".cmd", ".js", ".py", ".vbs")
FILE_TAGS = ("<path>", "<users>", "<programfiles>", "<windows>", "<tmp>", "<c>", "<programdata>")
FEW, FEW_WITH_FILE = 4, 6

ARENA = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("idx", "parent", "pos", "depth", "subtree")] + [T.StructField("value", T.StringType())]))
PARSED = T.StructType([T.StructField("tree", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()), T.StructField("nodes", ARENA)])

# What a command is: null, one that gives its process name alone, or one to parse.
NULL, PROCESS_ALONE, WHOLE = range(3)

READ = T.StructType([PARSED["tree"], PARSED["tokens"], PARSED["nodes"]])


def arena(tree: cmdline.Tree | None) -> list[tuple]:
    """A tree as a flat list of nodes (idx, parent, pos, depth, subtree size, value) in pre-order. The first token is the root."""
    out: list[list] = []

    def add(value: str, children: tuple, parent: int, pos: int, depth: int) -> int:
        me = len(out)
        out.append([me, parent, pos, depth, 1, value])
        out[me][4] = 1 + sum(place(c, me, k, depth + 1) for k, c in enumerate(children))
        return out[me][4]

    def place(node: cmdline.Tree, parent: int, pos: int, depth: int) -> int:
        while not isinstance(node, str) and len(node) == 1:
            node = node[0]
        if isinstance(node, str):
            return add(node, (), parent, pos, depth)
        return add("<subcommand>", tuple(c for c in node if c != ()), parent, pos, depth) if node else 0

    if isinstance(tree, str):
        tree = (tree,)
    if not tree:
        add("<empty>", (), -1, 0, 0)
    elif isinstance(tree[0], str):
        add(tree[0], tree[1:], -1, 0, 0)
    else:
        add("<root_command>", tuple(tree), -1, 0, 0)
    return [tuple(x) for x in out]


def parse_row(command: str | None, process: str | None, rules_on: bool = True) -> tuple:
    """A failure is a row of its own with the error, not the end of the job."""
    if command is None:
        return None, None, None, None
    try:
        tree = cmdline.normalise(command, process, rules_on)
        return json.dumps(tree, ensure_ascii=False), [] if tree is None else cmdline.flat(tree), None, arena(tree)
    except Exception as e:  # noqa: BLE001
        return None, None, f"{type(e).__name__}: {e}", None


def _lists(rows: list[list | None], values: pa.Array) -> pa.ListArray:
    """Lists of some lengths (None: no list) over values that follow each other."""
    offsets, at = [], 0
    for row in rows:
        offsets.append(None if row is None else at)
        at += len(row or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def as_arrow(rows: list[tuple]) -> pa.StructArray:
    """Rows of parse_row as one column: nested parts are laid out flat, which costs a fraction of turning them into objects one by one."""
    trees, tokens, errors, nodes = zip(*rows) if rows else ((), (), (), ())
    flat = [n for x in nodes if x is not None for n in x]
    columns = list(zip(*flat)) if flat else [()] * len(ARENA.elementType.names)
    kinds = [pa.string() if f.dataType == T.StringType() else pa.int32() for f in ARENA.elementType]
    node_values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ARENA.elementType.names)
    words = pa.array([t for x in tokens if x is not None for t in x], pa.string())
    return pa.StructArray.from_arrays([pa.array(trees, pa.string()), _lists(tokens, words), pa.array(errors, pa.string()), _lists(nodes, node_values)], PARSED.names)


def finished_row(kind: int, process: str | None, items: str | None, error: str | None) -> tuple:
    """parse_row's result, out of a command's kind and what parsing by levels found (members of the tree as JSON, or an error)."""
    if kind == NULL:
        return None, None, None, None
    if error is not None:
        return None, None, error, None
    tree = process if kind == PROCESS_ALONE else cmdline.with_program(_tuples(json.loads(items)), process)
    return json.dumps(tree, ensure_ascii=False), [] if tree is None else cmdline.flat(tree), None, arena(tree)


@F.arrow_udf(PARSED)
def _finished(kinds: pa.Array, processes: pa.Array, items: pa.Array, errors: pa.Array) -> pa.Array:
    return as_arrow([finished_row(*row) for row in zip(*(x.to_pylist() for x in (kinds, processes, items, errors)))])


@F.arrow_udf(PARSED)
def _split_only(commands: pa.Array, processes: pa.Array) -> pa.Array:
    return as_arrow([parse_row(c, p, False) for c, p in zip(commands.to_pylist(), processes.to_pylist())])


def _text_id(*texts: Column) -> Column:
    """A digest of texts, any of which may be null. It names each once, and is never null itself, which a join would ask: what an expression is made of is worked out as often as it is named."""
    digest = lambda t: F.coalesce(F.unhex(F.md5(t)), F.lit(bytes(16)))
    each = [digest(t.cast("binary")) for t in texts]
    return each[0] if len(each) == 1 else digest(F.concat(*each))


def parsed_by_tree(df: DataFrame, command: str = "command_line", process: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df with __key, and a table of __key and __parsed, the parser's struct: commands of one shape and process share it.

    Distinct commands pass the rules once, dealt by their text to at least two tasks
    a core; what the rules leave of them, their shape, is parsed once (parsing).
    Rows find their command's key by its digest, without the text.
    """
    spark = df.sparkSession
    ship(spark)
    text, of = F.col("__raw"), F.col("__process")
    named = [F.col(command).alias("__raw"), (F.col(process) if process else F.lit(None).cast("string")).alias("__process")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    kind = F.when(text.isNull(), NULL).when((text == "") | program.few_ascii(text), PROCESS_ALONE).otherwise(WHOLE)
    once = df.select(*named).repartition(tasks, "__raw", "__process").distinct().withColumn("__kind", kind)
    once = parsing.rewritten(once.withColumn("__whole", F.when(F.col("__kind") == WHOLE, text)), "__whole", "__shape")
    once = once.select("__kind", "__process", "__shape", _text_id(text, of).alias("__id"), _text_id(text).alias("__text"), parsing.shape_id(F.col("__shape")).alias("__value"))
    key = _text_id(F.col("__kind").cast("string"), F.col("__value"), of)
    once = stored(once.withColumn("__key", key), "commands")
    found = parsing.shape_values(once.where("__shape is not null").select(F.col("__value").alias("id"), F.col("__shape").alias("shape")).distinct())
    # commands that stand inside their own deep parts have values of their own; their text is that of the part
    deep = found.select(F.col("id").alias("__value"), F.explode("deep").alias("__raw")).withColumn("__text", _text_id(F.col("__raw")))
    looping = stored(once.join(deep, ["__value", "__text"]).select("__id", "__raw", "__process", "__kind"), "looping")
    whole = lambda rows: rows.select(F.col("id").alias("__value"), F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]")).alias("__items"), F.col("error").alias("__error"))
    values = whole(found)
    keyed = once.select("__id", "__kind", "__process", "__value", "__key")
    if not looping.isEmpty():
        looping = looping.withColumn("__lone", F.hex("__id"))
        values = values.unionByName(whole(parsing.lone_values(looping.select(F.col("__lone").alias("id"), F.col("__raw").alias("text")))))
        keyed = keyed.join(looping.select("__id", "__lone"), "__id", "left").withColumn("__value", F.coalesce("__lone", "__value"))
        keyed = keyed.withColumn("__key", key)
    kinds = keyed.select("__key", "__kind", "__process", "__value").distinct()
    trees = stored(kinds.join(values, "__value", "left").select("__key", _finished("__kind", "__process", "__items", "__error").alias("__parsed")), "trees")
    digest = _text_id(F.col(command), F.col(process) if process else F.lit(None).cast("string"))
    return df.withColumn("__row", digest).join(keyed.select(F.col("__id").alias("__row"), "__key"), "__row").drop("__row"), trees


def parsed(df: DataFrame, command: str = "command_line", process: str | None = None, rules_on: bool = True) -> DataFrame:
    """df with tree (JSON), tokens, valid, error and nodes (parsed_by_tree). Without rules a distinct command is split where it is."""
    if rules_on:
        rows, trees = parsed_by_tree(df, command, process)
        return rows.join(trees, "__key").select(*df.columns, *parsed_columns(F.col("__parsed")))
    spark = df.sparkSession
    ship(spark)
    of = F.col(process) if process else F.lit(None).cast("string")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    once = df.select(command, *([process] if process else [])).distinct().withColumn("__digest", _text_id(F.col(command), of)).repartition(tasks, "__digest")
    once = once.select("__digest", _split_only(F.col(command), of).alias("__parsed"))
    rows = df.withColumn("__of", _text_id(F.col(command), of)).join(once, F.col("__of") == F.col("__digest"))
    return rows.select(*df.columns, *parsed_columns(F.col("__parsed")))


def parsed_columns(row: Column) -> list[Column]:
    """tree, tokens, valid, error and nodes out of the parser's struct; only a null command, which has neither tokens nor an error, has no say on valid."""
    usable = row["error"].isNull() & (F.size(row["tokens"]) > 0) & valid_tokens(row["tokens"])
    valid = F.when(row["tokens"].isNotNull() | row["error"].isNotNull(), F.coalesce(usable, F.lit(False)))
    return [row["tree"].alias("tree"), row["tokens"].alias("tokens"), valid.alias("valid"), row["error"].alias("error"), row["nodes"].alias("nodes")]


def one_rule(name: Column, text: Column) -> Column:
    """A text after one rule of the program alone, its gate looking at this text."""
    out = text
    for rule in rules.RULES:
        out = F.when(name == rule, program.one(rule, text, F.lower(text), F.contains(text, F.lit("/")))).otherwise(out)
    return out


def mostly_ascii(df: DataFrame, command: str = "command_line", least: float = 0.8) -> DataFrame:
    return df.where(ascii_share(F.col(command)) >= least)


def valid_tokens(tokens: Column) -> Column:
    """The validity filter as an expression, for tokens that are already an array."""
    one_dot = lambda t: F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) == 1
    name, extension = lambda t: F.substring_index(t, ".", 1), lambda t: F.substring_index(t, ".", -1)
    ends = lambda t: t.rlike("(" + "|".join(x.replace(".", "[.]") for x in PROGRAMS) + ")$")
    tags = lambda t: t.rlike("|".join(FILE_TAGS))
    file = lambda t: (one_dot(t) & ((F.length(extension(t)) + 1 < FEW_WITH_FILE) | name(t).rlike(r"[\\/]$"))) | ends(t) | tags(t)
    n, first = F.size(tokens), F.get(tokens, F.lit(0))
    long_enough = (n >= FEW_WITH_FILE) | ((n >= FEW) & ~F.exists(F.slice(tokens, 2, F.greatest(n, F.lit(1))), file))
    host = first.rlike(r"^\\*([0-9]|<int_ip>|<ext_ip>|<host>)")
    odd = first.isin("//", "x") | F.startswith(first, F.lit("//--"))
    assigns = (n >= 3) & (F.get(tokens, F.lit(1)) == "=") & first.rlike("^[%$]")
    return long_enough & ~host & ~odd & ~assigns


def unique_table(df: DataFrame, occurrences: str | None = "total_occurrences") -> DataFrame:
    """Valid trees once each, with the sum of occurrences where the column exists."""
    rows = df.where(F.col("valid") & F.col("tree").isNotNull())
    if occurrences and occurrences in df.columns:
        return rows.groupBy(F.col("tree").alias("cmd_json")).agg(F.sum(occurrences).alias(occurrences), F.first("tokens").alias("tokens"))
    return rows.groupBy(F.col("tree").alias("cmd_json")).agg(F.first("tokens").alias("tokens"))


def make_unique(raw: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Raw table (command_line, perhaps process_name and total_occurrences) to its unique table. Rows with a null go.

    seen is told, by the job that writes the result, of rows: how many there were,
    how many had a null, were not parsed, were parsed but are no valid command, and
    were kept. It is one pass, and no job more. Give it tables of a session of their
    own (newSession): what observes cannot be sent to tasks, and closures of some
    learners hold their session.
    """
    process = "process_name" if "process_name" in raw.columns else None
    whole = F.lit(True)
    for c in raw.columns:
        whole = whole & F.col(c).isNotNull()
    rows = parsed(raw.withColumn("__whole", whole), process=process)
    if seen is not None:
        failed = F.col("error").isNotNull()
        valid = F.col("valid") & F.col("tree").isNotNull()
        counts = {"rows": F.lit(True), "with_null": ~F.col("__whole"), "not_parsed": F.col("__whole") & failed, "not_valid": F.col("__whole") & ~failed & ~valid, "kept": F.col("__whole") & valid}
        rows = rows.observe(seen, *(F.count_if(c).alias(k) for k, c in counts.items()))
    return unique_table(rows.where("__whole")).withColumn("command_line", python_repr(F.col("cmd_json")))


def read_tree(text: str | None) -> cmdline.Tree | None:
    """A tree out of its text: nested tuples or lists of strings, as Python prints them or as JSON. Only literals are read; None for all else."""
    for read in (ast.literal_eval, json.loads):
        try:
            tree = read(text or "")
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
        if _is_tree(tree):
            return _tuples(tree)
    return None


def read_row(text: str | None) -> tuple:
    """A unique table's row as parse_row gives a raw one's: tree, tokens, error (none) and nodes."""
    tree = read_tree(text)
    return (None, None, None, None) if tree is None else (json.dumps(tree, ensure_ascii=False), cmdline.flat(tree), None, arena(tree))


def _is_tree(x) -> bool:
    return isinstance(x, str) or (isinstance(x, (list, tuple)) and all(map(_is_tree, x)))


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, (list, tuple)) else x


def read_back(unique: DataFrame, column: str = "command_line") -> DataFrame:
    """A unique table's rows with tree (JSON), tokens, nodes and text: the leaves joined by spaces, or where there is no tree the text without ( ) ' and ,."""
    ship(unique.sparkSession)

    @F.arrow_udf(PARSED)
    def read(texts: pa.Array) -> pa.Array:
        return as_arrow([read_row(t) for t in texts.to_pylist()])

    plain = F.translate(F.coalesce(F.col(column), F.lit("")), "()',", "    ")
    rows = unique.withColumn("__read", read(F.col(column)))
    return rows.select(*unique.columns, *(f"__read.{f.name}" for f in READ), F.coalesce(F.array_join("__read.tokens", " "), plain).alias("text"))


@F.pandas_udf(T.StringType())
def _repr(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: repr(_tuples(json.loads(t))))


def python_repr(tree: Column) -> Column:
    """The sink's text form of a tree: nested tuples as Python prints them."""
    return _repr(tree)
