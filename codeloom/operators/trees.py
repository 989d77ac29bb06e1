"""Syntax trees as node tables.

:func:`flatten` is the one place that walks JSON: one row per program in, one row per node out.
Everything else is relational over the node table.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions.javatypes import api_name
from codeloom.operators.ranking import running_sum
from codeloom.operators.scope import SHORT, by_length
from codeloom.session import persist_table

# Child lists of each tag, in evaluation order.
SLOTS = {
    "DSubTree": ("_nodes",),
    "DBranch": ("_cond", "_then", "_else"),
    "DLoop": ("_cond", "_body"),
    "DExcept": ("_try", "_catch"),
    "DInfix": ("_left", "_right"),
    "DReturnStmt": ("_stmt",),
    "DVarDeclExpr": ("_stmt",),
    "DAPICall": ("expr_var_id", "fp_var_ids"),
    "DClsInit": ("fp_var_ids",),
    "DInternalAPICall": ("fp_var_ids",),
}
CONTROL = ("DBranch", "DLoop", "DExcept")
SLOT_LABELS = {
    "DBranch": (("_cond", "DCond"), ("_then", "DThen"), ("_else", "DElse")),
    "DLoop": (("_cond", "DCond"), ("_body", "DBody")),
    "DExcept": (("_try", "DTry"), ("_catch", "DCatch")),
}
NODE_SCHEMA = (
    "pid bigint, node_id int, parent_id int, prev_id int, slot string, slot_pos int, depth int, scope string, tag string, "
    "calls array<struct<call:string,args:array<string>,returns:string>>, var_id string, expr_id string, ret_id string, "
    "returns string, op string, iattrib array<int>, attrs string, seq_in int, seq_out int, "
    "list_parent int, list_slot string, parent_tag string, slot_ends array<int>, list_end int"
)
_FIELDS = re.split(r", (?=[a-z_]+ (?:bigint|int|string|array))", NODE_SCHEMA)
CALL_STRUCT = pa.struct([("call", pa.string()), ("args", pa.list_(pa.string())), ("returns", pa.string())])
_ARROW = pa.schema([
    ("pid", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("prev_id", pa.int32()),
    ("slot", pa.string()), ("slot_pos", pa.int32()), ("depth", pa.int32()), ("scope", pa.string()), ("tag", pa.string()),
    ("calls", pa.list_(CALL_STRUCT)), ("var_id", pa.string()), ("expr_id", pa.string()), ("ret_id", pa.string()),
    ("returns", pa.string()), ("op", pa.string()), ("iattrib", pa.list_(pa.int32())), ("attrs", pa.string()),
    ("seq_in", pa.int32()), ("seq_out", pa.int32()), ("list_parent", pa.int32()), ("list_slot", pa.string()),
    ("parent_tag", pa.string()), ("slot_ends", pa.list_(pa.int32())), ("list_end", pa.int32()),
])
FOREVER = 1 << 26  # later than any step of a walk
LISTS = ("DSubTree", "DBranch", "DLoop", "DExcept", "DInfix")  # tags that own statement lists
INHERITED = -1  # an iterator flag that is as it was where the part begins
_ITERATOR = re.compile(r"java\.util\.Iterator<.*>\.(hasNext|next|remove)\(\)")
BATCH_ROWS = 20_000
DEEPEST = 20_000  # calls that a walk may be inside of; Spark's JSON parser ends at 1000 levels, some four calls each
EVENT_BIN = 8192  # steps of a walk whose control nodes are added up together


def _flags_after(flags: tuple, calls: list) -> tuple:
    for name, _, _ in calls:
        hit = _ITERATOR.match(name) if name and name.startswith("java.util.Iterator<") else None
        if hit:
            flags = {"hasNext": (1, 0, 0), "next": (flags[0], 1, flags[2]), "remove": (flags[0], flags[1], 1)}[hit.group(1)]
    return flags


def _visit(nodes, parent, parent_tag, slot, depth, scope, flags, home, home_slot, pid, out, at) -> tuple:
    """The rows of one list of nodes; ``at`` holds the last step. A function of its own, as a closure that calls itself would be a cycle for each tree."""
    prev, mine = -1, []
    for pos, node in enumerate(nodes):
        if not isinstance(node, dict):
            continue
        at[0] = step = at[0] + 1
        get, tag, me = node.get, node["node"], len(out)
        stored = get("_calls") or ([node] if "_call" in node else None)
        calls = [
            (c["_call"], ["LITERAL" if a is None else a for a in c.get("fp") or c.get("fp_var_ids") or () if not isinstance(a, dict)], c.get("_returns"))
            for c in stored
        ] if stored else ()
        expr, op = get("expr_var_id"), get("_op")
        ends: list = []
        row = [
            pid, me, parent, prev, slot, pos, depth, scope, tag, calls, get("_id", get("_var")),
            expr if isinstance(expr, str) else None, get("ret_var_id"), get("_returns"),
            op[0] if isinstance(op, list) else op, flags, get("int_meth_id", get("int_meth_name")),
            step, None, home, home_slot, parent_tag, ends, None,
        ]
        out.append(row)
        mine.append(row)
        prev = me
        names = SLOTS.get(tag)
        if names is not None:
            before = after = flags
            inside, own = tag in CONTROL, tag in LISTS
            for name in names:
                value = get(name)
                reached = after
                if value and (isinstance(value, list) or isinstance(value, dict)):
                    inner = f"{scope}/{me}.{name[1:]}" if inside else scope
                    reached = _visit(
                        value if isinstance(value, list) else (value,), me, tag, name, depth + 1, inner, after,
                        me if own else home, name if own else home_slot, pid, out, at)
                ends.append(at[0])
                if tag == "DBranch":  # both sides go on from the condition
                    if name == "_cond":
                        after = reached
                    elif name == "_then":
                        then = reached
                    else:
                        after = then if get("_then") else reached
                elif tag == "DExcept":  # the catch goes on from where the try block began
                    if name == "_try":
                        tried = reached
                    else:
                        after = tried if get("_try") else reached
                else:
                    after = reached
            if tag in ("DBranch", "DExcept"):
                flags = after
            else:
                flags = before if tag == "DLoop" else _flags_after(after, calls)
        elif calls:
            flags = _flags_after(flags, calls)
        at[0] += 1
        row[18] = at[0]
    end = at[0] if parent >= 0 else FOREVER
    for row in mine:
        row[23] = end
    return flags


PLAIN = ("pid", "node_id", "tag", "calls", "var_id", "expr_id", "ret_id", "returns", "op", "attrs")


def _visit_plain(nodes, pid, out) -> None:
    """The rows of one list of nodes with only the columns of :data:`PLAIN`: what a node says itself, not where it stands."""
    for node in nodes:
        if not isinstance(node, dict):
            continue
        get, tag = node.get, node["node"]
        stored = get("_calls") or ((node,) if "_call" in node else ())
        calls = [
            (c["_call"], ["LITERAL" if a is None else a for a in c.get("fp") or c.get("fp_var_ids") or () if not isinstance(a, dict)], c.get("_returns"))
            for c in stored
        ]
        expr, op = get("expr_var_id"), get("_op")
        out.append((
            pid, len(out), tag, calls, get("_id", get("_var")), expr if isinstance(expr, str) else None, get("ret_var_id"), get("_returns"),
            op[0] if isinstance(op, list) else op, get("int_meth_id", get("int_meth_name"))))
        for name in SLOTS.get(tag, ()):
            value = get(name)
            if value and isinstance(value, list):
                _visit_plain(value, pid, out)
            elif value and isinstance(value, dict):
                _visit_plain((value,), pid, out)


def _walk(pid: int, ast: dict, out: list, entry: tuple = (0, 0, 0)) -> tuple:
    """Preorder rows; iterator flags flow left to right and through branches as evaluated.

    ``seq_in`` and ``seq_out`` number entering and leaving a node, ``slot_ends`` the last step in each
    of its lists, ``list_end`` the last step in the list it stands in. ``list_parent`` and
    ``list_slot`` name the statement list a node belongs to, arguments to that of their statement.
    Gives the flags at the end.
    """
    root = ast["_nodes"] if isinstance(ast, dict) else ast
    return _visit(root, -1, None, "_nodes", 0, "", entry, -1, "_nodes", pid, out, [-1])


def calls_array(values: Sequence[Sequence[tuple]]) -> pa.Array:
    """Calls of nodes as one array, made from flat columns: far cheaper than from nested values."""
    flat = [c for calls in values for c in calls]
    args = [c[1] for c in flat]
    listed = pa.ListArray.from_arrays(
        pa.array([None if a is None else at for a, at in zip(args, accumulate((len(a or ()) for a in args), initial=0))] + [sum(len(a or ()) for a in args)], pa.int32()),
        pa.array([a for some in args for a in some or ()], pa.string()))
    structs = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.string()), listed, pa.array([c[2] for c in flat], pa.string())], fields=list(CALL_STRUCT))
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), structs)


def int_lists(values: Sequence[Sequence[int]]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), pa.array([n for some in values for n in some], pa.int32()))


def array_of(values: Sequence, field: pa.Field) -> pa.Array:
    """Values of a column of node rows, as an array."""
    made = calls_array if field.name == "calls" else int_lists if field.type == pa.list_(pa.int32()) else None
    return made(values) if made else pa.array(values, field.type)


def values_of(column: pa.Array) -> list:
    """The values of an array; numbers, texts that repeat and lists of numbers are read as a whole, not one by one."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        texts = [*coded.dictionary.to_pylist(), None]
        return [texts[i] for i in coded.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False).tolist()]
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count and not column.values.null_count:
        flat, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy(zero_copy_only=False).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]
    if pa.types.is_list(column.type) and pa.types.is_string(column.type.value_type) and not column.null_count:
        texts, ends = values_of(column.values), column.offsets.to_numpy(zero_copy_only=False).tolist()
        return [texts[a:b] for a, b in zip(ends, ends[1:])]
    if column.type == pa.list_(CALL_STRUCT) and not column.null_count:
        return _calls_of(column)
    return column.to_pylist()


def _record_batch(rows: list) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _tree_rows(pid: int, text: str) -> list | None:
    """Node rows of one text, None if it is JSON of another shape: no list of statements, a node without its tag, a call without its name."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    rows: list = []
    try:
        ast = json.loads(text)
        if not isinstance(ast.get("_nodes") if isinstance(ast, dict) else ast, list):
            return None
        _walk(pid, ast, rows)
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None
    return rows


def _converted(trees: list[list], made=_record_batch) -> Iterator[pa.RecordBatch]:
    """The rows of several trees; a tree with a value of a wrong type, such as a number for a name, is left out."""
    try:
        yield made([row for tree in trees for row in tree])
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        if len(trees) > 1:
            for tree in trees:
                yield from _converted([tree], made)


def _flatten_batches(made=_record_batch):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gc.disable()  # neither trees nor rows have cycles
                try:
                    rows = _tree_rows(pid, text)
                finally:
                    gc.enable()
                if rows:
                    out.append(rows)
                    size += len(rows)
                if size >= BATCH_ROWS:
                    yield from _converted(out, made)
                    out, size = [], 0
        if out:
            yield from _converted(out, made)

    return walk


def _only_columns(names: Sequence[str]):
    places, schema = [_ARROW.get_field_index(n) for n in names], pa.schema([_ARROW.field(n) for n in names])
    return lambda rows: pa.RecordBatch.from_arrays([array_of(list(map(itemgetter(i), rows)), f) for i, f in zip(places, schema)], schema=schema)


def _misshapen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = []
        for pid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = _tree_rows(pid, text)
            flags.append(rows is None or (bool(rows) and not any(True for _ in _converted([rows]))))
        yield batch.select([0]).filter(pa.array(flags, pa.bool_()))


def well_formed(programs: DataFrame, ast: str = "ast") -> DataFrame:
    return programs.where(F.try_parse_json(ast).isNotNull())


def malformed(programs: DataFrame, ast: str = "ast") -> DataFrame:
    """The rest: records to count and keep aside."""
    return programs.where(F.col(ast).isNotNull() & F.try_parse_json(ast).isNull())


def rejected(programs: DataFrame, ast: str = "ast") -> DataFrame:
    """``pid, reason`` of the programs that :func:`flatten` leaves out: ``no text``, ``not JSON`` or ``not a tree``."""
    unread = programs.where(F.col(ast).isNull()).select(F.col("pid").cast("bigint"), F.lit("no text").alias("reason"))
    broken = malformed(programs, ast).select(F.col("pid").cast("bigint"), F.lit("not JSON").alias("reason"))
    other = well_formed(programs, ast).select(F.col("pid").cast("bigint"), ast).mapInArrow(_misshapen_batches, "pid bigint")
    return unread.unionByName(broken).unionByName(other.withColumn("reason", F.lit("not a tree")))


def flatten(programs: DataFrame, ast: str = "ast", only: Sequence[str] | None = None) -> DataFrame:
    """``pid, ast`` (JSON) to the node table. What is no tree is left out; :func:`rejected` lists it.

    ``only``: the columns to give, if not all; types are looked at in these.
    """
    texts = well_formed(programs, ast).select(F.col("pid").cast("bigint"), ast)
    if only is None:
        return texts.mapInArrow(_flatten_batches(), NODE_SCHEMA)
    return texts.mapInArrow(_flatten_batches(_only_columns(only)), _schema_of(only))


def _schema_of(names: Sequence[str]) -> str:
    types = {field.split(" ", 1)[0]: field for field in _FIELDS}
    return ", ".join(types[n] for n in names)


def in_order(nodes: DataFrame, *columns: str) -> DataFrame:
    """The columns of the nodes, and ``_first`` that marks where a program begins: programs stand together, their nodes in order.

    For steps that read through programs one by one in Python; nodes that are dealt by program are not shuffled.
    """
    first = F.row_number().over(W.partitionBy("pid").orderBy("node_id")) == 1
    return nodes.select(*columns, first.alias("_first"))


def programs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each program, from those of :func:`in_order`."""
    program: list[tuple] = []
    for batch in batches:
        *columns, firsts = [values_of(batch.column(k)) for k in range(batch.num_columns)]
        for row, first in zip(zip(*columns), firsts):
            if first and program:
                yield program
                program = []
            program.append(row)
    if program:
        yield program


_PART_ARROW = pa.schema([*_ARROW, ("part", pa.int64()), ("part_nodes", pa.int32()), ("part_steps", pa.int32()), ("part_roots", pa.int32()), ("last_root", pa.int32()), ("flags_after", pa.list_(pa.int32()))])
PART_SCHEMA = NODE_SCHEMA + ", part bigint, part_nodes int, part_steps int, part_roots int, last_root int, flags_after array<int>"


def _flatten_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each part by itself; its first row also has the part's sizes and its map of the iterator flags."""
    out: list = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out), _PART_ARROW)], schema=_PART_ARROW)

    for batch in batches:
        for pid, part, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows: list = []
            after = _walk(pid, json.loads(text), rows, (INHERITED,) * 3)
            roots = [r[1] for r in rows if r[2] < 0]
            sizes = [len(rows), rows[-1][18] + 1 if not roots else rows[roots[-1]][18] + 1, len(roots), roots[-1], after] if rows else []
            out.extend([*r, part, *(sizes if k == 0 else [None] * 5)] for k, r in enumerate(rows))
            if len(out) >= BATCH_ROWS:
                yield made()
                out = []
    if out:
        yield made()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``pid`` and text of programs that come as one part each."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())


def _programs_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``pid`` and text of programs whose statements come one by one, in order; those of the same place in order of their texts."""
    def text() -> str:
        if len(set(places)) < len(places):
            at = {place: i for i, place in reversed(list(enumerate(places)))}
            texts.sort(key=lambda t: (at[t[0]], t[1]))
        return f"[{','.join([t for _, t in texts])}]"

    texts, places, now, begun = [], [], None, False
    for batch in batches:
        for pid, place, node in zip(values_of(batch.column(0)), values_of(batch.column(1)), batch.column(2).to_pylist()):
            if begun and pid != now:
                yield now, text()
                texts, places = [], []
            now, begun = pid, True
            if node is not None:
                texts.append((place, node))
                places.append(place)
    if begun:
        yield now, text()


def _flatten_columns(names: Sequence[str], read=_parts):
    """A walk over programs of one part that gives only the columns of these names; ``read`` gives their ids and texts."""
    plain = set(names) <= set(PLAIN)
    places = [PLAIN.index(n) if plain else _ARROW.get_field_index(n) for n in names]
    schema = pa.schema([_ARROW.field(n) for n in names])
    made = lambda rows: pa.RecordBatch.from_arrays([array_of(list(map(itemgetter(i), rows)), f) for i, f in zip(places, schema)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for pid, text in read(batches):
            gc.disable()  # neither trees nor rows have cycles, and a search for some goes through all of them again and again
            try:
                rows: list = []
                ast = json.loads(text)
                if plain:
                    _visit_plain(ast["_nodes"] if isinstance(ast, dict) else ast, pid, rows)
                else:
                    _walk(pid, ast, rows, (INHERITED,) * 3)
                out.extend(rows)
                full = made(out) if len(out) >= BATCH_ROWS else None
            finally:
                gc.enable()
            if full:
                out = []
                yield full
        if out:
            yield made(out)

    return walk


def _of_one_part(rows: DataFrame, only: Sequence[str] | None, read) -> DataFrame:
    wanted = list(only or _ARROW.names)
    walked = rows.mapInArrow(_flatten_columns(wanted, read), _schema_of(wanted))
    cleared = F.transform("iattrib", lambda flag: F.greatest(flag, F.lit(0)))
    return walked.withColumn("iattrib", cleared) if "iattrib" in wanted else walked


def flatten_lines(lines: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """``pid, place, node`` (JSON, one or more statements) to the node table: a program is its lines, which stand together and in order."""
    return _of_one_part(lines.select(F.col("pid").cast("bigint"), "place", "node"), only, _programs_of_lines)


def flatten_parts(parts: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """``pid, part, ast`` (JSON lists of statements; a program is its parts in order) to the node table.

    Each part is walked by itself, so a long program spreads over tasks. What a part must know of those before
    it is a prefix sum of their nodes, steps and statements, and what they leave of the iterator flags: a part maps
    each flag to 0, to 1 or to what it was, and such maps compose, so the flags that a part begins with are
    the last that any part before it has set. Programs of one part need none of this. ``only``: the columns to
    give, if not all; those that nobody reads are then not made.
    """
    large = parts.where("part <> 0").limit(1)
    walked = parts.select(F.col("pid").cast("bigint"), F.col("part").cast("bigint"), "ast").mapInArrow(_flatten_parts, PART_SCHEMA)
    columns = [f.name for f in walked.schema.fields][:24]
    if not large.count():
        return _of_one_part(parts.select(F.col("pid").cast("bigint"), F.col("part").cast("bigint"), "ast"), only, _parts)
    walked = persist_table(walked, "parts")
    firsts = walked.where("part_nodes is not null").select("pid", "part", "part_nodes", "part_steps", "part_roots", "last_root", "flags_after")
    before = W.partitionBy("pid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    set_ = lambda i: F.coalesce(F.last(F.when(F.get("flags_after", F.lit(i)) >= 0, F.get("flags_after", F.lit(i))), ignorenulls=True).over(before), F.lit(0))
    offsets = firsts.select(
        F.col("pid").alias("_pid"), F.col("part").alias("_part"), total("part_nodes").alias("_n"), total("part_steps").alias("_s"), total("part_roots").alias("_r"),
        F.last(F.col("last_root")).over(before).alias("_last"), F.last(F.col("part_nodes")).over(before).alias("_size"), F.array(*[set_(i) for i in range(3)]).alias("_flags"),
    ).where("_n > 0")
    rows = walked.join(offsets, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("part") == F.col("_part")), "left")
    n, s, r = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_s", "_r"))
    own = lambda c: F.when(F.col(c) >= 0, F.col(c) + n).otherwise(F.col(c))
    root = F.col("parent_id") < 0
    first = root & (F.col("prev_id") < 0) & F.col("_last").isNotNull()
    scope = F.array_join(F.transform(F.split("scope", "/"), lambda x: F.when(x == "", x).otherwise(F.concat_ws(".", (F.substring_index(x, ".", 1).cast("int") + n).cast("string"), F.substring_index(x, ".", -1)))), "/")
    flags = F.transform("iattrib", lambda flag, i: F.when(flag >= 0, flag).otherwise(F.coalesce(F.get("_flags", i), F.lit(0))))
    moved = {
        "node_id": F.col("node_id") + n, "parent_id": own("parent_id"), "prev_id": F.when(first, F.col("_last") + n - F.col("_size")).otherwise(own("prev_id")),
        "slot_pos": F.when(root, F.col("slot_pos") + r).otherwise(F.col("slot_pos")), "scope": F.when(n > 0, scope).otherwise(F.col("scope")), "iattrib": flags,
        "seq_in": F.col("seq_in") + s, "seq_out": F.col("seq_out") + s, "list_parent": own("list_parent"), "slot_ends": F.transform("slot_ends", lambda e: e + s),
        "list_end": F.when(F.col("list_end") == FOREVER, F.col("list_end")).otherwise(F.col("list_end") + s),
    }
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in only or columns])


def entered_controls(scope: Column) -> Column:
    """``(control node id, slot)`` of every enclosing control node."""
    parts = F.filter(F.split(scope, "/"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, ".", 1).cast("int").alias("control"), F.concat(F.lit("_"), F.substring_index(p, ".", -1)).alias("in_slot")
        ),
    )


def gather_calls(nodes: DataFrame) -> DataFrame:
    """All calls in evaluation order."""
    return nodes.where(F.col("tag") == "DAPIInvoke").select(
        "pid", "node_id", "scope", F.posexplode("calls").alias("call_pos", "c")
    ).select("pid", "node_id", "scope", "call_pos", "c.call", "c.args", "c.returns")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``pid, node_id, anc``: every node with itself and the control nodes round it."""
    chain = F.concat(F.transform(entered_controls(F.col("scope")), lambda c: c["control"]), F.array("node_id"))
    return nodes.select("pid", "node_id", F.explode(chain).alias("anc"))


def drop_empty_controls(nodes: DataFrame) -> DataFrame:
    """Branches, loops and try blocks that hold nothing but such nodes go; all else keeps its row and its numbers.

    A control node stays if a node of another tag names it among those round it: distinct (program, control node)
    pairs, as many as control nodes, however many statements there are.
    """
    control = F.col("tag").isin(*CONTROL)
    round_it = F.explode(F.transform(entered_controls(F.col("scope")), lambda c: c["control"])).alias("_id")
    filled = nodes.where(~control).select(F.col("pid").alias("_pid"), "scope").distinct().select("_pid", round_it).distinct()
    kept = nodes.where(control).join(filled, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("node_id") == F.col("_id")), "left_semi")
    return nodes.where(~control).unionByName(kept)


def nesting(nodes: DataFrame, tags: tuple[str, ...] = CONTROL) -> DataFrame:
    """``path_<tag>`` and ``nested_<tag>`` per program.

    ``path``: nesting as the corpus rules count it, where siblings in a row add up like nested
    nodes: a control node counts from where it stands to the end of its list. ``nested``: plain
    nesting, where it counts while it is open. Both are the most that count at any one time: the
    peak of a running sum over where they begin and end. Short programs are summed up as they stand, others in bins,
    so no long program is in one task. ``nodes`` should be stored.
    """
    span = lambda kind, until: [
        F.struct(F.concat(F.lit(f"{kind}_"), "tag").alias("kind"), at.alias("at"), F.lit(n).alias("n")) for at, n in ((F.col("seq_in"), 1), (F.col(until) + 1, -1))]
    ends = F.explode(F.array(*span("path", "list_end"), *span("nested", "seq_out"))).alias("e")
    kinds = [f"{kind}_{t}" for kind in ("path", "nested") for t in tags]
    peaks_of = lambda open_now: open_now.groupBy("pid").agg(*[F.max(F.when(F.col("kind") == k, F.col("open_now"))).alias(k) for k in kinds])
    events_of = lambda some: some.where(F.col("tag").isin(*tags)).select("pid", ends).select("pid", "e.*").where(F.col("at") <= FOREVER)
    out = lambda pid: [pid.alias("pid"), *[F.coalesce(k, F.lit(0)).cast("int").alias(k) for k in kinds]]

    def together(some: DataFrame) -> DataFrame:
        so_far = W.partitionBy("pid", "kind").orderBy("at", "n").rowsBetween(W.unboundedPreceding, 0)
        peaks = peaks_of(events_of(some).withColumn("open_now", F.sum("n").over(so_far)))
        return some.select("pid").distinct().join(peaks, "pid", "left").select(*out(F.col("pid")))

    def in_bins(some: DataFrame) -> DataFrame:
        some = persist_table(some.select("pid", "tag", "seq_in", "seq_out", "list_end"), "steps")  # read three times
        peaks = peaks_of(running_sum(events_of(some), F.col("n"), [F.col("at"), F.col("n")], F.floor(F.col("at") / EVENT_BIN), ["pid", "kind"], out="open_now"))
        programs = some.select("pid").distinct().select(F.col("pid").alias("_pid"))
        return programs.join(peaks, F.col("_pid").eqNullSafe(F.col("pid")), "left").select(*out(F.col("_pid")))

    return by_length(nodes, together, in_bins, F.col("seq_out") >= 2 * SHORT)


def structure_counts(nodes: DataFrame) -> DataFrame:
    """Statements, loops, branches and try blocks per program.

    Loops and branches inside a condition do not count. Statements in a condition or a try
    block count one each, whatever they hold; a loop, branch or try block counts by its content.
    """
    parts = F.split(F.col("scope"), "/")
    own = F.element_at(parts, -1)
    outer = F.slice(parts, 1, F.size(parts) - 1)
    flat = lambda p: p.endswith(".cond") | p.endswith(".try")
    in_cond = F.exists(parts, lambda p: p.endswith(".cond"))
    hidden = F.exists(outer, flat)
    is_control = F.col("tag").isin(*CONTROL)
    statement = ~hidden & (flat(own) | ~(is_control | F.col("tag").isin("DInfix", "DSubTree")))
    of_tag = lambda tag: F.count_if((F.col("tag") == tag) & ~in_cond)
    return nodes.groupBy("pid").agg(
        F.count_if(statement).alias("statements"), of_tag("DLoop").alias("loops"),
        of_tag("DBranch").alias("branches"), of_tag("DExcept").alias("excepts"),
    )


def extra_infos(nodes: DataFrame) -> DataFrame:
    """One keyword per control or infix node, duplicates kept."""
    tag = F.col("tag")
    word = F.when(tag == "DBranch", "conditional").when(tag == "DLoop", "loop").when(tag == "DExcept", "exception").when(tag == "DInfix", "infix")
    return nodes.select("pid", "node_id", word.alias("keyword")).where("keyword is not null")


def node_labels(nodes: DataFrame) -> DataFrame:
    """``label``: API names joined for calls, the tag for control nodes, else null."""
    names = F.array_join(F.transform("calls", lambda c: F.coalesce(api_name(c["call"]), F.lit(""))), ">")
    label = F.when(F.col("tag") == "DAPIInvoke", names).when(F.col("tag").isin(*CONTROL), F.col("tag"))
    return nodes.withColumn("label", label)


def child_lists(nodes: DataFrame) -> DataFrame:
    """Every child list, empty ones too: ``pid, owner, in_slot, slot_no, scope`` (owner -1: the body)."""
    slots = F.array(*[
        F.struct(F.lit(tag).alias("t"), F.lit(slot).alias("in_slot"), F.lit(i).alias("slot_no"), F.lit(label).alias("slot_label"))
        for tag, pairs in SLOT_LABELS.items() for i, (slot, label) in enumerate(pairs)
    ])
    inner = nodes.where(F.col("tag").isin(*CONTROL)).select(
        "pid", F.col("node_id").alias("owner"), "scope", "tag", F.explode(slots).alias("s")
    ).where(F.col("s.t") == F.col("tag"))
    inner = inner.select(
        "pid", "owner", F.col("s.in_slot").alias("in_slot"), F.col("s.slot_no").alias("slot_no"),
        F.concat("scope", F.lit("/"), F.col("owner").cast("string"), F.lit("."), F.expr("substring(s.in_slot, 2)")).alias("scope"),
    )
    body = nodes.select("pid").distinct().select(
        "pid", F.lit(-1).alias("owner"), F.lit("_nodes").alias("in_slot"), F.lit(0).alias("slot_no"), F.lit("").alias("scope")
    )
    return body.unionByName(inner)


def root_leaf_paths(nodes: DataFrame, calls_only: bool = False) -> DataFrame:
    """``pid, path``: distinct labels from the root to the end of every child list.

    In child/sibling form a path runs through the earlier siblings of each enclosing node and
    through the slots before the one entered. So a node is on the paths that end between its own
    step and the end of its list, a slot label on those until its control node is left; the path
    to a list end is what holds at that moment. Times are steps times 20, leaving room for slots.
    """
    labelled = node_labels(nodes)
    tag, is_control = F.col("tag"), F.col("tag").isin(*CONTROL)
    slot_no = F.when(F.col("slot").isin("_then", "_body", "_catch", "_right"), 1).when(F.col("slot") == "_else", 2).otherwise(0)
    after = lambda end, k: end * 20 + 2 * (k + 1)

    def held(since, until, label) -> Column:
        return F.struct(since.alias("since"), until.alias("until"), label.alias("label"))

    own = F.array(F.when(F.col("label").isNotNull() & ~(is_control & F.lit(calls_only)), held(
        F.col("seq_in") * 20, F.when(F.col("parent_id") < 0, F.lit(FOREVER * 20)).otherwise(after(F.col("list_end"), slot_no) + 1), F.col("label"))))
    names = F.lit(None).cast("array<string>")
    for control, pairs in SLOT_LABELS.items():
        names = F.when(tag == control, F.array(*[F.lit(label) for _, label in pairs])).otherwise(names)
    starts = F.concat(F.array("seq_in"), F.col("slot_ends"))
    slots = F.transform(names, lambda name, k: held(after(F.get(starts, k), k), F.col("seq_out") * 20, name))
    holds = own if calls_only else F.concat(own, F.coalesce(slots, F.slice(own, 1, 0)))
    ends = F.when(is_control, F.transform("slot_ends", lambda end, k: after(end, k) + 1)).otherwise(F.array().cast("array<int>"))
    programs = labelled.select("pid", F.array_compact(holds).alias("holds"), ends.alias("ends")).groupBy("pid").agg(
        F.array_sort(F.flatten(F.collect_list("holds"))).alias("holds"), F.concat(F.flatten(F.collect_list("ends")), F.array(F.lit(FOREVER * 20))).alias("ends")
    )

    def path_at(t: Column) -> Column:
        on_path = F.filter("holds", lambda h: (h["since"] <= t) & (t <= h["until"]))
        return F.array_join(F.transform(on_path, lambda h: h["label"]), ">")

    paths = F.array_distinct(F.transform("ends", path_at))
    return programs.select("pid", F.explode(paths).alias("path")).where("path <> ''")


def productions(nodes: DataFrame) -> DataFrame:
    """``lhs --edge--> rhs``: a node with its previous sibling, or with the owner of its list if first."""
    labelled = node_labels(nodes).select("pid", "node_id", "parent_id", "prev_id", "slot", F.coalesce("label", "tag").alias("rhs"))
    labelled = persist_table(labelled, "labelled")  # met with itself
    from_id = F.when(F.col("prev_id") >= 0, F.col("prev_id")).otherwise(F.col("parent_id"))
    left = labelled.select("pid", F.col("node_id").alias("from_id"), F.col("rhs").alias("lhs"))
    edges = labelled.select("pid", "node_id", "slot", "rhs", from_id.alias("from_id"), (F.col("prev_id") < 0).alias("child"))
    joined = edges.join(left, ["pid", "from_id"], "left")
    slot_name = F.concat(F.lit("D"), F.initcap(F.expr("substring(slot, 2)")))
    lhs = F.when(F.col("from_id") < 0, "DSubTree").when(F.col("child"), F.concat_ws(">", "lhs", slot_name)).otherwise(F.col("lhs"))
    return joined.select("pid", "node_id", lhs.alias("lhs"), F.when(F.col("child"), "child").otherwise("sibling").alias("edge"), "rhs")


def signatures(nodes: DataFrame) -> DataFrame:
    """``pid, signature``: the shape of a program as text, for equality of structure."""
    label = F.concat_ws(":", "depth", F.expr("substring(slot, 2)"), "tag")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node_id", label.alias("t")))), lambda s: s["t"])
    return nodes.groupBy("pid").agg(F.md5(F.array_join(ordered, " ")).alias("signature"))


def subtree_hashes(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """``pid, node_id, hash, size``: a hash of each subtree, by its label and its children's slots, order and hashes.

    Made from the innermost level outwards: equal subtrees, in whatever program, have equal hashes. Short programs are read through
    one by one, longer ones take one aggregate and join per level of nesting. ``label`` defaults to the tag. ``nodes`` should be stored.
    """
    together = lambda some: in_order(some.withColumn("_label", F.col("tag") if label is None else label), *HASHED).mapInArrow(_hash_batches, "pid bigint, node_id int, hash string, size bigint")
    return by_length(nodes, together, lambda some: _hashes_by_level(some, label))


HASHED = ("pid", "node_id", "parent_id", "slot", "slot_pos", "_label")


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []
    schema = pa.schema([("pid", pa.int64()), ("node_id", pa.int32()), ("hash", pa.string()), ("size", pa.int64())])
    made = lambda: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
    for rows in programs_in(batches):
        below: dict = {}
        for pid, node_id, parent_id, slot, slot_pos, label in reversed(rows):  # a node comes before all that is in it
            inside, size = "", 1
            if node_id in below:
                children = sorted(below.pop(node_id))
                inside, size = ",".join([f"{s}:{p}:{h}" for s, p, h, _ in children]), 1 + sum([c[3] for c in children])
            hashed = md5((inside if label is None else f"{label}|{inside}").encode(), usedforsecurity=False).hexdigest()
            out.append((pid, node_id, hashed, size))
            if parent_id >= 0:
                below.setdefault(parent_id, []).append((slot, slot_pos, hashed, size))
        if len(out) >= BATCH_ROWS:
            yield made()
            out = []
    if out:
        yield made()


def _hashes_by_level(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    own = persist_table(nodes.select("pid", "node_id", "parent_id", "slot", "slot_pos", "depth", (F.col("tag") if label is None else label).alias("label")), "labels")
    levels = [r["depth"] for r in own.select("depth").distinct().collect()]  # one row per level of nesting
    done = None
    below = own.limit(0).select("pid", F.col("node_id").alias("_of"), F.lit("").alias("_inside"), F.lit(0).cast("long").alias("_sizes"))
    for depth in sorted(levels, reverse=True):
        here = own.where(F.col("depth") == depth)
        met = here.join(below.withColumnRenamed("pid", "_pid"), F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("node_id") == F.col("_of")), "left")
        hashed = persist_table(met.select(
            "pid", "node_id", "parent_id", "slot", "slot_pos", F.md5(F.concat_ws("|", "label", F.coalesce("_inside", F.lit("")))).alias("hash"), (F.coalesce("_sizes", F.lit(0)) + 1).alias("size")), "hashes")
        done = hashed if done is None else done.unionByName(hashed)
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "slot_pos", "hash"))), lambda c: F.concat_ws(":", c["slot"], c["slot_pos"].cast("string"), c["hash"])), ",")
        below = hashed.where("parent_id >= 0").groupBy("pid", F.col("parent_id").alias("_of")).agg(inside.alias("_inside"), F.sum("size").alias("_sizes"))
    if done is None:
        return own.select("pid", "node_id", F.lit("").alias("hash"), F.lit(0).cast("long").alias("size"))
    return done.select("pid", "node_id", "hash", "size")


def shared_subtrees(hashes: DataFrame) -> DataFrame:
    """Subtrees as one table: ``hash, size, times, programs``, of those that more than one program has."""
    per = hashes.groupBy("hash", "pid").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("hash").agg(F.max("size").alias("size"), F.sum("n").alias("times"), F.count(F.lit(1)).alias("programs")).where("programs > 1")


def remove_invalid(nodes: DataFrame, invalid: DataFrame) -> DataFrame:
    """Drop every node that is invalid or stands under an invalid one (``pid, node_id``)."""
    bad = invalid.select("pid", F.col("node_id").alias("anc")).distinct()
    hit = ancestors(nodes).join(bad, ["pid", "anc"], "left_semi").select("pid", "node_id").distinct()
    return nodes.join(hit, ["pid", "node_id"], "left_anti")


BUILT = ("pid", "node_id", "parent_id", "slot", "tag", "calls", "var_id", "expr_id", "ret_id", "returns")


def _calls_of(column: pa.Array) -> list:
    """The calls of nodes, each a list of its call, arguments and return type."""
    flat = column.values
    args, texts = flat.field("args"), values_of(flat.field("args").values)
    ends = args.offsets.to_pylist()
    listed = [texts[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], args.is_valid().to_pylist())]
    each = list(zip(values_of(flat.field("call")), listed, values_of(flat.field("returns"))))
    ends = column.offsets.to_pylist()
    return [each[a:b] for a, b in zip(ends, ends[1:])]


def _build_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pids, texts, size = [], [], 0
    for rows in programs_in(batches):
        body: list = []
        made: dict = {}
        for _, node_id, parent_id, slot, tag, calls, var_id, expr_id, ret_id, returns in rows:
            node = {"node": tag, **{s: [] for s in SLOTS.get(tag, ()) if tag in SLOT_LABELS or tag == "DInfix"}}
            fields = {"_id": var_id, "expr_var_id": expr_id, "ret_var_id": ret_id, "_returns": returns}
            node.update({k: v for k, v in fields.items() if v is not None})
            if calls:
                node["_calls"] = [{"_call": call, "fp": args, "_returns": kind} for call, args, kind in calls]
            made[node_id] = node
            (body if parent_id < 0 else made[parent_id][slot]).append(node)
        pids.append(rows[0][0])
        texts.append(json.dumps({"node": "DSubTree", "_nodes": body}, separators=(",", ":")))
        size += len(rows)
        if size >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(texts, pa.string())], names=["pid", "ast"])
            pids, texts, size = [], [], 0
    if pids:
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(texts, pa.string())], names=["pid", "ast"])


def unflatten(nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """Node rows back to one JSON tree per program; with ``cap``, only programs of at most so many nodes."""
    if cap is not None:
        sizes = nodes.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap).select("pid")
        nodes = nodes.join(sizes, "pid", "left_semi")
    return in_order(nodes, *BUILT).mapInArrow(_build_batches, "pid bigint, ast string")


def topdown_paths(nodes: DataFrame) -> DataFrame:
    """``pid, path``: control tags from the outside to each call, and each control slot that is empty. ``nodes`` should be stored."""
    return by_length(nodes, _topdown_together, _topdown_by_joins)


def _topdown_together(nodes: DataFrame) -> DataFrame:
    """Of short programs: each node finds the tags of those round it among its program's control nodes."""
    tag = F.col("tag")
    rows = nodes.where(tag.isin(*CONTROL, "DAPIInvoke")).select("pid", "node_id", "scope", "tag", "calls", "seq_in", "slot_ends")
    own = F.when(tag.isin(*CONTROL), F.struct(F.col("node_id").alias("id"), "tag"))
    met = node_labels(rows.withColumn("_known", F.collect_list(own).over(W.partitionBy("pid"))))
    chain = F.transform(entered_controls(F.col("scope")), lambda c: F.get(F.filter("_known", lambda k: k["id"] == c["control"]), F.lit(0))["tag"])
    names = F.array_compact(F.concat(chain, F.array(F.when(tag == "DAPIInvoke", F.col("label")).otherwise(tag))))
    many = F.lit(None).cast("int")
    for control, pairs in SLOT_LABELS.items():
        many = F.when(tag == control, len(pairs)).otherwise(many)
    begins = F.concat(F.array("seq_in"), F.col("slot_ends"))
    empty = F.size(F.filter(F.sequence(F.lit(0), many - 1), lambda i: F.get("slot_ends", i) <= F.get(begins, i)))
    times = F.when(tag == "DAPIInvoke", 1).otherwise(empty)
    return met.select("pid", F.array_join(names, ">").alias("path"), F.explode(F.array_repeat(F.lit(0), times))).select("pid", "path")


def _topdown_by_joins(nodes: DataFrame) -> DataFrame:
    """Of programs of any size."""
    labelled = node_labels(nodes)
    tags = nodes.where(F.col("tag").isin(*CONTROL)).select("pid", F.col("node_id").alias("control"), F.col("tag").alias("control_tag"))

    def with_controls(rows: DataFrame, end: str) -> DataFrame:
        steps = rows.select("pid", "key", end, F.posexplode_outer(entered_controls(F.col("scope"))).alias("i", "e"))
        named = steps.select("pid", "key", end, "i", F.col("e.control").alias("control")).join(tags, ["pid", "control"], "left")
        ordered = F.array_sort(F.collect_list(F.when(F.col("control_tag").isNotNull(), F.struct("i", "control_tag"))))
        chain = F.transform(ordered, lambda s: s["control_tag"])
        return named.groupBy("pid", "key", end).agg(F.array_join(F.array_compact(F.concat(chain, F.array(end))), ">").alias("path"))

    calls = labelled.where(F.col("tag") == "DAPIInvoke").select("pid", F.col("node_id").cast("string").alias("key"), "scope", "label")
    filled = nodes.select("pid", F.col("parent_id").alias("owner"), F.col("slot").alias("in_slot")).distinct()
    empty = child_lists(nodes).where("owner >= 0").join(filled, ["pid", "owner", "in_slot"], "left_anti")
    bare = empty.select("pid", F.col("scope").alias("key"), "scope", F.lit(None).cast("string").alias("label"))
    return with_controls(calls.unionByName(bare), "label").select("pid", "path")


def edge_list(nodes: DataFrame) -> DataFrame:
    """Labelled edges for drawing: dots in a label become line breaks."""
    rows = productions(nodes)
    broken = lambda c: F.replace(c, F.lit("."), F.lit("\n"))
    return rows.select("pid", "node_id", broken(F.col("lhs")).alias("from_label"), broken(F.col("rhs")).alias("to_label"), F.col("edge").alias("label"))
