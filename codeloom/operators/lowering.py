"""From extracted statements to normal form.

What a node turns into is a set of emitted rows keyed by when the node is entered or left, so order falls out of
numbering them: arguments that are calls come before their statement as declaration and call on a temporary,
declarations come before the call that needs them, chained calls fold into the call before. What a node needs of
others comes by joins: its operands by parent, the type its target has by an as-of scan along the scope, the row a link
hangs on by an as-of scan along its list. Numbers are positions in bins. No step brings a long program, or a list of
statements, together in one task; short programs are lowered one by one, in the same steps.
"""

from __future__ import annotations

import gc
import re
from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import plaintypes as plain
from codeloom.functions.javatypes import formal_types, is_primitive, simplify_api, simplify_type
from codeloom.operators.checks import constructors_for
from codeloom.operators.ranking import positions
from codeloom.operators import scope as sc
from codeloom.operators.scope import enclosing, latest_before
from codeloom.operators.trees import BATCH_ROWS, CALL_STRUCT, LISTS, array_of, values_of
from codeloom.session import persist_buckets, persist_table

ARGUMENT_SLOTS = ("expr_var_id", "fp_var_ids")
UNTYPED = (*LISTS, "DReturnStmt", "DVarDeclExpr", "DAssign", "DInternalAPICall")
CHAINED = "last_DAPICall"
RETURN_VAR = "my_return_var"
AT_END = 1 << 28  # later than any step of a walk


def _text(value=None) -> Column:
    return F.lit(value).cast("string")


def _emission(when: Column, at: Column, sub: int, tag, **fields: Column) -> tuple[Column, dict[str, Column]]:
    """The row a node emits if ``when`` holds."""
    values = {
        "at": at, "sub": F.lit(sub), "tag": F.lit(tag) if isinstance(tag, str) else tag, "raw_id": F.lit(None).cast("int"),
        "call": _text(), "args": F.lit(None).cast("array<string>"), "var_id": _text(), "expr_id": _text(), "ret_id": _text(),
        "returns": _text(), "method": _text(), "op": _text(), "home": F.col("list_parent"), "home_slot": F.col("list_slot"),
    }
    values.update(fields)
    return when, values


def _emit(nodes: DataFrame, emissions: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """All rows all nodes emit, in one pass: which emissions apply, then their fields."""
    codes = F.array(*[F.when(when, F.lit(i)) for i, (when, _) in enumerate(emissions)])
    chosen = nodes.withColumn("_code", F.explode(F.array_compact(codes)))
    columns = []
    for name in emissions[0][1]:
        chain = None
        for i, (_, values) in enumerate(emissions):
            hit = F.col("_code") == i
            chain = F.when(hit, values[name]) if chain is None else chain.when(hit, values[name])
        columns.append(chain.alias(name))
    return chosen.select("pid", "iattrib", *columns)


def with_simple_types(nodes: DataFrame) -> DataFrame:
    """Types and API texts simplified, each distinct text once; an absent type of a typed node becomes Object. ``nodes`` are written."""
    untyped = F.col("tag").isin(*UNTYPED) | F.col("slot").isin(*ARGUMENT_SLOTS) & (F.col("tag") == "DVarCall")
    call = F.get("calls", F.lit(0))["call"]
    types = nodes.select(F.col("returns").alias("_type")).distinct().withColumn("_simple", simplify_type(F.col("_type")))
    calls = nodes.select(call.alias("_call")).where("_call is not null").distinct().withColumn("_simple_call", simplify_api(F.col("_call")))
    types, calls = persist_table(types, "types"), persist_table(calls, "calls")
    joined = nodes.withColumn("_c", call).join(types, F.col("returns").eqNullSafe(F.col("_type")), "left").join(calls, F.col("_c") == F.col("_call"), "left")
    returns = F.when(untyped, F.col("returns")).when((F.col("tag") == "DReturnVar") & (F.col("returns") == "null"), _text()).otherwise(F.col("_simple"))
    return joined.select(*[c for c in nodes.columns if c not in ("calls", "returns")], returns.alias("returns"), F.col("_simple_call").alias("call"))


def _bin(at: Column) -> Column:
    return F.floor(at / sc.BIN)


def with_temporaries(nodes: DataFrame) -> DataFrame:
    """``temp``: name of the variable that takes an argument expression, numbered per program."""
    hoisted = F.col("slot").isin(*ARGUMENT_SLOTS) & F.col("tag").isin("DAPICall", "DVarDeclExpr")
    numbered = positions(nodes.where(hoisted), [F.col("seq_in")], _bin(F.col("seq_in")), ["pid"], out="_no")
    named = numbered.withColumn("temp", F.concat(F.lit("my_decl_var_"), F.col("_no").cast("string"))).drop("_no")
    return nodes.where(~hoisted).withColumn("temp", _text()).unionByName(named)


def with_operands(nodes: DataFrame) -> DataFrame:
    """Calls get ``args`` and ``expr`` as variable ids, and ``ret``: their own target or the one their wrapper sets.

    A wrapper (return statement, declaring argument) has the type of its last statement.
    """
    is_argument, inside = F.col("slot").isin(*ARGUMENT_SLOTS), F.col("slot") == "_stmt"
    tag, operand = F.col("tag"), F.coalesce("temp", "var_id")
    below = nodes.where(is_argument | inside).groupBy(F.col("pid").alias("_pid"), F.col("parent_id").alias("_of")).agg(
        F.array_sort(F.collect_list(F.when(F.col("slot") == "fp_var_ids", F.struct("slot_pos", operand.alias("id"))))).alias("_args"),
        F.min(F.when(F.col("slot") == "expr_var_id", F.struct("slot_pos", operand.alias("id"))))["id"].alias("_expr"),
        F.max(F.when(inside, F.struct("slot_pos", "returns", "tag"))).alias("_w"),
    )
    below = persist_table(below, "operands")
    gathered = nodes.join(below, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("node_id") == F.col("_of")), "left")
    gathered = gathered.withColumn("wrapped_type", F.col("_w.returns")).withColumn("wrapped_tag", F.col("_w.tag")).withColumn(
        "args", F.transform(F.coalesce("_args", F.slice(F.array(F.struct(F.lit(0).alias("slot_pos"), _text().alias("id"))), 1, 0)), lambda o: F.coalesce(o["id"], F.lit("LITERAL")))
    ).withColumn("expr", F.coalesce("_expr", "expr_id")).drop("_pid", "_of", "_args", "_expr", "_w")
    # statements inside a wrapper look up to it: what it sets, and which of them is its last
    temps = nodes.where("temp is not null").select(F.col("pid").alias("_tp"), F.col("node_id").alias("_tn"), F.col("temp").alias("_temp"))
    lasts = below.where("_w is not null").select("_pid", "_of", F.col("_w.slot_pos").alias("_last_pos"))
    up = lasts.join(temps, F.col("_pid").eqNullSafe(F.col("_tp")) & (F.col("_of") == F.col("_tn")), "left").select("_pid", "_of", "_last_pos", "_temp")
    looking = gathered.where(inside).join(up, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("parent_id") == F.col("_of")), "left")
    wrapped = F.when(F.col("parent_tag") == "DReturnStmt", F.lit(RETURN_VAR)).when(F.col("parent_tag") == "DVarDeclExpr", F.col("_temp"))
    last = F.col("slot_pos") == F.col("_last_pos")
    looking = looking.withColumn("wrapped", wrapped).withColumn("ret", F.coalesce(F.when(last, F.col("wrapped")), "ret_id")).withColumn(
        "var_id", F.coalesce(F.when(last & (tag == "DClsInit"), F.col("wrapped")), "var_id")
    ).drop("_pid", "_of", "_last_pos", "_temp")
    rest = gathered.where(~inside).withColumn("wrapped", _text()).withColumn("ret", F.coalesce(F.when(is_argument, F.col("temp")), "ret_id"))
    return rest.unionByName(looking)


def with_seen_types(nodes: DataFrame) -> DataFrame:
    """``seen_type``: the type the symbol table has for the target of a call or constructor.

    All slots of a control node share one table. A call that gets a declaration inserted does
    not enter it, so the next call into the same unknown variable declares again. ``nodes`` are written.
    """
    tag = F.col("tag")
    statement = ~F.col("slot").isin(*ARGUMENT_SLOTS)
    name = (
        F.when(statement & tag.isin("DVarCall", "DExceptionVar", "DFieldCall", "DClsInit"), F.col("var_id"))
        .when(F.col("temp").isNotNull(), F.col("temp")).when(tag == "DReturnStmt", RETURN_VAR)
    )
    at = F.when(tag == "DClsInit", F.col("seq_out") * 2 + 1).otherwise(F.col("seq_in") * 2)
    target = F.when(statement & (tag == "DAPICall"), F.col("ret")).when(statement & (tag == "DClsInit"), F.col("var_id"))
    scope = F.regexp_replace("scope", r"\.[a-z]+", "")
    known = nodes.select("pid", name.alias("name"), scope.alias("_in"), at.alias("at"), F.struct(at.alias("at"), F.coalesce("wrapped_type", "returns").alias("type")).alias("seen"))
    asked = nodes.select("pid", target.alias("name"), F.explode(enclosing(scope)).alias("_in"), (F.col("seq_out") * 2).alias("at"), "node_id")
    usable = F.col("pid").isNotNull() & F.col("name").isNotNull()
    each = latest_before(asked.where(usable), known.where(usable), ["pid", "name", "_in"], "at", "seen", 4)
    seen = each.groupBy(F.col("pid").alias("_pid"), F.col("node_id").alias("_of")).agg(F.max("seen")["type"].alias("seen_type"))
    return nodes.join(seen, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("node_id") == F.col("_of")), "left").drop("_pid", "_of")


def lower(nodes: DataFrame, apis: DataFrame | None = None, buckets: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lowered node rows, rejected programs). ``apis``: ``api, id`` of known constructors.

    Programs of at most ``scope.SHORT`` nodes are lowered one by one, each where its nodes meet; longer ones, and nodes without one,
    by joins and scans over their rows. ``buckets``: to how many the nodes are dealt by program, if they are.
    """
    kept = persist_buckets(nodes.where(F.col("tag") != "DAssign"), "extracted", "pid", buckets)
    parts: list[DataFrame] = []  # rejected programs

    def part(of) -> Callable[[DataFrame], DataFrame]:
        def rows(some: DataFrame) -> DataFrame:
            done, bad = of(some, apis)
            parts.append(bad)
            return done
        return rows

    done = sc.by_length(kept, part(_lower_together), part(_lower_rows))
    bad = parts[0]
    for more in parts[1:]:
        bad = bad.unionByName(more)
    return done, bad


def _lower_rows(kept: DataFrame, apis: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Programs of any size."""
    tag = F.col("tag")
    kept = persist_table(kept, "long-extracted")
    operands = persist_table(with_operands(persist_table(with_temporaries(with_simple_types(kept)), "temporaries")), "with-operands")
    typed = _with_followers(with_seen_types(operands))
    if apis is None:
        typed = typed.withColumn("fix", _text())
    else:
        fits = constructors_for(typed.where(tag == "DVarCall").select(F.col("returns").alias("type")), apis)
        wants = (tag == "DVarCall") & ~is_primitive(F.col("returns")) & F.col("next_tag").isNotNull() & (F.col("next_tag") != "DClsInit")
        typed = typed.join(fits.select(F.col("type").alias("returns"), F.col("api").alias("_api")), "returns", "left")
        typed = typed.withColumn("fix", F.when(wants, F.col("_api")))
    return _assemble(_emit(typed, _emissions()).unionByName(_void_returns(operands)))


# --- short programs, one by one ------------------------------------------------------------

READ = (
    "pid", "node_id", "parent_id", "slot", "slot_pos", "scope", "tag", "var_id", "expr_id", "ret_id", "returns", "op", "iattrib", "attrs", "seq_in", "seq_out",
    "list_parent", "list_slot", "parent_tag",
)
LOWERED = (
    "pid bigint, node_id int, parent_id int, slot string, slot_pos int, tag string, calls array<struct<call:string,args:array<string>,returns:string>>, var_id string, expr_id string, "
    "ret_id string, returns string, op string, iattrib array<int>, method string"
)
_LOWERED = pa.schema([
    ("pid", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("slot", pa.string()), ("slot_pos", pa.int32()), ("tag", pa.string()), ("calls", pa.list_(CALL_STRUCT)),
    ("var_id", pa.string()), ("expr_id", pa.string()), ("ret_id", pa.string()), ("returns", pa.string()), ("op", pa.string()), ("iattrib", pa.list_(pa.int32())), ("method", pa.string()),
])
REJECTED = -1  # ``node_id`` of the one row that a rejected program gives
_Node = namedtuple("_Node", [*READ, "call", "api"])
_SLOT_NAME = re.compile(r"\.[a-z]+")


def _lower_together(kept: DataFrame, apis: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Programs of at most ``scope.SHORT`` nodes: sorted once, then read through, program by program."""
    rows = kept.withColumn("_call", F.get("calls", F.lit(0))["call"])
    if apis is None:
        rows = rows.withColumn("_api", _text())
    else:
        stands = (F.col("tag") == "DVarCall") & ~F.col("slot").isin(*ARGUMENT_SLOTS)
        types = persist_table(rows.where(stands).select(F.col("returns").alias("_type")).distinct().withColumn("type", simplify_type(F.col("_type"))), "types")
        fits = types.join(constructors_for(types.select("type"), apis), "type").select("_type", F.col("api").alias("_api"))
        rows = rows.join(fits, F.when(stands, F.coalesce("returns", _text("\0"))) == F.coalesce("_type", _text("\0")), "left")
    first = F.row_number().over(W.partitionBy("pid").orderBy("node_id")) == 1
    made = rows.select(*READ, "_call", "_api", first.alias("_first")).mapInArrow(_lower_batches, LOWERED)
    return made.where(F.col("node_id") != REJECTED), made.where(F.col("node_id") == REJECTED).select("pid").distinct()


def _lower_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([array_of(v, f) for v, f in zip(columns, _LOWERED)], schema=_LOWERED)

    program: list[_Node] = []
    for batch in batches:
        done = []
        gc.disable()  # nothing here has cycles
        try:
            *columns, firsts = [values_of(batch.column(k)) for k in range(batch.num_columns)]
            for node, first in zip(map(_Node._make, zip(*columns)), firsts):
                if first and program:
                    out.extend(_lower_program(program))
                    program = []
                    if len(out) >= BATCH_ROWS:
                        done.append(made())
                        out = []
                program.append(node)
        finally:
            gc.enable()
        yield from done
    if program:
        out.extend(_lower_program(program))
    if out:
        yield made()


def _lower_program(nodes: list[_Node]) -> list[tuple]:
    """The lowered rows of one program, whose nodes come in their order; each step is named by what does it for programs of any size."""
    pid, size = nodes[0].pid, len(nodes)
    argument = [n.slot in ARGUMENT_SLOTS for n in nodes]
    # with_simple_types
    returns = []
    for n, is_argument in zip(nodes, argument):
        if n.tag in UNTYPED or is_argument and n.tag == "DVarCall":
            returns.append(n.returns)
        else:
            returns.append(None if n.tag == "DReturnVar" and n.returns == "null" else plain.simplify_type(n.returns))
    # with_temporaries, with_operands
    temps: list = [None] * size
    below: dict = {}  # by parent: arguments, receivers, statements inside
    hoisted = 0
    for i, n in enumerate(nodes):
        if argument[i] and n.tag in ("DAPICall", "DVarDeclExpr"):
            temps[i] = f"my_decl_var_{hoisted}"
            hoisted += 1
        if argument[i] or n.slot == "_stmt":
            below.setdefault(n.parent_id, ([], [], []))[0 if n.slot == "fp_var_ids" else 1 if argument[i] else 2].append(i)
    at_id = {n.node_id: i for i, n in enumerate(nodes)}
    operand = lambda i: nodes[i].var_id if temps[i] is None else temps[i]
    place = lambda i: nodes[i].slot_pos
    args, exprs, rets, vars_, wrapped, wrapped_type, wrapped_tag = [], [], [], [], [None] * size, [None] * size, [None] * size
    for i, n in enumerate(nodes):
        given, receivers, inside = below.get(n.node_id, ((), (), ()))
        args.append([a if a is not None else "LITERAL" for a in map(operand, sorted(given, key=place))] if given else [])
        receiver = operand(min(receivers, key=place)) if receivers else None
        exprs.append(n.expr_id if receiver is None else receiver)
        if inside:
            last = max(inside, key=place)
            wrapped_type[i], wrapped_tag[i] = returns[last], nodes[last].tag
        ret, var = n.ret_id, n.var_id
        if n.slot == "_stmt":
            above = at_id.get(n.parent_id)
            wrapped[i] = RETURN_VAR if n.parent_tag == "DReturnStmt" else temps[above] if n.parent_tag == "DVarDeclExpr" and above is not None else None
            if wrapped[i] is not None and n.slot_pos == max(map(place, below[n.parent_id][2])):
                ret = wrapped[i]
                var = wrapped[i] if n.tag == "DClsInit" else var
        elif argument[i] and temps[i] is not None:
            ret = temps[i]
        rets.append(ret)
        vars_.append(var)
    # with_seen_types
    scopes = [_SLOT_NAME.sub("", n.scope) for n in nodes]
    known: dict = {}
    for i, n in enumerate(nodes):
        if not argument[i] and n.tag in ("DVarCall", "DExceptionVar", "DFieldCall", "DClsInit"):
            name = vars_[i]
        else:
            name = temps[i] if temps[i] is not None else RETURN_VAR if n.tag == "DReturnStmt" else None
        if name is not None:
            at = n.seq_out * 2 + 1 if n.tag == "DClsInit" else n.seq_in * 2
            known.setdefault((name, scopes[i]), []).append((at, returns[i] if wrapped_type[i] is None else wrapped_type[i]))

    def seen_type(i: int, name: str | None):
        if name is None:
            return None
        before, best, kind, inner = nodes[i].seq_out * 2, -1, None, scopes[i]
        while True:
            for at, known_type in known.get((name, inner), ()):
                if best < at < before:
                    best, kind = at, known_type
            if inner == "":
                return kind
            inner = inner[:inner.rfind("/")]

    # _with_followers
    following: dict = {}
    latest: dict = {}
    for i, n in enumerate(nodes):
        if not argument[i] and wrapped[i] is None:
            key = (n.list_parent, n.list_slot)
            if key in latest:
                following[latest[key]] = i
            latest[key] = i
    # _emissions
    emitted: list = []  # place, tag, raw_id, call, args, var_id, expr_id, ret_id, returns, method, op, home, home_slot, iattrib

    def emit(n: _Node, at: int, sub: int, tag, raw_id=None, call=None, args=None, var_id=None, expr_id=None, ret_id=None, returns=None, method=None, op=None) -> None:
        emitted.append((at * 4 + sub, tag, raw_id, call, args, var_id, expr_id, ret_id, returns, method, op, n.list_parent, n.list_slot, n.iattrib))

    sets = False
    for i, n in enumerate(nodes):
        tag, entered, left, kind, ret, var, statement = n.tag, n.seq_in, n.seq_out, returns[i], rets[i], vars_[i], not argument[i]
        declared = "DVarDeclCls" if wrapped_tag[i] == "DClsInit" or tag == "DVarDeclExpr" else "DVarDecl"
        if n.scope == "" and (tag == "DReturnVar" and kind is not None or tag == "DReturnStmt" and wrapped_type[i] is not None):
            sets = True
        if temps[i] is not None:
            emit(n, entered, 0, declared, var_id=temps[i], returns=kind if wrapped_type[i] is None else wrapped_type[i])
        if tag in LISTS and tag != "DSubTree":
            emit(n, entered, 0, tag, raw_id=n.node_id, op=n.op)
        elif tag == "DReturnStmt":
            if wrapped_type[i] is not None:
                emit(n, entered, 0, declared, var_id=RETURN_VAR, returns=wrapped_type[i])
                emit(n, left, 0, "DReturnVar", var_id=RETURN_VAR, returns=wrapped_type[i])
        elif tag == "DAPICall":
            chained = exprs[i] == CHAINED
            if statement and ret is not None and not chained:
                seen = seen_type(i, ret)
                if seen is None or kind is not None and seen != kind:
                    emit(n, left, 1, "DVarDecl", var_id=ret, returns=kind)
            emit(n, left, 2, "chained" if chained else "DAPIInvoke", call=None if n.call is None else plain.simplify_api(n.call), args=args[i], expr_id=exprs[i], ret_id=ret, returns=kind)
        elif tag == "DClsInit":
            if var is not None:
                seen = seen_type(i, var) if statement else None
                if seen is None or kind is not None and seen != kind:
                    emit(n, left, 1, "DVarDeclCls", var_id=var, returns=kind)
            emit(n, left, 2, "DClsInit", call=None if n.call is None else plain.simplify_api(n.call), args=args[i], var_id=var, returns=kind)
        elif tag == "DInternalAPICall":
            emit(n, left, 2, tag, args=args[i], ret_id=ret, returns=kind, method=n.attrs)
        elif tag == "DVarCall":
            if statement:
                then = following.get(i) if wrapped[i] is None else None
                wants = then is not None and nodes[then].tag not in (None, "DClsInit") and kind is not None and not plain.is_primitive(kind)
                fix = n.api if wants else None
                emit(n, entered, 0, "DVarDecl" if fix is None else "DVarDeclCls", var_id=var, returns=kind)
                if fix is not None:
                    emit(n, entered, 1, "DClsInit", call=fix, args=["LITERAL"] * plain.formal_count(fix), var_id=var, returns=kind)
        elif tag in ("DExceptionVar", "DFieldCall", "DReturnVar"):
            if statement:
                emit(n, entered, 0, tag, var_id=var, returns=kind)
            if tag == "DExceptionVar" and n.list_slot == "_catch":
                then = following.get(i) if wrapped[i] is None and statement else None
                used_at_once = then is not None and nodes[then].tag == "DAPICall" and var is not None and exprs[then] == var
                if not used_at_once:
                    emit(n, entered, 1, "DAPIInvoke", call="java.lang.Throwable.printStackTrace()", args=[], expr_id=var, returns="void")
    if not sets:
        last = max(nodes, key=lambda n: n.seq_out)
        emitted.append((AT_END * 4, "DReturnVar", None, None, None, None, None, None, "void", None, None, -1, "_nodes", last.iattrib))
    # _assemble
    emitted.sort(key=lambda e: e[0])
    on, calls, heads = {}, {}, []
    made: dict = {}
    for e in emitted:
        key = e[11], e[12]
        if e[1] == "chained":
            head = on.get(key)
            if head is None or head[1] != "DAPIInvoke":
                return [(pid, REJECTED, None, None, None, None, (), None, None, None, None, None, (), None)]
            if head[3] is not None:
                calls[head[0]].append((e[3], e[4], e[8]))
            continue
        on[key] = e
        heads.append(e)
        calls[e[0]] = [(e[3], e[4], e[8])] if e[3] is not None else []
        if e[1] == "DClsInit" and e[5] is not None:
            made[(*key, e[5])] = e[0]
    numbers = {e[2]: k for k, e in enumerate(heads) if e[2] is not None}
    counts: dict = {}
    out = []
    for k, (at, tag, _, _, _, var_id, expr_id, ret_id, kind, method, op, home, home_slot, iattrib) in enumerate(heads):
        if tag == "DVarDecl" and made.get((home, home_slot, var_id), -1) > at:
            tag = "DVarDeclCls"
        pos = counts[home, home_slot] = counts.get((home, home_slot), -1) + 1
        out.append((pid, k, numbers.get(home, -1), home_slot, pos, tag, calls[at], var_id, expr_id, ret_id, kind, op, iattrib, method))
    return out


def _with_followers(typed: DataFrame) -> DataFrame:
    """``next_tag, next_expr``: the next statement in the list, for those that ask: exceptions and plain variables.

    Statements of a list are paired in bins of their places, the last of a bin with the first of the next that has one.
    """
    top = ~F.col("slot").isin(*ARGUMENT_SLOTS) & F.col("wrapped").isNull()
    asks = top & F.col("tag").isin("DExceptionVar", "DVarCall")
    keys = ["pid", "list_parent", "list_slot"]
    lists = typed.where(asks).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("list_parent") == F.col("_list_parent")) & (F.col("list_slot") == F.col("_list_slot"))
    there = typed.where(top).select(*keys, "seq_in", "node_id", F.struct(F.col("tag").alias("next_tag"), F.col("expr").alias("next_expr")).alias("_next"), asks.alias("_asks")).join(lists, same, "left_semi")
    there = persist_table(there.withColumn("_bin", _bin(F.col("seq_in"))), "lists")
    inside = W.partitionBy(*keys, "_bin").orderBy("seq_in")
    found = there.withColumn("_then", F.lead("_next").over(inside)).where("_asks")
    firsts = there.groupBy(*keys, "_bin").agg(F.min_by("_next", "seq_in").alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(W.partitionBy(*keys).orderBy("_bin"))).where("_later is not null")
    later = later.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_at_bin"), "_later")
    found = found.join(later, same & (F.col("_bin") == F.col("_at_bin")), "left").select(F.col("pid").alias("_of_pid"), F.col("node_id").alias("_of"), F.coalesce("_then", "_later").alias("_next"))
    joined = typed.join(found, F.col("pid").eqNullSafe(F.col("_of_pid")) & (F.col("node_id") == F.col("_of")), "left")
    return joined.select(*typed.columns, "_next.next_tag", "_next.next_expr")


def _void_returns(nodes: DataFrame) -> DataFrame:
    """A body that sets no return type returns nothing: one row for each such program, after all others."""
    tag = F.col("tag")
    sets = (F.col("scope") == "") & ((tag == "DReturnVar") & F.col("returns").isNotNull() | (tag == "DReturnStmt") & F.col("wrapped_type").isNotNull())
    bodies = nodes.groupBy("pid").agg(F.coalesce(F.bool_or(sets), F.lit(False)).alias("_sets"), F.max_by("iattrib", "seq_out").alias("iattrib")).where("not _sets")
    fields = _emission(F.lit(True), F.lit(AT_END), 0, "DReturnVar", returns=F.lit("void"), home=F.lit(-1), home_slot=F.lit("_nodes"))[1]
    return bodies.select("pid", "iattrib", *[value.alias(name) for name, value in fields.items()])


def _emissions() -> list[tuple[Column, dict[str, Column]]]:
    tag, entered, left = F.col("tag"), F.col("seq_in"), F.col("seq_out")
    statement = ~F.col("slot").isin(*ARGUMENT_SLOTS)
    var_id, returns, ret, args = F.col("var_id"), F.col("returns"), F.col("ret"), F.col("args")
    is_new = F.col("seen_type").isNull() | (F.col("seen_type") != returns)
    class_made = (F.col("wrapped_tag") == "DClsInit") | (tag == "DVarDeclExpr")
    wrapped_decl = F.when(F.coalesce(class_made, F.lit(False)), "DVarDeclCls").otherwise("DVarDecl")
    valued = (tag == "DReturnStmt") & F.col("wrapped_type").isNotNull()
    call, chained = tag == "DAPICall", F.coalesce(F.col("expr") == CHAINED, F.lit(False))
    used_at_once = F.coalesce((F.col("next_tag") == "DAPICall") & (F.col("next_expr") == var_id), F.lit(False))
    plain, fix = tag == "DVarCall", F.col("fix")
    none = F.array().cast("array<string>")
    return [
        # control nodes and plain declarations stand where they are entered
        _emission(tag.isin(*LISTS) & (tag != "DSubTree"), entered, 0, tag, raw_id=F.col("node_id"), op=F.col("op")),
        _emission(statement & tag.isin("DExceptionVar", "DFieldCall", "DReturnVar"), entered, 0, tag, var_id=var_id, returns=returns),
        # argument expressions and wrapped returns declare their variable first
        _emission(F.col("temp").isNotNull(), entered, 0, wrapped_decl, var_id=F.col("temp"), returns=F.coalesce("wrapped_type", "returns")),
        _emission(valued, entered, 0, wrapped_decl, var_id=F.lit(RETURN_VAR), returns=F.col("wrapped_type")),
        _emission(valued, left, 0, "DReturnVar", var_id=F.lit(RETURN_VAR), returns=F.col("wrapped_type")),
        # calls, with a declaration of an unknown target
        _emission(call & statement & ret.isNotNull() & ~chained & is_new, left, 1, "DVarDecl", var_id=ret, returns=returns),
        _emission(call, left, 2, F.when(chained, "chained").otherwise("DAPIInvoke"), call=F.col("call"), args=args, expr_id=F.col("expr"), ret_id=ret, returns=returns),
        # constructors, with a declaration of an unknown or retyped variable
        _emission((tag == "DClsInit") & var_id.isNotNull() & is_new, left, 1, "DVarDeclCls", var_id=var_id, returns=returns),
        _emission(tag == "DClsInit", left, 2, "DClsInit", call=F.col("call"), args=args, var_id=var_id, returns=returns),
        _emission(tag == "DInternalAPICall", left, 2, "DInternalAPICall", args=args, ret_id=ret, returns=returns, method=F.col("attrs")),
        # a caught exception nobody calls at once is printed
        _emission(
            (tag == "DExceptionVar") & (F.col("list_slot") == "_catch") & ~used_at_once, entered, 1, "DAPIInvoke",
            call=F.lit("java.lang.Throwable.printStackTrace()"), args=none, expr_id=var_id, returns=F.lit("void"),
        ),
        # objects without a constructor after them get the first that fits their type
        _emission(plain & statement, entered, 0, F.when(fix.isNotNull(), "DVarDeclCls").otherwise("DVarDecl"), var_id=var_id, returns=returns),
        _emission(plain & statement & fix.isNotNull(), entered, 1, "DClsInit", call=fix, args=F.transform(formal_types(fix), lambda _: F.lit("LITERAL")), var_id=var_id, returns=returns),
    ]


def _assemble(emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold chains, mark constructed declarations, number the rows."""
    keys = ["pid", "home", "home_slot"]
    place = (F.col("at").cast("long") * 4 + F.col("sub")).alias("place")
    rows = persist_table(emitted.withColumn("is_link", F.col("tag") == "chained").withColumn("place", place), "emitted")
    own_call = F.struct("call", "args", "returns")
    heads, links = rows.where("not is_link"), rows.where("is_link and pid is not null")
    # a link hangs on the last row before it in its list, which must be a call
    hung = latest_before(links.select(*keys, "place", own_call.alias("c")), heads.where("pid is not null").select(*keys, "place", F.struct(F.col("place").alias("head"), "tag").alias("on")), keys, "place", "on", 16)
    hung = persist_table(hung, "links")
    bad = hung.where("on is null or on.tag <> 'DAPIInvoke'").select("pid").distinct()
    followers = hung.where("on is not null").groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("on.head").alias("_place")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("_more"))
    same = F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("home") == F.col("_home")) & (F.col("home_slot") == F.col("_home_slot"))
    # an earlier plain declaration of a variable constructed later in the same list is a class declaration
    made = heads.where("tag = 'DClsInit'").groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("var_id").alias("_var")).agg(F.max("place").alias("_made"))
    plain = heads.where("tag = 'DVarDecl'").join(made, same & (F.col("var_id") == F.col("_var")), "left")
    plain = plain.withColumn("tag", F.when(F.col("_made") > F.col("place"), "DVarDeclCls").otherwise("DVarDecl")).select(*heads.columns)
    folded = heads.where("tag <> 'DVarDecl'").unionByName(plain).join(followers, same & (F.col("place") == F.col("_place")), "left")
    none = F.slice(F.array(own_call), 1, 0)
    calls = F.when(F.col("call").isNotNull(), F.concat(F.array(own_call), F.coalesce("_more", none))).otherwise(none)
    kept = folded.select(*heads.columns, calls.alias("calls")).join(bad.select(F.col("pid").alias("_bad")), F.col("pid") == F.col("_bad"), "left_anti")
    return _numbered_in_bins(persist_table(kept, "folded")), bad


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "pid", F.col("node_id").cast("int").alias("node_id"), F.coalesce("parent_id", F.lit(-1)).cast("int").alias("parent_id"), F.col("home_slot").alias("slot"), F.col("slot_pos").cast("int").alias("slot_pos"),
        "tag", "calls", "var_id", "expr_id", "ret_id", "returns", "op", "iattrib", "method",
    )


def _numbered_in_bins(kept: DataFrame) -> DataFrame:
    """Numbers and parents of the rows of programs of any size."""
    numbered = persist_table(positions(kept, [F.col("place")], _bin(F.col("at")), ["pid"], out="node_id"), "numbered")
    listed = positions(numbered, [F.col("place")], _bin(F.col("at")), ["pid", "home", "home_slot"], out="slot_pos")
    owners = numbered.where("raw_id is not null").select(F.col("pid").alias("_pid"), F.col("raw_id").alias("_raw"), F.col("node_id").alias("parent_id"))
    return _finished(listed.join(owners, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("home") == F.col("_raw")), "left"))
