"""Rule programs as DataFrame plans.

* Relations that need one another are evaluated together, in strata; a relation that needs itself through
  a negation or an aggregate is refused.
* A rule's body becomes joins in an order that follows shared variables, starting with the delta; a
  comparison is a filter as soon as its variables are bound, a negation is an anti-join, an atom whose new
  variables nothing needs is a semi-join. Catalyst and AQE choose the physical joins.
* Recursion is semi-naive: each round joins what the last round found with everything found so far, once
  for each recursive atom. A round writes its new tuples to the shared folder as one small table and goes
  on from there, so lineage stays short and a lost executor costs a round's work at most.
* Relations are sets of non-null tuples. A record is a struct, its ``nil`` the struct of nulls; a record type that
  contains itself (a list, a tree) is text instead: each field's length and value in turn, ``nil`` the empty text. So
  records and ``nil`` join, differ and repeat like any value. ``choice-domain`` keeps for each key the least tuple of the
  first round that has any.
* Only what the requested relations need is evaluated.
* A program in which each rule speaks of one key, the first column of all its relations, can be run ``keyed``: facts are dealt
  by the key once, relations are bucketed tables, and joins, distinct rows and aggregates stay where their key is. That is for
  keys of many small groups, such as methods: a key's tuples are one task's.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from threading import RLock as Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewright.functions import functors
from tuplewright.plans.language import Aggregate, Atom, Call, Compare, Const, Program, Relation, Rule, RuleError, Var, all_variables, parse, used, variables

COMPACT_AFTER = 8
PARALLEL = 6
#: a stratum's rules that are planned, and relations that are written, side by side
WORKERS = 8
#: bytes of a keyed program's facts, as the plan tells, for a bucket
BUCKET_BYTES = 1 << 19
#: while a keyed program runs: a join goes by its key alone, and no filter of nulls (there are none) hides that from a union
BY_KEY = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}
#: the most bytes of a relation that a join broadcasts: each goes through the driver, in every round, and is several times larger there
BROADCAST_BYTES = 1 << 20


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings for the jobs inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a purely local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tuplewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stored:
    """A relation's tuples as files in the shared folder, added to round by round. buckets: by the first column, if any."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, buckets: int = 0) -> None:
        self.spark, self.schema, self.buckets = spark, schema, buckets
        self.base = f"{shared_dir(spark)}/relations/{name.replace('.', '_')}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.read: DataFrame | None = None

    def write(self, df: DataFrame) -> tuple[DataFrame, int, str]:
        """The rows as written, not yet part of the relation, their count (by the job that writes them), and their place."""
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        return self._put(df, path, seen), seen.get["n"], path

    def _put(self, df: DataFrame, path: str, seen: Observation | None = None) -> DataFrame:
        df = df.repartition(self.buckets, df.columns[0]) if self.buckets else df  # none if the rows are dealt so
        df = df.observe(seen, F.count(F.lit(1)).alias("n")) if seen else df
        if self.buckets:
            df.write.format("parquet").option("path", path).bucketBy(self.buckets, df.columns[0]).saveAsTable(self._table(path))
        else:
            df.write.parquet(path)
        return self._get([path])

    @staticmethod
    def _table(path: str) -> str:
        return re.sub(r"\W", "_", "_".join(path.split("/")[-2:]))

    def _get(self, paths: list[str]) -> DataFrame:
        if self.buckets:
            # the filter passes all: a union of scans alone would be one of column batches, which loses the buckets that it claims to keep
            tables = (self.spark.table(self._table(p)) for p in paths)
            return reduce(DataFrame.unionByName, (t.where(F.col(f"`{t.columns[0]}`").cast("string") >= "") for t in tables))
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, path: str) -> None:
        self.read = None
        self.paths.append(path)
        if len(self.paths) > COMPACT_AFTER:
            path = f"{self.base}/all-{uuid.uuid4().hex[:8]}"
            self._put(self.all(), path)
            self.paths, self.read = [path], None

    def take(self, rows: DataFrame) -> None:
        """Writes the relation anew without these rows."""
        left, n, path = self.write(self.all().join(rows, rows.columns, "left_anti"))
        self.paths, self.read = [path] if n else [], left if n else None

    def all(self) -> DataFrame:
        if self.read is None:
            self.read = self._get(self.paths) if self.paths else self.spark.createDataFrame([], self.schema)
        return self.read


def _symbols(x) -> set[str]:
    """The texts that a term or literal names."""
    if isinstance(x, Const):
        return {x.value} if isinstance(x.value, str) else set()
    if isinstance(x, Aggregate):
        return set().union(*(_symbols(y) for y in (x.value, *x.body) if y is not None))
    if isinstance(x, Compare):
        return _symbols(x.left) | _symbols(x.right)
    return set().union(*map(_symbols, x.args)) if isinstance(x, Call | Atom) and x.args else set()


@dataclass
class Round:
    stratum: tuple[str, ...]
    number: int
    found: dict[str, int]


@dataclass
class Result:
    relations: dict[str, DataFrame]
    rounds: list[Round] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.relations[name]


def strata(program: Program, wanted: Iterable[str]) -> list[list[str]]:
    """Groups of mutually recursive relations that the wanted ones need, in an order of evaluation."""
    needs: dict[str, set[tuple[str, bool]]] = {r: set() for r in program.relations}
    for rule in program.rules:
        for head in rule.heads:
            if head.relation not in needs:
                raise RuleError(f"{head.relation} is not declared")
            for x in rule.body:
                needs[head.relation].update(used(x))
    for relation, them in needs.items():
        for r, _ in them:
            if r not in needs:
                raise RuleError(f"{r}, used by {relation}, is not declared")
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(start: str) -> None:
        work = [(start, iter(sorted(r for r, _ in needs[start])))]
        index[start] = low[start] = len(index)
        stack.append(start)
        while work:
            node, rest = work[-1]
            for r in rest:
                if r not in index:
                    index[r] = low[r] = len(index)
                    stack.append(r)
                    work.append((r, iter(sorted(x for x, _ in needs[r]))))
                    break
                if r in stack:
                    low[node] = min(low[node], index[r])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        group.append(stack.pop())
                        if group[-1] == node:
                            break
                    out.append(sorted(group))

    for r in sorted(wanted):
        if r not in needs:
            raise RuleError(f"{r} is not declared")
        if r not in index:
            visit(r)
    for group in out:
        for r in group:
            for other, whole in needs[r]:
                if whole and other in group:
                    raise RuleError(f"{r} needs all of {other} by negation or aggregate, but {other} depends on {r}")
    return out


#: the relation of symbols and their ordinals, which rules with ord read
ORDINALS = "$ord"


class Ordinals:
    """An injective table of symbols to numbers in the shared folder, added to as symbols appear.

    A batch's symbols are sorted by ranges and numbered in their partitions (a partition's numbers start at a place of its
    own, so no task sees all), above those of the batches before. So ordinals of symbols that came in one batch, such as all of the facts', follow the text.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.store = Stored(spark, "ordinals", T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType())]))
        self.next = 0

    def add(self, symbols: DataFrame) -> None:
        """symbols: one column."""
        new = symbols.toDF("s").where("s is not null").distinct()
        if self.store.paths:
            new = new.join(self.store.all(), "s", "left_anti")
        df, count, path = self.store.write(new.orderBy("s").select("s", (F.monotonically_increasing_id() + self.next).alias("n")))
        if count:
            self.store.add(path)
            self.next = df.agg(F.max("n")).first()[0] + 1

    def all(self) -> DataFrame:
        return self.store.all()


def leaves(df: DataFrame) -> DataFrame | None:
    """All texts in df's columns, those in records too, as one column."""

    def below(column: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in below(column[f.name], f.dataType)]
        return [column] if isinstance(kind, T.StringType) else []

    found = [c for f in df.schema.fields for c in below(F.col(f"`{f.name}`"), f.dataType)]
    return df.select(F.explode(F.array(*found)).alias("s")).distinct() if found else None


class WithOrdinals:
    """Rules in which ord(x) is a variable that the relation of ordinals binds."""

    #: functors that make symbols which no fact may have
    MAKERS = ("cat", "substr", "to_string")

    def __init__(self, program: Program, typed) -> None:
        self.program, self.typed, self.used, self.count = program, typed, False, 0
        calls = [c for r in program.rules for x in (*r.heads, *r.body) for c in self.calls(x)]
        #: whether rules can make symbols that are not in the facts
        self.open = any(c in self.MAKERS or c.startswith("@") or c == "[]" for c in calls)
        if "ord" in calls:
            program.rules = [self.rule(r) for r in program.rules]
        if self.used:
            program.relations[ORDINALS] = Relation(ORDINALS, (("s", "symbol"), ("n", "number")))

    def calls(self, x) -> list[str]:
        if isinstance(x, Aggregate):
            return [c for y in (x.value, *x.body) if y is not None for c in self.calls(y)]
        if isinstance(x, Compare):
            return self.calls(x.left) + self.calls(x.right)
        if isinstance(x, Call | Atom):
            return ([x.name] if isinstance(x, Call) else []) + [c for a in x.args for c in self.calls(a)]
        return []

    def rule(self, rule: Rule) -> Rule:
        self.kinds = self.typed(rule.body, rule.heads)
        more: list = []
        body = tuple(self.literal(x, more) for x in rule.body)
        heads = tuple(Atom(h.relation, tuple(self.term(a, more) for a in h.args), h.negated) for h in rule.heads)
        return Rule(heads, (*body, *more))

    def literal(self, x, more: list):
        if isinstance(x, Atom):
            return x if x.negated else Atom(x.relation, tuple(self.term(a, more) for a in x.args))
        if isinstance(x, Compare):
            sides = (x.left, x.right)
            if all(isinstance(a, Call) and a.name == "ord" for a in sides) and (x.op in ("=", "!=") or not self.open):
                return Compare(x.op, sides[0].args[0], sides[1].args[0])  # as ordinals follow the text
            by_symbol = any(isinstance(a, Aggregate) and isinstance(b, Var) and self.kinds.get(b.name) not in (None, "number", "unsigned") for a, b in (sides, sides[::-1]))
            if by_symbol:  # the least symbol itself is asked for
                return x
            return Compare(x.op, *(self.term(a, more) for a in sides))
        if isinstance(x, Call):
            return Call(x.name, tuple(self.term(a, more) for a in x.args))
        return x

    def term(self, x, more: list):
        if isinstance(x, Aggregate):
            inner: list = []
            value = self.term(x.value, inner) if x.value is not None else None
            body = tuple(self.literal(b, inner) for b in x.body)
            return Aggregate(x.kind, value, (*body, *inner))
        if isinstance(x, Call) and x.name == "ord":
            self.used, self.count = True, self.count + 1
            symbol, number = self.term(x.args[0], more), Var(f"?ord{self.count}")
            if not isinstance(symbol, Var | Const):
                name = Var(f"?sym{self.count}")
                more.append(Compare("=", name, symbol))
                symbol = name
            more.append(Atom(ORDINALS, (symbol, number)))
            return number
        if isinstance(x, Call):
            return Call(x.name, tuple(self.term(a, more) for a in x.args))
        return x


class Compiler:
    """Bodies to DataFrames whose columns are variables."""

    def __init__(self, spark: SparkSession, program: Program) -> None:
        self.spark, self.program = spark, program

    # -- types
    def resolved(self, name: str | None) -> str | None:
        """A type without its aliases: a basic type or the list of a record's field types."""
        seen = set()
        while name in self.program.types and name not in seen:
            seen.add(name)
            name = self.program.types[name]
        return name

    def fields(self, name: str | None) -> list[str] | None:
        """The field types of a record type; None for others."""
        name = self.resolved(name)
        return None if name is None or not name.startswith("[") else [f for f in name[1:-1].split(",") if f]

    def below(self, name: str) -> set[str]:
        """The record types that a record type's values can hold, as resolved names."""
        out: set[str] = set()
        work = list(self.fields(name) or [])
        while work:
            inner = self.resolved(work.pop())
            if inner.startswith("[") and inner not in out:
                out.add(inner)
                work += self.fields(inner)
        return out

    def encoded(self, name: str | None) -> bool:
        """Whether values of a record type are texts: it is a part of a type that contains itself."""
        mine = self.resolved(name)
        if self.fields(mine) is None:
            return False
        every = {self.resolved(t) for t in self.program.types} | {mine}
        loops = {t for t in every if t.startswith("[") and t in self.below(t)}
        return any(mine == t or mine in self.below(t) for t in loops)

    def data_type(self, name: str) -> T.DataType:
        fields = self.fields(name)
        if fields is not None:
            return T.StringType() if self.encoded(name) else T.StructType([T.StructField(f"_{i + 1}", self.data_type(f)) for i, f in enumerate(fields)])
        return {"number": T.LongType(), "unsigned": T.LongType(), "float": T.DoubleType()}.get(self.resolved(name), T.StringType())

    def nil(self, name: str | None) -> Column:
        if self.fields(name) is None:
            return F.lit(None)
        if self.encoded(name):
            return F.lit("")
        return F.struct(*(F.lit(None).alias(f"_{i + 1}") for i in range(len(self.fields(name))))).cast(self.data_type(name))

    def is_nil(self, value: Column, name: str | None) -> Column:
        if not self.fields(name):
            return value.isNull()
        return value == "" if self.encoded(name) else value["_1"].isNull()

    def record(self, args: list[Column], name: str | None) -> Column:
        if not self.encoded(name):
            return F.struct(*(a.alias(f"_{i + 1}") for i, a in enumerate(args)))
        texts = [a.cast("string") for a in args]
        return F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts))

    def parts(self, value: Column, name: str | None, n: int) -> list[Column]:
        """A record's n fields."""
        if not self.encoded(name):
            return [value[f"_{i + 1}"] for i in range(n)]
        out, rest = [], value
        for kind in self.fields(name):
            size = F.substring_index(rest, ":", 1)
            start = F.length(size) + 2
            out.append(F.substring(rest, start, size.cast("int")).cast(self.data_type(kind)))
            rest = F.substring(rest, start + size.cast("int"), F.length(rest))
        return out

    def types_of(self, literals: Iterable, heads: Iterable[Atom] = ()) -> dict[str, str]:
        """The declared types of a rule's variables, as far as its atoms tell."""
        out: dict[str, str] = {}

        def walk(x, kind: str | None) -> None:
            if isinstance(x, Var) and kind is not None:
                out.setdefault(x.name, kind)
            elif isinstance(x, Call) and x.name == "[]":
                for a, k in zip(x.args, self.fields(kind) or [], strict=False):
                    walk(a, k)

        atoms = [x for x in literals if isinstance(x, Atom)] + list(heads)
        for x in atoms:
            for a, (_, kind) in zip(x.args, self.program.relations[x.relation].columns, strict=False):
                walk(a, kind)
        for x in literals:
            if isinstance(x, Compare) and x.op == "=":
                for a, b in ((x.left, x.right), (x.right, x.left)):
                    if isinstance(a, Var):
                        walk(b, out.get(a.name))
        return out

    def schema(self, relation: Relation) -> T.StructType:
        return T.StructType([T.StructField(n.lstrip("?"), self.data_type(t), True) for n, t in relation.columns])

    # -- terms
    def term(self, x, bound: dict[str, Column], kind: str | None = None) -> Column:
        """A term's value. kind: the declared type of its place, which records and nil need."""
        if isinstance(x, Var):
            return bound[x.name]
        if isinstance(x, Const):
            return F.lit(x.value).cast("long") if isinstance(x.value, int) else F.lit(x.value)
        if x.name == "nil":
            return self.nil(kind)
        if x.name == "[]":
            kinds = self.fields(kind) or [None] * len(x.args)
            if len(kinds) != len(x.args):
                raise RuleError(f"a record of {kind} has {len(kinds)} fields")
            return self.record([self.term(a, bound, k) for a, k in zip(x.args, kinds, strict=True)], kind)
        args = [self.term(a, bound) for a in x.args]
        if x.name in ("+", "-", "*"):
            a, b = (c.cast("long") for c in args)
            return a + b if x.name == "+" else a - b if x.name == "-" else a * b
        if x.name in ("/", "%"):
            return (functors.div if x.name == "/" else functors.mod)(*args)
        if x.name not in functors.FUNCTORS:
            raise RuleError(f"unknown functor {x.name}")
        return functors.FUNCTORS[x.name][0](*args)

    def condition(self, x, bound: dict[str, Column], types: dict[str, str] | None = None) -> Column:
        types = types or {}
        if isinstance(x, Call) and x.name == "not":
            return ~self.condition(x.args[0], bound, types)
        if isinstance(x, Call) and x.name == "match":
            pattern = x.args[0]
            return functors.match(pattern.value if isinstance(pattern, Const) else self.term(pattern, bound), self.term(x.args[1], bound))
        if isinstance(x, Call) and x.name == "contains":
            return functors.contains(self.term(x.args[0], bound), self.term(x.args[1], bound))
        if isinstance(x, Call):
            return self.term(x, bound)
        kind = next((types[s.name] for s in (x.left, x.right) if isinstance(s, Var) and s.name in types), None)
        nil = [isinstance(s, Call) and s.name == "nil" for s in (x.left, x.right)]
        if any(nil):
            is_nil = self.is_nil(self.term(x.left if nil[1] else x.right, bound, kind), kind)
            return is_nil if x.op == "=" else ~is_nil
        a, b = self.term(x.left, bound, kind), self.term(x.right, bound, kind)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]

    # -- bodies
    def body(self, literals: tuple, tables: list[DataFrame | None], keep: set[str], first: int | None = None, seed: DataFrame | None = None, types: dict[str, str] | None = None) -> DataFrame:
        """The distinct-to-be bindings of the variables to keep. tables: for each literal that is an atom, its relation; first: the atom to start with."""
        todo = list(range(len(literals)))
        types = self.types_of(literals) | (types or {})
        state: DataFrame | None = seed
        have: set[str] = set(seed.columns) if seed is not None else set()

        def needed(without: int) -> set[str]:
            return keep.union(*(all_variables(literals[i]) for i in todo if i != without))

        def bound() -> dict[str, Column]:
            return {v: F.col(f"`{v}`") for v in have}

        def with_column(name: str, value: Column) -> None:
            nonlocal state
            state = (self.spark.range(1).select(value.alias(name)) if state is None else state.withColumn(name, value)).where(F.col(f"`{name}`").isNotNull())
            have.add(name)

        def bind(pattern, value: Column, kind: str | None = None) -> list[tuple[object, Column, str | None]]:
            """Binds what of a pattern is free; gives the equalities that are left, with their types."""
            nonlocal state
            if isinstance(pattern, Var) and pattern.name not in have:
                with_column(pattern.name, value)
                return []
            if isinstance(pattern, Call) and pattern.name == "[]":
                rest, kinds = [], self.fields(kind) or [None] * len(pattern.args)
                if self.fields(kind):
                    state = state.where(~self.is_nil(value, kind))
                for part, x, k in zip(pattern.args, self.parts(value, kind, len(pattern.args)), kinds, strict=True):
                    if not (isinstance(part, Var) and part.name.startswith("_") and part.name not in keep and not any(part.name in all_variables(literals[j]) for j in todo)):
                        rest += bind(part, x, k)
                return rest
            return [(pattern, value, kind)]

        def holds(pattern, value: Column, kind: str | None) -> Column:
            return self.condition(Compare("=", pattern, Var("_v")), bound() | {"_v": value}, types | ({"_v": kind} if kind else {}))

        def settle() -> None:
            """Applies all comparisons and aggregates that can be."""
            nonlocal state
            again = True
            while again:
                again = False
                for i in list(todo):
                    x = literals[i]
                    if isinstance(x, Atom):
                        continue
                    sides = [x.left, x.right] if isinstance(x, Compare) else []
                    aggregate = next((s for s in sides if isinstance(s, Aggregate)), None)
                    if aggregate is not None:
                        outside = (keep | have).union(*(variables(y) for j, y in enumerate(literals) if j != i), *(variables(s) for s in sides))
                        outer = outside & all_variables(aggregate)
                        if not outer <= have:
                            continue
                        todo.remove(i)
                        state = self.aggregate(aggregate, state, sorted(outer), "_agg", types)
                        have.add("_agg")
                        other = sides[1] if sides[0] is aggregate else sides[0]
                        rest = bind(other, F.col("_agg")) if x.op == "=" else [(other, F.col("_agg"))]
                        if rest and x.op != "=" and sides[0] is not aggregate:
                            state = state.where(self.condition(Compare(x.op, other, Var("_agg")), bound(), types))
                        elif rest:
                            state = state.where(self.condition(Compare(x.op, Var("_agg"), other), bound(), types))
                        state, _ = state.drop("_agg"), have.discard("_agg")
                        again = True
                        continue
                    free = variables(x) - have
                    if not free:
                        todo.remove(i)
                        if state is None:
                            state = self.spark.range(1).select(F.lit(1).alias("_one"))
                        state = state.where(self.condition(x, bound(), types))
                        again = True
                    elif isinstance(x, Compare) and x.op == "=":
                        ranges = [(a, b) for a, b in ((x.left, x.right), (x.right, x.left)) if isinstance(a, Var) and isinstance(b, Call) and b.name == "range"]
                        if ranges and variables(ranges[0][1]) <= have:
                            todo.remove(i)
                            low, high = (self.term(t, bound()).cast("long") for t in ranges[0][1].args)
                            with_column(ranges[0][0].name, F.explode(F.when(low < high, F.sequence(low, high - 1))))
                            again = True
                            continue
                        if ranges:
                            continue
                        for a, b in ((x.left, x.right), (x.right, x.left)):
                            pattern = isinstance(a, Var) and a.name not in have or isinstance(a, Call) and a.name == "[]"
                            if pattern and variables(b) <= have and i in todo:
                                todo.remove(i)
                                kind = next((types[s.name] for s in (a, b) if isinstance(s, Var) and s.name in types), None)
                                for p, value, k in bind(a, self.term(b, bound(), kind), kind):
                                    if variables(p) <= have:
                                        state = state.where(holds(p, value, k))
                                    else:
                                        raise RuleError(f"can't solve {p}")
                                again = True

        def atom_view(x: Atom, df: DataFrame) -> tuple[DataFrame, list[tuple[object, str, str]]]:
            """The relation with variables for columns; and what must equal which extra column, of which type."""
            columns, names, later, seen = df.columns if x.args else [], [], [], {}
            kinds = [k for _, k in self.program.relations[x.relation].columns]
            for k, (a, c) in enumerate(zip(x.args, columns, strict=True)):
                if isinstance(a, Const):
                    df = df.where(F.col(f"`{c}`") == self.term(a, {}))
                elif isinstance(a, Var) and a.name in seen:
                    df = df.where(F.col(f"`{c}`") == F.col(f"`{seen[a.name]}`"))
                elif isinstance(a, Var):
                    seen[a.name] = c
                else:
                    names.append((c, f"_x{k}"))
                    later.append((a, f"_x{k}", kinds[k]))
            wanted = needed(index) | have
            names += [(c, v) for v, c in seen.items() if v in wanted]
            return df.select(*(F.col(f"`{c}`").alias(v) for c, v in names)) if names else df.select(F.lit(1).alias("_any")).limit(1), later

        while todo:
            settle()
            atoms = [i for i in todo if isinstance(literals[i], Atom) and not literals[i].negated]
            ready = [i for i in todo if isinstance(literals[i], Atom) and literals[i].negated and {v for v in variables(literals[i]) if not v.startswith("_")} <= have]
            if ready:
                index = ready[0]
                x = literals[index]
                todo.remove(index)
                solved = Atom(x.relation, tuple(a if isinstance(a, Const | Var) else self._named(a, k) for k, a in enumerate(x.args)))
                for k, a in enumerate(x.args):
                    if not isinstance(a, Const | Var):
                        with_column(f"_n{k}", self.term(a, bound(), self.program.relations[x.relation].columns[k][1]))
                view, _ = atom_view(solved, tables[index])
                on = [c for c in view.columns if c in have]
                if state is None:
                    state = self.spark.range(1).select(F.lit(1).alias("_one"))
                if on:
                    state = state.join(view.select(on), on, "left_anti")
                else:
                    state = state.join(view.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
                continue
            if not atoms:
                if todo:
                    raise RuleError(f"variables never bound: {sorted(set().union(*(variables(literals[i]) for i in todo)) - have)}")
                break
            if first in atoms and state is seed:
                index = first
            else:
                index = max(atoms, key=lambda i: (len(variables(literals[i]) & have) > 0, sum(isinstance(a, Const) for a in literals[i].args), len(variables(literals[i]) & have), -i))
            x = literals[index]
            todo.remove(index)
            if x.relation == ORDINALS:
                tables = [*tables]
                tables[index] = self.ordinals_for(x.args[0], state, have)
            view, later = atom_view(x, tables[index])
            on = [c for c in view.columns if c in have]
            new = [c for c in view.columns if c not in have]
            if state is None:
                state = view
            elif not new and on:
                state = state.join(view, on, "left_semi")
            elif on:
                state = state.join(view, on)
            elif view.columns == ["_any"]:
                state = state.join(view, F.lit(True), "left_semi")
            else:
                state = state.crossJoin(view)  # the rule itself asks for a product
            have.update(c for c in new if c != "_any")
            for a, c, kind in later:
                # an argument that is an expression or a record: match it against the column
                left = bind(a, F.col(c), kind) if isinstance(a, Call) and a.name == "[]" else [(a, F.col(c), kind)]
                for p, value, k in left:
                    if variables(p) <= have:
                        state = state.where(holds(p, value, k))
                    else:
                        types.setdefault(c, kind)
                        literals = (*literals, Compare("=", p, Var(c)))
                        tables = [*tables, None]
                        todo.append(len(literals) - 1)
                        have.add(c)
            drop = [c for c in state.columns if c not in needed(-1) and c in have and len(state.columns) > 1]
            if drop:
                state = state.drop(*drop)
                have.difference_update(drop)
        settle()
        if state is None:
            state = self.spark.range(1).select(F.lit(1).alias("_one"))
        missing = keep - have
        if missing:
            raise RuleError(f"variables never bound: {sorted(missing)}")
        return state

    @staticmethod
    def _named(_, k: int) -> Var:
        return Var(f"_n{k}")

    def aggregate(self, x: Aggregate, state: DataFrame | None, outer: list[str], name: str, types: dict[str, str] | None = None) -> DataFrame:
        """state with the aggregate's value for each binding of the outer variables."""
        seed = state.select(*outer).distinct() if outer else None
        blank = {v for b in x.body if isinstance(b, Atom) and b.negated for v in variables(b) if v.startswith("_")}
        inner = set().union(*map(all_variables, x.body)) - blank | (all_variables(x.value) if x.value is not None else set())
        tables = [self.relation(b.relation) if isinstance(b, Atom) else None for b in x.body]
        names = [a.name for a in x.body[0].args if isinstance(a, Var)] if len(x.body) == 1 and isinstance(x.body[0], Atom) and not x.body[0].negated else []
        if names and len(set(names)) == len(x.body[0].args) and set(outer) <= set(names):
            rows = self.body(x.body, tables, inner, types=types)  # a whole relation's tuples, which are distinct
        else:
            rows = self.body(x.body, tables, inner, seed=seed, types=types).distinct()
        value = self.term(x.value, {v: F.col(f"`{v}`") for v in rows.columns}) if x.value is not None else F.lit(1)
        make = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.mean}[x.kind]
        sums = rows.groupBy(*outer).agg(make(value).alias(name))
        if not outer:
            sums = sums.withColumn(name, F.coalesce(F.col(name), F.lit(0))) if x.kind in ("count", "sum") else sums.where(F.col(name).isNotNull())
            return sums if state is None else state.crossJoin(F.broadcast(sums))  # one row
        if x.kind in ("count", "sum"):
            return state.join(sums, outer, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
        return state.join(sums, outer)

    def relation(self, name: str) -> DataFrame:
        raise NotImplementedError

    def ordinals_for(self, symbol, state: DataFrame | None, have: set[str]) -> DataFrame:
        raise NotImplementedError


class Engine(Compiler):
    """Evaluates a program over given facts."""

    def __init__(self, spark: SparkSession, program: Program | str, facts: dict[str, DataFrame] | None = None, defined: set[str] | None = None, most_rounds: int = 10_000, keyed: bool = False) -> None:
        super().__init__(spark, parse(program, defined) if isinstance(program, str) else program)
        self.facts = facts or {}
        self.keyed = keyed
        self.buckets = self._buckets() if keyed else 0
        self.most_rounds = most_rounds
        typed = WithOrdinals(self.program, self.types_of)
        self.open_symbols, self.ordinals, self.ordering = typed.open, None, Lock()
        self.stored: dict[str, Stored] = {}
        self.rounds: list[Round] = []
        derived = {h.relation for r in self.program.rules for h in r.heads}
        #: relations that are facts alone are read where they are
        self.plain = {n: self._facts(n) for n in self.program.relations if n in self.facts and n not in derived and self.program.relations[n].columns}
        #: of those, the ones known to have no tuples
        self.bare = {n for n in self.plain if self._rowless(self.facts[n])}
        #: and the ones that are written without repeated rows, for rounds to read
        self.settled: set[str] = set()
        if ORDINALS in self.program.relations:
            self.plain[ORDINALS] = None
            self.settled.add(ORDINALS)
        #: called with (relation, its new tuples, round) as they are found
        self.on_delta = None

    @staticmethod
    def _rowless(df: DataFrame) -> bool:
        """Whether the optimised plan alone, without a job, shows that there are no rows."""
        most = df._jdf.queryExecution().optimizedPlan().maxRows()
        return most.isDefined() and most.get() == 0

    def _buckets(self) -> int:
        """How many buckets a keyed program's relations have: by the size of the facts."""
        for rule in self.program.rules:
            atoms = list(rule.heads)
            work = list(rule.body)
            while work:
                x = work.pop()
                if isinstance(x, Atom):
                    atoms.append(x)
                elif isinstance(x, Aggregate):
                    work += x.body
                elif isinstance(x, Compare):
                    work += [x.left, x.right]
            keys = {x.args[0] if x.args else None for x in atoms}
            if len(keys) > 1 or not all(isinstance(k, Var) for k in keys) or not any(isinstance(x, Atom) and not x.negated for x in rule.body):
                raise RuleError(f"a rule for {rule.heads[0].relation} has no one key")
        sizes = [df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for df in self.facts.values()]
        most = max(200, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return int(min(max(1, max(sizes, default=0) // BUCKET_BYTES), most))

    def running(self):
        """The session's settings while a program runs."""
        if self.keyed:
            return settings(self.spark, BY_KEY)
        most = min(BROADCAST_BYTES, self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        return settings(self.spark, {"spark.sql.autoBroadcastJoinThreshold": str(most)})

    def _store(self, name: str, schema: T.StructType) -> Stored:
        return Stored(self.spark, name, schema, self.buckets if self.program.relations[name].columns else 0)

    def _settle(self, names: set[str]) -> None:
        """Writes facts that rounds will read again and again: else each round would compute and compare them anew."""
        names = sorted(names & set(self.plain) - self.bare - self.settled)
        with ThreadPoolExecutor(max_workers=WORKERS) as pool:
            made = dict(zip(names, pool.map(lambda n: self._store(n, self.schema(self.program.relations[n])).write(self.plain[n]), names), strict=True))
        for name, (df, count, _) in made.items():
            self.plain[name] = df
            self.settled.add(name)
            if not count:
                self.bare.add(name)

    def _idle(self, rule: Rule, delta: dict[str, DataFrame] | None, first: int | None) -> bool:
        """Whether the rule can give nothing, as a relation that it joins has no tuples."""
        asked = (x.relation for i, x in enumerate(rule.body) if isinstance(x, Atom) and not x.negated and i != first)
        return any(r in self.bare or r in self.stored and not self.stored[r].paths for r in asked)

    def relation(self, name: str) -> DataFrame:
        if name == ORDINALS:
            with self.ordering:
                return self._ordinals().all()
        if name in self.plain:
            return self.plain[name]
        return self.stored[name].all()

    def _ordinals(self) -> Ordinals:
        """The ordinals, at first of all symbols in the facts and in the rules."""
        if self.ordinals is None:
            self.ordinals = Ordinals(self.spark)
            constants = {c for r in self.program.rules for x in (*r.heads, *r.body) for c in _symbols(x)}
            parts = [leaves(self.given(n)) for n in sorted(self.facts) if n in self.program.relations]
            parts.append(self.spark.createDataFrame([(c,) for c in sorted(constants)], "s string"))
            parts = [p for p in parts if p is not None]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            self.ordinals.add(every)
        return self.ordinals

    def ordinals_for(self, symbol, state: DataFrame | None, have: set[str]) -> DataFrame:
        """The ordinals, with those of the symbols that a rule's bindings have if rules can make new ones."""
        with self.ordering:
            table = self._ordinals()
            if self.open_symbols and isinstance(symbol, Var) and symbol.name in have:
                table.add(state.select(F.col(f"`{symbol.name}`").cast("string")))
            return table.all()

    def given(self, name: str) -> DataFrame | None:
        """The facts of a relation with its declared names and types."""
        if name not in self.facts:
            return None
        df, schema = self.facts[name], self.schema(self.program.relations[name])
        if len(df.columns) != len(schema):
            raise RuleError(f"{name} has {len(schema)} columns, its facts have {len(df.columns)}")
        return df.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema.fields, strict=True)))

    def _facts(self, name: str) -> DataFrame:
        """A relation's distinct facts."""
        df = self.given(name)
        return (df.repartition(self.buckets, df.columns[0]) if self.keyed and df.columns else df).distinct()

    def _rule(self, rule: Rule, group: set[str], delta: dict[str, DataFrame] | None, first: int | None) -> DataFrame:
        tables = []
        for i, x in enumerate(rule.body):
            if not isinstance(x, Atom):
                tables.append(None)
            elif i == first:
                tables.append(delta[x.relation])
            else:
                tables.append(self.relation(x.relation))
        keep = set().union(*(variables(h) for h in rule.heads))
        return self.body(rule.body, tables, keep, first, types=self.types_of(rule.body, rule.heads))

    def _head(self, head: Atom, body: DataFrame) -> DataFrame:
        schema = self.schema(self.program.relations[head.relation])
        if len(head.args) != len(schema):
            raise RuleError(f"{head.relation} has {len(schema)} columns")
        bound = {v: F.col(f"`{v}`") for v in body.columns}
        kinds = [k for _, k in self.program.relations[head.relation].columns]
        row = [self.term(a, bound, k).cast(f.dataType).alias(f.name) for a, f, k in zip(head.args, schema.fields, kinds, strict=True)]
        out = body.select(*row) if row else body.select(F.lit(1).alias("_one")).limit(1)
        for f, a in zip(schema.fields, head.args, strict=True):
            if isinstance(a, Call) and a.name != "nil":
                out = out.where(F.col(f"`{f.name}`").isNotNull())
        return out

    def _new(self, name: str, parts: list[DataFrame]) -> tuple[DataFrame, int, str]:
        """The tuples of the parts that the relation lacks, written."""
        store, relation = self.stored[name], self.program.relations[name]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if not relation.columns:
            out = out.limit(1)
        out = out.distinct()
        if store.paths:
            if relation.columns:
                out = out.join(store.all(), out.columns, "left_anti")
            else:
                out = out.limit(0)  # a stored relation without columns has its one tuple
        if relation.choice:
            keys = [c.lstrip("?") for c in relation.choice]
            w = Window.partitionBy(*keys).orderBy(*[c for c in out.columns])
            out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
            if store.paths:
                out = out.join(store.all().select(*keys), keys, "left_anti")
        return store.write(out)

    def _evaluate(self, group: list[str], delta: dict[str, DataFrame] | None = None) -> None:
        """Brings a stratum to its fixpoint. delta: new tuples of lower relations, when only what follows from them is to be added."""
        inside = set(group)
        rules = [r for r in self.program.rules if any(h.relation in inside for h in r.heads)]
        for name in group:
            if name not in self.stored:
                schema = self.schema(self.program.relations[name]) if self.program.relations[name].columns else T.StructType([T.StructField("_one", T.IntegerType())])
                self.stored[name] = self._store(name, schema)
        parts: dict[str, list[DataFrame]] = {r: [] for r in group}

        def fire(rule: Rule, deltas: dict[str, DataFrame] | None, first: int | None) -> list[tuple[str, DataFrame]]:
            body = self._rule(rule, inside, deltas, first)
            return [(h.relation, self._head(h, body)) for h in rule.heads if h.relation in inside]

        recursive = [[i for i, x in enumerate(r.body) if isinstance(x, Atom) and not x.negated and x.relation in inside] for r in rules]
        if delta is None:
            for name in group:
                if name in self.facts and not self._rowless(self.facts[name]):
                    parts[name].append(self._facts(name))
            firings = [(rule, None, None) for rule, inner in zip(rules, recursive, strict=True) if not inner]
        else:
            firings = [(rule, dict(delta), i) for rule in rules for i, x in enumerate(rule.body) if isinstance(x, Atom) and not x.negated and x.relation in delta]
            for name in group:
                if name in delta and name in self.facts:
                    parts[name].append(delta[name])
        number = 0
        with ThreadPoolExecutor(max_workers=WORKERS) as pool:
            while True:
                for found in pool.map(lambda f: fire(*f), [f for f in firings if not self._idle(*f)]):
                    for name, df in found:
                        parts[name].append(df)
                work = {r: p for r, p in parts.items() if p}
                counted = any(recursive) or delta is not None
                made = dict(zip(work, pool.map(lambda r: self._new(r, work[r]), work), strict=True))
                fresh = {r: df for r, (df, n, _) in made.items() if n}
                for r, df in fresh.items():
                    self.stored[r].add(made[r][2])
                    if delta is not None:
                        delta[r] = delta[r].unionByName(df) if r in delta else df
                self.rounds.append(Round(tuple(group), number, {r: n for r, (_, n, _) in made.items()} if counted else {}))
                if self.on_delta:
                    for r, df in fresh.items():
                        self.on_delta(r, df, number)
                if not fresh or not any(recursive):
                    return
                number += 1
                if number > self.most_rounds:
                    raise RuleError(f"no fixpoint of {group} after {self.most_rounds} rounds")
                parts = {r: [] for r in group}
                firings = [(rule, fresh, i) for rule, inner in zip(rules, recursive, strict=True) for i in inner if rule.body[i].relation in fresh]

    def run(self, *wanted: str) -> Result:
        """Evaluates what the wanted relations need (by default the outputs, or else everything)."""
        with self.running():
            return self._run(*wanted)

    def _run(self, *wanted: str) -> Result:
        wanted = wanted or tuple(self.program.outputs) or tuple(r for r in self.program.relations if r != ORDINALS)
        groups = [g for g in strata(self.program, wanted) if not all(r in self.stored or r in self.plain for r in g)]
        needs = {r: {u for q in self.program.rules for h in q.heads if h.relation == r for x in q.body for u, _ in used(x)} for g in groups for r in g}
        done: dict[str, Future] = {}
        self._settle({u for g in groups for r in g if self.keyed or needs[r] & set(g) for q in g for u in needs[q]})

        def evaluate_after(group: list[str], before: list[Future]) -> None:
            for f in before:
                f.result()
            self._evaluate(group)

        # groups come after what they need, so that a waiting one never holds up another
        with ThreadPoolExecutor(max_workers=PARALLEL) as pool:
            for group in groups:
                before = {id(done[u]): done[u] for r in group for u in needs[r] if u in done and u not in group}
                future = pool.submit(evaluate_after, group, list(before.values()))
                done |= dict.fromkeys(group, future)
            for f in done.values():
                f.result()
        return Result({r: self.relation(r) for r in wanted}, self.rounds)

    def stored_rows(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a relation, written to the shared folder."""
        schema = self.schema(self.program.relations[name])
        rows = rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, schema.fields, strict=True)))
        return Stored(self.spark, f"{name}-batch", schema).write(rows.distinct())[0]

    def insert(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Adds facts after a run and derives what follows. Relations that negate or aggregate anything that changed are evaluated anew."""
        with self.running():
            return self._insert(name, rows)

    def _insert(self, name: str, rows: DataFrame) -> dict[str, int]:
        schema = self.schema(self.program.relations[name])
        rows = rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, schema.fields, strict=True)))
        self.facts[name] = self.facts[name].unionByName(rows.toDF(*self.facts[name].columns)) if name in self.facts else rows
        if self.ordinals is not None and (new := leaves(rows)) is not None:
            self.ordinals.add(new)
        fact_only = name in self.plain
        if fact_only:
            self.plain[name] = self.plain[name].unionByName(rows).distinct()
            self.bare.discard(name)
            self.settled.discard(name)
        delta, changed = {name: rows}, {name}
        before = len(self.rounds)
        for group in strata(self.program, list(self.stored)):
            rules = [r for r in self.program.rules if any(h.relation in group for h in r.heads)]
            uses = {u for r in rules for x in r.body for u in used(x)}
            if any(whole and r in changed for r, whole in uses) or any(self.program.relations[r].choice for r in group):
                for r in group:
                    del self.stored[r]
                self._evaluate(group)
                # what went can't be taken back above, so those above are evaluated anew too
                changed.update(group)
                for r in self.program.relations:
                    if r in self.stored and any((g, w) in {u for q in self.program.rules for h in q.heads if h.relation == r for x in q.body for u in used(x)} for g in group for w in (True, False)):
                        changed.add(r)
                delta.update({r: self.relation(r) for r in group})
            elif any(r in delta for r, _ in uses) or name in group:
                self._evaluate(group, delta)
                changed.update(r for r in group if r in delta)
        found: dict[str, int] = {}
        for round_ in self.rounds[before:]:
            for r, n in round_.found.items():
                found[r] = found.get(r, 0) + n
        return found

    def _uses(self, group: list[str]) -> set[tuple[str, bool]]:
        return {u for r in self.program.rules if any(h.relation in group for h in r.heads) for x in r.body for u in used(x)}

    def _gone(self, name: str, rows: DataFrame, among: DataFrame, less: DataFrame | None = None) -> DataFrame | None:
        """The distinct rows that are in among and not in less, written; None if there are none."""
        rows = rows.distinct().join(among, among.columns, "left_semi")
        rows = rows if less is None else rows.join(less, less.columns, "left_anti")
        df, n, _ = Stored(self.spark, f"{name}-gone", among.schema, self.buckets if self.program.relations[name].columns else 0).write(rows)
        return df if n else None

    def _suspects(self, group: list[str], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Of a stratum's tuples all that have a derivation from a tuple that is gone, by rounds over the relations as they were."""
        rules = [r for r in self.program.rules if any(h.relation in group for h in r.heads)]
        out = {r: gone[r] for r in group if r in gone}
        front = dict(gone)
        while front:
            parts: dict[str, list[DataFrame]] = {}
            for rule in rules:
                for i, x in enumerate(rule.body):
                    if isinstance(x, Atom) and not x.negated and x.relation in front and not self._idle(rule, front, i):
                        body = self._rule(rule, set(group), front, i)
                        for h in rule.heads:
                            if h.relation in group:
                                parts.setdefault(h.relation, []).append(self._head(h, body))
            front = {}
            for name, found in parts.items():
                every = found[0]
                for p in found[1:]:
                    every = every.unionByName(p)
                new = self._gone(name, every, self.stored[name].all(), out.get(name))
                if new is not None:
                    front[name] = new
                    out[name] = out[name].unionByName(new) if name in out else new
        return out

    def delete(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Takes facts away after a run, and what no longer follows; gives how many tuples each relation lost.

        Delete and derive again: first, stratum by stratum, every tuple with a derivation from one that goes is suspect.
        Suspects are taken out, and those that the rest still derives (or that are facts themselves) come back by
        semi-naive rounds from the suspects alone. Strata that negate or aggregate a relation with suspects, those with
        choices, and what depends on them are evaluated anew.
        """
        with self.running():
            return self._delete(name, rows)

    def _delete(self, name: str, rows: DataFrame) -> dict[str, int]:
        schema = self.schema(self.program.relations[name])
        rows = rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, schema.fields, strict=True)))
        if name not in self.facts:
            return {}
        rows = self._gone(name, rows, self.given(name).distinct())
        if rows is None:
            return {}
        order = [g for g in strata(self.program, list(self.stored)) if any(r in self.stored and r not in self.plain for r in g)]
        gone, again = {name: rows}, set()
        if name not in self.plain:
            gone = {n: df for n in (name,) if (df := self._gone(n, rows, self.stored[n].all())) is not None}
        for group in order:
            uses = self._uses(group)
            if any(r in again or whole and r in gone for r, whole in uses) or any(r in gone for r, _ in uses | {(g, True) for g in group}) and any(self.program.relations[r].choice for r in group):
                again.update(group)
            elif any(r in gone for r, _ in uses) or any(r in gone for r in group):
                gone |= self._suspects(group, gone)
        left = self.given(name).join(rows, rows.columns, "left_anti")
        self.facts[name] = Stored(self.spark, f"{name}-left", schema, self.buckets).write(left)[0]
        if name in self.plain:
            self.plain[name] = self.facts[name].distinct()
            self.settled.discard(name)
            self.bare |= {name} if self.plain[name].isEmpty() else set()
        lost: dict[str, int] = {name: rows.count()} if name in self.plain else {}
        for group in order:
            if again & set(group):
                before = {r: self.stored.pop(r).all() for r in group}
                self._evaluate(group)
                lost |= {r: df.join(self.stored[r].all(), df.columns, "left_anti").count() for r, df in before.items() if df.columns}
                continue
            suspects = {r: gone[r] for r in group if r in gone}
            for r, df in suspects.items():
                self.stored[r].take(df)
            self._derive_again(group, suspects)
            for r, df in suspects.items():
                lost[r] = df.join(self.stored[r].all(), df.columns, "left_anti").count()
        return {r: n for r, n in lost.items() if n}

    def _derive_again(self, group: list[str], suspects: dict[str, DataFrame]) -> None:
        """Puts the suspects back that follow from what is left of the stratum, or are facts."""
        back: dict[str, list[DataFrame]] = {r: [] for r in suspects}
        for rule in self.program.rules:
            for h in rule.heads:
                if h.relation in suspects and not self._idle(rule, None, None):
                    wanted = suspects[h.relation]
                    plain = [(a.name, c) for a, c in zip(h.args, wanted.columns, strict=True) if isinstance(a, Var)]
                    seed = wanted.select(*(F.col(f"`{c}`").alias(v) for v, c in dict(plain).items())).distinct() if plain and rule.body else None
                    tables = [self.relation(x.relation) if isinstance(x, Atom) else None for x in rule.body]
                    body = self.body(rule.body, tables, variables(h), seed=seed, types=self.types_of(rule.body, rule.heads))
                    back[h.relation].append(self._head(h, body))
        delta: dict[str, DataFrame] = {}
        for r, wanted in suspects.items():
            if r in self.facts:
                back[r].append(self.given(r))
            if back[r]:
                every = back[r][0]
                for p in back[r][1:]:
                    every = every.unionByName(p)
                df = self._gone(r, every, wanted)
                if df is not None:
                    delta[r] = df
        for r, df in delta.items():
            self.stored[r].add(self.stored[r].write(df)[2])
        if delta and any(r in delta for r, _ in self._uses(group)):
            self._evaluate(group, delta)


def evaluate(spark: SparkSession, text: str, facts: dict[str, DataFrame], *wanted: str, defined: set[str] | None = None) -> Result:
    return Engine(spark, text, facts, defined).run(*wanted)
