"""Named relations: every operator outside streaming is one declarative SQL relation.

A relation is a function from a dialect to a SELECT over other relations. Spark resolves all
that a relation needs one after the other and plans (prunes, pushes down and reuses) the
whole of it at once; for an ANSI engine the same definitions are chained as common table
expressions, as an oracle. What differs between engines is in the dialect alone.

Relations stay linear where they can: columns are added to one wide row rather than
joined back, and nothing filters or joins on a computed column below an aggregate or a
window, since Catalyst would push the predicate down with the whole computation in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are dealt out by a key once, where what is said of the key's values meets.
DEALT = {"orders": "o_orderkey", "lineitem": "l_orderkey"}

#: Rows of an array that a recurrence is appended to a row at a time.
CHUNK = 128

#: What counts as white space.
WHITE = r"[ \t-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    """Spark SQL."""

    spark = True

    def tokens(self, text, pattern):
        return f"regexp_extract_all({text}, '{pattern}', 0)"

    def keep(self, array, cond):
        return f"filter({array}, x -> {cond})"

    def map(self, array, expr):
        return f"transform({array}, x -> {expr})"

    def zip(self, a, b, expr):
        """expr of x and y, the values of two arrays at each place; null where one ends."""
        return f"zip_with({a}, {b}, (x, y) -> {expr})"

    def sum_of(self, array):
        return f"aggregate({array}, 0e0, (a, x) -> a + x)"

    def max_of(self, array):
        return f"array_max({array})"

    def any(self, array, cond):
        return f"exists({array}, x -> {cond})"

    def size(self, array):
        return f"size({array})"

    def join(self, array, sep):
        return f"array_join({array}, '{sep}')"

    def common(self, a, b):
        return f"size(array_intersect({a}, {b}))"

    def union_size(self, a, b):
        return f"size(array_union({a}, {b}))"

    def distinct(self, a):
        return f"array_distinct({a})"

    def contains_item(self, array, item):
        return f"array_contains({array}, {item})"

    def strings(self, *values):
        return "array(" + ", ".join(quote(v) for v in values) + ")"

    def each(self, array, var, expr):
        """expr of each value, under a name of its own: may stand inside another."""
        return f"transform({array}, {var} -> {expr})"

    def once(self, column, expr):
        """expr, in whose lambdas the column is a value worked out once a row: Catalyst puts a
        computed column's expression in its place, also where it is asked for each element."""
        return f"transform(array({column}), {column} -> {expr})[0]"

    def fold(self, array, first, acc, var, expr):
        return f"aggregate({array}, {first}, ({acc}, {var}) -> {expr})"

    def min_of(self, array):
        return f"array_min({array})"

    def array(self, *values):
        return f"array({', '.join(values)})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"

    def append(self, array, value):
        return f"concat({array}, array({value}))"

    def joined(self, *arrays):
        return f"concat({', '.join(arrays)})"

    def no_strings(self):
        return "cast(array() as array<string>)"

    def agg_list(self, value, order):
        return f"transform(array_sort(collect_list(struct({order} as k, {value} as v))), x -> x.v)"

    def agg_text(self, value, sep, *order):
        keys = ", ".join(f"{o} as k{i}" for i, o in enumerate(order))
        return f"array_join(transform(array_sort(collect_list(struct({keys}, {value} as v))), x -> x.v), '{sep}')"

    def unnest(self, source, array, alias):
        return f"(select * from {source} lateral view explode({array}) _t as {alias}) _u"

    def unnest_at(self, source, array, alias, at):
        """Elements and their places from 1."""
        return f"(select *, cast(_at + 1 as int) as {at} from {source} lateral view posexplode({array}) _t as _at, {alias}) _u"

    def seconds(self, ts):
        return f"(unix_micros(cast({ts} as timestamp)) / 1e6)"

    def split(self, text, pattern):
        return f"split({text}, '{pattern}')"

    def replace(self, text, pattern, by):
        return f"regexp_replace({text}, '{pattern}', '{by}')"

    def strip(self, text):
        """Without white space (all that Unicode knows) at both ends."""
        white = WHITE.replace("\\", "\\\\") if self.spark else WHITE
        return self.replace(text, f"^{white}|{white}$", "")

    def cut(self, text, pattern, group):
        """Parts of a text: cut where the pattern matches, but for its group 1, which stays."""
        pattern, by = (pattern.replace("\\", "\\\\"), "$1") if self.spark else (pattern, "\\1")
        return self.split(f"regexp_replace({text}, '{pattern}', concat('{by}', chr(1)){'' if self.spark else ", 'g'"})", "\x01")

    def matches(self, text, pattern):
        return f"({text} rlike '{pattern}')"

    def extract(self, text, pattern, group):
        return f"regexp_extract({text}, '{pattern}', {group})"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def last_known(self, value, over):
        return f"last_value({value}) ignore nulls over ({over})"

    def element(self, array, i):
        return f"get({array}, ({i}) - 1)"

    def half_even(self, x):
        """Rounded to a whole number, halves to the even one."""
        return f"rint({x})"

    def round(self, x, n):
        """Rounded to n places as DuckDB does, by the product with 10^n: Spark's own round goes
        by the decimal digits of the shortest text of the number and differs next to halves."""
        return f"(round(({x}) * 1e{n}) / 1e{n})"

    def decoded(self, x):
        """A text with its percent escapes decoded; null where they are not valid."""
        return f"try_url_decode(replace({x}, '+', '%2B'))"

    def bytes(self, x):
        return f"octet_length({x})"

    def mod(self, a, b):
        return f"pmod({a}, {b})"

    def slice(self, array, start, n):
        return f"slice({array}, {start}, {n})"

    def range(self, a, b):
        return f"case when {b} >= {a} then sequence({a}, {b}) else cast(array() as array<int>) end"

    def hex2(self, x):
        return f"lower(lpad(hex({x}), 2, '0'))"

    def scan(self, source, keys, at, fields, state):
        """Rows of `source`, numbered by `at` from 1 within the keys, each with a state that
        depends on the state of the row before. state: name -> (type, first, step), where x.
        is the row (of which `fields` are used) and s. the state before."""
        kind = ", ".join([f"{at}:int", *(f"{n}:{t}" for n, (t, _, _) in state.items())])
        first = ", ".join(f"cast({f} as {t}) as {n}" for n, (t, f, _) in state.items())
        before = lambda e: re.sub(r"\bs\.", "get(b, size(b) - 1).", e)
        step = ", ".join(f"cast({before(e)} as {t}) as {n}" for n, (t, _, e) in state.items())
        items = f"array_sort(collect_list(struct(cast({at} as int) as {at}, {', '.join(fields)})))"
        # appending copies an array, so rows are appended to arrays of CHUNK rows, and these to the whole
        last = "case when size(a) = 0 then a else slice(a, size(a), 1) end"
        chunk = f"aggregate(c, {last}, (b, x) -> concat(b, array(case when size(b) = 0 then struct(x.{at} as {at}, {first}) else struct(x.{at} as {at}, {step}) end)))"
        chunks = f"transform(sequence(0, cast((size(items) - 1) / {CHUNK} as int)), i -> slice(items, i * {CHUNK} + 1, {CHUNK}))"
        walk = f"aggregate({chunks}, cast(array() as array<struct<{kind}>>), (a, c) -> concat(a, slice({chunk}, case when size(a) = 0 then 1 else 2 end, {CHUNK})))"
        own = ", ".join(keys)
        return f"select {own}, {', '.join(f'r.{n} as {n}' for n in (at, *state))} from (select {own}, {walk} as rows from (select {own}, {items} as items from {source} group by {own})) lateral view explode(rows) t as r"

    def values(self, name, columns, rows):
        body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
        return f"select * from values {body} as {name}({', '.join(columns)})"


class Duck(Spark):
    """DuckDB SQL, for oracles."""

    spark = False

    def tokens(self, text, pattern):
        return f"regexp_extract_all({text}, '{pattern}')"

    def keep(self, array, cond):
        return f"list_filter({array}, lambda x: {cond})"

    def map(self, array, expr):
        return f"list_transform({array}, lambda x: {expr})"

    def zip(self, a, b, expr):
        return f"list_transform(list_zip({a}, {b}), lambda z: {re.sub(r'\b([xy])\b', lambda m: f'z[{1 + (m[1] == 'y')}]', expr)})"

    def sum_of(self, array):
        return f"list_sum({array})"

    def max_of(self, array):
        return f"list_max({array})"

    def any(self, array, cond):
        return f"(len(list_filter({array}, lambda x: {cond})) > 0)"

    def size(self, array):
        return f"len({array})"

    def join(self, array, sep):
        return f"array_to_string({array}, '{sep}')"

    def common(self, a, b):
        return f"len(list_distinct(list_intersect({a}, {b})))"

    def union_size(self, a, b):
        return f"len(list_distinct(list_concat({a}, {b})))"

    def distinct(self, a):
        return f"list_distinct({a})"

    def contains_item(self, array, item):
        return f"list_contains({array}, {item})"

    def strings(self, *values):
        return "[" + ", ".join(quote(v) for v in values) + "]"

    def each(self, array, var, expr):
        return f"list_transform({array}, lambda {var}: {expr})"

    def once(self, column, expr):
        return expr

    def fold(self, array, first, acc, var, expr):
        return f"list_reduce({array}, lambda {acc}, {var}: {expr}, {first})"

    def min_of(self, array):
        return f"list_min({array})"

    def array(self, *values):
        return f"[{', '.join(values)}]"

    def struct(self, **fields):
        return "struct_pack(" + ", ".join(f"{n} := {e}" for n, e in fields.items()) + ")"

    def append(self, array, value):
        return f"list_concat({array}, [{value}])"

    def joined(self, *arrays):
        return arrays[0] if len(arrays) == 1 else f"list_concat({arrays[0]}, {self.joined(*arrays[1:])})"

    def no_strings(self):
        return "cast([] as varchar[])"

    def agg_list(self, value, order):
        return f"list({value} order by {order})"

    def agg_text(self, value, sep, *order):
        return f"string_agg({value}, '{sep}' order by {', '.join(order)})"

    def unnest(self, source, array, alias):
        return f"(select *, unnest({array}) as {alias} from {source}) _u"

    def unnest_at(self, source, array, alias, at):
        return f"(select *, unnest({array}) as {alias}, cast(unnest(range(1, len({array}) + 1)) as int) as {at} from {source}) _u"

    def seconds(self, ts):
        return f"(epoch_us({ts}) / 1e6)"

    def split(self, text, pattern):
        return f"regexp_split_to_array({text}, '{pattern}')"

    def replace(self, text, pattern, by):
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def matches(self, text, pattern):
        return f"regexp_matches({text}, '{pattern}')"

    def extract(self, text, pattern, group):
        return f"regexp_extract({text}, '{pattern}', {group})"

    def sha256(self, x):
        return f"sha256({x})"

    def last_known(self, value, over):
        return f"last_value({value} ignore nulls) over ({over})"

    def element(self, array, i):
        return f"list_extract({array}, cast({i} as bigint))"

    def half_even(self, x):
        return f"round_even({x}, 0)"

    def round(self, x, n):
        return f"round({x}, {n})"

    def decoded(self, x):
        return f"url_decode({x})"

    def bytes(self, x):
        return f"octet_length(encode({x}))"

    def mod(self, a, b):
        return f"((({a}) % ({b}) + ({b})) % ({b}))"

    def slice(self, array, start, n):
        return f"list_slice({array}, {start}, {start} + {n} - 1)"

    def range(self, a, b):
        return f"range({a}, {b} + 1)"

    def scan(self, source, keys, at, fields, state):
        own = ", ".join(f"x.{k}" for k in keys)
        first = ", ".join(f"cast({f} as {t}) as {n}" for n, (t, f, _) in state.items())
        step = ", ".join(f"cast({e} as {t}) as {n}" for n, (t, _, e) in state.items())
        same = " and ".join(f"x.{k} = s.{k}" for k in keys)
        return f"with recursive walk as (select {own}, cast(x.{at} as int) as {at}, {first} from {source} x where x.{at} = 1 union all select {own}, cast(x.{at} as int) as {at}, {step} from walk s join {source} x on {same} and x.{at} = s.{at} + 1) select * from walk"

    def values(self, name, columns, rows):
        body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
        return f"select * from (values {body}) as {name}({', '.join(columns)})"


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}e0"
    return str(v) if isinstance(v, int) else quote(v)


@dataclass(frozen=True)
class Relation:
    name: str
    inputs: tuple[str, ...]
    sql: Callable
    public: bool
    doc: str
    dealt: bool = False


RELATIONS: dict[str, Relation] = {}
#: Shorter ways of Spark to the rows of a relation: inputs and SQL.
SHORTER: dict[str, tuple[tuple[str, ...], Callable]] = {}


def relation(*inputs: str, public: bool = True, name: str | None = None, dealt: bool = False):
    """Registers a function from a dialect to SQL over `inputs` under its own name. dealt: much
    of what it is built from meets by the key of a table, so the table is dealt out by it first."""

    def add(f):
        own = name or f.__name__
        RELATIONS[own] = Relation(own, inputs, f, public, f.__doc__ or "", dealt)
        return f

    return add


def shorter(name: str, *inputs: str):
    """Registers a way to the rows of a relation over other relations than its own inputs, one
    that works out less again. Spark goes it where none of those it passes by is given."""

    def add(f):
        SHORTER[name] = inputs, f
        return f

    return add


def plain(name: str, given: frozenset[str]) -> tuple[tuple[str, ...], Callable]:
    return RELATIONS[name].inputs, RELATIONS[name].sql


def shortest(name: str, given: frozenset[str]) -> tuple[tuple[str, ...], Callable]:
    """Inputs and SQL of a relation, by the shorter way where there is one."""
    if name in SHORTER and given.isdisjoint(set(needed(name)).difference(*map(needed, SHORTER[name][0]))):
        return SHORTER[name]
    return plain(name, given)


def needed(name: str, given: frozenset[str] = frozenset(), way: Callable = plain) -> list[str]:
    """The relations below `name`, and itself, inputs first."""
    out: list[str] = []

    def visit(n):
        if n in out or n in TABLES or n in given:
            return
        for i in way(n, given)[0]:
            visit(i)
        out.append(n)

    visit(name)
    return out


def render(name: str, dialect: Spark, sources: dict[str, str] | None = None) -> str:
    """One statement. sources: SQL for base tables (or relations) given from outside."""
    sources = sources or {}
    chain = needed(name, frozenset(sources))
    used = {i for n in chain for i in RELATIONS[n].inputs}
    parts = [f"{t} as ({q})" for t, q in sources.items() if t in used]
    once = "" if dialect.spark else "materialized "  # an oracle may hold what several relations read
    parts += [f"{n} as {once}({RELATIONS[n].sql(dialect).strip()})" for n in chain]
    return "with " + ",\n".join(parts) + f"\nselect * from {name}"


def frame(name: str, spark: SparkSession, given: dict[str, DataFrame]) -> DataFrame:
    """The relation over given DataFrames. Relations are resolved one after the other, so that
    the depth of a chain does not count against the analyzer's limit; Catalyst still plans
    the whole of it."""
    known, own = dict(given), frozenset(given)
    chain = needed(name, own, shortest)
    if any(RELATIONS[n].dealt for n in chain):
        known |= {t: known[t].repartition(k) for t, k in DEALT.items() if t in known}
    for n in chain:
        inputs, sql = shortest(n, own)
        text = sql(Spark()).strip()
        if inputs:
            text = text.replace("{", "{{").replace("}", "}}")
            text = re.sub(rf"\b(from|join) ({'|'.join(inputs)})\b", r"\1 {\2}", text)
            known[n] = spark.sql(text, **{i: known[i] for i in inputs})
        else:
            known[n] = spark.sql(text)
    return known[name]


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = sorted({i for n in needed(name) for i in RELATIONS[n].inputs if i in TABLES})
        return frame(name, spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    run.__name__, run.__doc__ = name, RELATIONS[name].doc
    return run


def apply(name: str, spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """The relation over given DataFrames: base tables, or any relation it is built from."""
    return frame(name, spark, frames)


def oracle(name: str) -> str:
    return render(name, Duck())
