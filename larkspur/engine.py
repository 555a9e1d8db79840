"""The engine: databases of tables (immutable DataFrames), SQL over them, PromQL, search requests, transactions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from itertools import islice
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import scalar as S
from larkspur.operators import geo as G
from larkspur.operators import relational as R
from larkspur.operators import search as Q
from larkspur.operators import timeseries as TS
from larkspur.operators import vector as V
from larkspur.plans import promql as P
from larkspur.plans import sql as A
from larkspur.sources.shared import shared_dir

EMPTY = T.StructType([])
#: Statements on one table after which its rows are written out.
DEPTH = 16


@dataclass(frozen=True)
class Table:
    """A table's rows and what its statements declared."""

    name: str
    rows: DataFrame
    pk: tuple[str, ...] = ()
    series: tuple[str, ...] = ()
    retention: int | None = None
    ooo: int = 0
    ttl: int | None = None
    options: dict = field(default_factory=dict)
    #: When rows without a stamp of their own count as written.
    made: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    #: Statements whose plans stand on one another since the rows were last written out.
    depth: int = 0

    @property
    def timeseries(self) -> bool:
        return bool(self.series)


@dataclass(frozen=True)
class IndexDef:
    kind: str
    name: str
    table: str
    columns: tuple[str, ...]
    options: dict


class Engine:
    """Sessions share nothing: each Engine has its own catalog, and a transaction is a copy of it."""

    def __init__(self, spark: SparkSession, embedder=None, reranker=None):
        self.spark, self.embedder, self.reranker = spark, embedder, reranker
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, IndexDef] = {}
        self.rollups: dict[str, dict] = {}
        self.built: dict[str, tuple] = {}
        self.databases, self.database = {"default"}, "default"
        self.saved: tuple | None = None
        self.now_ms: int | None = None

    # catalog

    def key(self, name: str) -> str:
        if "." in name and name.split(".")[0] in self.databases:
            db, name = name.split(".", 1)
            return name if db == "default" else f"{db}.{name}"
        return name if self.database == "default" else f"{self.database}.{name}"

    def register(self, name: str, rows: DataFrame, pk: tuple[str, ...] | list[str] = (), series: tuple[str, ...] | list[str] = (), **more) -> Table:
        """Makes a DataFrame a table."""
        self.tables[self.key(name)] = out = Table(name, rows, tuple(pk), tuple(series), **more)
        return out

    def table(self, name: str) -> Table:
        got = self.tables.get(self.key(name))
        if got is None:
            raise KeyError(f"no table {name}")
        return got

    def rows(self, name: str) -> DataFrame:
        """What a reader sees: rows within their time to live and retention."""
        t = self.table(name)
        rows = self.alive(t)
        if t.retention and "ts" in rows.columns:
            rows = TS.retained(rows, t.retention)
        return rows.drop("_written_at")

    def alive(self, t: Table) -> DataFrame:
        """Rows, with their stamps, that the time to live has left; the clock is read when the rows are."""
        if not t.ttl or not t.rows.columns:
            return t.rows
        return R.with_ttl(t.rows if "_written_at" in t.rows.columns else t.rows.withColumn("_written_at", F.lit(t.made)), "_written_at", t.ttl, F.current_timestamp())

    def put(self, table: str, t: Table, rows: DataFrame) -> None:
        """A table's next version; after DEPTH statements the rows are written out, so that plans don't grow with the number of statements."""
        t = replace(t, rows=rows, depth=t.depth + 1)
        if t.depth >= DEPTH and not any(isinstance(f.dataType, T.NullType) for f in rows.schema):
            path = f"{shared_dir(self.spark)}/larkspur/tables/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            t = replace(t, rows=self.spark.read.schema(rows.schema).parquet(path), depth=0)
        if t.options.get("memory"):
            held = self.tables[self.key(table)].rows
            t = replace(t, rows=t.rows.persist(StorageLevel.MEMORY_AND_DISK))
            t.rows.count()
            held.unpersist()
        self.tables[self.key(table)] = t

    # statements

    def sql(self, text: str, *params: Any) -> DataFrame:
        return self.run(A.parse(text, params))

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """A statement to run again and again with other parameters."""
        A.parse(text, (None,) * text.count("?"))  # refused now rather than at its first run
        return lambda *params: self.sql(text, *params)

    def batch(self, *statements: str | tuple) -> list[DataFrame]:
        """Statements one after another, each a text or a text with its parameters; the first that fails ends it."""
        return [self.sql(s) if isinstance(s, str) else self.sql(*s) for s in statements]

    def stream(self, text: str, *params: Any, chunk: int = 1000) -> Iterator[list]:
        """First the columns' names, then the rows in chunks; one partition is here at a time."""
        df = self.sql(text, *params)
        yield df.columns
        rows = df.toLocalIterator(prefetchPartitions=True)
        while part := [tuple(r) for r in islice(rows, chunk)]:
            yield part

    def run(self, s: Any) -> DataFrame:
        self.now_ms = None
        if isinstance(s, A.Select):
            return self.select(s)
        return getattr(self, f"do_{s.kind}")(**s.args)

    def done(self, affected: int | None = None) -> DataFrame:
        return self.spark.createDataFrame([(affected,)], "affected long")

    def do_create_database(self, name: str) -> DataFrame:
        self.databases.add(name)
        return self.done()

    def do_use(self, name: str) -> DataFrame:
        if name not in self.databases:
            raise KeyError(f"no database {name}")
        self.database = name
        return self.done()

    def do_create_table(self, table: str, pk: list[str], quiet: bool, options: dict) -> DataFrame:
        if self.key(table) in self.tables:
            if quiet:
                return self.done()
            raise ValueError(f"{table} exists")
        self.register(table, self.spark.createDataFrame([], EMPTY), pk, ttl=options.get("ttl"), options=options)
        return self.done()

    def do_create_timeseries(self, table: str, series: list[str], retention: int | None, ooo: int) -> DataFrame:
        self.register(table, self.spark.createDataFrame([], EMPTY), (), series, retention=retention, ooo=ooo)
        return self.done()

    def do_create_rollup(self, name: str, table: str, step: int, retention: int | None) -> DataFrame:
        t = self.table(table)
        self.rollups[name] = {"table": table, "step": step, "retention": retention}
        fields = [c for c in t.rows.columns if c not in (*t.series, "ts")]
        self.register(name, TS.rollup(t.rows, t.series, fields, step).withColumnRenamed("bucket", "ts"), (), t.series, retention=retention)
        return self.done()

    def do_create_index(self, kind: str, name: str, table: str, columns: list[str], options: dict) -> DataFrame:
        self.table(table)
        self.indexes[name] = IndexDef(kind, name, table, tuple(columns), options)
        return self.done()

    def do_set_index(self, kind: str, name: str, options: dict) -> DataFrame:
        ix = self.indexes[name]
        self.indexes[name] = replace(ix, options={**ix.options, **options})
        return self.done()

    def do_set_options(self, table: str, options: dict) -> DataFrame:
        t = self.table(table)
        known = {k: v for k, v in options.items() if k in ("ttl", "retention", "ooo")}
        self.tables[self.key(table)] = replace(t, options={**t.options, **options}, **known)
        return self.done()

    def do_drop(self, kind: str, name: str) -> DataFrame:
        if kind == "database":
            self.databases.discard(name)
            self.tables = {k: t for k, t in self.tables.items() if not k.startswith(f"{name}.")}
        elif kind in ("table", "rollup"):
            self.tables.pop(self.key(name), None)
            self.rollups.pop(name, None)
        else:
            self.indexes.pop(name, None)
        return self.done()

    def do_rename_table(self, table: str, to: str) -> DataFrame:
        self.tables[self.key(to)] = replace(self.tables.pop(self.key(table)), name=to)
        return self.done()

    def do_rename_column(self, table: str, old: str, new: str) -> DataFrame:
        t = self.table(table)
        swap = lambda names: tuple(new if x == old else x for x in names)
        self.tables[self.key(table)] = replace(t, rows=t.rows.withColumnRenamed(old, new), pk=swap(t.pk), series=swap(t.series))
        return self.done()

    def do_show(self, what: str) -> DataFrame:
        found = {
            "tables": lambda: [(k, "timeseries" if t.timeseries else "table") for k, t in sorted(self.tables.items())],
            "indexes": lambda: [(i.name, f"{i.kind} on {i.table}({', '.join(i.columns)})") for i in self.indexes.values()],
            "databases": lambda: [(d, "") for d in sorted(self.databases)],
            "status": lambda: [("tables", str(len(self.tables))), ("indexes", str(len(self.indexes)))],
        }
        return self.spark.createDataFrame(found[what](), "name string, detail string")

    def do_describe(self, table: str, full: bool) -> DataFrame:
        t = self.table(table)
        if full:
            return R.describe_types(self.rows(table))
        keyed = [(c, "primary key") for c in t.pk] + [(c, "series key") for c in t.series] + [(c, f"{i.kind} index {i.name}") for i in self.indexes.values() if i.table == table for c in i.columns]
        return self.spark.createDataFrame(keyed, "column string, role string")

    def do_explain(self, of: Any) -> DataFrame:
        """aspect and decision of a statement, which is planned and not run; of a SELECT, also Spark's physical plan."""
        out: list[tuple[str, str]] = []
        if isinstance(of, A.Select):
            out += [("statement", "select"), ("table", of.table or "none"), ("access", self.access(of.table, of.where, of))]
            out += [("join", f"{j.kind} {j.table}") for j in of.joins]
            out += [("group", f"{len(of.group)} keys")] if of.group else []
            out += [("top", f"{of.top[0]} a group")] if of.top else []
            out += [("order", f"{len(of.order)} keys, ties by primary key")] if of.order else []
            out += [("limit", f"{of.limit} after {of.offset}")] if of.limit is not None else []
            plan = self.select(of)._jdf.queryExecution().sparkPlan().toString()
            out += [("plan", line.rstrip()) for line in plan.splitlines() if line.strip()]
        elif of.kind in ("insert", "update", "delete"):
            out += [("statement", of.kind), ("table", of.args["table"])]
            out += [] if of.kind == "insert" else [("access", self.access(of.args["table"], of.args["where"], None))]
        else:
            raise ValueError("EXPLAIN takes SELECT, INSERT, UPDATE or DELETE")
        return self.spark.createDataFrame(out, "aspect string, decision string")

    def access(self, table: str | None, where: Any, s: A.Select | None) -> str:
        """How a table's rows are found."""
        if table is None:
            return "no table"
        t, parts = self.table(table), A.conjuncts(where)
        mine = [i for i in self.indexes.values() if i.table == table]
        if s is not None and s.nearest:
            path = s.nearest[0]
            ix = next((i.name for i in mine if i.kind == "vector" and path in i.columns), None)
            return f"nearest {s.nearest[2]} by {f'vector index {ix}' if ix else 'exact scan'}"
        if any(isinstance(y, A.Func) and y.name in A.SEARCH for x in parts for y in A.walk(x)):
            ix = next((i.name for i in mine if i.kind == "search"), "none")
            if s is not None and (s.group or any(isinstance(x, A.Func) and x.name in A.AGGREGATES for i in s.items for x in A.walk(i.expr))):
                return f"search index {ix}: aggregation"
            ranked = s is not None and s.limit is not None and any(isinstance(x, A.Func) and x.name == "score" for e, _ in s.order for x in A.walk(e))
            return f"search index {ix}: {'BM25 top-k' if ranked else 'matching keys'}"
        equal = {p.left.path for p in parts if isinstance(p, A.Bin) and p.op == "=" and isinstance(p.left, A.Col) and isinstance(p.right, A.Lit)}
        within = {p.arg.path: len(p.items) for p in parts if isinstance(p, A.In) and not p.negated and isinstance(p.arg, A.Col)}
        some = {p.left.path for p in parts if isinstance(p, A.Bin) and p.op in ("<", "<=", ">", ">=") and isinstance(p.left, A.Col)} | {p.arg.path for p in parts if isinstance(p, A.Between) and isinstance(p.arg, A.Col)}
        if t.pk and set(t.pk) <= equal:
            return f"point read by primary key ({', '.join(t.pk)})"
        if t.pk and set(t.pk) <= equal | set(within):
            return f"point reads by primary key ({', '.join(t.pk)})"
        if t.pk and t.pk[0] in equal | some:
            return f"slice of primary key ({', '.join(t.pk)})"
        for i in mine:
            if i.kind == "plain" and i.columns[0] in equal | some | set(within):
                return f"index {i.name} on ({', '.join(i.columns)})"
        return "time and series filter" if t.timeseries and (some & {"ts"} or equal & set(t.series)) else "full table scan"

    def do_begin(self) -> DataFrame:
        self.saved = dict(self.tables), dict(self.indexes)
        return self.done()

    def do_commit(self) -> DataFrame:
        self.saved = None
        return self.done()

    def do_rollback(self) -> DataFrame:
        if self.saved:
            self.tables, self.indexes = self.saved
        self.saved = None
        return self.done()

    def do_backup(self, path: str) -> DataFrame:
        meta = {}
        for k, t in self.tables.items():
            if t.rows.columns:
                t.rows.write.mode("overwrite").parquet(f"{path}/{k}")
            meta[k] = {"pk": t.pk, "series": t.series, "retention": t.retention, "ooo": t.ooo, "ttl": t.ttl, "rows": bool(t.rows.columns)}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_catalog")
        return self.done()

    def do_restore(self, path: str) -> DataFrame:
        meta = json.loads(self.spark.read.text(f"{path}/_catalog").first()[0])
        for k, m in meta.items():
            rows = self.spark.read.parquet(f"{path}/{k}") if m.pop("rows") else self.spark.createDataFrame([], EMPTY)
            self.tables[k] = Table(k, rows, tuple(m["pk"]), tuple(m["series"]), m["retention"], m["ooo"], m["ttl"])
        return self.done()

    # writes

    def do_insert(self, table: str, columns: list[str], rows: list[list]) -> DataFrame:
        t, low = self.table(table), Lower(self, None)
        cells = [[low.expr(e) for e in row] for row in rows]
        types = [_common_type([row[k][1] for row in cells]) for k in range(len(columns))]
        if all(types) and "_seq" not in columns:
            # one frame for all rows: a plan of one line, whatever their number
            each = [F.struct(*(c.cast(t).alias(f"c{k}") for k, ((c, _), t) in enumerate(zip(row, types, strict=True))), F.lit(n).alias("_seq")) for n, row in enumerate(cells)]
            new = self.spark.range(1).select(F.inline(F.array(*each))).toDF(*columns, "_seq")
        else:
            made = [self.spark.range(1).select(*(c.alias(name) for name, (c, _) in zip(columns, row, strict=True)), F.lit(n).alias("_seq")) for n, row in enumerate(cells)]
            new = made[0]
            for m in made[1:]:
                new = _union_wide(new, m)
        return self.append(table, new, t, len(rows))

    def append(self, table: str, new: DataFrame, t: Table | None = None, n: int | None = None) -> DataFrame:
        """Adds rows (n, if known) with `_seq`: an upsert by primary key, or samples of a time-series table."""
        t = t or self.table(table)
        if t.timeseries:
            TS.validate({c: k for c, k in new.dtypes if c != "_seq"}, t.series)
            if new.where(" or ".join(f"{c} is null" for c in (*t.series, "ts"))).count():
                raise ValueError("labels and ts are required")
            old = t.rows.withColumn("_seq", F.lit(-1)) if t.rows.columns else None
            both = new if old is None else _union_wide(old, new)
            marked = TS.accepted(both.withColumn("_t", F.timestamp_millis(S.millis(F.col("ts"), both.schema["ts"].dataType).cast("long"))), t.series, "_t", "_seq", max(t.ooo, 0))
            keep = marked.where((F.col("_seq") < 0) | F.col("accepted")).drop("_t", "accepted")
            affected = keep.where("_seq >= 0").count()
            fields = [c for c in keep.columns if c not in (*t.series, "ts", "_seq")]
            rows = keep.groupBy(*t.series, "ts").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_seq"))).alias(f) for f in fields))
            self.put(table, t, rows)
            return self.done(affected)
        if missing := [p for p in t.pk if p not in new.columns]:
            raise ValueError(f"the primary key needs {missing}")
        n = new.count() if n is None else n
        new = new.withColumn("_written_at", F.lit(datetime.now(timezone.utc)))
        last = F.row_number().over(W.partitionBy(*t.pk).orderBy(F.col("_seq").desc()))
        new = new.withColumn("_last", last).where("_last = 1").drop("_last", "_seq")
        old = t.rows
        if old.columns and "_written_at" not in old.columns:
            old = old.withColumn("_written_at", F.lit(t.made))
        self.put(table, t, new if not old.columns else _union_wide(old.join(new.select(*t.pk), list(t.pk), "left_anti"), new))
        return self.done(n)

    def do_update(self, table: str, sets: dict, where: Any) -> DataFrame:
        t = self.table(table)
        if t.timeseries:
            raise ValueError("time-series rows are not updated")
        rows = self.alive(t)
        low = Lower(self, rows)
        hit = low.expr(where)[0] if where is not None else F.lit(True)
        n = rows.where(F.coalesce(hit, F.lit(False))).count()
        changes = {p: low.expr(e)[0] for p, e in sets.items()}
        if "_written_at" in rows.columns:
            changes["_written_at"] = F.lit(datetime.now(timezone.utc))
        self.put(table, t, R.update(rows, changes, hit))
        return self.done(n)

    def do_delete(self, table: str, where: Any) -> DataFrame:
        t = self.table(table)
        if t.timeseries:
            raise ValueError("time-series rows are not deleted")
        rows = self.alive(t)
        hit = Lower(self, rows).expr(where)[0] if where is not None else F.lit(True)
        n = rows.where(F.coalesce(hit, F.lit(False))).count()
        self.put(table, t, R.delete(rows, hit))
        return self.done(n)

    # search

    def search_index(self, table: str) -> Q.Index:
        defs = [i for i in self.indexes.values() if i.kind == "search" and i.table == table]
        if not defs:
            raise ValueError(f"{table} has no search index")
        d, t, fields = defs[0], self.table(table), []
        visible = self.rows(table)
        for col in d.columns:
            opt = {k.split(".", 1)[1]: v for k, v in d.options.items() if k.startswith(f"{col}.")}
            if opt.get("type", "text") in ("text", "keyword") and dict(visible.dtypes).get(col) == "string":
                analyzer = "keyword" if opt.get("type") == "keyword" else opt.get("analyzer", "standard")
                fields.append(Q.TextField(col, analyzer, opt.get("search_analyzer"), float(opt.get("boost", 1)), opt.get("copy_to"), opt.get("synonyms", "")))
                if str(opt.get("keyword", "")).lower() in ("true", "1"):
                    fields.append(Q.TextField(col, "keyword", alias=f"{col}.keyword"))
        if t.ttl:  # rows leave with time, so nothing is kept
            return Q.Index(visible, t.pk[0], fields)
        kept = self.built.get(d.name)
        if kept is None or kept[0] is not t.rows or kept[1] != fields:
            ix = Q.Index(visible, t.pk[0], fields).saved(f"{shared_dir(self.spark)}/larkspur/search/{uuid.uuid4().hex}")
            self.built[d.name] = kept = (t.rows, fields, ix)
        return kept[2]

    def do_suggest(self, text: str, index: str, column: str | None, limit: int) -> DataFrame:
        ix = self.search_index(self.indexes[index].table)
        return Q.suggest(ix, column or ix.fields[0].name, text, limit)

    def do_explain_score(self, select: A.Select, pk: Any) -> DataFrame:
        call = next(x for x in A.walk(select.where) if isinstance(x, A.Func) and x.name in A.SEARCH)
        return Q.explain_score(self.search_index(select.table), call.args[0].path, call.args[-1].value, pk)

    # reads

    def select(self, s: A.Select) -> DataFrame:
        return Planner(self, s).plan()

    def promql(self, text: str, start: int, end: int | None = None, step: int = 1, table: str | None = None) -> DataFrame:
        """An instant query at `start`, or a range query; over one time-series table or all of them."""
        parts = None
        for t in [self.table(table)] if table else [t for t in self.tables.values() if t.timeseries]:
            one = P.samples(t.rows, t.series, [c for c in t.rows.columns if c not in (*t.series, "ts")])
            parts = one if parts is None else parts.unionAll(one)
        return P.query_range(parts, text, start, start if end is None else end, step)

    def search(self, table: str, body: dict) -> dict:
        from larkspur.plans.dsl import search

        return search(self, table, body)


def _common_type(types: list) -> Any:
    """The type that a column of VALUES takes, as _union_wide() widens; None if there is none."""
    known = list(dict.fromkeys(t for t in types if not isinstance(t, T.NullType)))
    if len(known) <= 1:
        return known[0] if known else None
    if all(isinstance(t, T.NumericType) for t in known):
        return T.DoubleType() if T.DoubleType() in known else T.LongType()
    return None


def _union_wide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column that one side lacks, or has only as NULL, takes the other's type, and integers widen."""
    types = {}
    for c in dict.fromkeys([*a.columns, *b.columns]):
        ts = [x.schema[c].dataType for x in (a, b) if c in x.columns and not isinstance(x.schema[c].dataType, T.NullType)]
        wide = next((w for w in (T.DoubleType(), T.LongType()) if len(ts) == 2 and ts[0] != ts[1] and (T.DoubleType() in ts) == (w == T.DoubleType())), None)
        types[c] = wide or (ts[0] if ts else T.NullType())
    fit = lambda df: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    return fit(a).unionAll(fit(b))


class Lower:
    """Expressions to Columns, with their types."""

    #: Terms and analyzer of the search that HIGHLIGHT marks.
    highlighted: tuple[list[str], str] = ([], "standard")

    def __init__(self, engine: Engine, df: DataFrame | None, names: dict[str, DataFrame] | None = None, aggregates: dict | None = None):
        self.engine, self.df, self.names, self.aggregates = engine, df, names or {}, aggregates or {}

    def type_of(self, c: Column) -> T.DataType:
        """The type of an expression over self.df (or, within a join's condition, over the tables so far)."""
        df = self.df
        if df is None:
            df = self.engine.spark.range(1)
            for name, t in self.names.items():
                df = df.crossJoin(t.limit(0).alias(name))  # only analysed, never run
        return df.select(c.alias("x")).schema["x"].dataType

    def typed(self, c: Column) -> tuple[Column, T.DataType]:
        return c, self.type_of(c)

    def expr(self, e: Any) -> tuple[Column, T.DataType]:
        if repr(e) in self.aggregates:
            return self.typed(F.col(self.aggregates[repr(e)]))
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def _lit(self, e: A.Lit):
        v = e.value
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return self.typed(F.lit(v))
        return self.typed(F.lit(v).cast("long") if isinstance(v, int) else F.lit(float(v)))

    def _col(self, e: A.Col):
        """A column or path; what is missing reads as NULL."""
        path = e.path.split(".")
        if path[0] in self.names:
            if len(path) > 1 and path[1] in self.names[path[0]].columns:
                return self.nested(F.col(f"`{path[0]}`.`{path[1]}`"), self.names[path[0]].schema[path[1]].dataType, path[2:])
            if path[0] not in (self.df.columns if self.df is not None else []):
                return F.lit(None), T.NullType()
        for name, df in self.names.items():  # the first table that has the name
            if path[0] in df.columns:
                return self.nested(F.col(f"`{name}`.`{path[0]}`"), df.schema[path[0]].dataType, path[1:])
        if self.df is not None and path[0] in self.df.columns:
            return self.nested(F.col(f"`{path[0]}`"), self.df.schema[path[0]].dataType, path[1:])
        return F.lit(None), T.NullType()

    def nested(self, c: Column, t: T.DataType, rest: list[str]):
        for p in rest:
            if isinstance(t, T.StructType) and p in t.fieldNames():
                c, t = c[p], t[p].dataType
            elif isinstance(t, T.MapType):
                c, t = F.try_element_at(c, F.lit(p)), t.valueType
            else:
                return F.lit(None), T.NullType()
        return c, t

    def _arr(self, e: A.Arr):
        return self.typed(F.array(*(self.expr(x)[0] for x in e.items)))

    def _obj(self, e: A.Obj):
        return self.typed(F.struct(*(self.expr(v)[0].alias(k) for k, v in e.items.items())))

    def _un(self, e: A.Un):
        c, t = self.expr(e.arg)
        if e.op == "not":
            return ~c.cast("boolean"), T.BooleanType()
        return S.arithmetic("-", F.lit(0).cast("long"), T.LongType(), c, t), T.LongType() if isinstance(t, S.INTEGRAL) else T.DoubleType()

    def _bin(self, e: A.Bin):
        (a, ta), (b, tb) = self.expr(e.left), self.expr(e.right)
        if e.op in ("and", "or"):
            for t in (ta, tb):
                if not isinstance(t, (T.BooleanType, T.NullType)):
                    raise TypeError("AND and OR take booleans")
            a, b = a.cast("boolean"), b.cast("boolean")
            return (a & b) if e.op == "and" else (a | b), T.BooleanType()
        if e.op in "+-*/":
            return self.typed(S.arithmetic(e.op, a, ta, b, tb))
        return S.compare(e.op, a, ta, b, tb), T.BooleanType()

    def _isnull(self, e: A.IsNull):
        c = self.expr(e.arg)[0]
        return (c.isNotNull() if e.negated else c.isNull()), T.BooleanType()

    def _in(self, e: A.In):
        c, t = self.expr(e.arg)
        items = [self.expr(y) for x in e.items for y in (x.items if isinstance(x, A.Arr) else [x])]
        hit = S.is_in(c, t, items)
        return (~hit if e.negated else hit), T.BooleanType()

    def _between(self, e: A.Between):
        (c, t), (lo, tl), (hi, th) = self.expr(e.arg), self.expr(e.low), self.expr(e.high)
        hit = S.compare(">=", c, t, lo, tl) & S.compare("<=", c, t, hi, th)
        return (~hit if e.negated else hit), T.BooleanType()

    def _like(self, e: A.Like):
        c, t = self.expr(e.arg)
        hit = S.like(c, e.pattern, e.fold) if isinstance(t, T.StringType) else S.null_bool()
        return (~hit if e.negated else hit), T.BooleanType()

    def _cast(self, e: A.Cast):
        kind = {"int": "int", "integer": "int", "bigint": "int", "long": "int", "float": "float", "double": "float", "real": "float", "string": "string", "text": "string", "varchar": "string", "bool": "bool", "boolean": "bool", "timestamp": "timestamp"}[e.to]
        return self._func(A.Func(f"to_{kind}", [e.arg]))

    def _func(self, e: A.Func):
        n = e.name
        if n == "now":
            return self.typed(F.current_timestamp())
        if n in ("score", "rrf_score"):
            return self.typed(F.col("_score" if n == "score" else "_rrf_score"))
        if n == "distance":
            return self.typed(F.lit(S.distance(e.args[0].value)))
        if n == "highlight":
            return self.typed(self.highlight(e))
        args = [self.expr(a) for a in e.args]
        if n == "time_bucket":
            return S.time_bucket(e.args[0].value, *args[1]), args[1][1]
        if n == "coalesce":
            return self.typed(F.coalesce(*(c for c, _ in args)))
        if n.startswith("to_") and hasattr(S, n):
            return self.typed(getattr(S, n)(*args[0]))
        if n in ("geo_distance", "geo_bbox"):
            lat, lon = G.lat_lon(*args[0])
            rest = [float(self.constant(a)) for a in e.args[1:]]
            return self.typed(G.geo_distance(lat, lon, *rest) if n == "geo_distance" else G.geo_bbox(lat, lon, *rest))
        raise ValueError(f"unknown function {n}")

    def constant(self, e: Any) -> Any:
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Un) and e.op == "-":
            return -self.constant(e.arg)
        if isinstance(e, A.Func) and e.name == "distance":
            return S.distance(e.args[0].value)
        raise ValueError("a constant is needed here")


    def highlight(self, e: A.Func) -> Column:
        rest = [self.constant(a) for a in e.args[1:]]
        names = ("size", "pre", "post", "no_match", "count")
        return Q.highlight(self.expr(e.args[0])[0], self.highlighted[0], self.highlighted[1], **dict(zip(names, rest, strict=False)))


class Planner:
    """One SELECT to a DataFrame."""

    def __init__(self, engine: Engine, s: A.Select):
        self.engine, self.s = engine, s
        aliases = {i.alias: i.expr for i in s.items if i.alias}
        self.aliases = aliases

    def plan(self) -> DataFrame:
        s = self.s
        if not s.unions:
            return self.core(s)
        if any(x.table is not None and self.engine.table(x.table).timeseries for x in (s, *(part for _, part in s.unions))):
            raise ValueError("time-series tables are not united")
        out = self.core(s)
        for every, part in s.unions:
            other = Planner(self.engine, part).core(part)
            out = out.unionAll(other) if every else out.unionAll(other).distinct()
        keys = [(e.path, way) for e, way in s.order]
        if keys or s.limit is not None:
            out = R.order_by(out, *keys, limit=s.limit, offset=s.offset)
        return out

    def source(self, s: A.Select) -> tuple[DataFrame, Lower]:
        e = self.engine
        if s.table is None:
            df = e.spark.range(1).select()
            return df, Lower(e, df)
        df = e.rows(s.table)
        if not s.joins:
            return df, Lower(e, df, {s.alias: df})
        if e.table(s.table).timeseries:
            raise ValueError("time-series tables are not joined")
        names = {s.alias: df}
        joined = df.alias(s.alias)
        for j in s.joins:
            other = e.rows(j.table)
            names[j.alias] = other
            right = other.alias(j.alias)
            if j.kind == "cross":
                joined = joined.crossJoin(right)
            else:
                joined = joined.join(right, Lower(e, None, names).expr(j.on)[0], j.kind)
        return joined, Lower(e, joined, names)

    def core(self, s: A.Select) -> DataFrame:
        e = self.engine
        df, low = self.source(s)
        if not s.joins and s.table is not None:
            df = df.alias(s.alias)
            low = Lower(e, df, {s.alias: df})
        df, low = self.filtered(s, df, low)
        has_agg = any(isinstance(x, A.Func) and x.name in A.AGGREGATES for i in s.items for x in A.walk(i.expr)) or (s.having is not None)
        if s.top:
            return self.top(s, df, low)
        if s.group or has_agg:
            return self.grouped(s, df, low)
        return self.projected(s, df, low)

    def filtered(self, s: A.Select, df: DataFrame, low: Lower) -> tuple[DataFrame, Lower]:
        e = self.engine
        search = [x for x in A.conjuncts(s.where) if any(isinstance(y, A.Func) and y.name in A.SEARCH for y in A.walk(x))]
        plain = [x for x in A.conjuncts(s.where) if x not in search]
        pk = e.table(s.table).pk[0] if s.table and e.table(s.table).pk else None
        ix = query = None
        if s.nearest and e.table(s.table).timeseries:
            raise ValueError("NEAREST does not take a time-series table")
        marks = low.highlighted
        if search:
            ix = e.search_index(s.table)
            query = self.query(search[0]) if len(search) == 1 else Q.And([self.query(x) for x in search])
            call = next(x for x in A.walk(search[0]) if isinstance(x, A.Func) and x.name in A.SEARCH)
            name = call.args[0].path if call.args and isinstance(call.args[0], A.Col) else ix.fields[0].name
            marks = (ix.field(name).query_terms(str(call.args[-1].value)) if isinstance(call.args[-1], A.Lit) else [], ix.field(name).analyzer)
        cond = None
        for x in plain:
            c, t = low.expr(x)
            if not isinstance(t, (T.BooleanType, T.NullType)):
                raise TypeError("WHERE takes a boolean")
            cond = c.cast("boolean") if cond is None else cond & c.cast("boolean")
        if s.rrf:
            path, vector, k = s.nearest
            legs_from = df if cond is None else df.where(cond)
            near = V.nearest(legs_from, path, self.vector(vector, df, path), k, pk, self.metric(s.table, path))
            near = near.withColumn("_rank", F.row_number().over(W.orderBy("_distance", pk)))
            hits = query.score(ix).withColumnRenamed("doc", pk).withColumnRenamed("score", "_score")
            text = V.ranked(legs_from.join(hits, pk), F.col("_score").desc(), pk, k)
            fused = V.rrf([near, text], pk, 2 * k, s.rrf)
            df = df.join(fused, pk)
        else:
            if query is not None:
                hits = query.score(ix).withColumnRenamed("doc", "_doc").withColumnRenamed("score", "_score")
                df = df.join(hits, df[pk] == hits["_doc"]).drop("_doc")
            if cond is not None:
                df = df.where(cond)
            if s.nearest:
                path, vector, k = s.nearest
                df = V.nearest(df, path, self.vector(vector, df, path), k, pk, self.metric(s.table, path))
        if s.rerank:
            r = s.rerank
            by = F.col("_rrf_score").desc() if s.rrf else F.col("_score").desc() if query is not None else F.col("_distance").asc()
            call = next((x for x in A.walk(s.where) if isinstance(x, A.Func) and x.name in A.SEARCH), None)
            column = r["on"] or (call.args[0].path if call else None)
            score = V.overlap if e.reranker is None else e.reranker
            df = V.rerank(df, by, pk, column, r["query"] or (call.args[-1].value if call else ""), r["top"], r["top"], score)
        out = Lower(e, df, {s.alias: df.alias(s.alias)} if not s.joins and s.alias and not (s.rrf or s.rerank or query is not None or s.nearest) else (low.names if s.joins else None))
        out.highlighted = marks
        return df, out

    def metric(self, table: str, path: str) -> str:
        """That of the column's vector index; cosine without one."""
        mine = (i for i in self.engine.indexes.values() if i.kind == "vector" and i.table == table and path in i.columns)
        return next((i.options.get("metric", "cosine") for i in mine), "cosine")

    def vector(self, v: Any, df: DataFrame, path: str) -> list[float]:
        if isinstance(v, str):
            dim = len(df.select(path).first()[0])
            return V.hash_embed(v, dim) if self.engine.embedder is None else self.engine.embedder(v)
        return [float(x) for x in v]

    def query(self, x: Any) -> Q.Query:
        if isinstance(x, A.Bin) and x.op in ("and", "or"):
            return (Q.And if x.op == "and" else Q.Or)([self.query(x.left), self.query(x.right)])
        if isinstance(x, A.Un) and x.op == "not":
            return Q.Not(self.query(x.arg))
        if not isinstance(x, A.Func) or x.name not in A.SEARCH:
            raise ValueError("search and ordinary predicates mix under AND only")
        cols = [a.path for a in x.args if isinstance(a, A.Col)]
        lits = [a.value for a in x.args if isinstance(a, A.Lit)]
        return {
            "match": lambda: Q.Match(cols, lits[0]), "match_best": lambda: Q.Match(cols, lits[0]), "match_cross": lambda: Q.MatchCross(cols, lits[0]),
            "match_phrase": lambda: Q.MatchPhrase(cols[0], lits[0], *lits[1:]), "match_prefix": lambda: Q.prefix(cols[0], lits[0]), "wildcard": lambda: Q.wildcard(cols[0], lits[0]),
            "regexp": lambda: Q.regexp(cols[0], lits[0]), "fuzzy": lambda: Q.fuzzy(cols[0], *lits), "more_like_this": lambda: Q.MoreLikeThis(cols[0], lits[0]),
            "search": lambda: Q.query_string(lits[0]), "boosted": lambda: Q.Boosted(self.query(x.args[0]), [self.query(a) for a in x.args[1:]]),
        }[x.name]()

    def label(self, i: A.Item) -> str:
        if i.alias:
            return i.alias
        if isinstance(i.expr, A.Col):
            return i.expr.path
        return i.expr.name if isinstance(i.expr, A.Func) else "expr"

    def items(self, s: A.Select, df: DataFrame, low: Lower) -> list[Column]:
        out = []
        for i in s.items:
            if isinstance(i.expr, A.Col) and i.expr.path == "*":
                seen: set[str] = set()
                for name, t in (low.names or {None: df}).items():
                    for c in t.columns:
                        if not c.startswith("_") and c not in seen:
                            seen.add(c)
                            out.append(F.col(f"`{name}`.`{c}`" if name and s.joins else f"`{c}`"))
            else:
                out.append(low.expr(i.expr)[0].alias(self.label(i)))
        return out

    def resolved(self, e: Any) -> Any:
        """A bare alias stands for its expression."""
        return self.aliases[e.path] if isinstance(e, A.Col) and e.path in self.aliases else e

    def keys(self, s: A.Select, low: Lower) -> list[Column]:
        out = []
        for e, way in s.order:
            c = low.expr(self.resolved(e))[0]
            out.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_first())
        return out

    def projected(self, s: A.Select, df: DataFrame, low: Lower) -> DataFrame:
        pk = self.engine.table(s.table).pk if s.table and not s.joins else ()
        if s.distinct:
            out = df.select(*self.items(s, df, low)).distinct()
            if s.order or s.limit is not None:
                out = R.order_by(out, *((self.label(A.Item(e, None)), way) for e, way in s.order), limit=s.limit, offset=s.offset)
            return out
        if s.after and s.order:
            e, way = s.order[0]
            c, p = low.expr(self.resolved(e))[0], F.col(pk[0])
            beyond = c > F.lit(s.after[0]) if way == "asc" else c < F.lit(s.after[0])
            df = df.where(beyond | ((c == F.lit(s.after[0])) & (p > F.lit(s.after[1]))))
        if not s.unions:
            keys = self.keys(s, low)
            if not keys and "_rerank" in df.columns:
                keys = [F.col("_rerank").desc(), F.col("_rank").asc()]
            elif not keys and "_rrf_score" in df.columns:
                keys = [F.col("_rrf_score").desc()]
            elif not keys and "_distance" in df.columns:
                keys = [F.col("_distance").asc()]
            if keys:
                df = df.orderBy(*keys, *(F.col(f"`{p}`").asc() for p in pk))
            if s.offset:
                df = df.offset(s.offset)
            if s.limit is not None:
                df = df.limit(s.limit)
        return df.select(*self.items(s, df, low))

    def aggregate(self, f: A.Func, low: Lower, s: A.Select) -> Column:
        star = not f.args or (isinstance(f.args[0], A.Col) and f.args[0].path == "*")
        c = None if star else low.expr(f.args[0])[0]
        if f.name == "count":
            return F.count(F.lit(1)) if star else F.count_distinct(c) if f.distinct else F.count(c)
        if f.name == "percentile":
            return R.percentile(c, low.constant(f.args[1]))
        if f.name in ("first", "last"):
            at = F.when(c.isNotNull(), F.col("ts"))
            return F.min_by(c, at) if f.name == "first" else F.max_by(c, at)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "approx_count_distinct": F.approx_count_distinct}[f.name](c)

    def grouped(self, s: A.Select, df: DataFrame, low: Lower) -> DataFrame:
        groups = [self.resolved(g) for g in s.group]
        group_cols = [low.expr(g)[0].alias(f"_g{k}") for k, g in enumerate(groups)]
        calls: dict[str, A.Func] = {}
        for e in [i.expr for i in s.items] + [s.having] + [self.resolved(o) for o, _ in s.order]:
            for x in A.walk(e):
                if isinstance(x, A.Func) and x.name in A.AGGREGATES:
                    calls.setdefault(repr(x), x)
        for a in self.aliases.values():
            for x in A.walk(a):
                if isinstance(x, A.Func) and x.name in A.AGGREGATES:
                    calls.setdefault(repr(x), x)
        named = {k: f"_a{i}" for i, k in enumerate(calls)}
        plain = {k: x for k, x in calls.items() if x.name not in ("rate", "increase", "delta")}
        loose = {}  # columns outside of aggregates: any value of the group
        for e in [i.expr for i in s.items]:
            if repr(e) not in map(repr, groups) and not any(isinstance(x, A.Func) and x.name in A.AGGREGATES for x in A.walk(e)) and not isinstance(e, A.Lit):
                loose[repr(e)] = e
        made = [self.aggregate(x, low, s).alias(named[k]) for k, x in plain.items()]
        made += [F.any_value(low.expr(e)[0]).alias(f"_l{i}") for i, e in enumerate(loose.values())]
        out = df.groupBy(*group_cols).agg(*(made or [F.count(F.lit(1)).alias("_n")]))
        for k, x in calls.items():
            if k in plain:
                continue
            t = self.engine.table(s.table)
            rows = df.select(*group_cols, *(F.col(f"`{c}`") for c in dict.fromkeys([*t.series, "ts"])), low.expr(x.args[0])[0].alias("_f"))
            names = [f"_g{i}" for i in range(len(groups))]
            part = TS.rates(rows, t.series, names, "_f").select(*names, F.col(x.name).alias(named[k]))
            out = out.join(part, names, "left") if names else out.crossJoin(part)
        known = {repr(g): f"_g{k}" for k, g in enumerate(groups)} | named | {k: f"_l{i}" for i, k in enumerate(loose)}
        after = Lower(self.engine, out, None, known)
        if s.having is not None:
            out = out.where(after.expr(self.substituted(s.having))[0].cast("boolean"))
        if not s.unions:
            keys = []
            for e, way in s.order:
                c = after.expr(self.resolved(e))[0]
                keys.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_first())
            if keys:
                out = out.orderBy(*keys)
            if s.offset:
                out = out.offset(s.offset)
            if s.limit is not None:
                out = out.limit(s.limit)
        items = [after.expr(i.expr)[0].alias(self.label(i)) for i in s.items]
        out = out.select(*items)
        return out.distinct() if s.distinct else out

    def substituted(self, e: Any) -> Any:
        """Aliases anywhere in an expression."""
        if isinstance(e, A.Col):
            return self.resolved(e)
        if hasattr(e, "__dict__"):
            return type(e)(**{k: self.substituted(v) if hasattr(v, "__dict__") else [self.substituted(x) if hasattr(x, "__dict__") else x for x in v] if isinstance(v, list) else v for k, v in vars(e).items()})
        return e

    def top(self, s: A.Select, df: DataFrame, low: Lower) -> DataFrame:
        k, e, way = s.top
        if any(isinstance(x, A.Func) and x.name in A.AGGREGATES for i in s.items for x in A.walk(i.expr)):
            raise ValueError("TOP k BY returns rows, not aggregates")
        pk = self.engine.table(s.table).pk
        df = df.withColumns({f"_g{i}": low.expr(self.resolved(g))[0] for i, g in enumerate(s.group)} | {"_by": low.expr(e)[0]})
        names = [f"_g{i}" for i in range(len(s.group))]
        if s.having is not None:
            kept = self.grouped(A.Select([A.Item(g, f"_g{i}") for i, g in enumerate(s.group)], s.table, s.alias, group=s.group, having=s.having), df, low)
            on = F.lit(True)
            for n in names:
                on = on & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
            df = df.alias("x").join(kept.alias("y"), on, "left_semi")
        out = R.top_k_per_group(df, names, "_by", k, way, pk)
        marks, low = low.highlighted, Lower(self.engine, out)
        low.highlighted = marks
        if s.order:
            out = out.orderBy(*self.keys(s, low), *(F.col(p).asc() for p in pk))
        if s.limit is not None:
            out = out.limit(s.limit)
        return out.select(*self.items(s, out, low))

